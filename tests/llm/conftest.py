import pytest

from llm_helpers import ROWS, SCHEMA, SF


@pytest.fixture(scope="session")
def odd(spark):
    """Edge-case documents; the extra columns ``n`` and ``key`` clash with names inside the operators."""
    return spark.createDataFrame([(i, t, 1, k) for i, t, _, k in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
