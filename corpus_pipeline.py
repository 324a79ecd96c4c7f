"""Corpus pipeline: STAGES over ``documents``, each a (name, function) that calls one operator of
``hubrisk.llm``. A function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet in the shared folder and rereads it as the next one's ``docs``. All stages but the
last return the columns of ``documents``.

Defined results: a null text fails the quality rules; rows with a null id pass the join and the
decontamination; rows repeated in id and text are reduced to one by the join; extra columns pass
through to packing; an empty table gives no sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hubrisk.llm import decontaminate as D
from hubrisk.llm import jaccard_join as J
from hubrisk.llm import packing as P
from hubrisk.llm import quality_rules as Q
from hubrisk.llm import secrets as S
from hubrisk.llm.common import cut, need, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return Q.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (one row of it)."""
    return J.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark leaks."""
    return D.decontaminate(docs, need(table(spark, sf_dir, "benchmark"), "item_id", "text"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark (their ``n_chars`` follows)."""
    return S.redact(docs, S.secret_scan(need(docs, "doc_id", "text")), length="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed training sequences."""
    return P.pack(need(docs, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", without_secrets),
    ("packing", packed),
]

#: Automata and packing have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
