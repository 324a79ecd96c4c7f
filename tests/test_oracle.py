"""Driver-style check: registered Spark queries vs their DuckDB oracle SQL on sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = os.environ.get("HUBRISK_TEST_SF", "/root/testdata/sf0.001")
FAST_KEYS = ["weather_daily", "metar_daily", "airport_month_stats", "sequences", "cascade_events",
             "cascade_airport_days", "greedy_assignment", "pair_features", "risk_scores", "avoid_list",
             "swap_recommendations", "impact_by_k", "cascade_impact_by_day", "worst_cascade_day", "worst_cascade_summary", "baseline_comparison", "auc_roc", "average_precision"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def _norm(rows):
    def n(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6) + 0.0
        return v.isoformat() if hasattr(v, "isoformat") else v
    return sorted((tuple(n(x) for x in r) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "cascade_cost" in df.columns


def test_every_oracle_key_is_registered():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", FAST_KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    cols = df.columns
    srows = df.collect()
    cur = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    order = sorted(cols)
    a = _norm([tuple(r[cols.index(c)] for c in order) for r in srows])
    b = _norm([tuple(r[ocols.index(c)] for c in order) for r in orows])
    assert a == b
