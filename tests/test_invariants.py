"""SURVEY section 5 invariants over the registered queries on sf0.001."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = os.environ.get("HUBRISK_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def q(spark):
    qs = E.queries()
    return lambda key: qs[key](spark, SF)


def test_risk_score_range_and_rank_one(q):
    r = q("risk_scores").agg(F.min("risk_score"), F.max("risk_score"),
                             F.min(F.when(F.col("risk_rank") == 1, F.col("risk_score")))).first()
    assert r[0] >= 0 and r[1] <= 100 and r[2] == 100.0


def test_avoid_and_swap_thresholds(q):
    assert q("avoid_list").where("risk_score < 65").count() == 0
    sw = q("swap_recommendations")
    assert sw.where("swap_risk >= 30 OR swap_dest = avoid_dest").count() == 0
    assert sw.where("abs(risk_reduction - (avoid_risk - swap_risk)) > 1e-5").count() == 0


def test_greedy_uses_each_outbound_once_with_turnaround(q):
    g = q("greedy_assignment")
    assert g.groupBy("out_flight_id").count().where("count > 1").count() == 0
    assert g.groupBy("in_flight_id").count().where("count > 1").count() == 0
    assert g.where("turnaround_gap < 60").count() == 0


def test_prevented_never_exceeds_total_and_grows_with_k(q):
    rows = sorted(q("impact_by_k").collect(), key=lambda r: r.k)
    assert all(r.prevented_events <= r.total_cascade_events for r in rows)
    assert all(a.prevented_events <= b.prevented_events for a, b in zip(rows, rows[1:]))


def test_curves_monotone(q):
    roc = q("roc_curve").orderBy(F.desc("threshold")).collect()
    assert all(a.fpr <= b.fpr and a.tpr <= b.tpr for a, b in zip(roc, roc[1:]))
    pr = q("pr_curve").orderBy(F.desc("threshold")).collect()
    assert all(a.recall <= b.recall for a, b in zip(pr, pr[1:]))


def test_season_top_ten_and_canonical_keys(q):
    assert q("seasonal_summary").groupBy("season").count().where("count > 10").count() == 0
    assert q("cascade_events").where("pair_a >= pair_b").count() == 0
    assert q("cascade_airport_days").where("pair_a >= pair_b").count() == 0


def test_sequences_gap_and_distinct_ends(q):
    assert q("sequences").where("connection_minutes < 60 OR airport_a = airport_b").count() == 0


def test_stream_matches_batch(q):
    cols = ["date", "pair_a", "pair_b", "in_flight_id", "out_flight_id", "total_cascade_minutes"]
    assert sorted(map(tuple, q("stream_cascade").select(cols).collect())) == \
        sorted(map(tuple, q("cascade_events").select(cols).collect()))
