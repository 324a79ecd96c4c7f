import random

from pyspark.sql import functions as F

from hubrisk.operators import impact as IM
from hubrisk.operators import ml as ML
from hubrisk.operators import recommend as RC

SCORE_COLS = ("airport_a string, airport_b string, month int, risk_score double, joint_weather_delay_prob double, "
              "missed_connection_prob double, duty_violation_risk double, fatigue_exposure double, "
              "thunderstorm_co_occurrence double")


def test_avoid_reasons_default_and_dedupe(spark, params):
    s = spark.createDataFrame([("A", "B", 6, 70.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("A", "B", 7, 90.0, 0.1, 0.0, 0.0, 0.5, 0.0),
                               ("A", "C", 6, 50.0, 0.0, 0.0, 0.0, 0.0, 0.0)], SCORE_COLS)
    rows = RC.avoid_list(s, params).collect()
    assert len(rows) == 1 and rows[0].month == 7
    assert rows[0].reason == "correlated weather delays; fatigue / WOCL exposure"
    one = spark.createDataFrame([("A", "B", 6, 70.0, 0.0, 0.0, 0.0, 0.0, 0.0)], SCORE_COLS)
    assert RC.avoid_list(one, params).first().reason == "elevated composite risk"


def test_swap_absent_when_no_partner_but_feed_keeps_row(spark, params):
    s = spark.createDataFrame([("A", "B", 6, 70.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("A", "C", 6, 40.0, 0.0, 0.0, 0.0, 0.0, 0.0)],
                              SCORE_COLS)
    fl = spark.createDataFrame([("HUB", "B"), ("HUB", "C")], "Origin string, Dest string")
    avoid = RC.avoid_list(s, params)
    assert RC.swap_recommendations(s, avoid, fl, params).count() == 0
    air = spark.createDataFrame([("A", "Alpha")], "iata string, city string")
    feed = {(r.airport_a, r.airport_b): r for r in RC.risk_feed(s, air, params).collect()}
    assert feed[("A", "B")].swap_dest is None and feed[("A", "B")].city_a == "Alpha"


def test_swap_skips_the_avoided_destination(spark, params):
    s = spark.createDataFrame([("A", "B", 6, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("A", "C", 6, 80.0, 0.0, 0.0, 0.0, 0.0, 0.0),
                               ("D", "A", 6, 20.0, 0.0, 0.0, 0.0, 0.0, 0.0)], SCORE_COLS)
    fl = spark.createDataFrame([("HUB", x) for x in "BCD"], "Origin string, Dest string")
    avoid = RC.avoid_list(s, params)
    rows = RC.swap_recommendations(s, avoid, fl, params).collect()
    assert [(r.avoid_dest, r.swap_dest, r.risk_reduction) for r in rows] == [("C", "B", 70.0)]


def test_topk_larger_than_table_flags_everything(spark, params):
    s = spark.createDataFrame([(f"A{i}", f"B{i}", 1, float(i)) for i in range(30)],
                              "airport_a string, airport_b string, month int, risk_score double")
    cad = spark.createDataFrame([(f"A{i}", f"B{i}", 1, 2.0) for i in range(30)],
                                "pair_a string, pair_b string, month int, cascade_minutes double")
    rows = {r.k: r for r in IM.impact_by_k(cad, s, params).collect()}
    assert rows[500].prevented_events == 30 and rows[50].pct_events_prevented == 100.0


def test_auc_single_class_is_zero(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.7)], "label int, score double")
    assert ML.auc_roc(df).first().auc_roc == 0.0


def test_auc_and_ap_match_brute_force(spark):
    rnd = random.Random(11)
    data = [(rnd.randint(0, 1), rnd.choice([0.1, 0.2, 0.35, 0.5, 0.8, 0.9, 1.3, -0.2])) for _ in range(300)]
    df = spark.createDataFrame(data, "label int, score double")
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(ML.auc_roc(df).first().auc_roc - auc) < 1e-12
    ap, P = 0.0, len(pos)
    for t in sorted({s for _, s in data}, reverse=True):
        tp = sum(1 for y, s in data if y == 1 and s >= t)
        fp = sum(1 for y, s in data if y == 0 and s >= t)
        ap += sum(1 for y, s in data if y == 1 and s == t) / P * tp / (tp + fp)
    assert abs(ML.average_precision(df).first().average_precision - ap) < 1e-12
    assert ML.roc_curve(df).where(F.col("threshold") == -0.2).first().tpr == 1.0


def test_confusion_and_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, predicted int")
    cm = {(r.label, r.predicted): r.n for r in ML.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 1}
    rep = {r["class"]: r for r in ML.classification_report(df).collect()}
    assert rep["1"].precision == 1.0 and rep["1"].recall == 0.5 and rep["accuracy"].f1_score == 0.75
