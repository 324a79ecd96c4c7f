"""Retrospective impact and naive baseline.

Top-K membership for all K is one pass: the score table is reduced to its top max(K)
rows (TakeOrderedAndProject), each pair keeps its best position, and events are flagged
at every K by comparing that position with K. The position table has at most max(K)
rows, a proven bound, so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hubrisk.functions.exprs import pair_hi, pair_lo
from hubrisk.operators.common import one_row
from hubrisk.operators.flights import airport_month_stats
from hubrisk.params import Params

KEY = ("airport_a", "airport_b", "month")


def top_k_positions(scores: DataFrame, score_col: str, k_max: int) -> DataFrame:
    """Top k_max rows by score (ties by pair and month) with 1-based position."""
    order = [F.desc(score_col), *KEY]
    top = scores.orderBy(*order).limit(k_max)
    return (top.withColumn("pos", F.row_number().over(Window.orderBy(*order)))
            .select(pair_lo("airport_a", "airport_b").alias("pair_a"), pair_hi("airport_a", "airport_b").alias("pair_b"),
                    "month", "pos", score_col))


def _per_k_rows(agg: DataFrame, ks, fields: dict) -> DataFrame:
    """One row per K from one aggregate row holding per-K columns named f'{field}_{k}'."""
    structs = [F.struct(F.lit(k).alias("k"), *[F.col(f"{f}_{k}").alias(f) for f in fields]) for k in ks]
    keep = [c for c in agg.columns if not any(c == f"{f}_{k}" for f in fields for k in ks)]
    return agg.select(*keep, F.explode(F.array(*structs)).alias("_r")).select(*keep, "_r.*")


def impact_by_k(cascading: DataFrame, scores: DataFrame, p: Params) -> DataFrame:
    """Events / minutes of airport-day cascades whose canonical pair is among the top-K pair-months
    (month ignored when flagging)."""
    ks = sorted(p.top_k)
    best = (top_k_positions(scores, "risk_score", max(ks)).groupBy("pair_a", "pair_b")
            .agg(F.min("pos").alias("best_pos")))
    c = cascading.join(F.broadcast(best), ["pair_a", "pair_b"], "left")
    aggs = [F.count(F.lit(1)).alias("total_cascade_events"), F.sum("cascade_minutes").alias("total_cascade_minutes")]
    for k in ks:
        hit = F.col("best_pos") <= k
        aggs += [F.count_if(hit).alias(f"prevented_events_{k}"),
                 F.coalesce(F.sum(F.when(hit, F.col("cascade_minutes"))), F.lit(0.0)).alias(f"prevented_minutes_{k}")]
    rows = _per_k_rows(c.agg(*aggs), ks, {"prevented_events": 0, "prevented_minutes": 0})
    return rows.select(
        "k", "total_cascade_events", "prevented_events",
        (F.col("prevented_events") / F.greatest(F.col("total_cascade_events"), F.lit(1)) * 100).alias("pct_events_prevented"),
        F.coalesce(F.col("total_cascade_minutes"), F.lit(0.0)).alias("total_cascade_minutes"), "prevented_minutes",
        (F.col("prevented_minutes") / F.greatest(F.coalesce(F.col("total_cascade_minutes"), F.lit(0.0)), F.lit(1.0)) * 100)
        .alias("pct_minutes_prevented"),
        (F.col("prevented_minutes") * p.cost_per_minute).alias("dollar_savings"))


def impact_by_month(cascading: DataFrame, scores: DataFrame, p: Params) -> DataFrame:
    """Per (K, month 1..12): events, prevented events / minutes and savings (zeros filled)."""
    ks = sorted(p.top_k)
    best = (top_k_positions(scores, "risk_score", max(ks)).groupBy("pair_a", "pair_b")
            .agg(F.min("pos").alias("best_pos")))
    c = cascading.join(F.broadcast(best), ["pair_a", "pair_b"], "left")
    aggs = [F.count(F.lit(1)).alias("total_events")]
    for k in ks:
        hit = F.col("best_pos") <= k
        aggs += [F.count_if(hit).alias(f"prevented_events_{k}"),
                 F.coalesce(F.sum(F.when(hit, F.col("cascade_minutes"))), F.lit(0.0)).alias(f"prevented_minutes_{k}")]
    by_month = _per_k_rows(c.groupBy("month").agg(*aggs), ks, {"prevented_events": 0, "prevented_minutes": 0})
    spark = SparkSession.getActiveSession()
    spine = (spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
             .withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))))
    out = spine.join(by_month, ["month", "k"], "left")
    return out.select("k", "month", F.coalesce("total_events", F.lit(0)).alias("total_events"),
                      F.coalesce("prevented_events", F.lit(0)).alias("prevented_events"),
                      F.coalesce("prevented_minutes", F.lit(0.0)).alias("prevented_minutes"),
                      (F.coalesce("prevented_minutes", F.lit(0.0)) * p.cost_per_minute).alias("dollar_savings"))


def impact_adjusted(flights: DataFrame, cascading: DataFrame, by_k: DataFrame, p: Params) -> DataFrame:
    """Assignment-probability scaling (mean daily flights / 2 over possible pairs) and annualisation."""
    daily = flights.groupBy("FlightDate").agg(F.count(F.lit(1)).alias("n"))
    airports = (cascading.select(F.col("airport_in").alias("a"))
                .unionByName(cascading.select(F.col("airport_out").alias("a"))).distinct())
    avg_daily = F.lit(one_row(daily, (F.avg("n") / 2).alias("v"))["v"]).cast("double")
    n_ap = F.lit(float(one_row(airports, F.count(F.lit(1)).alias("v"))["v"]))
    years = F.lit(one_row(flights, F.count_distinct("Year").alias("v"))["v"]).cast("long")
    prob = avg_daily / F.greatest(n_ap * (n_ap - 1) / 2, F.lit(1.0))
    return by_k.select(
        "k", "dollar_savings", "prevented_events", prob.alias("assignment_prob"),
        (F.col("dollar_savings") * prob).alias("adjusted_savings"),
        (F.col("prevented_events") * prob).alias("adjusted_prevented_events"),
        (F.col("dollar_savings") / F.greatest(years, F.lit(1))).alias("annual_savings_upper"),
        (F.col("dollar_savings") * prob / F.greatest(years, F.lit(1))).alias("annual_savings_adjusted"))


def top_cascading_pairs(cascading: DataFrame) -> DataFrame:
    return (cascading.groupBy("pair_a", "pair_b")
            .agg(F.count(F.lit(1)).alias("total_events"), F.sum("cascade_minutes").alias("total_delay_minutes"),
                 F.avg("cascade_minutes").alias("avg_delay")))


def actual_pair_month(cascading: DataFrame) -> DataFrame:
    """Actual cascades per canonical pair-month; minutes = summed outbound departure delay."""
    return (cascading.groupBy("pair_a", "pair_b", "month")
            .agg(F.count(F.lit(1)).alias("actual_events"), F.sum("outbound_delay").alias("actual_minutes")))


def naive_scores(scores: DataFrame, flights: DataFrame, p: Params) -> DataFrame:
    """Naive score = product of the two airports' monthly weather-delay rates (missing -> 0);
    the per-month median rate is kept as a column."""
    rates = airport_month_stats(flights, p).select("airport", F.col("Month").alias("month"), "weather_delay_rate")
    med = rates.groupBy("month").agg(F.median("weather_delay_rate").alias("month_median_rate"))
    a = rates.select(F.col("airport").alias("airport_a"), "month", F.col("weather_delay_rate").alias("a_rate"))
    b = rates.select(F.col("airport").alias("airport_b"), "month", F.col("weather_delay_rate").alias("b_rate"))
    j = (scores.select(*KEY).join(a, ["airport_a", "month"], "left").join(b, ["airport_b", "month"], "left")
         .join(med, "month", "left").fillna(0.0, ["a_rate", "b_rate"]))
    return j.select(*KEY, "a_rate", "b_rate", (F.col("a_rate") * F.col("b_rate")).alias("naive_score"),
                    "month_median_rate")


def baseline_comparison(actual: DataFrame, scores: DataFrame, naive: DataFrame, p: Params) -> DataFrame:
    """Pair-months and minutes caught at each K by the model ranking vs the naive ranking."""
    ks = sorted(p.top_k)
    ours = top_k_positions(scores, "risk_score", max(ks)).select("pair_a", "pair_b", "month", F.col("pos").alias("our_pos"))
    nv = top_k_positions(naive, "naive_score", max(ks)).select("pair_a", "pair_b", "month", F.col("pos").alias("naive_pos"))
    key = ["pair_a", "pair_b", "month"]
    j = actual.join(F.broadcast(ours), key, "left").join(F.broadcast(nv), key, "left")
    aggs = [F.coalesce(F.sum("actual_minutes"), F.lit(0.0)).alias("total_minutes")]
    for k in ks:
        for who in ("our", "naive"):
            hit = F.col(f"{who}_pos") <= k
            aggs += [F.count_if(hit).alias(f"{who}_events_caught_{k}"),
                     F.coalesce(F.sum(F.when(hit, F.col("actual_minutes"))), F.lit(0.0)).alias(f"{who}_minutes_caught_{k}")]
    fields = {f"{w}_{m}": 0 for w in ("our", "naive") for m in ("events_caught", "minutes_caught")}
    rows = _per_k_rows(j.agg(*aggs), ks, fields)
    tot = F.greatest(F.col("total_minutes"), F.lit(1.0))
    return rows.select(
        "k", "our_events_caught", "naive_events_caught", "our_minutes_caught", "naive_minutes_caught", "total_minutes",
        (F.col("our_minutes_caught") / tot * 100).alias("our_pct"),
        (F.col("naive_minutes_caught") / tot * 100).alias("naive_pct"),
        ((F.col("our_minutes_caught") - F.col("naive_minutes_caught"))
         / F.greatest(F.col("naive_minutes_caught"), F.lit(1.0)) * 100).alias("improvement_pct"))


def ranking_overlap(scores: DataFrame, naive: DataFrame, k: int = 500) -> DataFrame:
    """Distinct canonical pairs (month dropped) in both top-k lists, only the model's, only the naive one's."""
    ours = top_k_positions(scores, "risk_score", k).select("pair_a", "pair_b", F.lit(1).alias("m"), F.lit(0).alias("n"))
    nv = top_k_positions(naive, "naive_score", k).select("pair_a", "pair_b", F.lit(0).alias("m"), F.lit(1).alias("n"))
    flags = ours.unionByName(nv).groupBy("pair_a", "pair_b").agg(F.max("m").alias("m"), F.max("n").alias("n"))
    return flags.agg(F.count_if((F.col("m") == 1) & (F.col("n") == 1)).alias("in_both"),
                     F.count_if((F.col("m") == 1) & (F.col("n") == 0)).alias("only_model"),
                     F.count_if((F.col("m") == 0) & (F.col("n") == 1)).alias("only_naive"))
