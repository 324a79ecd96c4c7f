"""Recommendations: avoid list, swaps, dashboard feed, forecast screen, seasonal summary,
objective coverage (R1-R4, D35, D36, E2, E3, C12, C13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubrisk.functions.exprs import pair_hi, pair_lo, region_pattern, season_of, severity_band
from hubrisk.params import AVOID_DEFAULT_REASON, AVOID_REASONS, Params


def avoid_list(scores: DataFrame, p: Params, cascade_prop: DataFrame | None = None) -> DataFrame:
    """Pair-months with risk >= threshold, labelled by season with ordered reasons and the
    cascade cost of high-cost cascades (> threshold) on the canonical key; one row per
    (season, pair): its highest-risk month."""
    flagged = scores.where(F.col("risk_score") >= p.avoid_threshold).withColumn("season", season_of("month", p.seasons))
    if cascade_prop is not None:
        hi = cascade_prop.where(F.col("cascade_cost") > p.cascade_cost_threshold).select(
            F.col("airport_a").alias("_lo"), F.col("airport_b").alias("_hi"), "month", "cascade_cost")
        flagged = (flagged.withColumns({"_lo": pair_lo("airport_a", "airport_b"), "_hi": pair_hi("airport_a", "airport_b")})
                   .join(hi, ["_lo", "_hi", "month"], "left"))
    else:
        flagged = flagged.withColumn("cascade_cost", F.lit(None).cast("double"))
    parts = [F.when(F.coalesce(F.col(c) > t, F.lit(False)), F.lit(text)) for c, t, text in AVOID_REASONS]
    reason = F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), F.lit(AVOID_DEFAULT_REASON))
    w = Window.partitionBy("season", "airport_a", "airport_b").orderBy(F.desc("risk_score"), "month")
    return (flagged.select("season", "month", "airport_a", "airport_b", "risk_score", reason.alias("reason"),
                           F.coalesce("cascade_cost", F.lit(0.0)).alias("cascade_cost"))
            .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
            .orderBy("season", F.desc("risk_score"), "airport_a", "airport_b"))


def _candidates(scores: DataFrame, p: Params, active: DataFrame | None) -> DataFrame:
    """Per (month, origin): the two lowest-risk partners under the swap threshold. Two suffice
    because a swap excludes exactly one destination (the avoided one)."""
    both = (scores.select("month", F.col("airport_a").alias("origin"), F.col("airport_b").alias("other"), "risk_score")
            .unionByName(scores.select("month", F.col("airport_b").alias("origin"), F.col("airport_a").alias("other"),
                                       "risk_score"))
            .where(F.col("risk_score") < p.swap_threshold))
    if active is not None:
        both = both.join(active.select(F.col("airport").alias("other")).distinct(), "other", "left_semi")
    w = Window.partitionBy("month", "origin").orderBy("risk_score", "other")
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")


def _best_swap(rows: DataFrame, cands: DataFrame, origin: str, avoided: str, how: str) -> DataFrame:
    c = cands.select("month", F.col("origin").alias(origin), F.col("other").alias("_other"),
                     F.col("risk_score").alias("_swap_risk"), "_rn")
    j = rows.join(c, ["month", origin], "left").where(F.col("_other").isNull() | (F.col("_other") != F.col(avoided)))
    keys = [c for c in rows.columns]
    best = j.groupBy(*keys).agg(F.min_by(F.struct("_other", "_swap_risk"), F.col("_rn")).alias("_b"))
    out = rows.join(best.select(*keys, "_b"), keys, how)
    return out.withColumns({"swap_dest": F.col("_b._other"), "swap_risk": F.col("_b._swap_risk")}).drop("_b")


def swap_recommendations(scores: DataFrame, avoid: DataFrame, flights: DataFrame, p: Params) -> DataFrame:
    """For each avoided (A, B, month): the lowest-risk destination C != B served from the hub,
    paired with A under the swap threshold; rows without such C are dropped."""
    active = flights.where(F.col("Origin") == p.hub).select(F.col("Dest").alias("airport"))
    rows = avoid.select("season", "month", F.col("airport_a").alias("avoid_origin"),
                        F.col("airport_b").alias("avoid_dest"), F.col("risk_score").alias("avoid_risk"))
    out = _best_swap(rows, _candidates(scores, p, active), "avoid_origin", "avoid_dest", "inner")
    return (out.where(F.col("swap_dest").isNotNull())
            .select("season", "avoid_origin", "avoid_dest", "avoid_risk", "swap_dest", "swap_risk",
                    (F.col("avoid_risk") - F.col("swap_risk")).alias("risk_reduction"))
            .orderBy(F.desc("risk_reduction"), "season", "avoid_origin", "avoid_dest"))


def risk_feed(scores: DataFrame, airports: DataFrame, p: Params, top_n: int = 5) -> DataFrame:
    """Per month: the top-n pairs with band, city names and a swap for A (none filtered by service)."""
    w = Window.partitionBy("month").orderBy(F.desc("risk_score"), "airport_a", "airport_b")
    top = (scores.select("month", "airport_a", "airport_b", "risk_score")
           .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n))
    out = _best_swap(top, _candidates(scores, p, None), "airport_a", "airport_b", "left")
    city = airports.select("iata", "city")
    out = (out.join(city.select(F.col("iata").alias("airport_a"), F.col("city").alias("city_a")), "airport_a", "left")
           .join(city.select(F.col("iata").alias("airport_b"), F.col("city").alias("city_b")), "airport_b", "left"))
    return out.select("month", "rank", "airport_a", "airport_b", "risk_score",
                      severity_band("risk_score", p.critical_threshold, p.avoid_threshold).alias("band"),
                      F.coalesce("city_a", "airport_a").alias("city_a"), F.coalesce("city_b", "airport_b").alias("city_b"),
                      "swap_dest", "swap_risk")


def forecast_screen(scores: DataFrame, advisory: DataFrame, p: Params) -> DataFrame:
    """Pairs at or above the avoid threshold in the advisory's month with either end under advisory."""
    risky = scores.where(F.col("risk_score") >= p.avoid_threshold).select("airport_a", "airport_b", "month", "risk_score")
    ends = (risky.withColumn("advisory_airport", F.explode(F.array("airport_a", "airport_b"))))
    adv = advisory.select(F.col("airport").alias("advisory_airport"), "month").distinct()
    return ends.join(adv, ["advisory_airport", "month"], "inner")


def seasonal_summary(scores: DataFrame, airports: DataFrame, p: Params, top_n: int = 10) -> DataFrame:
    """Per season: top-n pairs by mean risk with max risk, peak month and region pattern."""
    g = (scores.withColumn("season", season_of("month", p.seasons))
         .groupBy("season", "airport_a", "airport_b").agg(
             F.avg("risk_score").alias("avg_risk"), F.max("risk_score").alias("max_risk"),
             F.max_by("month", F.struct(F.col("risk_score"), -F.col("month"))).alias("peak_month")))
    w = Window.partitionBy("season").orderBy(F.desc("avg_risk"), "airport_a", "airport_b")
    top = g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    reg = airports.select("iata", "region")
    top = (top.join(reg.select(F.col("iata").alias("airport_a"), F.col("region").alias("ra")), "airport_a", "left")
           .join(reg.select(F.col("iata").alias("airport_b"), F.col("region").alias("rb")), "airport_b", "left"))
    return top.select("season", "rank", "airport_a", "airport_b", "avg_risk", "max_risk", "peak_month",
                      region_pattern("ra", "rb").alias("geographic_pattern")).orderBy("season", "rank")


OBJECTIVES = (
    ("delay_propagation", "joint_weather_delay_prob", 0.05),
    ("duty_violations", "duty_violation_risk", 0.8),
    ("missed_connections", "missed_connection_prob", 0.5),
    ("fatigue_risk", "fatigue_exposure", 0.0),
)


def objective_coverage(scores: DataFrame, avoid: DataFrame) -> DataFrame:
    """Per objective: distinct risky pairs, how many are on the avoid list, coverage %."""
    av = avoid.select("airport_a", "airport_b").distinct().withColumn("_cov", F.lit(True))
    j = scores.join(av, ["airport_a", "airport_b"], "left")
    pair = F.struct("airport_a", "airport_b")
    aggs = []
    for name, col, t in OBJECTIVES:
        risky = F.col(col) > t
        aggs += [F.count_distinct(F.when(risky, pair)).alias(f"t_{name}"),
                 F.count_distinct(F.when(risky & F.col("_cov").isNotNull(), pair)).alias(f"c_{name}")]
    row = j.agg(*aggs)
    structs = [F.struct(F.lit(n).alias("objective"), F.col(f"t_{n}").alias("total_risky"),
                        F.col(f"c_{n}").alias("in_avoid_list")) for n, _, _ in OBJECTIVES]
    out = row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
    return out.withColumn("coverage", F.col("in_avoid_list") / F.greatest(F.col("total_risky"), F.lit(1)) * 100)
