"""Report and dashboard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubrisk.functions.exprs import pair_hi, pair_lo, season_of, severity_band
from hubrisk.operators.common import one_row
from hubrisk.params import SHORT_SEASONS, Params


def pair_explorer(scores: DataFrame, airport_a: str | None = None, airport_b: str | None = None) -> DataFrame:
    """Per unordered pair (or the one asked for, either direction): mean / peak risk, peak month,
    mean joint weather-delay probability, months present."""
    s = scores
    if airport_a is not None and airport_b is not None:
        s = s.where(((F.col("airport_a") == airport_a) & (F.col("airport_b") == airport_b))
                    | ((F.col("airport_a") == airport_b) & (F.col("airport_b") == airport_a)))
    return (s.groupBy(pair_lo("airport_a", "airport_b").alias("pair_a"), pair_hi("airport_a", "airport_b").alias("pair_b"))
            .agg(F.avg("risk_score").alias("avg_risk"), F.max("risk_score").alias("peak_risk"),
                 F.max_by("month", F.struct(F.col("risk_score"), -F.col("month"))).alias("peak_month"),
                 F.avg("joint_weather_delay_prob").alias("avg_joint_weather_delay_prob"),
                 F.count(F.lit(1)).alias("n_months")))


def month_top_pairs(scores: DataFrame, n: int = 10, min_overlap: int = 0, month: int | None = None) -> DataFrame:
    """Per month (or one month): the n highest-risk pairs with at least min_overlap days."""
    s = scores.where(F.col("n_overlap_days") >= min_overlap)
    if month is not None:
        s = s.where(F.col("month") == month)
    w = Window.partitionBy("month").orderBy(F.desc("risk_score"), "airport_a", "airport_b")
    return (s.select("month", "airport_a", "airport_b", "risk_score", "n_overlap_days")
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))


def risk_bands(scores: DataFrame, p: Params) -> DataFrame:
    """Per month and severity band (CRIT >= 80, HIGH >= 65, else MOD): pair-month counts."""
    return (scores.withColumn("band", severity_band("risk_score", p.critical_threshold, p.avoid_threshold))
            .groupBy("month", "band").agg(F.count(F.lit(1)).alias("n_pairs")))


def route_segments(scores: DataFrame, airports: DataFrame, p: Params, k: int = 200) -> DataFrame:
    """Per month the top-k pairs with both ends' coordinates and the hub's (unknown airports dropped)."""
    w = Window.partitionBy("month").orderBy(F.desc("risk_score"), "airport_a", "airport_b")
    top = scores.select("month", "airport_a", "airport_b", "risk_score").withColumn("rank", F.row_number().over(w)) \
        .where(F.col("rank") <= k)
    co = airports.select("iata", "latitude", "longitude")
    hub = co.where(F.col("iata") == p.hub).select(F.col("latitude").alias("hub_lat"), F.col("longitude").alias("hub_lon"))
    out = (top.join(co.select(F.col("iata").alias("airport_a"), F.col("latitude").alias("lat_a"),
                              F.col("longitude").alias("lon_a")), "airport_a")
           .join(co.select(F.col("iata").alias("airport_b"), F.col("latitude").alias("lat_b"),
                           F.col("longitude").alias("lon_b")), "airport_b"))
    h = one_row(hub, F.max("hub_lat").alias("lat"), F.max("hub_lon").alias("lon"))
    hub_lat, hub_lon = F.lit(h["lat"]).cast("double"), F.lit(h["lon"]).cast("double")
    band = severity_band("risk_score", p.critical_threshold, p.avoid_threshold)
    return out.select("month", "rank", "airport_a", "airport_b", "risk_score", "lat_a", "lon_a", "lat_b", "lon_b",
                      hub_lat.alias("hub_lat"), hub_lon.alias("hub_lon"), band.alias("band"),
                      F.when(band == "CRIT", 2.5).when(band == "HIGH", 1.8).otherwise(1.2).alias("line_width"))


def risk_heatmap(scores: DataFrame, n: int = 15) -> DataFrame:
    """Top-n pairs by mean risk x months 1..12 (mean risk per month)."""
    top = (scores.groupBy("airport_a", "airport_b").agg(F.avg("risk_score").alias("mean_risk"))
           .orderBy(F.desc("mean_risk"), "airport_a", "airport_b").limit(n))
    sel = scores.join(top.select("airport_a", "airport_b"), ["airport_a", "airport_b"], "left_semi")
    piv = sel.groupBy("airport_a", "airport_b").pivot("month", list(range(1, 13))).agg(F.avg("risk_score"))
    return piv.select("airport_a", "airport_b", *[F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)])


def season_distribution(scores: DataFrame, seasons: dict | None = None) -> DataFrame:
    """Box-plot numbers (min, q1, median, q3, max) of risk per season."""
    q = F.percentile("risk_score", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    g = scores.withColumn("season", season_of("month", seasons or SHORT_SEASONS)).groupBy("season").agg(q.alias("q"))
    names = ("risk_min", "risk_q1", "risk_median", "risk_q3", "risk_max")
    return g.select("season", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def savings_tiers(by_month: DataFrame, k: int | None = None) -> DataFrame:
    """Monthly savings at K (default: the largest K) tiered by the 0.7 / 0.4 quantiles."""
    kk = k if k is not None else one_row(by_month, F.max("k").alias("k"))["k"]
    m = by_month.where(F.col("k") == kk)
    q = one_row(m, F.percentile("dollar_savings", 0.7).alias("q7"), F.percentile("dollar_savings", 0.4).alias("q4"))
    q7, q4 = F.lit(q["q7"]).cast("double"), F.lit(q["q4"]).cast("double")
    return m.select("k", "month", "dollar_savings",
                    F.when(F.col("dollar_savings") > q7, "high").when(F.col("dollar_savings") > q4, "mid")
                    .otherwise("low").alias("tier"))


def kpi_summary(scores: DataFrame, adjusted: DataFrame, avoid: DataFrame, swaps: DataFrame, p: Params,
                k: int = 200) -> DataFrame:
    """Per month: critical pairs, avoid-list size; with annual savings at K and mean swap reduction."""
    crit = scores.groupBy("month").agg(F.count_if(F.col("risk_score") >= p.critical_threshold).alias("critical_pairs"))
    av = avoid.groupBy("month").agg(F.count(F.lit(1)).alias("avoid_count"))
    a = adjusted.where(F.col("k") == k)
    sv = one_row(a, F.max("annual_savings_upper").alias("u"), F.max("annual_savings_adjusted").alias("a"))
    upper, adj = F.lit(sv["u"]).cast("double"), F.lit(sv["a"]).cast("double")
    red = F.lit(one_row(swaps, F.avg("risk_reduction").alias("r"))["r"]).cast("double")
    return (crit.join(av, "month", "left")
            .select("month", "critical_pairs", F.coalesce("avoid_count", F.lit(0)).alias("avoid_count"),
                    upper.alias("annual_savings_upper"), adj.alias("annual_savings_adjusted"),
                    red.alias("avg_swap_reduction")))


def airport_degree(scores: DataFrame, p: Params) -> DataFrame:
    """Per month and airport: number of pairs at or above the avoid threshold, clamped 6..20 for markers."""
    risky = scores.where(F.col("risk_score") >= p.avoid_threshold)
    g = (risky.select("month", F.explode(F.array("airport_a", "airport_b")).alias("airport"))
         .groupBy("month", "airport").agg(F.count(F.lit(1)).alias("n_pairs")))
    return g.withColumn("marker_size", F.least(F.greatest(F.col("n_pairs"), F.lit(6)), F.lit(20)))


def top_pairs(scores: DataFrame, k: int = 20) -> DataFrame:
    return (scores.select("airport_a", "airport_b", "month", "risk_score", "risk_rank")
            .orderBy(F.desc("risk_score"), "airport_a", "airport_b", "month").limit(k))


def top_pairs_by_max(scores: DataFrame, n: int = 15) -> DataFrame:
    return (scores.groupBy("airport_a", "airport_b")
            .agg(F.max("risk_score").alias("max_risk"), F.avg("risk_score").alias("mean_risk"))
            .orderBy(F.desc("max_risk"), "airport_a", "airport_b").limit(n))


def airport_universe(scores: DataFrame) -> DataFrame:
    return (scores.select(F.col("airport_a").alias("airport"))
            .unionByName(scores.select(F.col("airport_b").alias("airport"))).distinct())
