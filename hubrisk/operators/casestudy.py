"""Day case studies for any set of dates (D30-D34, C11, C15 consumers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubrisk.functions.exprs import pair_hi, pair_lo
from hubrisk.operators.impact import top_k_positions
from hubrisk.operators.sequences import greedy_assignment
from hubrisk.params import Params


def worst_day(flights: DataFrame, p: Params) -> DataFrame:
    """The date with the most weather-delayed inbound flights (ties: earliest)."""
    return (flights.where((F.col("Dest") == p.hub) & (F.col("WeatherDelay") > 0))
            .groupBy(F.col("FlightDate").alias("date")).agg(F.count(F.lit(1)).alias("wx_inbound"))
            .orderBy(F.desc("wx_inbound"), "date").limit(1))


def cascade_impact_by_day(flights: DataFrame, p: Params) -> DataFrame:
    """Per day with a cascade: one-to-one matched cascades over all flights, their propagated and total minutes.
    The matching runs on all days at once; its minutes are summed before anything is ranked."""
    propagated = F.greatest(F.lit(0.0), F.col("inbound_arr_delay") - F.col("turnaround_gap"))
    return (greedy_assignment(flights, p).groupBy("date")
            .agg(F.count(F.lit(1)).alias("cascades"), F.sum(propagated).alias("propagated_delay"),
                 F.sum(propagated + F.col("outbound_dep_delay")).alias("total_cascade_minutes")))


def worst_cascade_day(flights: DataFrame, p: Params) -> DataFrame:
    """The date whose matched cascades cost the most minutes (ties: earliest)."""
    return cascade_impact_by_day(flights, p).orderBy(F.desc_nulls_last("total_cascade_minutes"), "date").limit(1)


def risk_lookup(scores: DataFrame) -> DataFrame:
    return scores.select(pair_lo("airport_a", "airport_b").alias("_lo"), pair_hi("airport_a", "airport_b").alias("_hi"),
                         "month", "risk_score")


def case_cascades(flights: DataFrame, scores: DataFrame, p: Params, days: DataFrame) -> DataFrame:
    """Greedy-matched cascades of the given days with propagated minutes and the pair's risk (default 0)."""
    g = greedy_assignment(flights, p, days)
    propagated = F.greatest(F.lit(0.0), F.col("inbound_arr_delay") - F.col("turnaround_gap"))
    g = g.withColumns({"propagated_delay": propagated,
                       "total_cascade_minutes": propagated + F.col("outbound_dep_delay"),
                       "_lo": pair_lo("origin", "dest"), "_hi": pair_hi("origin", "dest")})
    j = g.join(risk_lookup(scores), ["_lo", "_hi", "month"], "left")
    return j.select("date", "origin", "dest", "inbound_weather_delay", "inbound_arr_delay", "turnaround_gap",
                    "propagated_delay", "outbound_dep_delay", "total_cascade_minutes",
                    F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"), "inbound_arr_time", "outbound_dep_time")


def k_thresholds(scores: DataFrame, p: Params) -> DataFrame:
    """Per K: the lowest risk score inside the top-K pair-months (the flagging cut-off)."""
    top = top_k_positions(scores, "risk_score", max(p.top_k))
    return top.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("pos") <= k).alias("inside"))
                                            for k in sorted(p.top_k)])).alias("x"), "risk_score") \
        .where("x.inside").groupBy(F.col("x.k").alias("k")).agg(F.min("risk_score").alias("threshold"))


def case_study_summary(flights: DataFrame, scores: DataFrame, cascades: DataFrame, p: Params,
                       days: DataFrame) -> DataFrame:
    """Per (day, K): traffic, weather-delayed inbound, delayed outbound, cascades, and what top-K would flag."""
    d = flights.join(days.select(F.col("date").alias("FlightDate")).distinct(), "FlightDate", "left_semi")
    inbound, outbound = F.col("Dest") == p.hub, F.col("Origin") == p.hub
    wx = inbound & (F.col("WeatherDelay") > 0)
    late = outbound & (F.col("DepDelay") > p.delay_threshold)
    traffic = d.groupBy(F.col("FlightDate").alias("date")).agg(
        F.count(F.lit(1)).alias("total_flights"), F.count_if(inbound).alias("inbound_flights"),
        F.count_if(outbound).alias("outbound_flights"), F.count_if(wx).alias("wx_inbound"),
        F.coalesce(F.sum(F.when(wx, F.col("WeatherDelay"))), F.lit(0.0)).alias("wx_delay_total"),
        F.avg(F.when(wx, F.col("WeatherDelay"))).alias("wx_delay_mean"),
        F.count_if(late).alias("delayed_outbound"),
        F.coalesce(F.sum(F.when(late, F.col("DepDelay"))), F.lit(0.0)).alias("dep_delay_total"))
    cas = (cascades.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sorted(p.top_k)])))
           .join(F.broadcast(k_thresholds(scores, p)), "k").where(F.col("risk_score") >= F.col("threshold")))
    per_k = (cascades.groupBy("date").agg(
        F.count(F.lit(1)).alias("cascading_sequences"),
        F.count_if(F.col("propagated_delay") > 0).alias("propagated_sequences"),
        F.sum("total_cascade_minutes").alias("total_cascade_minutes")))
    flagged = cas.groupBy("date", "k").agg(
        F.count(F.lit(1)).alias("flagged_sequences"), F.sum("total_cascade_minutes").alias("flagged_minutes"))
    ks = traffic.select("date").withColumn("k", F.explode(F.array(*[F.lit(k) for k in sorted(p.top_k)])))
    out = ks.join(traffic, "date").join(per_k, "date", "left").join(flagged, ["date", "k"], "left")
    tot = F.coalesce(F.col("total_cascade_minutes"), F.lit(0.0))
    fm = F.coalesce(F.col("flagged_minutes"), F.lit(0.0))
    return out.select(
        "date", "k", "total_flights", "inbound_flights", "outbound_flights", "wx_inbound",
        (F.try_divide(F.col("wx_inbound").cast("double"), F.col("inbound_flights").cast("double")) * 100).alias("wx_inbound_pct"),
        "wx_delay_total", "wx_delay_mean", "delayed_outbound",
        (F.try_divide(F.col("delayed_outbound").cast("double"), F.col("outbound_flights").cast("double")) * 100)
        .alias("delayed_outbound_pct"),
        "dep_delay_total", F.coalesce("cascading_sequences", F.lit(0)).alias("cascading_sequences"),
        F.coalesce("propagated_sequences", F.lit(0)).alias("propagated_sequences"),
        tot.alias("total_cascade_minutes"), (tot * p.cost_per_minute).alias("total_cost"),
        F.coalesce("flagged_sequences", F.lit(0)).alias("flagged_sequences"), fm.alias("flagged_minutes"),
        (fm / F.greatest(tot, F.lit(1.0)) * 100).alias("flagged_pct"),
        (fm * p.cost_per_minute).alias("flagged_savings"))


def case_pair_summary(cascades: DataFrame, p: Params) -> DataFrame:
    """Per (day, origin, dest): sequences, total / mean cascade minutes, mean risk, FLAGGED / MISSED."""
    g = cascades.groupBy("date", "origin", "dest").agg(
        F.count(F.lit(1)).alias("n_sequences"), F.sum("total_cascade_minutes").alias("total_cascade"),
        F.avg("total_cascade_minutes").alias("avg_cascade"), F.avg("risk_score").alias("risk_score"))
    return g.withColumn("status", F.when(F.col("risk_score") >= p.avoid_threshold, "FLAGGED").otherwise("MISSED"))


def hourly_timeline(cascades: DataFrame, days: DataFrame, first_hour: int = 6, last_hour: int = 21) -> DataFrame:
    """Per day and inbound arrival hour (zero-filled first..last hour): cascades, minutes, and
    whether the hour is among the two worst of the day."""
    hourly = (cascades.withColumn("hour", F.floor(F.col("inbound_arr_time") / 60).cast("int"))
              .groupBy("date", "hour").agg(F.count(F.lit(1)).alias("n_cascades"),
                                           F.sum("total_cascade_minutes").alias("total_delay")))
    spine = days.select("date").distinct().withColumn("hour", F.explode(F.sequence(F.lit(first_hour), F.lit(last_hour))))
    t = (spine.join(hourly, ["date", "hour"], "left")
         .fillna({"n_cascades": 0, "total_delay": 0.0}))
    w = Window.partitionBy("date").orderBy(F.desc("total_delay"), "hour")
    t = t.withColumn("_rn", F.row_number().over(w))
    second = F.max(F.when(F.col("_rn") == 2, F.col("total_delay"))).over(Window.partitionBy("date"))
    return t.withColumn("is_peak", F.col("total_delay") >= F.coalesce(second, F.col("total_delay"))).drop("_rn")
