"""Airport-pair features per month.

Pairs are those of all spokes (or the Params.top_airports busiest); a pair (a, b)
has a = the busier airport. Days that two airports share come from bitmaps: one per airport
and year-month, joined to the pair-months and counted as ``bit_count(a & b)``, without a row
per pair and day. Correlations come from one self-join of an airport-day table on date (at most
N rows per date, so the join is bounded by N^2 per day and has no hot key) followed by one
partial+final hash aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubrisk.functions.exprs import (cyclic_cos, cyclic_sin, haversine_miles, hhmm_to_minutes,
                                     spoke_airport)
from hubrisk.operators.flights import (airport_day_delay, airport_month_stats, flight_dates,
                                       inbound_delay_dist, schedule_profile)
from hubrisk.params import Params

STAT_COLS = ("flight_count", "weather_delay_rate", "weather_delay_mean", "weather_delay_p90",
             "avg_delay", "delay_rate_15", "delay_std", "cancellation_rate", "late_aircraft_rate")


def ranked_spokes(flights: DataFrame, p: Params) -> DataFrame:
    """Spokes by flight count (ties by code) with rank rk = 1..n; with ``top_airports`` the first N only."""
    top = (flights.groupBy(spoke_airport(p.hub).alias("airport")).agg(F.count(F.lit(1)).alias("n_flights"))
           .orderBy(F.desc("n_flights"), "airport"))
    if p.top_airports is not None:
        top = top.limit(p.top_airports)
    # the windows run over one row per airport
    return (top.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("n_flights"), "airport")))
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy())))


def ranked_by_code(airports: DataFrame, col: str = "airport") -> DataFrame:
    """Distinct airports ranked alphabetically (rk = 1..n), for all-pairs keys."""
    d = airports.select(F.col(col).alias("airport")).distinct()
    return (d.withColumn("rk", F.dense_rank().over(Window.orderBy("airport")))
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy())))


def enumerate_pairs(ranked: DataFrame) -> DataFrame:
    """All (a, b) with rk_a < rk_b, generated by exploding rank ranges up to the count n
    and an equi-join on rank (no cross join)."""
    a = (ranked.where(F.col("rk") < F.col("n"))
         .select(F.col("airport").alias("airport_a"), F.col("rk").alias("rk_a"),
                 F.explode(F.sequence(F.col("rk") + 1, F.col("n"))).alias("rk_b")))
    b = ranked.select(F.col("airport").alias("airport_b"), F.col("rk").alias("rk_b"))
    return a.join(b, "rk_b").select("airport_a", "airport_b", "rk_a", "rk_b")


def month_date_counts(dates: DataFrame) -> DataFrame:
    return dates.groupBy("month").agg(F.count(F.lit(1)).alias("n_dates"))


def pair_spine(flights: DataFrame, p: Params) -> DataFrame:
    """Pairs of top-N spokes x calendar months having >= min_month_dates flight dates."""
    pairs = enumerate_pairs(ranked_spokes(flights, p))
    months = month_date_counts(flight_dates(flights)).where(F.col("n_dates") >= p.min_month_dates)
    return (pairs.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
            .join(months.select("month", F.col("n_dates").alias("n_overlap_days")), "month")
            .select("airport_a", "airport_b", "month", "rk_a", "rk_b", "n_overlap_days"))


def _pair_self_join(fact: DataFrame, value_cols: list[str]) -> DataFrame:
    """fact(airport, rk, date, month, values...) joined to itself on date with rk_a < rk_b."""
    a = fact.select(F.col("airport").alias("airport_a"), F.col("rk").alias("rk_a"), "date", "month",
                    *[F.col(c).alias(f"{c}_a") for c in value_cols])
    b = fact.select(F.col("airport").alias("airport_b"), F.col("rk").alias("rk_b"), "date",
                    *[F.col(c).alias(f"{c}_b") for c in value_cols])
    return a.join(b, "date").where(F.col("rk_a") < F.col("rk_b"))


def day_bitmaps(days: DataFrame, flags: list[Column]) -> DataFrame:
    """Per (airport, calendar month) of ``days`` (airport, date, ...): a map from year to one bitmap per flag, whose
    bit d - 1 tells whether the flag holds on day d. Bits are set within tasks before rows meet."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.dayofmonth("date") - 1)
    by_year = days.where(F.col("date").isNotNull()).groupBy("airport", F.month("date").alias("month"), F.year("date").alias("year")).agg(
        F.array(*[F.coalesce(F.bit_or(F.when(f, bit)), F.lit(0).cast("long")) for f in flags]).alias("bits"))
    return by_year.groupBy("airport", "month").agg(F.map_from_entries(F.collect_list(F.struct("year", "bits"))).alias("_bits"))


def _with_bitmaps(pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Pair-months with both airports' bitmaps (``_bits_a``, ``_bits_b``); the bitmaps are a row per airport-month."""
    def side(s: str) -> DataFrame:
        return bitmaps.select(F.col("airport").alias(f"airport_{s}"), "month", F.col("_bits").alias(f"_bits_{s}"))
    return pairs.join(side("a"), ["airport_a", "month"], "left").join(side("b"), ["airport_b", "month"], "left")


def _days(flag: int, other: str | None = None) -> Column:
    """Days of the month, over all years, with a flag at airport a (and, with ``other``, at b too)."""
    def bits(e: Column) -> Column:
        own = F.get(e["value"], flag)
        return own if other is None else own.bitwiseAND(F.coalesce(F.get(F.try_element_at(F.col(other), e["key"]), flag), F.lit(0).cast("long")))
    n = F.aggregate(F.map_entries("_bits_a"), F.lit(0).cast("long"), lambda s, e: s + F.bit_count(bits(e)))
    return F.coalesce(n, F.lit(0).cast("long"))


def with_joint_delay(spine: DataFrame, flights: DataFrame, p: Params) -> DataFrame:
    """``spine`` with joint / conditional delay probabilities. The denominator is the number of flight dates in
    the calendar month (any airport); missing airport-days count as no delay."""
    legs = flights.select(spoke_airport(p.hub).alias("airport"), F.col("FlightDate").alias("date"), "WeatherDelay", "DepDelay")
    bitmaps = day_bitmaps(legs, [F.col("WeatherDelay") > 0, F.col("DepDelay") > p.delay_threshold])
    counts = _with_bitmaps(spine, bitmaps).withColumns({"_both_wx": _days(0, "_bits_b"), "_both_d15": _days(1, "_bits_b"), "_a_wx": _days(0)})
    return counts.withColumns({
        "joint_weather_delay_prob": F.col("_both_wx") / F.col("n_overlap_days"),
        "joint_delay_15_prob": F.col("_both_d15") / F.col("n_overlap_days"),
        "conditional_delay_prob": F.when(F.col("_a_wx") > 0, F.col("_both_wx") / F.col("_a_wx")).otherwise(F.lit(0.0)),
    }).drop("_bits_a", "_bits_b", "_both_wx", "_both_d15", "_a_wx")


def pair_joint_delay(flights: DataFrame, p: Params, spine: DataFrame | None = None) -> DataFrame:
    """Joint / conditional delay probabilities per pair-month."""
    spine = spine if spine is not None else pair_spine(flights, p)
    return with_joint_delay(spine, flights, p).select(
        "airport_a", "airport_b", "month", "n_overlap_days", "joint_weather_delay_prob", "joint_delay_15_prob", "conditional_delay_prob")


def _pearson(x: str, y: str, min_days: int):
    """Pearson correlation over rows where both are non-NULL; 0 unless > min_days rows, 0 when undefined."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = F.when(both, F.col(x)), F.when(both, F.col(y))
    r = F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))
    return F.when(F.count_if(both) > min_days, F.coalesce(r, F.lit(0.0))).otherwise(F.lit(0.0)), F.count_if(both)


def weather_corr(daily: DataFrame, dates: DataFrame, ranked: DataFrame, p: Params) -> DataFrame:
    """Pearson correlation of daily precipitation and of daily max gust per pair-month, over
    flight dates on which both airports have weather rows."""
    fact = (daily.join(dates.select("date", "month"), "date", "inner").join(ranked.select("airport", "rk"), "airport")
            .select("airport", "rk", "date", "month", "precip_total", "wind_gusts_max"))
    j = _pair_self_join(fact, ["precip_total", "wind_gusts_max"])
    pc, n_p = _pearson("precip_total_a", "precip_total_b", p.min_corr_days)
    wc, _ = _pearson("wind_gusts_max_a", "wind_gusts_max_b", p.min_corr_days)
    return j.groupBy("airport_a", "airport_b", "month").agg(
        pc.alias("precip_correlation"), wc.alias("wind_correlation"), n_p.alias("n_common_days"))


def pair_weather_corr(daily: DataFrame, dates: DataFrame, ranked: DataFrame, spine: DataFrame,
                      p: Params) -> DataFrame:
    """The correlations of ``weather_corr`` per pair-month of ``spine``; 0 without common days."""
    agg = weather_corr(daily, dates, ranked, p)
    return (spine.select("airport_a", "airport_b", "month").join(agg, ["airport_a", "airport_b", "month"], "left")
            .fillna({"precip_correlation": 0.0, "wind_correlation": 0.0, "n_common_days": 0}))


def with_cooccurrence(pairs: DataFrame, daily: DataFrame, values: dict[str, str], date_spine: DataFrame) -> DataFrame:
    """Pair-months with the share of days with value > 0 at both airports, per named output.
    Denominator: spine dates of the month that also appear in ``daily`` (any airport);
    an empty denominator or an airport without rows gives 0."""
    days = date_spine.select("date", "month").distinct().join(daily.select("date").distinct(), "date")
    bitmaps = day_bitmaps(daily.join(days.select("date"), "date", "left_semi"), [F.col(src) > 0 for src in values.values()])
    counts = _with_bitmaps(pairs, bitmaps).join(month_date_counts(days).withColumnRenamed("n_dates", "_n_dates"), "month", "left")
    shares = {name: F.coalesce(F.try_divide(_days(k, "_bits_b").cast("double"), F.col("_n_dates").cast("double")), F.lit(0.0))
              for k, name in enumerate(values)}
    return counts.withColumns(shares).drop("_bits_a", "_bits_b", "_n_dates")


def pair_cooccurrence(daily: DataFrame, values: dict[str, str], date_spine: DataFrame, spine: DataFrame) -> DataFrame:
    """The shares of ``with_cooccurrence`` alone, per pair-month of ``spine``."""
    return with_cooccurrence(spine.select("airport_a", "airport_b", "month"), daily, values, date_spine).select(
        "airport_a", "airport_b", "month", *values)


def pair_operational_risk(flights: DataFrame, pairs: DataFrame, p: Params) -> DataFrame:
    """Turnaround, missed-connection probability, buffer, duty-time and fatigue risk for a -> hub -> b."""
    dist = inbound_delay_dist(flights, p).withColumn("_has_dist", F.lit(True))
    prof = schedule_profile(flights, p)
    a_in = prof.where(F.col("direction") == "inbound").select(
        F.col("airport").alias("airport_a"), F.col("avg_airtime").alias("a_airtime_raw"),
        F.col("median_crs_time").alias("a_arr_hhmm"), F.lit(True).alias("_has_a_in"))
    b_out = prof.where(F.col("direction") == "outbound").select(
        F.col("airport").alias("airport_b"), F.col("avg_airtime").alias("b_airtime_raw"),
        F.col("median_crs_time").alias("b_dep_hhmm"), F.lit(True).alias("_has_b_out"))
    j = (pairs.select("airport_a", "airport_b")
         .join(dist.withColumnRenamed("airport", "airport_a"), "airport_a", "left")
         .join(a_in, "airport_a", "left").join(b_out, "airport_b", "left"))
    arr = hhmm_to_minutes(F.coalesce(F.col("a_arr_hhmm"), F.lit(p.default_arr_hhmm)))
    dep = hhmm_to_minutes(F.coalesce(F.col("b_dep_hhmm"), F.lit(p.default_dep_hhmm)))
    raw_turn = dep - arr
    turn = F.when(raw_turn < 0, raw_turn + 1440).otherwise(raw_turn)
    p90 = F.when(F.col("_has_dist").isNull(), F.lit(p.default_p90)).otherwise(F.col("delay_p90"))
    med = F.when(F.col("_has_dist").isNull(), F.lit(0.0)).otherwise(F.col("delay_median"))

    def airtime(raw: str, present: str):
        return (F.when(F.col(present).isNull(), F.lit(p.default_airtime))
                .when(F.col(raw) == 0, F.lit(p.default_airtime)).otherwise(F.col(raw)))

    j = j.select("airport_a", "airport_b", arr.alias("_arr"), dep.alias("_dep"), turn.alias("turnaround_minutes"),
                 p90.alias("_p90"), med.alias("_med"), airtime("a_airtime_raw", "_has_a_in").alias("_a_air"),
                 airtime("b_airtime_raw", "_has_b_out").alias("_b_air"))
    t = F.col("turnaround_minutes")
    missed = F.when(F.col("_p90") > t, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.col("_p90") / F.greatest(t, F.lit(1))))
    buffer = F.when(F.col("_p90").isNull(), F.lit(None).cast("double")).otherwise(
        t / F.greatest(F.when(F.col("_p90") == 0, F.lit(p.default_p90)).otherwise(F.col("_p90")), F.lit(1.0)))
    duty_h = (F.col("_a_air") + t + F.col("_b_air") + F.col("_med")) / 60
    duty = F.greatest(F.lit(0.0), duty_h / p.duty_limit_hours)
    in_wocl = lambda m: F.when((m / 60.0 >= p.wocl_start_hour) & (m / 60.0 <= p.wocl_end_hour), 1).otherwise(0)
    fatigue = (in_wocl(F.col("_arr")) + in_wocl(F.col("_dep"))) / 2.0
    return j.select("airport_a", "airport_b", "turnaround_minutes", missed.alias("missed_connection_prob"),
                    buffer.alias("buffer_adequacy"), duty.alias("duty_violation_risk"),
                    fatigue.alias("fatigue_exposure"))


def pair_geography(pairs: DataFrame, airports: DataFrame) -> DataFrame:
    """Distance and coordinate differences (NULL if unknown), same region (NULL-safe), corridors."""
    def side(s: str) -> DataFrame:
        return airports.select(F.col("iata").alias(f"airport_{s}"), F.col("latitude").alias(f"lat_{s}"),
                               F.col("longitude").alias(f"lon_{s}"), F.col("region").alias(f"region_{s}"),
                               F.col("in_tornado").alias(f"tor_{s}"), F.col("in_gulf").alias(f"gulf_{s}"),
                               F.col("in_winter").alias(f"win_{s}"))
    j = pairs.select("airport_a", "airport_b").join(side("a"), "airport_a", "left").join(side("b"), "airport_b", "left")
    both = lambda x, y: F.coalesce(F.col(x) & F.col(y), F.lit(False)).cast("int")
    return j.select(
        "airport_a", "airport_b",
        haversine_miles("lat_a", "lon_a", "lat_b", "lon_b").alias("distance_ab"),
        F.abs(F.col("lat_a") - F.col("lat_b")).alias("latitude_diff"),
        F.abs(F.col("lon_a") - F.col("lon_b")).alias("longitude_diff"),
        F.col("region_a").eqNullSafe(F.col("region_b")).cast("int").alias("same_region"),
        both("tor_a", "tor_b").alias("tornado_alley_pair"),
        both("gulf_a", "gulf_b").alias("hurricane_pair"),
        both("win_a", "win_b").alias("winter_storm_pair"))


def pair_stats_join(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Pair-months with both airports' monthly delay statistics (suffix _a / _b)."""
    def side(s: str) -> DataFrame:
        return stats.select(F.col("airport").alias(f"airport_{s}"), F.col("Month").alias("month"),
                            *[F.col(c).alias(f"{c}_{s}") for c in STAT_COLS])
    return (pairs.join(side("a"), ["airport_a", "month"], "left")
            .join(side("b"), ["airport_b", "month"], "left"))


PAIR_FEATURE_ORDER = (
    "airport_a", "airport_b", "month", "joint_weather_delay_prob", "joint_delay_15_prob",
    "conditional_delay_prob", "precip_correlation", "wind_correlation", "thunderstorm_co_occurrence",
    "severe_weather_co_occurrence", "distance_ab", "latitude_diff", "longitude_diff", "same_region",
    "tornado_alley_pair", "hurricane_pair", "winter_storm_pair", "month_sin", "month_cos",
    "n_overlap_days", "ifr_co_occurrence", "metar_thunderstorm_co", "metar_low_vis_co",
    "missed_connection_prob", "buffer_adequacy", "duty_violation_risk", "fatigue_exposure",
    "turnaround_minutes",
)


def pair_features(flights: DataFrame, daily: DataFrame, airports: DataFrame, p: Params,
                  metar_day: DataFrame | None = None) -> DataFrame:
    """The full pair-month feature table (D17). With ``metar_day`` the IFR / thunderstorm /
    low-visibility co-occurrences come from METAR; otherwise IFR falls back to the
    model-weather proxy and the METAR-only features are 0."""
    spine = pair_spine(flights, p)
    ranked = ranked_spokes(flights, p).select("airport", "rk")
    dates = flight_dates(flights)
    pairs = enumerate_pairs(ranked_spokes(flights, p)).select("airport_a", "airport_b")
    # The spine is computed once; each branch adds its columns to it.
    f = with_joint_delay(spine, flights, p)
    storms = {"thunderstorm_co_occurrence": "thunderstorm_hours", "severe_weather_co_occurrence": "severe_weather_hours"}
    if metar_day is not None:
        f = with_cooccurrence(with_cooccurrence(f, daily, storms, dates), metar_day, {
            "ifr_co_occurrence": "metar_ifr_hours", "metar_thunderstorm_co": "metar_thunderstorm_hours", "metar_low_vis_co": "metar_low_vis_hours"}, dates)
    else:
        f = with_cooccurrence(f, daily, {**storms, "ifr_co_occurrence": "ifr_hours"}, dates).withColumns(
            {"metar_thunderstorm_co": F.lit(0.0), "metar_low_vis_co": F.lit(0.0)})
    corr = weather_corr(daily, dates, ranked, p).drop("n_common_days")
    ops = pair_operational_risk(flights, pairs, p)
    geo = pair_geography(pairs, airports)
    key = ["airport_a", "airport_b", "month"]
    f = (f.join(corr, key, "left").fillna(0.0, ["precip_correlation", "wind_correlation"])
         .join(ops, ["airport_a", "airport_b"], "left").join(geo, ["airport_a", "airport_b"], "left")
         .withColumns({"month_sin": cyclic_sin("month", 12.0), "month_cos": cyclic_cos("month", 12.0)}))
    f = pair_stats_join(f.select(*PAIR_FEATURE_ORDER), airport_month_stats(flights, p))
    return f.withColumns({
        "combined_weather_risk": F.col("weather_delay_rate_a") * F.col("weather_delay_rate_b"),
        "max_weather_risk": F.greatest("weather_delay_rate_a", "weather_delay_rate_b")})


def delay_pivot(flights: DataFrame, p: Params, airports: list[str], measure: str = "has_weather_delay") -> DataFrame:
    """Small date x airport pivot of an airport-day indicator (missing -> false), for parity
    with pivot-based consumers; the pair features never materialise it."""
    day = airport_day_delay(flights, p)
    piv = day.groupBy("date").pivot("airport", airports).agg(F.bool_or(measure))
    return piv.fillna(False, subset=airports)

