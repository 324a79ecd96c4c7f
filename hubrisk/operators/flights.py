"""Flight-level operators: hub filter, direction, legs, airport statistics (A2, A3, A9, B1, B2,
D4, D6, D12, D13, D21, E6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubrisk.functions.exprs import direction, flag, hhmm_to_minutes, number, spoke_airport
from hubrisk.params import Params

CAUSE_DELAYS = ("CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay")
NUMERIC_COLS = ("DepDelay", "ArrDelay", "DepDel15", "ArrDel15", "Distance", "AirTime",
                "CRSDepTime", "DepTime", "CRSArrTime", "ArrTime", "Cancelled")


def hub_filter(flights: DataFrame, p: Params) -> DataFrame:
    """Keep flights touching the hub, drop excluded years, derive calendar columns when absent."""
    df = with_calendar(flights.where((F.col("Origin") == p.hub) | (F.col("Dest") == p.hub)))
    return df.where(year_kept(p))


def with_calendar(flights: DataFrame) -> DataFrame:
    """Calendar columns that the flights lack, derived from the flight date."""
    derived = {
        "Year": F.year("FlightDate"), "Month": F.month("FlightDate"),
        "DayofMonth": F.dayofmonth("FlightDate"), "DayOfWeek": F.weekday("FlightDate") + 1,
    }
    if "FlightDate" not in flights.columns:
        return flights
    return flights.withColumns({k: v.cast("int") for k, v in derived.items() if k not in flights.columns})


def year_kept(p: Params) -> Column:
    """False for an excluded year; a row without a year stays."""
    return F.coalesce(~F.col("Year").isin(*p.excluded_years), F.lit(True)) if p.excluded_years else F.lit(True)


def coerce_flights(raw: DataFrame) -> DataFrame:
    """Typed flights from string columns: bad or non-finite numbers -> NULL, then 0 for cause delays."""
    casts = {}
    for c in raw.columns:
        if c in CAUSE_DELAYS:
            casts[c] = F.coalesce(number(c), F.lit(0.0))
        elif c in NUMERIC_COLS:
            casts[c] = number(c)
        elif c == "FlightDate":
            casts[c] = F.coalesce(F.col(c).try_cast("date"),
                                  F.try_to_timestamp(F.col(c)).cast("date"))
        elif c in ("Year", "Month", "DayofMonth", "DayOfWeek"):
            casts[c] = number(c).cast("int")
    return raw.withColumns(casts)


def flight_direction(flights: DataFrame, p: Params) -> DataFrame:
    return flights.select(
        "flight_id", F.col("FlightDate").alias("date"),
        spoke_airport(p.hub).alias("other_airport"), direction(p.hub).alias("direction"))


def airport_legs(flights: DataFrame, p: Params) -> DataFrame:
    """Stack inbound (ArrDelay) and outbound (DepDelay) legs into one per-airport table."""
    common = ["flight_id", "Year", "Month", "FlightDate",
              F.col("WeatherDelay").alias("weather_delay"),
              F.col("LateAircraftDelay").alias("late_aircraft_delay"), "Cancelled"]
    inbound = flights.where(F.col("Dest") == p.hub).select(
        F.col("Origin").alias("airport"), F.lit("inbound").alias("leg"),
        F.col("ArrDelay").alias("delay"), *common)
    outbound = flights.where(F.col("Origin") == p.hub).select(
        F.col("Dest").alias("airport"), F.lit("outbound").alias("leg"),
        F.col("DepDelay").alias("delay"), *common)
    return inbound.unionByName(outbound)


def airport_month_stats(flights: DataFrame, p: Params) -> DataFrame:
    """Per (airport, calendar month): volume, weather/late-aircraft rates, delay moments, p90."""
    legs = airport_legs(flights, p)
    as_rate = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return legs.groupBy("airport", "Month").agg(
        F.count(F.lit(1)).alias("flight_count"),
        as_rate(F.col("weather_delay") > 0).alias("weather_delay_rate"),
        F.avg("weather_delay").alias("weather_delay_mean"),
        F.percentile("weather_delay", 0.9).alias("weather_delay_p90"),
        F.avg("delay").alias("avg_delay"),
        as_rate(F.col("delay") > p.delay_threshold).alias("delay_rate_15"),
        F.stddev_samp("delay").alias("delay_std"),
        F.avg("Cancelled").alias("cancellation_rate"),
        as_rate(F.col("late_aircraft_delay") > 0).alias("late_aircraft_rate"),
    )


def airport_day_delay(flights: DataFrame, p: Params) -> DataFrame:
    """Per (spoke, date): any weather delay, any departure delay > threshold, max weather delay."""
    return (flights.select(spoke_airport(p.hub).alias("airport"), F.col("FlightDate").alias("date"),
                           "WeatherDelay", "DepDelay")
            .groupBy("airport", "date").agg(
                F.bool_or(flag(F.col("WeatherDelay") > 0)).alias("has_weather_delay"),
                F.bool_or(flag(F.col("DepDelay") > p.delay_threshold)).alias("has_delay_15"),
                F.max("WeatherDelay").alias("max_weather_delay"))
            .withColumn("month", F.month("date")))


def flight_dates(flights: DataFrame) -> DataFrame:
    """Distinct flight dates with calendar month (the per-month date spine)."""
    return flights.select(F.col("FlightDate").alias("date")).distinct().withColumn("month", F.month("date"))


def inbound_delay_dist(flights: DataFrame, p: Params) -> DataFrame:
    """Per inbound spoke: exact p90 / p75 / median of arrival delay (NULLs ignored)."""
    q = F.percentile("ArrDelay", F.array(F.lit(0.9), F.lit(0.75), F.lit(0.5)))
    return (flights.where(F.col("Dest") == p.hub)
            .groupBy(F.col("Origin").alias("airport")).agg(q.alias("q"))
            .select("airport", F.col("q")[0].alias("delay_p90"), F.col("q")[1].alias("delay_p75"),
                    F.col("q")[2].alias("delay_median")))


def schedule_profile(flights: DataFrame, p: Params) -> DataFrame:
    """Per (spoke, direction): mean airtime and median scheduled hub arrival / departure (HHMM)."""
    inbound = F.col("Dest") == p.hub
    return (flights.select(spoke_airport(p.hub).alias("airport"), direction(p.hub).alias("direction"),
                           "AirTime", F.when(inbound, F.col("CRSArrTime")).otherwise(F.col("CRSDepTime")).alias("crs"))
            .groupBy("airport", "direction")
            .agg(F.avg("AirTime").alias("avg_airtime"), F.median("crs").alias("median_crs_time")))


def profile_flights(flights: DataFrame, p: Params) -> DataFrame:
    """Per year: flights, inbound / outbound counts, distinct spokes."""
    return (flights.groupBy("Year").agg(
        F.count(F.lit(1)).alias("n_flights"),
        F.count_if(F.col("Dest") == p.hub).alias("n_inbound"),
        F.count_if(F.col("Origin") == p.hub).alias("n_outbound"),
        F.count_distinct(spoke_airport(p.hub)).alias("n_spokes")))


def hub_stratification(flights: DataFrame, p: Params) -> DataFrame:
    """Hub days split by whether any hub flight had a weather delay (one summary row)."""
    daily = (flights.where((F.col("Origin") == p.hub) | (F.col("Dest") == p.hub))
             .groupBy("FlightDate").agg(F.count_if(F.col("WeatherDelay") > 0).alias("wx")))
    impacted = F.col("wx") > 0
    return daily.agg(
        F.count_if(impacted).alias("impacted_days"),
        F.count_if(~impacted).alias("clear_days"),
        (F.count_if(impacted) / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100).alias("pct_impacted"),
        F.avg(F.when(impacted, F.col("wx"))).alias("avg_wx_delays_impacted"),
        F.avg(F.when(~impacted, F.col("wx"))).alias("avg_wx_delays_clear"),
    )


TIME_BANDS = ("overnight", "morning", "afternoon", "evening")


def time_band_risk(flights: DataFrame, p: Params) -> DataFrame:
    """Per (spoke, month, 6-hour band of the scheduled hub time): volume and delay rates."""
    inbound = F.col("Dest") == p.hub
    minute = hhmm_to_minutes(F.when(inbound, F.col("CRSArrTime")).otherwise(F.col("CRSDepTime")))
    band = (F.floor(minute / 360) % 4).cast("int")  # 2400 is midnight
    delay = F.when(inbound, F.col("ArrDelay")).otherwise(F.col("DepDelay"))
    labels = F.array(*[F.lit(b) for b in TIME_BANDS])
    return (flights.where(minute.isNotNull())
            .select(spoke_airport(p.hub).alias("airport"), "Month", band.alias("band_idx"),
                    "WeatherDelay", delay.alias("delay"))
            .groupBy("airport", "Month", "band_idx").agg(
                F.count(F.lit(1)).alias("flights"),
                F.avg(F.when(F.col("WeatherDelay") > 0, 1.0).otherwise(0.0)).alias("weather_delay_rate"),
                F.avg(F.when(F.col("delay") > p.delay_threshold, 1.0).otherwise(0.0)).alias("delay_rate_15"))
            .withColumn("band", F.element_at(labels, F.col("band_idx") + 1))
            .drop("band_idx"))




