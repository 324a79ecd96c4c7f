"""Weather rollups (D1, D2, D3, D5) over hourly model weather and METAR observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubrisk.functions import exprs as X
from hubrisk.params import (WMO_FOG, WMO_FREEZING_RAIN, WMO_HEAVY_RAIN, WMO_HEAVY_SNOW,
                            WMO_SEVERE, WMO_THUNDERSTORM)

WEATHER_DAILY_MEASURES = (
    "temp_mean", "temp_min", "temp_max", "precip_total", "rain_total", "snowfall_total",
    "snow_depth_max", "wind_speed_mean", "wind_speed_max", "wind_gusts_max", "cloud_cover_mean",
    "cloud_cover_low_mean", "humidity_mean", "dewpoint_mean", "pressure_mean", "pressure_std",
    "thunderstorm_hours", "fog_hours", "freezing_rain_hours", "heavy_rain_hours", "heavy_snow_hours",
    "severe_weather_hours", "high_wind_hours", "ifr_hours", "low_ceiling_hours",
    "poor_visibility_hours", "fog_proxy_hours",
)


def weather_daily(hourly: DataFrame) -> DataFrame:
    """One (airport, date) row with 27 measures, in a single hash aggregation."""
    code = F.col("weather_code")
    spread_small = F.abs(F.col("temperature_2m") - F.col("dew_point_2m")) < 3
    low_cloud = F.col("cloud_cover_low") > 90
    wet = F.col("precipitation") > 0
    zsum = lambda c: F.coalesce(F.sum(c), F.lit(0.0))  # noqa: E731  (all-NULL sum is 0)
    return (hourly.withColumn("date", F.to_date("time"))
            .groupBy("airport", "date").agg(
                F.avg("temperature_2m").alias("temp_mean"),
                F.min("temperature_2m").alias("temp_min"),
                F.max("temperature_2m").alias("temp_max"),
                zsum("precipitation").alias("precip_total"),
                zsum("rain").alias("rain_total"),
                zsum("snowfall").alias("snowfall_total"),
                F.max("snow_depth").alias("snow_depth_max"),
                F.avg("wind_speed_10m").alias("wind_speed_mean"),
                F.max("wind_speed_10m").alias("wind_speed_max"),
                F.max("wind_gusts_10m").alias("wind_gusts_max"),
                F.avg("cloud_cover").alias("cloud_cover_mean"),
                F.avg("cloud_cover_low").alias("cloud_cover_low_mean"),
                F.avg("relative_humidity_2m").alias("humidity_mean"),
                F.avg("dew_point_2m").alias("dewpoint_mean"),
                F.avg("surface_pressure").alias("pressure_mean"),
                F.stddev_samp("surface_pressure").alias("pressure_std"),
                F.count_if(code.isin(*WMO_THUNDERSTORM)).alias("thunderstorm_hours"),
                F.count_if(code.isin(*WMO_FOG)).alias("fog_hours"),
                F.count_if(code.isin(*WMO_FREEZING_RAIN)).alias("freezing_rain_hours"),
                F.count_if(code.isin(*WMO_HEAVY_RAIN)).alias("heavy_rain_hours"),
                F.count_if(code.isin(*WMO_HEAVY_SNOW)).alias("heavy_snow_hours"),
                F.count_if(code.isin(*WMO_SEVERE)).alias("severe_weather_hours"),
                F.count_if(F.col("wind_gusts_10m") > 35).alias("high_wind_hours"),
                F.count_if(low_cloud & (wet | spread_small)).alias("ifr_hours"),
                F.count_if(low_cloud).alias("low_ceiling_hours"),
                F.count_if(spread_small & wet).alias("poor_visibility_hours"),
                F.count_if(spread_small).alias("fog_proxy_hours"),
            ))


def metar_observations(metar: DataFrame, local_time: str | None = None) -> DataFrame:
    """Per observation: ceiling, flight-category and phenomena flags (F1-F3). The date comes
    from ``local_time`` when given (kept in the output), else from ``valid``."""
    layers = tuple(i for i in range(1, 5) if f"skyc{i}" in metar.columns and f"skyl{i}" in metar.columns)
    ceiling = X.metar_ceiling(present=layers)
    extra = [local_time] if local_time else []
    df = metar.select(F.col("station").alias("airport"), F.to_date(local_time or "valid").alias("date"), "valid", *extra,
                      ceiling.alias("ceiling_ft"), F.col("vsby").cast("double").alias("vsby"),
                      F.col("gust").cast("double").alias("gust"),
                      F.col("sknt").cast("double").alias("sknt"), "wxcodes")
    flags = {
        "is_ifr": X.is_ifr("ceiling_ft", "vsby"), "is_lifr": X.is_lifr("ceiling_ft", "vsby"),
        "is_vfr": X.is_vfr("ceiling_ft", "vsby"), "is_mvfr": X.is_mvfr("ceiling_ft", "vsby"),
        **X.wx_flags("wxcodes"),
        "low_vis": X.flag(F.col("vsby") < 3), "high_wind": X.flag(F.col("gust") > 30),
    }
    return df.withColumns(flags)


METAR_COUNTS = (
    ("metar_ifr_hours", "is_ifr"), ("metar_lifr_hours", "is_lifr"), ("metar_vfr_hours", "is_vfr"),
    ("metar_mvfr_hours", "is_mvfr"), ("metar_thunderstorm_hours", "has_thunderstorm"),
    ("metar_fog_hours", "has_fog"), ("metar_snow_hours", "has_snow"),
    ("metar_freezing_hours", "has_freezing"), ("metar_rain_hours", "has_rain"),
    ("metar_low_vis_hours", "low_vis"), ("metar_high_wind_hours", "high_wind"),
)


#: Size of the streaming quantile sketches, and a bound on their rank error (that of one in a hundred sketches is larger).
SKETCH_K, SKETCH_RANK_ERROR = 800, 0.005


def sketched_quantile(column: str, q: float):
    """A value of the group whose rank is about ``q``, from a mergeable sketch; null where all values are."""
    found = F.call_function("kll_sketch_agg_double", F.col(column), F.lit(SKETCH_K))
    return F.when(F.min(column).isNotNull(), F.call_function("kll_sketch_get_quantile_double", found, F.lit(q)))


def metar_daily_aggs(exact_quantiles: bool = True) -> list:
    """The measures of ``metar_daily``; without exact quantiles these are sketched, as streams need."""
    p10 = lambda c: F.percentile(c, 0.1) if exact_quantiles else sketched_quantile(c, 0.1)
    aggs = [F.count_if(F.col(src)).alias(name) for name, src in METAR_COUNTS]
    aggs += [F.min("ceiling_ft").alias("metar_ceiling_min"), F.avg("ceiling_ft").alias("metar_ceiling_mean")]
    aggs.append(p10("ceiling_ft").alias("metar_ceiling_p10"))
    aggs += [F.min("vsby").alias("metar_vis_min"), F.avg("vsby").alias("metar_vis_mean")]
    aggs.append(p10("vsby").alias("metar_vis_p10"))
    aggs += [F.max("gust").alias("metar_gust_max"), F.max("sknt").alias("metar_wind_max"),
             F.count(F.lit(1)).alias("metar_obs_count")]
    return aggs


def metar_daily(metar: DataFrame) -> DataFrame:
    """One (airport, date) row with 20 aviation measures."""
    return metar_observations(metar).groupBy("airport", "date").agg(*metar_daily_aggs())


def ifr_top_airports(metar_day: DataFrame, n: int = 10) -> DataFrame:
    """Airports ranked by mean daily METAR IFR hours (top n; ties by code)."""
    return (metar_day.groupBy("airport").agg(F.avg("metar_ifr_hours").alias("avg_ifr_hours"))
            .orderBy(F.desc("avg_ifr_hours"), "airport").limit(n))


def airport_month_weather(daily: DataFrame) -> DataFrame:
    """Per (airport, calendar month): day counts over thresholds, means and sums."""
    days = lambda cond: F.count_if(cond)
    return (daily.withColumn("month", F.month("date")).groupBy("airport", "month").agg(
        days(F.col("precip_total") > 0.1).alias("precip_days"),
        days(F.col("precip_total") > 1.0).alias("heavy_precip_days"),
        days(F.col("thunderstorm_hours") > 0).alias("thunderstorm_days"),
        days(F.col("fog_hours") > 0).alias("fog_days"),
        days(F.col("snowfall_total") > 0).alias("snow_days"),
        days(F.col("high_wind_hours") > 0).alias("high_wind_days"),
        days(F.col("severe_weather_hours") > 0).alias("severe_weather_days"),
        F.avg("precip_total").alias("avg_precip"),
        F.avg("wind_speed_mean").alias("avg_wind_speed"),
        F.avg("wind_gusts_max").alias("avg_wind_gusts"),
        F.avg("cloud_cover_mean").alias("avg_cloud_cover"),
        F.avg("pressure_std").alias("pressure_volatility"),
        F.sum("thunderstorm_hours").alias("thunderstorm_hours_total"),
        F.sum("severe_weather_hours").alias("severe_hours_total"),
    ))
