"""Proxy views: flights / weather / METAR / airports derived from the driver's
TPC-H-style Parquet tables (FIXTURES.md section 3). The SQL text is shared with
the DuckDB oracle, so both engines read the very same derived inputs.

Placeholders ``{lineitem}`` etc. are bound to DataFrames through
``spark.sql(text, **frames)``; the oracle substitutes plain table names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hubrisk.params import Params

HUB = "NATION_0"

PX_AIRPORT = """
SELECT n_name AS iata, CAST(25 + (n_nationkey * 7) % 25 AS DOUBLE) AS latitude,
       CAST(-70 - (n_nationkey * 11) % 55 AS DOUBLE) AS longitude,
       -5 - n_nationkey % 4 AS tz_offset, 'City ' || n_nationkey AS city,
       CASE WHEN n_nationkey IN (7, 19) THEN NULL ELSE r_name END AS region,
       n_nationkey % 3 = 0 AS in_tornado, n_nationkey % 4 = 0 AS in_gulf, n_nationkey % 5 = 0 AS in_winter
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

PX_FLIGHT = """
WITH b AS (
  SELECT l.*, s.s_nationkey AS nk, 4 * l_quantity - 60 AS ad, round(l_discount * 100) * 10 - 20 AS dd,
         (l_partkey * 37 + l_linenumber * 61) % 1440 AS m,
         CASE WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN 1 ELSE 0 END AS canc
  FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey WHERE s.s_nationkey <> 0)
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS flight_id,
       CAST(l_shipdate AS DATE) AS FlightDate, CAST(year(l_shipdate) AS INT) AS Year, CAST(month(l_shipdate) AS INT) AS Month,
       CASE WHEN l_linenumber % 2 = 1 THEN 'NATION_' || nk ELSE 'NATION_0' END AS Origin,
       CASE WHEN l_linenumber % 2 = 1 THEN 'NATION_0' ELSE 'NATION_' || nk END AS Dest,
       CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CAST(floor(m / 60) * 100 + m % 60 AS DOUBLE) END AS CRSDepTime,
       CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CAST(floor(m / 60) * 100 + m % 60 AS DOUBLE) END AS CRSArrTime,
       CASE WHEN canc = 1 THEN NULL ELSE ad END AS ArrDelay, CASE WHEN canc = 1 THEN NULL ELSE dd END AS DepDelay,
       CASE WHEN l_returnflag = 'R' AND canc = 0 AND ad > 0 THEN ad ELSE CAST(0 AS DOUBLE) END AS WeatherDelay,
       CASE WHEN l_returnflag = 'A' AND canc = 0 AND ad > 0 THEN ad ELSE CAST(0 AS DOUBLE) END AS LateAircraftDelay,
       60 + round(l_tax * 100) * 20 AS AirTime, CAST(canc AS DOUBLE) AS Cancelled
FROM b
"""

PX_WEATHER_HOURLY = """
SELECT 'NATION_' || (l_partkey % 25) AS airport, l_shipdate + INTERVAL '1' HOUR * CAST(l_orderkey % 24 AS INT) AS time,
       CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE 20 + l_quantity END AS temperature_2m,
       20 + l_quantity - l_linenumber AS dew_point_2m, CAST(50 + 5 * l_linenumber AS DOUBLE) AS relative_humidity_2m,
       CASE WHEN l_discount > 0.055 THEN round(l_discount * 100) - 5 ELSE CAST(0 AS DOUBLE) END AS precipitation,
       CASE WHEN l_discount > 0.055 AND l_quantity >= 5 THEN round(l_discount * 100) - 5 ELSE CAST(0 AS DOUBLE) END AS rain,
       CAST(CASE WHEN l_quantity < 5 THEN 1 ELSE 0 END AS DOUBLE) AS snowfall, CAST(CASE WHEN l_quantity < 5 THEN 2 ELSE 0 END AS DOUBLE) AS snow_depth,
       CAST(split_part('0,3,45,48,63,65,66,73,75,95,96,99', ',', 1 + CAST(l_quantity AS INT) % 12) AS INT) AS weather_code,
       least(CAST(100 AS DOUBLE), 2 * l_quantity + 10) AS cloud_cover, least(CAST(100 AS DOUBLE), 2 * l_quantity) AS cloud_cover_low,
       CAST(l_suppkey % 30 AS DOUBLE) AS wind_speed_10m, CAST(l_orderkey % 60 AS DOUBLE) AS wind_gusts_10m,
       CAST((l_orderkey * 7) % 360 AS DOUBLE) AS wind_direction_10m, 1000 - l_quantity AS surface_pressure
FROM {lineitem}
"""

PX_METAR_HOURLY = """
SELECT 'NATION_' || (user_id % 25) AS station, ts AS valid,
       split_part('CLR,FEW,SCT,BKN,OVC', ',', CAST(1 + event_id % 5 AS INT)) AS skyc1,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(100 * (1 + event_id % 40) AS DOUBLE) END AS skyl1,
       split_part('OVC,BKN,FEW,CLR', ',', CAST(1 + event_id % 4 AS INT)) AS skyc2, CAST(100 * (10 + event_id % 60) AS DOUBLE) AS skyl2,
       split_part('CLR,OVC,BKN', ',', CAST(1 + event_id % 3 AS INT)) AS skyc3, CAST(100 * (3 + event_id % 30) AS DOUBLE) AS skyl3,
       CASE WHEN event_id % 11 = 0 THEN 'OVC' ELSE NULL END AS skyc4, CAST(100 * (1 + event_id % 20) AS DOUBLE) AS skyl4,
       CAST(event_id % 90 AS DOUBLE) AS tmpf, CAST(event_id % 90 - event_id % 7 AS DOUBLE) AS dwpf, CAST(10 * (event_id % 36) AS DOUBLE) AS drct,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 40 AS DOUBLE) / 4 END AS vsby,
       CASE event_type WHEN 'error' THEN '+TSRA' WHEN 'signup' THEN 'BR' WHEN 'click' THEN '-RA' WHEN 'purchase' THEN 'SN FZFG' ELSE NULL END AS wxcodes,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(value) AS DOUBLE) % 50 END AS gust, CAST(event_id % 35 AS DOUBLE) AS sknt,
       CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k
FROM {events}
"""

# The flights as a file feed has them: all text, with flights that do not touch the hub, an excluded year,
# missing years, and bad or non-finite values.
PX_FLIGHT_FEED = """
WITH f AS (SELECT *, CAST(split_part(flight_id, '-', 1) AS BIGINT) % 50 AS o FROM (""" + PX_FLIGHT + """) x)
SELECT flight_id, CASE o WHEN 9 THEN '2020-03-05' WHEN 21 THEN 'no date' ELSE CAST(FlightDate AS STRING) END AS FlightDate,
       CASE o WHEN 9 THEN '2020' WHEN 23 THEN NULL ELSE CAST(Year AS STRING) END AS Year, CAST(Month AS STRING) AS Month,
       CASE WHEN o = 7 THEN 'NATION_98' ELSE Origin END AS Origin, CASE WHEN o = 7 THEN 'NATION_99' ELSE Dest END AS Dest,
       CAST(CRSDepTime AS STRING) AS CRSDepTime, CAST(CRSArrTime AS STRING) AS CRSArrTime,
       CASE o WHEN 11 THEN 'NaN' WHEN 13 THEN 'bad' WHEN 17 THEN 'Infinity' ELSE CAST(ArrDelay AS STRING) END AS ArrDelay,
       CAST(DepDelay AS STRING) AS DepDelay, CASE WHEN o = 19 THEN 'NaN' ELSE CAST(WeatherDelay AS STRING) END AS WeatherDelay,
       CAST(LateAircraftDelay AS STRING) AS LateAircraftDelay, CAST(AirTime AS STRING) AS AirTime, CAST(Cancelled AS STRING) AS Cancelled
FROM f
"""

PROXY_SQL = {
    "px_flight_feed": (PX_FLIGHT_FEED, ("lineitem", "supplier")),
    "px_airport": (PX_AIRPORT, ("nation", "region")),
    "px_flight": (PX_FLIGHT, ("lineitem", "supplier")),
    "px_weather_hourly": (PX_WEATHER_HOURLY, ("lineitem",)),
    "px_metar_hourly": (PX_METAR_HOURLY, ("events",)),
}


def proxy_sql_for_duckdb(name: str) -> str:
    text, tables = PROXY_SQL[name]
    return text.format(**{t: t for t in tables})


@dataclass
class HubData:
    """The four inputs of the analysis, as lazy DataFrames."""

    flights: DataFrame
    weather_hourly: DataFrame
    metar_hourly: DataFrame
    airports: DataFrame


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def proxy_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, tables = PROXY_SQL[name]
    frames = {t: read_table(spark, sf_dir, t) for t in tables}
    return spark.sql(text, **frames)


def load(spark: SparkSession, sf_dir: str) -> HubData:
    return HubData(
        flights=proxy_view(spark, sf_dir, "px_flight"),
        weather_hourly=proxy_view(spark, sf_dir, "px_weather_hourly"),
        metar_hourly=proxy_view(spark, sf_dir, "px_metar_hourly"),
        airports=proxy_view(spark, sf_dir, "px_airport"),
    )


def proxy_params(**overrides) -> Params:
    """Parameters for the proxy data: hub NATION_0, train 1995-2000, test 2001."""
    base = dict(hub=HUB, train_years=(1995, 1996, 1997, 1998, 1999, 2000), test_year=2001)
    base.update(overrides)
    return Params(**base)
