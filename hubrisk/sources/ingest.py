"""File ingest: flight CSVs with varying headers, hourly-weather JSON documents of parallel
arrays, METAR CSVs with 'M'/'T' markers, stage materialisation (A1, A3-A5, A7)."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubrisk.functions.exprs import number
from hubrisk.operators.flights import coerce_flights, with_calendar, year_kept
from hubrisk.params import Params

# Header aliases (lower-case) accepted for each canonical flight column.
FLIGHT_ALIASES = {
    "FlightDate": ("fl_date", "flightdate"),
    "Year": ("year",),
    "Month": ("month",),
    "DayofMonth": ("dayofmonth", "day_of_month"),
    "DayOfWeek": ("dayofweek", "day_of_week"),
    "Reporting_Airline": ("reporting_airline", "op_unique_carrier", "mkt_unique_carrier", "carrier", "airline",
                          "airline_code"),
    "Origin": ("origin",),
    "Dest": ("dest",),
    "CRSDepTime": ("crsdeptime", "crs_dep_time"),
    "DepTime": ("deptime", "dep_time"),
    "DepDelay": ("depdelay", "dep_delay"),
    "DepDel15": ("depdel15", "dep_del15"),
    "CRSArrTime": ("crsarrtime", "crs_arr_time"),
    "ArrTime": ("arrtime", "arr_time"),
    "ArrDelay": ("arrdelay", "arr_delay"),
    "ArrDel15": ("arrdel15", "arr_del15"),
    "Cancelled": ("cancelled",),
    "CancellationCode": ("cancellationcode", "cancellation_code"),
    "CarrierDelay": ("carrierdelay", "carrier_delay", "delay_due_carrier"),
    "WeatherDelay": ("weatherdelay", "weather_delay", "delay_due_weather"),
    "NASDelay": ("nasdelay", "nas_delay", "delay_due_nas"),
    "SecurityDelay": ("securitydelay", "security_delay", "delay_due_security"),
    "LateAircraftDelay": ("lateaircraftdelay", "late_aircraft_delay", "delay_due_late_aircraft"),
    "Distance": ("distance",),
    "AirTime": ("airtime", "air_time"),
}
KEEP_EXTRA = ("flight_id",)


def canonical_names(columns: list[str]) -> dict[str, str]:
    """Source column -> canonical name; case-insensitive, the first column wins per target."""
    lookup = {alias: canon for canon, aliases in FLIGHT_ALIASES.items() for alias in aliases}
    out, taken = {}, set()
    for c in columns:
        canon = lookup.get(c.strip().lower())
        if canon and canon not in taken:
            out[c] = canon
            taken.add(canon)
        elif c in KEEP_EXTRA:
            out[c] = c
    return out


def read_flight_csvs(spark: SparkSession, paths: list[str], p: Params) -> DataFrame:
    """All CSV files under the paths, whatever their headers: files with one header are read together,
    renamed, hub-filtered, coerced and given the calendar columns they lack; the groups are unioned by
    name and excluded years dropped. Files without Origin and Dest columns are skipped."""
    frames = []
    for header, files in header_groups(spark, paths):
        names = canonical_names(header)
        if "Origin" not in names.values() or "Dest" not in names.values():
            continue
        # Columns are read by place: the header is known, so that no job reads it again.
        places = {f"_c{header.index(src)}": dst for src, dst in names.items()}
        schema = ", ".join(f"_c{i} string" for i in range(len(header)))
        raw = spark.read.schema(schema).option("header", True).csv(files)
        df = raw.select(*[F.col(place).alias(dst) for place, dst in places.items()])
        df = df.where((F.col("Origin") == p.hub) | (F.col("Dest") == p.hub))
        frames.append(with_calendar(coerce_flights(df)))
    if not frames:
        raise ValueError(f"no file with Origin and Dest columns under {paths}")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.where(year_kept(p)) if "Year" in out.columns else out


def header_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, header``: the first line with text of every file under the paths, in one scan. Only a file's
    first block can hold it, within which lines are read in order."""
    lines = spark.read.option("recursiveFileLookup", True).text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    first = lines.where((F.col("start") == 0) & (F.trim("value") != "")).withColumn("_at", F.monotonically_increasing_id())
    return first.groupBy("file").agg(F.min_by("value", "_at").alias("header"))


def header_groups(spark: SparkSession, paths: list[str]) -> list[tuple[list[str], list[str]]]:
    """(columns, files) by equal header line. The lines are found and grouped by Spark; a row for each
    different header reaches the driver, which needs the files' names to read them."""
    groups = header_lines(spark, paths).groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header")
    return [(next(csv.reader([r.header.removeprefix("\ufeff")], escapechar="\\")), [unquote(f) for f in r.files]) for r in groups.collect()]


WEATHER_VARS = ("temperature_2m", "dew_point_2m", "relative_humidity_2m", "precipitation", "rain", "snowfall",
                "snow_depth", "weather_code", "cloud_cover", "cloud_cover_low", "wind_speed_10m", "wind_gusts_10m",
                "wind_direction_10m", "surface_pressure")


def read_weather_json(spark: SparkSession, path: str, variables=WEATHER_VARS) -> DataFrame:
    """Documents {"airport", "latitude", "longitude", "hourly": {"time": [...], var: [...]}} ->
    one row per (airport, hour) via arrays_zip + explode."""
    hourly = ", ".join(["time: array<string>"] + [f"{v}: array<double>" for v in variables])
    schema = f"airport string, latitude double, longitude double, hourly struct<{hourly}>"
    docs = spark.read.schema(schema).json(path)
    z = F.arrays_zip(*[F.col(f"hourly.{c}").alias(c) for c in ("time", *variables)])
    rows = docs.select("airport", "latitude", "longitude", F.explode(z).alias("h"))
    return rows.select("airport", "latitude", "longitude",
                       F.col("h.time").try_cast("timestamp_ntz").alias("time"),
                       *[(F.col(f"h.{v}").cast("int") if v == "weather_code" else F.col(f"h.{v}")).alias(v)
                         for v in variables])


METAR_NUMERIC = ("tmpf", "dwpf", "relh", "drct", "sknt", "p01i", "alti", "mslp", "vsby", "gust",
                 "skyl1", "skyl2", "skyl3", "skyl4")


def read_metar_csv(spark: SparkSession, path: str) -> DataFrame:
    """METAR CSV folders: 'M' is missing; numeric columns coerced ('T' trace, bad and non-finite values ->
    NULL). Times are local ISO times down to minutes or finer, bad ones NULL."""
    raw = spark.read.option("header", True).option("nullValue", "M").csv(path)
    casts = {c: number(c) for c in raw.columns if c in METAR_NUMERIC}
    casts["valid"] = F.col("valid").try_cast("timestamp_ntz")
    return raw.withColumns(casts)


def materialize(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> DataFrame:
    """Write a stage as Parquet (optionally partitioned) and return the re-read table; the
    reuse decision is the caller's (explicit mode), never an implicit "file exists"."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "static")  # overwrite drops all old partitions
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)
