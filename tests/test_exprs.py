from pyspark.sql import functions as F

from hubrisk.functions import exprs as X


def test_hhmm_to_minutes(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 5.0, 59.0, 100.0, 2359.0, 2400.0)], "t double")
    got = [r[0] for r in df.select(X.hhmm_to_minutes("t")).collect()]
    assert got == [0, 5, 59, 60, 1439, 1440]


def test_minutes_to_hhmm(spark):
    df = spark.createDataFrame([(0.0,), (61.0,), (1439.0,), (1500.0,)], "m double")
    assert [r[0] for r in df.select(X.minutes_to_hhmm("m")).collect()] == ["00:00", "01:01", "23:59", "01:00"]


def test_metar_ceiling_first_layer(spark):
    rows = [("FEW", 200.0, "BKN", 900.0), ("OVC", None, "BKN", 700.0), ("CLR", None, "FEW", 500.0)]
    df = spark.createDataFrame(rows, "skyc1 string, skyl1 double, skyc2 string, skyl2 double")
    got = [r[0] for r in df.select(X.metar_ceiling(present=(1, 2))).collect()]
    assert got == [900.0, 700.0, 99999.0]


def test_category_with_null_visibility(spark):
    df = spark.createDataFrame([(5000.0, None)], "c double, v double")
    r = df.select(X.is_ifr("c", "v").alias("ifr"), X.is_vfr("c", "v").alias("vfr"), X.is_mvfr("c", "v").alias("mvfr")).first()
    assert (r.ifr, r.vfr, r.mvfr) == (False, False, True)


def test_visibility_text(spark):
    df = spark.createDataFrame([("10+",), ("1/2",), (None,), ("2.5",)], "v string")
    assert [r[0] for r in df.select(X.parse_visibility("v")).collect()] == [10.0, 10.0, 10.0, 2.5]


def test_live_ceiling_lowest_truthy(spark):
    df = spark.createDataFrame([([("BKN", 900), ("OVC", 400), ("BKN", 0)],), ([("FEW", 100)],)],
                               "clouds array<struct<cover:string,base:int>>")
    assert [r[0] for r in df.select(X.live_ceiling("clouds")).collect()] == [400.0, 99999.0]


def test_pair_key_and_region_pattern(spark):
    df = spark.createDataFrame([("B", "A", None, None), ("A", "C", "X", "Y")], "a string, b string, ra string, rb string")
    rows = df.select(X.pair_lo("a", "b"), X.pair_hi("a", "b"), X.region_pattern("ra", "rb")).collect()
    assert tuple(rows[0]) == ("A", "B", "Same region (Unknown)")
    assert tuple(rows[1]) == ("A", "C", "Cross-region (X / Y)")


def test_haversine(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    miles = df.select(X.haversine_miles("a", "b", "c", "d")).first()[0]
    assert abs(miles - 69.09) < 0.05
    assert df.select(F.lit(1)).count() == 1


def test_format_local_time_ignores_session_zone(spark):
    import datetime as dt
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
    try:
        df = spark.createDataFrame([(dt.datetime(1996, 4, 7, 2, 0, 0, 179575),)], "t timestamp_ntz")
        r = df.select(X.format_local_time("t").alias("a"), X.format_local_time("t", micros=False, sep="T").alias("b")).first()
        assert (r.a, r.b) == ("1996-04-07 02:00:00.179575", "1996-04-07T02:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
