import datetime as dt

from hubrisk.operators import weather as WX
from hubrisk.session import scratch_path
from hubrisk.streaming import metar_stream as ST


def test_all_null_precip_sums_to_zero_and_single_std_null(spark):
    cols = ("airport string, time timestamp_ntz, temperature_2m double, dew_point_2m double, relative_humidity_2m double, "
            "precipitation double, rain double, snowfall double, snow_depth double, weather_code int, cloud_cover double, "
            "cloud_cover_low double, wind_speed_10m double, wind_gusts_10m double, surface_pressure double")
    t0 = dt.datetime(2024, 1, 1, 3)
    rows = [("X", t0, 10.0, 9.0, 50.0, None, None, 0.0, 0.0, 95, 50.0, 95.0, 5.0, 40.0, 1000.0),
            ("X", t0 + dt.timedelta(hours=1), 10.0, 9.0, 50.0, None, None, 0.0, 0.0, 3, 50.0, 20.0, 5.0, None, None)]
    r = WX.weather_daily(spark.createDataFrame(rows, cols)).first()
    assert r.precip_total == 0.0 and r.pressure_std is None and r.thunderstorm_hours == 1
    assert r.high_wind_hours == 1 and r.ifr_hours == 1 and r.fog_proxy_hours == 2


def _metar_rows(days):
    out = []
    for i, day in enumerate(days):
        out.append(("AAA", f"{day} 0{i % 9}:00:00.000000", "FEW", 400.0, "CLR", 9000.0, "OVC", 700.0, None, None, 2.0, "+TSRA", 35.0, 10.0))
    return out


def test_stream_daily_rollup_equals_batch_and_drops_late_rows(spark):
    base = scratch_path(spark, "t-metar-stream")
    cols = ST.METAR_SCHEMA
    first = spark.createDataFrame(_metar_rows(["2024-01-01", "2024-01-01", "2024-01-05"]), cols)
    first.coalesce(1).write.json(f"{base}/in/b1")
    q1 = ST.metar_daily_stream(spark, f"{base}/in/*", f"{base}/out", f"{base}/chk").collect()
    batch = {(r.airport, str(r.date)): r.metar_obs_count for r in q1}
    assert batch == {("AAA", "2024-01-01"): 2, ("AAA", "2024-01-05"): 1}
    late = spark.createDataFrame(_metar_rows(["2024-01-01", "2024-01-06"]), cols)
    late.coalesce(1).write.json(f"{base}/in/b2")
    q2 = ST.metar_daily_stream(spark, f"{base}/in/*", f"{base}/out", f"{base}/chk").collect()
    got = {(r.airport, str(r.date)): r.metar_obs_count for r in q2}
    assert got[("AAA", "2024-01-01")] == 2 and got[("AAA", "2024-01-06")] == 1


def test_stream_and_batch_agree_on_a_ceiling_in_the_third_layer(spark):
    base = scratch_path(spark, "t-layer3")
    rows = spark.createDataFrame(_metar_rows(["2024-02-01", "2024-02-02"]), ST.METAR_SCHEMA)
    rows.coalesce(1).write.json(f"{base}/in")
    stream = {str(r.date): r.metar_ceiling_min for r in ST.metar_daily_stream(spark, f"{base}/in", f"{base}/out", f"{base}/chk").collect()}
    batch = {str(r.date): r.metar_ceiling_min for r in WX.metar_daily(
        rows.withColumn("valid", rows["valid"].cast("timestamp_ntz"))).collect()}
    assert stream == batch == {"2024-02-01": 700.0, "2024-02-02": 700.0}


def test_queries_on_weather_do_not_build_the_flights(spark, monkeypatch):
    from hubrisk.plans import registry as R
    sf = "/root/testdata/sf0.001"

    def flights(spark, sf_dir):
        raise AssertionError("flights are not read")
    monkeypatch.setattr(R, "data", flights)
    assert R.QUERIES["ingest_weather_json"](spark, sf).count() == R.source(spark, sf).weather_hourly.count() > 0
    assert R.QUERIES["ingest_metar"](spark, sf).count() == R.source(spark, sf).metar_hourly.count() > 0


def test_cascade_stream_lands_and_keeps_little(spark, tmp_path, monkeypatch):
    from hubrisk.plans import registry as R
    monkeypatch.setattr(R, "scratch_path", lambda spark, label: str(tmp_path / label))
    R.QUERIES["stream_cascade"](spark, "/root/testdata/sf0.001")
    assert all(f.name.endswith(".json.gz") for f in (tmp_path / "cascade-stream/input").glob("part-*"))
    assert list((tmp_path / "cascade-stream/out").glob("part-*.zstd.parquet"))

