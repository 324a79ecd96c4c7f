import pytest

from hubrisk.operators.flights import coerce_flights
from hubrisk.session import checkpoint_root, scratch_path
from hubrisk.sources import ingest as IN


def test_alias_map_first_column_wins():
    m = IN.canonical_names(["FL_DATE", "Origin", "dest", "WeatherDelay", "delay_due_weather", "flight_id", "junk"])
    assert m == {"FL_DATE": "FlightDate", "Origin": "Origin", "dest": "Dest", "WeatherDelay": "WeatherDelay",
                 "flight_id": "flight_id"}


def test_flight_csv_groups_union_and_skip(spark, params):
    base = scratch_path(spark, "t-csv")
    spark.createDataFrame([("2024-01-02", "HUB", "AAA", "1200", "", "bad")],
                          "FlightDate string, Origin string, Dest string, CRSDepTime string, WeatherDelay string, "
                          "DepDelay string").write.option("header", True).csv(f"{base}/a")
    spark.createDataFrame([("2024-01-03", "BBB", "HUB", "7.5")],
                          "fl_date string, origin string, dest string, delay_due_weather string") \
        .write.option("header", True).csv(f"{base}/b")
    spark.createDataFrame([("x",)], "foo string").write.option("header", True).csv(f"{base}/c")
    rows = {r.Origin: r for r in IN.read_flight_csvs(spark, [f"{base}/a", f"{base}/b", f"{base}/c"], params).collect()}
    assert rows["HUB"].WeatherDelay == 0.0 and rows["HUB"].DepDelay is None and rows["HUB"].DayOfWeek == 2
    assert rows["BBB"].WeatherDelay == 7.5 and rows["BBB"].Year == 2024


def test_weather_json_parallel_arrays(spark):
    base = scratch_path(spark, "t-json")
    doc = ('{"airport": "AAA", "latitude": 1.0, "longitude": 2.0, "hourly": {"time": ["2024-01-01T00:00", '
           '"2024-01-01T01:00"], "precipitation": [0.5, null], "weather_code": [95, 3]}}')
    spark.createDataFrame([(doc,)], "value string").write.text(base)
    rows = IN.read_weather_json(spark, base, variables=("precipitation", "weather_code")).orderBy("time").collect()
    assert [(r.precipitation, r.weather_code) for r in rows] == [(0.5, 95), (None, 3)]


def _write(spark, rows, schema, path, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).option("header", True).csv(path)


def test_a_file_without_year_keeps_its_rows(spark, params):
    base = scratch_path(spark, "t-year")
    _write(spark, [("2019-01-02", "2019", "HUB", "AAA"), ("2020-01-02", "2020", "HUB", "AAA")],
           "FlightDate string, Year string, Origin string, Dest string", base)
    _write(spark, [("2024-01-03", "BBB", "HUB"), ("2020-05-05", "BBB", "HUB"), ("?", "CCC", "HUB")],
           "fl_date string, origin string, dest string", base)
    rows = IN.read_flight_csvs(spark, [base], params).collect()
    assert sorted((r.Origin, r.Year) for r in rows if r.Year) == [("BBB", 2024), ("HUB", 2019)]
    assert [r.Origin for r in rows if r.Year is None] == ["CCC"]  # no year: not known to be excluded


def test_headers_of_one_folder_may_differ_in_order(spark, params):
    base = scratch_path(spark, "t-order")
    _write(spark, [("2024-01-02", "HUB", "AAA", "7")], "FlightDate string, Origin string, Dest string, ArrDelay string", base)
    _write(spark, [("9", "BBB", "HUB", "2024-01-03")], "ArrDelay string, Origin string, Dest string, FlightDate string", base)
    rows = {r.Origin: r for r in IN.read_flight_csvs(spark, [base], params).collect()}
    assert rows["HUB"].ArrDelay == 7.0 and rows["BBB"].ArrDelay == 9.0 and rows["BBB"].Dest == "HUB"


def test_non_finite_numbers_are_missing(spark):
    df = spark.createDataFrame([("NaN", "NaN"), ("Infinity", "-inf"), ("x", None), ("16", "3")], "ArrDelay string, WeatherDelay string")
    assert [tuple(r) for r in coerce_flights(df).collect()] == [(None, 0.0), (None, 0.0), (None, 0.0), (16.0, 3.0)]


def test_metar_times_of_any_precision_and_bad_ones(spark):
    base = scratch_path(spark, "t-metar")
    _write(spark, [("A", "2024-01-01 00:53", "T"), ("B", "2024-01-01 00:53:07", "M"), ("C", "nonsense", "12"), ("D", "2024-01-01T01:00", "nan")],
           "station string, valid string, gust string", base)
    rows = {r.station: r for r in IN.read_metar_csv(spark, base).collect()}
    assert str(rows["A"].valid) == "2024-01-01 00:53:00" and str(rows["B"].valid) == "2024-01-01 00:53:07"
    assert rows["C"].valid is None and rows["C"].gust == 12.0 and str(rows["D"].valid) == "2024-01-01 01:00:00"
    assert rows["A"].gust is None and rows["B"].gust is None and rows["D"].gust is None


def test_overwrite_drops_partitions_that_are_gone(spark):
    path = scratch_path(spark, "t-overwrite")
    IN.materialize(spark.createDataFrame([(1, 2019), (2, 2020)], "x int, year int"), path, ["year"])
    out = IN.materialize(spark.createDataFrame([(3, 2019)], "x int, year int"), path, ["year"])
    assert [(r.x, r.year) for r in out.collect()] == [(3, 2019)]


def test_without_a_shared_folder_scratch_paths_are_an_error():
    class Nothing:
        def get(self, key, default=None):
            return default

        def getCheckpointDir(self):
            return None

    class Session:
        conf = sparkContext = Nothing()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(Session(), "x")
    assert checkpoint_root(Session(), "/shared/x/") == "/shared/x"


def _files(folder, texts):
    from pathlib import Path
    Path(folder).mkdir(parents=True)
    for name, text in texts.items():
        Path(folder, name).write_bytes(text.encode())


def test_headers_of_many_files_take_one_scan(spark, params, tmp_path):
    """200 files, three headers (quoted commas, a byte order mark, blank lines before, quoted names), names with
    blanks and signs; the number of Spark jobs does not depend on the number of files."""
    heads = ['FlightDate,Origin,Dest,"a, b",ArrDelay', '﻿\r\nDEST,"fl_date","ORIGIN",arr_delay', 'foo,"origin, dest",bar']
    rows = ['2024-01-02,HUB,S{i},"x, y",{i}', 'HUB,2024-01-03,T{i},{i}', '1,2,3']

    def make(folder, n):
        ends = ["\n", "\r\n"]
        _files(folder, {f"f {i}%20+{i}.csv": ends[i % 2].join([heads[i % 3], rows[i % 3].format(i=i), ""]) for i in range(n)})
        return str(folder)

    def jobs(folder):
        tag = f"headers-{folder}"
        spark.sparkContext.setJobGroup(tag, tag)
        try:
            got = IN.read_flight_csvs(spark, [folder], params).select("Origin", "Dest", "ArrDelay", "Year").collect()
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
    got, many = jobs(make(tmp_path / "many", 200))
    want = [("HUB", f"S{i}", float(i), 2024) if i % 3 == 0 else (f"T{i}", "HUB", float(i), 2024) for i in range(200) if i % 3 < 2]
    assert sorted(tuple(r) for r in got) == sorted(want)
    few_got, few = jobs(make(tmp_path / "few", 110))  # over 32 files a header, from which Spark lists them in a job
    assert len(few_got) == 74 and many == few < 12
    assert sorted(len(files) for _, files in IN.header_groups(spark, [str(tmp_path / "many")])) == [66, 67, 67]


def test_empty_and_blank_files_have_no_header(spark, params, tmp_path):
    _files(tmp_path / "x", {"empty.csv": "", "blank.csv": "\n \n", "one.csv": "Origin,Dest,FlightDate"})
    assert IN.header_groups(spark, [str(tmp_path / "x")])[0][0] == ["Origin", "Dest", "FlightDate"]
    assert IN.read_flight_csvs(spark, [str(tmp_path / "x")], params).count() == 0
    with pytest.raises(ValueError, match="no file"):
        _files(tmp_path / "y", {"blank.csv": "\n"})
        IN.read_flight_csvs(spark, [str(tmp_path / "y")], params)
