"""Upsert sink of the streams, and the streams' quantile sketches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hubrisk.operators import weather as WX
from hubrisk.session import scratch_path
from hubrisk.streaming import metar_stream as ST
from hubrisk.streaming import upserts as UP


def _batch(spark, rows):
    return spark.createDataFrame(rows, "k string, v long")


def _table(spark, out):
    return {r.k: r.v for r in UP.read(spark, out, ["k"]).collect()}


def test_reads_touch_the_snapshot_and_few_deltas(spark):
    out, rnd, want = scratch_path(spark, "t-upserts"), random.Random(1), {}
    write = UP.sink(out, ["k"], compact_every=4)
    for b in range(20):
        rows = {f"k{rnd.randrange(9)}": b * 100 + i for i in range(3)}
        write(_batch(spark, list(rows.items())), b)
        want.update(rows)
        m = UP.newest(spark, out)
        assert m.batch == b and len(m.deltas) < 4 and len(m.paths(out)) <= 4
    assert _table(spark, out) == want
    assert UP.newest(spark, out).snapshot == 19 and UP.batches(spark, out, "snapshot") == [15, 19]
    assert len(UP.batches(spark, out, "delta")) <= 8 and len(UP.batches(spark, out, "manifest")) <= 8


def test_batches_run_again_change_nothing(spark):
    out = scratch_path(spark, "t-again")
    for b, rows in enumerate([[("a", 1)], [("a", 2), ("b", 2)], [("c", 3)]]):
        UP.sink(out, ["k"], compact_every=2)(_batch(spark, rows), b)
    before, files = _table(spark, out), UP.newest(spark, out).paths(out)
    for b in (0, 2):
        UP.sink(out, ["k"], compact_every=2)(_batch(spark, [("a", 99), ("z", 99)]), b)
    assert _table(spark, out) == before == {"a": 2, "b": 2, "c": 3} and UP.newest(spark, out).paths(out) == files


def test_a_lost_batch_is_not_read_and_written_over(spark):
    out = scratch_path(spark, "t-lost")
    UP.sink(out, ["k"])(_batch(spark, [("a", 1)]), 0)
    _batch(spark, [("lost", 7)]).withColumn("_batch", F.lit(1)).write.parquet(UP.folder(out, "delta", 1))  # no manifest
    UP.file_system(spark, out)[0].mkdirs(UP.file_system(spark, UP.folder(out, "manifest", 1))[1])        # one not finished
    assert _table(spark, out) == {"a": 1}
    UP.sink(out, ["k"])(_batch(spark, [("b", 2)]), 1)
    assert _table(spark, out) == {"a": 1, "b": 2}
    with pytest.raises(FileNotFoundError):
        UP.read(spark, scratch_path(spark, "t-none"), ["k"])


def test_stream_over_many_batches_and_a_restart(spark):
    """One file a batch: late files change days again; a stream started anew goes on in the same table."""
    base = scratch_path(spark, "t-many")
    names = [f.name for f in ST.METAR_SCHEMA.fields]

    def land(day, hour, vis):
        row = dict.fromkeys(names) | {"station": "AAA", "valid": f"2024-01-{day:02d} {hour:02d}:00:00.000000", "vsby": vis}
        spark.createDataFrame([tuple(row[n] for n in names)], ST.METAR_SCHEMA).coalesce(1).write.mode("append").json(f"{base}/in")
    seen = {}
    for b in range(10):
        day, hour, vis = 1 + b // 4, b, float(b)
        land(day, hour, vis)
        seen.setdefault(day, []).append(vis)
        got = ST.metar_daily_stream(spark, f"{base}/in", f"{base}/out", f"{base}/chk")
    assert {r.date.day: (r.metar_obs_count, r.metar_vis_min, r.metar_vis_p10, r.metar_ceiling_min is not None) for r in got.collect()} == {
        d: (len(v), min(v), min(v), True) for d, v in seen.items()}
    assert UP.newest(spark, f"{base}/out").snapshot is not None


@pytest.mark.parametrize(("n", "values"), [(1, 5), (24, 3), (800, 900), (60_000, 50_000), (60_000, 7)])
def test_sketched_quantile_is_near_the_exact_one(spark, n, values):
    rnd = random.Random(n + values)
    v = sorted(float(rnd.randrange(values)) for _ in range(n))
    shuffled = rnd.sample(v, n)
    df = spark.createDataFrame([(1, x) for x in shuffled] + [(1, None), (2, None)], "k int, v double").repartition(7)
    got = {r.k: r.q for r in df.groupBy("k").agg(WX.sketched_quantile("v", 0.1).alias("q")).collect()}
    assert got[2] is None
    low, high = sum(x < got[1] for x in v) / n, sum(x <= got[1] for x in v) / n  # ranks that the value covers
    assert low - WX.SKETCH_RANK_ERROR <= 0.1 <= high + WX.SKETCH_RANK_ERROR
    if n <= WX.SKETCH_K:
        assert got[1] == v[math.ceil(n * 0.1) - 1]
