"""Upsert sink for streaming aggregations: a snapshot of all keys, the deltas since, and a manifest.

Every micro-batch writes its changed rows as one delta and then commits by a manifest: one line of JSON
naming the snapshot and the deltas that make up the table after that batch. When ``compact_every`` deltas
have gathered, they are merged into a new snapshot. A reader takes the newest manifest, so it opens the
snapshot and fewer than ``compact_every`` deltas, however many batches have run; of the rows of a key, that of
the latest batch counts.

A batch number that is already committed changes nothing, so a batch run again after a restart is harmless;
files that a lost run left behind are in no manifest and are written over. Files that no manifest of the last
two compactions names are removed at the next compaction: a reader has that long to finish.

Layout: ``delta/<batch>``, ``snapshot/<batch>``, ``manifest/<batch>`` (batch numbers zero-padded).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Manifest:
    batch: int
    snapshot: int | None
    deltas: tuple[int, ...]

    def paths(self, out_dir: str) -> list[str]:
        base = [] if self.snapshot is None else [folder(out_dir, "snapshot", self.snapshot)]
        return base + [folder(out_dir, "delta", d) for d in self.deltas]


def folder(out_dir: str, kind: str, batch: int) -> str:
    return f"{out_dir.rstrip('/')}/{kind}/{batch:012d}"


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """The Hadoop file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def batches(spark: SparkSession, out_dir: str, kind: str) -> list[int]:
    """Batch numbers that have a folder of that kind (a few more than ``compact_every``)."""
    fs, path = file_system(spark, f"{out_dir.rstrip('/')}/{kind}")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []


def committed(spark: SparkSession, out_dir: str, batch: int) -> bool:
    fs, done = file_system(spark, f"{folder(out_dir, 'manifest', batch)}/_SUCCESS")
    return fs.exists(done)


def newest(spark: SparkSession, out_dir: str) -> Manifest | None:
    """The newest committed manifest."""
    for b in reversed(batches(spark, out_dir, "manifest")):
        if committed(spark, out_dir, b):
            m = json.loads(spark.read.text(folder(out_dir, "manifest", b)).first().value)
            return Manifest(m["batch"], m["snapshot"], tuple(m["deltas"]))
    return None


def latest_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: that of the latest ``_batch``."""
    cols = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_batch").alias("_r"))
    return last.select(*keys, "_r.*")


def sink(out_dir: str, keys: list[str], compact_every: int = 8) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that upserts each batch's rows (one per key) into the table at ``out_dir``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = newest(spark, out_dir)
        if before is not None and batch_id <= before.batch:
            return
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(folder(out_dir, "delta", batch_id))
        now = Manifest(batch_id, before.snapshot if before else None, (*(before.deltas if before else ()), batch_id))
        if len(now.deltas) >= compact_every:
            whole = latest_rows(spark.read.parquet(*now.paths(out_dir)), keys)
            whole.write.mode("overwrite").parquet(folder(out_dir, "snapshot", batch_id))
            remove_before(spark, out_dir, before.snapshot if before else None)
            now = Manifest(batch_id, batch_id, ())
        line = json.dumps({"batch": now.batch, "snapshot": now.snapshot, "deltas": now.deltas})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(folder(out_dir, "manifest", batch_id))
    return write


def remove_before(spark: SparkSession, out_dir: str, snapshot: int | None) -> None:
    """Remove what the present snapshot (about to be replaced) and its deltas do not need."""
    if snapshot is None:
        return
    for kind, keep_from in (("snapshot", snapshot), ("delta", snapshot + 1), ("manifest", snapshot)):
        for b in batches(spark, out_dir, kind):
            if b < keep_from:
                fs, path = file_system(spark, folder(out_dir, kind, b))
                fs.delete(path, True)


def read(spark: SparkSession, out_dir: str, keys: list[str]) -> DataFrame:
    """The table: the latest row of each key."""
    m = newest(spark, out_dir)
    if m is None:
        raise FileNotFoundError(f"no batch has been committed under {out_dir}")
    return latest_rows(spark.read.parquet(*m.paths(out_dir)), keys).drop("_batch")
