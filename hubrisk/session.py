"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "hubrisk",
                  driver_memory: str = "16g", checkpoint_dir: str | None = None) -> SparkSession:
    """Session tuned for the library: AQE with skew-join splitting, UTC, no UI. ``checkpoint_dir``: the
    folder for intermediate tables and stream state (shared by all machines on a cluster), where the
    environment does not configure one."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.cleaner.periodicGC.interval", "60s")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession, folder: str | None = None) -> str:
    """The folder for lineage cuts and stream state: ``folder``, else the session's
    ``spark.checkpoint.dir`` (or the context's checkpoint folder). Executors must share it, so there
    is no machine-local default: without one this raises."""
    root = folder or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str, folder: str | None = None) -> str:
    """A fresh, unique folder name under the shared checkpoint folder."""
    return f"{checkpoint_root(spark, folder)}/{label}-{uuid.uuid4().hex[:12]}"
