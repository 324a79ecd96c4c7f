"""Stages that later processes reuse: a table per fingerprint of what it was made from.

A stage's fingerprint covers its input files (path, length and time of change, hashed by Spark, so that no
list of files reaches the driver), its parameters and the library's code. The rows go to a folder of their own;
the manifest, written after them, names it and is the commit: without a finished manifest the stage does not
exist, whatever a broken run has left. Equal fingerprints give the stored table, any change a new one.

Layout: ``<root>/<name>/<fingerprint>/rows-<id>`` and ``.../manifest`` (one line of JSON).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import cache
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODE = ("functions", "operators", "plans", "sources", "params.py")


@cache
def code_version() -> str:
    """Hash of the modules that make stages."""
    found = {}

    def walk(at, name: str) -> None:  # noqa: ANN001
        if at.is_dir():
            for x in at.iterdir():
                walk(x, f"{name}/{x.name}")
        elif name.endswith(".py"):
            found[name] = at.read_bytes()
    for top in CODE:
        walk(files("hubrisk").joinpath(top), top)
    whole = hashlib.sha256()
    for name in sorted(found):
        whole.update(f"{name}:{len(found[name])}:".encode() + found[name])
    return whole.hexdigest()


def input_state(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """Number, bytes and a hash of the files under the paths; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length", "modificationTime")
    one = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    low = one.bitwiseAND(F.lit(0xFFFFFFFF))
    r = rows.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.coalesce(F.bit_xor(one), F.lit(0)).alias("xor"),
                 F.coalesce(F.sum(low), F.lit(0)).alias("sum")).first()
    return r.asDict()


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """The finished manifest of a stage folder."""
    fs, done = file_system(spark, f"{folder}/manifest/_SUCCESS")
    return json.loads(spark.read.text(f"{folder}/manifest").first().value) if fs.exists(done) else None


def reused(spark: SparkSession, root: str, name: str, inputs: list[str], params: object, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage ``name`` of these inputs and parameters: the stored table, or else ``build()``, stored."""
    made_from = {"name": name, "inputs": input_state(spark, inputs), "params": repr(params), "code": code_version()}
    key = hashlib.sha256(json.dumps(made_from, sort_keys=True).encode()).hexdigest()[:32]
    folder = f"{root.rstrip('/')}/{name}/{key}"
    found = manifest(spark, folder)
    if found is None:
        found = made_from | {"rows": f"{folder}/rows-{uuid.uuid4().hex[:12]}"}
        build().write.parquet(found["rows"])
        spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return spark.read.parquet(found["rows"])
