"""Shared helpers of the llm operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from hubrisk.session import scratch_path

#: A word is a maximal run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
#: Lower-casing of the contracts touches A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only; extra columns (with whatever names) never reach an operator's joins."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def cut(df: DataFrame, label: str, rows: int | None = None, by: int = 100_000) -> DataFrame:
    """Materialise in the shared checkpoint folder and read back: cuts lineage, computes once,
    survives lost executors. ``rows``: about how many rows it has at most, where known; it is then written as
    no more files than have ``by`` rows each, however many shuffle partitions there are (on a local disk Hadoop
    starts a process for each file)."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // by)))
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[list[list]]], Iterator[dict]], ddl: str) -> DataFrame:
    """``mapInArrow`` over plain Python columns: ``fn`` gets an iterator of batches (one list per
    column, None for null) and yields dicts of lists or numpy arrays for ``ddl``'s columns. Text
    rows may be long, so Arrow batches are kept to a few hundred rows: a Python worker then holds some
    MB of text at a time, whatever the partition's size. Ended tasks hand freed memory back."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn([c.to_pylist() for c in b.columns] for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        give_back()
    return df.mapInArrow(run, ddl)


def give_back() -> None:
    """Hand freed memory back at the end of a task: its Python worker stays for the next one, and what Arrow's and the
    C library's allocators keep would add up over stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def keep_freed() -> None:
    """Let this worker use freed arrays of up to 32 MB again instead of fetching zeroed pages for each; ``give_back``
    still hands all of them back when the task ends."""
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        malloc = ctypes.CDLL(None).mallopt
        malloc(-3, 32 << 20)  # M_MMAP_THRESHOLD
        malloc(-1, 64 << 20)  # M_TRIM_THRESHOLD


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def sized_hint(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast hint only when a counted row number is within a limit; else Spark's own choice."""
    return F.broadcast(df) if rows <= limit else df


Registry = dict[str, Callable[[SparkSession, str], DataFrame]]
