"""Shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from hubrisk.session import scratch_path


def one_row(df: DataFrame, *aggs: Column) -> Row:
    """Evaluate a global aggregate (exactly one row of a few bounded statistics: min/max,
    totals, quantiles) in one job and return it, so the values enter later plans as
    literals. Nothing row-level reaches the driver."""
    return df.agg(*aggs).first()


def lit(v) -> Column:
    return F.lit(v)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: computed once, lineage cut."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def passed(value: Column, splits: Column) -> Column:
    """How many of an ascending array of splitters lie below a value: its chunk."""
    return F.size(F.filter(splits, lambda s: s < value))


def balanced_chunk(df: DataFrame, value: str, chunks: int, part: list[str] | None = None, name: str = "_chunk") -> DataFrame:
    """``df`` with a chunk number that ascends with ``value`` and holds about as many rows for each chunk
    (of a ``part``): splitters are quantiles counted from the rows, not equal widths. ``chunks`` splitters a
    part are all that is kept of it; ``df`` is read twice."""
    part = part or []
    at = F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(i / chunks) for i in range(1, chunks)]), F.lit(100 * chunks)).alias("_splits")
    if part:
        out = df.join(df.groupBy(*part).agg(at), part).withColumn(name, passed(F.col(value), F.array_distinct("_splits")))
        return out.drop("_splits")
    splits = sorted(set(one_row(df, at)["_splits"] or []))
    # Coarse splitters first, then those between two of them.
    step = max(1, int(len(splits) ** 0.5))
    groups = [splits[i:i + step] for i in range(0, len(splits), step)]
    if not groups:
        return df.withColumn(name, F.lit(0))
    coarse = passed(F.col(value), F.array(*[F.lit(g[-1]) for g in groups]))
    fine = F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), coarse)
    return df.withColumn(name, coarse * step + F.coalesce(passed(F.col(value), fine), F.lit(0)))
