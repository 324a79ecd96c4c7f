"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubrisk.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is the smallest node reached.

    Each round is aggregations and equi-joins over the edges, written to the shared folder; the
    number of rounds grows with the logarithm of the longest path. Only counters reach the driver. ``edges`` should
    be a written table, as its rows are counted first.
    """
    rows = edges.count()
    e = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "edges", rows)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.distinct(), "edges", rows)
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(m.select("a", F.col("m").alias("b"))).distinct(), "edges", rows)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state, rows = tuple(now), now[0]
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
