"""Operator 12, hard-negative mining by coordinate pruning over length buckets (the LEMP scheme).

``build_index`` deals all vectors by descending length to tasks; each cuts its rows into length buckets
and stores, beside the integer matrix, one sorted list of row places per coordinate. ``mine`` takes the
anchors in blocks of bounded size: a block is sent to every bucket twice, first for each anchor's best
rows of its own label, then for rows of other labels whose score lies in the bands these set.

In a bucket an anchor needs a cosine of at least ``least score / (anchor length * longest length)``. Its
focus coordinates (the largest ones) each turn that into a range of values, thus into a slice of the
coordinate's sorted list. The slices are intersected and what is left is scored exactly. Where even the
shortest slice holds much of the bucket, intersecting saves nothing: such anchors are scored against the
whole bucket in one product. Least scores rise as a task finds rows. Pruning only leaves out rows that
cannot be among the results, so these are exact.

A task holds one bucket, one block of anchors and the k best rows of each band, whatever the size of a
label or of a group of equal vectors; Spark merges the tasks' lists by a window of at most k rows a task.

Defined results: rows without id, label or vector, or with a null or non-finite component, take no part;
rows equal in id, label and vector count once. Components are cut to +-2**26 after scaling, and scores add
over the components that both vectors have. Ties go to the smaller id. An anchor row is never its own
positive; other rows of its id are rows like any. Anchors without positives, and positives without
negatives, give no rows; empty tables give none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hubrisk.llm.common import cut, map_batches
from hubrisk.session import scratch_path

LIMIT = 1 << 26


@dataclass(frozen=True)
class MineParams:
    scale: int = 256           # a component x becomes floor(scale * x)
    every: int = 100           # anchors: ids divisible by this
    positives: int = 5
    negatives: int = 5
    low_pct: int = 80          # a negative scores low_pct to high_pct of its positive
    high_pct: int = 100
    bucket_rows: int = 4096
    shrink: float = 0.9        # a bucket's shortest length against its longest, if it has least_rows
    least_rows: int = 512
    focus: int = 4             # focus coordinates of an anchor
    dense: float = 0.25        # share of a bucket in the shortest slice from which the bucket is scored whole
    chunk: int = 4096          # anchors sent at once (mean; rows are dealt to chunks by hash)
    block: int = 256           # anchors scored at once in a task


def prepared(df: DataFrame, label: Column, p: MineParams) -> DataFrame:
    """Distinct ``vec_id, label, q, norm2`` of the rows that take part; ``q`` holds the integer components."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(v.cast("double") * p.scale))).cast("int"))
    rows = df.select("vec_id", label.cast("int").alias("label"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & whole)
    return rows.select("vec_id", "label", scaled.alias("q")).distinct().withColumn(
        "norm2", F.aggregate("q", F.lit(0).cast("long"), lambda s, v: s + v.cast("long") * v))


BUCKETS = "n int, dims int, longest double, shortest double, ids binary, labels binary, matrix binary, places binary"


def _bucket(rows: list[tuple]) -> dict:
    """One index row: vectors in order, and per coordinate the rows' places by ascending direction value."""
    ids, labels, qs, norms = zip(*rows, strict=True)
    dims = max(1, max(map(len, qs)))
    m = np.zeros((len(rows), dims), np.int32)
    for i, v in enumerate(qs):
        m[i, :len(v)] = v
    length = np.sqrt(np.array(norms, np.float64))
    order = np.argsort(directions(m, length), axis=0, kind="stable").T.astype("<u2")
    small = np.abs(m).max(initial=0) < 1 << 15
    return {"n": [len(rows)], "dims": [dims], "longest": [length.max()], "shortest": [length.min()],
            "ids": [np.array(ids, "<i8").tobytes()], "labels": [np.array(labels, "<i4").tobytes()],
            "matrix": [m.astype("<i2" if small else "<i4").tobytes()], "places": [order.tobytes()]}


def directions(m: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (m / np.where(length > 0, length, 1)[:, None]).astype(np.float32)


def build_index(rows: DataFrame, p: MineParams) -> DataFrame:
    """Length buckets of all rows. Equal lengths are dealt on by a hash of the id, so many equal vectors
    spread over tasks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("deal", F.xxhash64("vec_id", "label")).repartitionByRange(n, F.desc("norm2"), "deal")
    dealt = dealt.sortWithinPartitions(F.desc("norm2"), "vec_id").select("vec_id", "label", "q", "norm2")

    def build(batches: Iterator[list[list]]) -> Iterator[dict]:
        held: list[tuple] = []
        for columns in batches:
            for row in zip(*columns, strict=True):
                if len(held) == p.bucket_rows or (len(held) >= p.least_rows and row[3] < p.shrink ** 2 * held[0][3]):
                    yield _bucket(held)
                    held = []
                held.append(row)
        if held:
            yield _bucket(held)
    return cut(map_batches(dealt, build, BUCKETS), "hard-negative-index")


#: Bounds of bands without one; an unused band has them the wrong way round.
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Queries:
    """A chunk of anchors with score bands: for each anchor and band, the k best rows of the same label
    (or of others) that score ``lo`` to ``hi``."""

    same: bool
    k: int
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray   # int64, as are all that follow
    lo: np.ndarray        # (anchors, bands)
    hi: np.ndarray
    of: np.ndarray        # what the band stands for: the positive's id and score
    of_score: np.ndarray

    def plain(self) -> tuple:
        return tuple(vars(self).values())

    def rows(self, at: slice) -> Queries:
        return Queries(self.same, self.k, *(x[at] for x in self.plain()[2:]))


class Block:
    """The k best rows so far of each band of a block of anchors."""

    def __init__(self, q: Queries, first: int, p: MineParams) -> None:
        self.q, self.first, self.p = q, first, p
        n, self.bands = q.lo.shape
        self.theta, self.tie = q.lo.copy(), np.full((n, self.bands), MOST)
        self.key = np.empty(0, np.int64)    # anchor * bands + band
        self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64)
        self.norm2 = (q.vectors * q.vectors).sum(axis=1)
        self.norm = np.sqrt(self.norm2.astype(np.float64))
        unit = q.vectors / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :p.focus]
        self.angle = np.arccos(np.clip(np.take_along_axis(unit, self.focus, axis=1), -1, 1))

    def limits(self, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Scores that some band of an anchor still takes: the least and the most."""
        return self.theta[at].min(axis=1), np.where(self.theta[at] < MOST, self.q.hi[at], LEAST).max(axis=1)

    def ranges(self, longest: float, shortest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feasible values of each anchor's focus coordinates, and which anchors can find rows at all."""
        need, top = self.limits(slice(None))
        alive = need <= self.norm * longest * (1 + 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            least, most = need / (self.norm * longest), top / (self.norm * shortest)
            reach = np.where(need > 0, np.arccos(np.clip(least, -1, 1)), np.pi)[:, None]
            away = np.where((top >= 0) & (most < 1), np.arccos(np.clip(most, -1, 1)), 0)[:, None]
        low = np.cos(np.minimum(np.pi, self.angle + reach))
        high = np.minimum(np.cos(np.maximum(0, self.angle - reach)), np.cos(np.maximum(0, away - self.angle)))
        slack = 1e-5  # the lists hold float32 values
        return low - slack, high + slack, alive

    def meet(self, b: Bucket) -> None:
        low, high, alive = self.ranges(b.longest, b.shortest)
        size = np.full(low.shape, b.n)
        start = np.zeros(low.shape, np.int64)
        within = self.focus < b.dims
        for f in np.unique(self.focus[within & alive[:, None]]):
            at = (self.focus == f) & alive[:, None]
            values = b.sorted_values(f)
            start[at] = np.searchsorted(values, low[at], "left")
            size[at] = np.searchsorted(values, high[at], "right") - start[at]
        best = size.argmin(axis=1)
        shortest = size[np.arange(len(size)), best]
        alive &= shortest > 0
        whole = np.flatnonzero(alive & (shortest > self.p.dense * b.n))
        if len(whole):
            self.verify_bucket(b, whole)
        found = []
        for a in np.flatnonzero(alive & (shortest <= self.p.dense * b.n)):
            s = best[a]
            rows = b.places[self.focus[a, s], start[a, s]:start[a, s] + size[a, s]].astype(np.int64)
            for t in range(self.focus.shape[1]):
                if t != s and within[a, t]:
                    v = b.unit[rows, self.focus[a, t]]
                    rows = rows[(v >= low[a, t]) & (v <= high[a, t])]
            if len(rows):
                found.append((np.full(len(rows), a), rows, b.product(self.q.vectors[a:a + 1], self.norm[a], rows)[0]))
        if found:
            self.add(b, *map(np.concatenate, zip(*found, strict=True)))

    def verify_bucket(self, b: Bucket, anchors: np.ndarray) -> None:
        score = b.product(self.q.vectors[anchors], self.norm[anchors].max(), None)
        need, top = (x.astype(score.dtype) for x in self.limits(anchors))  # bounds that this rounds are beyond all scores
        match = (self.q.labels[anchors][:, None] == b.labels[None, :]) == self.q.same
        match &= score >= need[:, None]
        match &= score <= top[:, None]
        a, rows = np.nonzero(match)
        if len(a):
            self.add(b, anchors[a], rows, score[a, rows])

    def add(self, b: Bucket, a: np.ndarray, rows: np.ndarray, score: np.ndarray) -> None:
        """Merge scored rows into the bands."""
        score, ids, same = score.astype(np.int64), b.ids[rows], self.q.labels[a] == b.labels[rows]
        # Equal id, label and, by Cauchy-Schwarz, vector: the anchor's own row.
        own = same & (ids == self.q.ids[a]) & (score == self.norm2[a]) & (score == b.norm2[rows])
        ok = (same == self.q.same) & ~own
        a, score, ids = a[ok], score[ok], ids[ok]
        keys, scores, found = [self.key], [self.score], [self.id]
        for j in range(self.bands):
            t = self.theta[a, j]
            m = ((score > t) | ((score == t) & (ids < self.tie[a, j]))) & (score <= self.q.hi[a, j])
            keys.append(a[m] * self.bands + j)
            scores.append(score[m])
            found.append(ids[m])
        key, score, ids = map(np.concatenate, (keys, scores, found))
        if len(key) == len(self.key):
            return
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        rank = np.arange(len(key)) - np.repeat(starts, np.diff(starts, append=len(key)))
        self.key, self.score, self.id = (x[rank < self.q.k] for x in (key, score, ids))
        full = np.flatnonzero(rank == self.q.k - 1)
        self.theta.flat[key[full]], self.tie.flat[key[full]] = score[full], ids[full]


class Bucket:
    """A decoded index row."""

    def __init__(self, n, dims, longest, shortest, ids, labels, matrix, places) -> None:  # noqa: ANN001
        self.n, self.dims, self.longest, self.shortest = n, dims, longest, shortest
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i4")
        kind = "<i2" if len(matrix) == 2 * n * dims else "<i4"
        self.m = np.frombuffer(matrix, kind).reshape(n, dims)
        self.norm2 = (self.m.astype(np.int64) ** 2).sum(axis=1)
        self.unit = directions(self.m, np.sqrt(self.norm2.astype(np.float64)))
        self.places = np.frombuffer(places, "<u2").reshape(dims, n)
        self.lists: dict[int, np.ndarray] = {}
        self.typed: dict[type, np.ndarray] = {}

    def sorted_values(self, f: int) -> np.ndarray:
        if f not in self.lists:
            self.lists[f] = self.unit[self.places[f], f]
        return self.lists[f]

    def product(self, vectors: np.ndarray, norm: float, rows: np.ndarray | None) -> np.ndarray:
        """Exact inner products: in floats where lengths prove every partial sum exact, else in int64."""
        most = norm * self.longest * (1 + 1e-9)
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        if kind not in self.typed:
            self.typed[kind] = self.m.astype(kind)
        d = min(self.dims, vectors.shape[1])
        m = self.typed[kind][:, :d] if rows is None else self.typed[kind][rows, :d]
        return vectors[:, :d].astype(kind) @ m.T


FOUND = "anchor int, band int, anchor_id long, of long, of_score long, id long, score long"


def search(index: DataFrame, sent: Broadcast, k: int, p: MineParams) -> DataFrame:
    """The k best rows of each band over all buckets, with their ``rank``."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Queries(*sent.value)
        blocks = [Block(q.rows(slice(i, i + p.block)), i, p) for i in range(0, len(q.ids), p.block)]
        for batch in batches:
            for i in range(batch.num_rows):
                b = Bucket(*(c[i].as_py() for c in batch.columns))
                for block in blocks:
                    block.meet(b)
        for x in blocks:
            a, band = x.key // x.bands, x.key % x.bands
            columns = (a + x.first).astype(np.int32), band.astype(np.int32), x.q.ids[a], x.q.of[a, band], x.q.of_score[a, band], x.id, x.score
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "band", "anchor_id", "of", "of_score", "id", "score"])

    best = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id")
    return index.mapInArrow(find, FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


@contextmanager
def shared(spark: SparkSession, queries: Queries) -> Iterator[Broadcast]:
    """A chunk's queries on all executors, dropped after use. Plain arrays: executors need not import this module
    to read them."""
    sent = spark.sparkContext.broadcast(queries.plain())
    try:
        yield sent
    finally:
        sent.destroy()


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """An index row is some MB: Arrow batches hold few of them while the index is searched."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def anchors_of(rows: list, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        vectors[i, :len(r.q)] = r.q
    return np.array([r.vec_id for r in rows], np.int64), np.array([r.label for r in rows], np.int32), vectors


RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def mine_chunk(index: DataFrame, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, p: MineParams, out: str) -> None:
    """Append the hard negatives of a chunk of anchors to ``out``."""
    spark, n, none = index.sparkSession, len(ids), np.zeros((len(ids), 1), np.int64)
    every = Queries(True, p.positives, ids, labels, vectors, none + LEAST, none + MOST, none, none)
    with shared(spark, every) as sent:
        positives = search(index, sent, p.positives, p).select("anchor", "rank", "id", "score").collect()  # at most `positives` an anchor
    lo, hi = np.full((n, p.positives), MOST), np.full((n, p.positives), LEAST)
    of, of_score = np.zeros((n, p.positives), np.int64), np.zeros((n, p.positives), np.int64)
    for r in positives:
        at = r.anchor, r["rank"] - 1
        lo[at], hi[at] = -(-p.low_pct * r.score // 100), p.high_pct * r.score // 100
        of[at], of_score[at] = r.id, r.score
    lo[lo > hi] = MOST  # no score can be in the band of a negative score
    with shared(spark, Queries(False, p.negatives, ids, labels, vectors, lo, hi, of, of_score)) as sent:
        search(index, sent, p.negatives, p).select(
            "anchor_id", F.col("of").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            F.col("of_score").alias("positive_score"), F.col("score").alias("negative_score")).write.mode("append").parquet(out)


def mine(df: DataFrame, label: Column | None = None, p: MineParams = MineParams()) -> DataFrame:
    """Hard negatives of all anchors of ``df`` (``vec_id, embedding, label``); ``label`` replaces the label."""
    spark = df.sparkSession
    rows = prepared(df, F.col("label") if label is None else label, p)
    index = build_index(rows, p)
    anchors = cut(rows.where(F.col("vec_id") % p.every == 0).withColumn("deal", F.xxhash64("vec_id", "label", "q")), "hard-negative-anchors")
    size = anchors.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dims")).first()
    chunks = -(-size.n // p.chunk)
    out = scratch_path(spark, "hard-negatives")
    spark.createDataFrame([], RESULT).write.parquet(out)
    with small_batches(spark, 4):
        for c in range(chunks):
            part = anchors.where(F.pmod("deal", F.lit(chunks)) == c).select("vec_id", "label", "q").orderBy("vec_id", "label", "q").collect()
            if part:
                mine_chunk(index, *anchors_of(part, max(1, size.dims)), p, out)
    return spark.read.schema(RESULT).parquet(out)


def table_label() -> Column:
    """Where ``vec_id`` is divisible by 7, the label becomes the next of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def oracle_sql(p: MineParams = MineParams()) -> str:
    """The same rows as DuckDB SQL over ``embeddings`` (distinct ids)."""
    return f"""
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor({p.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2])), 0) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {p.every} = 0),
pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {p.positives})
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS "rank",
  id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id)
WHERE NOT same AND {p.low_pct} * positive_score <= 100 * score AND 100 * score <= {p.high_pct} * positive_score
QUALIFY "rank" <= {p.negatives}"""
