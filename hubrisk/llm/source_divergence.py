"""Operator 13, source divergence audit by hash-consed segment trees.

Each language keeps the terms that enough of its documents use. A group (language, source) has a count
for every kept term and from it a smoothed share; the audit gives the distance between the shares of any
two sources of a language, and the terms that a source uses more than its language does.

Distances come from segment trees over term ids. The kept terms of a language are dealt by hash to blocks
of some thousand terms; within a block a term's id is its place. Per block every source has a tree whose
leaves are counts and whose inner nodes are pairs of nodes below. Nodes are hash-consed: equal count
subtrees, of any source and place, are one node, so that the long runs of zeros and of small counts are
stored once (``consed``). Two sources are compared by walking both trees at once (``priced``), level by
level: a pair of nodes met again is not followed again, and each distinct pair of counts is priced once.

Texts are read once: tasks count terms per group (with the number of documents) before anything is
shuffled. A block holds a bounded number of terms, and sources are paired in tiles of bounded size, so
neither a large language nor one with many sources meets in one task; the result itself has a row for
each pair of sources of a language. Shares are whole numbers, computed exactly up to 2.9e14 terms a language.

Defined results: a null text, lang or source is ''. Repeated rows are documents of their own. A group
without terms has all counts 0; a language without kept terms gives value 0 for its pairs and no terms.
Ties rank by UTF-8 order of the item. Very long texts are read in slices between terms. An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubrisk.llm.common import cut, map_batches, sized_hint


@dataclass(frozen=True)
class DivergenceParams:
    min_docs: int = 30       # documents of a language that a kept term occurs in
    smooth: int = 5
    ranks: int = 50          # terms listed a group
    block_terms: int = 4096  # kept terms in a block (mean)
    tile: int = 32           # sources in a tile
    flush: int = 200_000     # distinct terms that a task holds before it sends them
    slice: int = 1 << 22     # bytes of text cut into terms at once
    broadcast_rows: int = 100_000  # tables of languages, groups or blocks with at most so many counted rows


#: Shares are in billionths; two factors keep the products within a long.
UNIT, COARSE, FINE = 1_000_000_000, 32_000, 31_250

#: Bytes of terms stay (A-Z lower-cased), all others become blanks: a term is a run of ASCII letters and
#: non-ASCII characters.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None, size: int) -> Iterator[list[bytes]]:
    """The terms of a text, slice by slice (blanks are the only ASCII white space left)."""
    raw, at = (text or "").encode().translate(TERM_BYTES), 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def term_counts(docs: DataFrame, p: DivergenceParams = DivergenceParams()) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents; a row with term '' for each group counts
    its documents."""
    def count(batches: Iterator[list[list]]) -> Iterator[dict]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        docs_with: dict[tuple, Counter] = defaultdict(Counter)

        def out() -> dict:
            rows = [(g, t, c) for g, found in n.items() for t, c in found.items()]
            return {"lang": [g[0] for g, _, _ in rows], "source": [g[1] for g, _, _ in rows],
                    "term": [t.decode() for _, t, _ in rows], "n": [c for _, _, c in rows],
                    "docs": [docs_with[g][t] for g, t, _ in rows]}
        for texts, langs, sources in batches:
            for text, lang, source in zip(texts, langs, sources, strict=True):
                g = (lang or "", source or "")
                own: Counter = Counter([b""])
                for found in terms(text, p.slice):
                    own.update(found)
                n[g].update(own)
                docs_with[g].update(own.keys())
            if sum(map(len, n.values())) > p.flush:
                yield out()
                n.clear()
                docs_with.clear()
        yield out()
    read = map_batches(docs.select("text", "lang", "source"), count, "lang string, source string, term string, n long, docs long")
    return read.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column, p: DivergenceParams) -> Column:
    """1 + floor(UNIT * (count + smooth) / (total + smooth * kept)), in longs."""
    whole = total + p.smooth * kept
    part = (count + p.smooth) * COARSE
    div = lambda a, b: F.call_function("div", a, b)
    return 1 + div(part, whole) * FINE + div((part % whole) * FINE, whole)


def shares(counts: np.ndarray, whole: int, p: DivergenceParams) -> np.ndarray:
    part = (counts + p.smooth) * COARSE
    return 1 + part // whole * FINE + part % whole * FINE // whole


def consed(leaves: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Hash-consed trees over the rows of ``leaves`` (width a power of two). Returns per level, from the
    root down, each tree's node ids by place (the last level: ids of counts), the distinct counts, and per
    inner level the (left, right) ids of each distinct node."""
    values, ids = np.unique(leaves, return_inverse=True)
    ids = ids.reshape(leaves.shape)
    levels, children = [ids], []
    while ids.shape[1] > 1:
        left, right = ids[:, 0::2].astype(np.int64), ids[:, 1::2].astype(np.int64)
        most = int(ids.max()) + 1
        nodes, ids = np.unique(left * most + right, return_inverse=True)
        ids = ids.reshape(left.shape)
        levels.append(ids)
        children.append(np.stack([nodes // most, nodes % most], axis=1))
    return levels[::-1], values, children[::-1]


def priced(u: int, v: int, values: np.ndarray, children: list[np.ndarray], price) -> int:  # noqa: ANN001
    """Sum of ``price(counts of u, counts of v)`` over the leaves of two trees, walked together from their
    roots: each distinct pair of nodes of a level is followed, and each pair of counts priced, once."""
    left, right = np.array([u]), np.array([v])
    inverses = []
    for nodes in children:
        a, b = nodes[left].ravel(), nodes[right].ravel()  # left and right child of every pair, in turn
        span = int(b.max()) + 1
        pairs, inverse = np.unique(a.astype(np.int64) * span + b, return_inverse=True)
        left, right = pairs // span, pairs % span
        inverses.append(inverse)
    cost = price(values[left], values[right])
    for inverse in reversed(inverses):
        cost = cost[inverse].reshape(-1, 2).sum(axis=1)
    return int(cost[0])


NO_TERM = -1  # leaf beyond a block's last term


def block_distances(pdf: pd.DataFrame, p: DivergenceParams) -> pd.DataFrame:
    """Distances over one block between the sources of two tiles (each pair once, smaller name first:
    a group's rows come in any order, another in each block)."""
    width = int(pdf["width"].iloc[0])
    leaves = np.full((len(pdf), 1 << (width - 1).bit_length()), NO_TERM, np.int64)
    leaves[:, :width] = 0
    for i, (places, counts) in enumerate(zip(pdf["places"], pdf["counts"], strict=True)):
        if places is not None:
            leaves[i, places] = counts
    levels, values, children = consed(leaves)
    root, whole = levels[0][:, 0], (pdf["total"] + p.smooth * pdf["kept"]).to_numpy()
    names, tiles = pdf["source"].to_numpy(), pdf["tile"].to_numpy()
    low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
    rows = []
    for i in np.flatnonzero(tiles == low):
        for j in np.flatnonzero(tiles == high):
            if low == high and i >= j:
                continue
            def price(a: np.ndarray, b: np.ndarray, wi: int = int(whole[i]), wj: int = int(whole[j])) -> np.ndarray:
                return np.where(a == NO_TERM, 0, np.abs(shares(a, wi, p) - shares(b, wj, p)))
            rows.append((*sorted((names[i], names[j])), priced(root[i], root[j], values, children, price)))
    out = pd.DataFrame(rows, columns=["one", "other", "value"])
    out.insert(0, "lang", pdf["lang"].iloc[0])
    return out


def divergence(docs: DataFrame, p: DivergenceParams = DivergenceParams()) -> DataFrame:
    """``lang, source, part, item, value, rank`` for all groups of ``docs`` (``text, lang, source``)."""
    small = lambda df: sized_hint(df, df.count(), p.broadcast_rows)  # noqa: E731  a few columns of aggregates that `cut` has written
    counts = cut(term_counts(docs, p), "divergence-counts")
    used = counts.where(F.col("term") != "")
    vocabulary = cut(used.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
                     .where(F.col("docs") >= p.min_docs).drop("docs"), "divergence-vocabulary")
    sizes = cut(vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
                .withColumn("blocks", F.ceil(F.col("kept") / p.block_terms)), "divergence-languages")
    place = Window.partitionBy("lang", "block").orderBy("term")
    placed = cut(vocabulary.join(small(sizes), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
                 .withColumn("place", F.row_number().over(place) - 1).drop("blocks"), "divergence-terms")
    kept = cut(used.drop("docs").join(placed, ["lang", "term"]), "divergence-kept")
    group = cut(counts.where(F.col("term") == "").select("lang", "source").join(
        kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0, ["total"]), "divergence-groups")

    # Pairs. Every group has a row in every block of its language, with or without counts there.
    tiled = group.join(group.groupBy("lang").agg(F.ceil(F.count("*") / p.tile).alias("tiles")), "lang").withColumn(
        "tile", F.pmod(F.xxhash64("source"), "tiles"))
    widths = cut(placed.groupBy("lang", "block").agg(F.count("*").alias("width"), F.first("kept").alias("kept")), "divergence-blocks")
    vectors = kept.groupBy("lang", "source", "block").agg(F.collect_list(F.struct("place", "n")).alias("at"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    paired = (tiled.join(small(widths), "lang").join(vectors, ["lang", "source", "block"], "left")
              .withColumns({"places": F.col("at.place"), "counts": F.col("at.n")}).drop("at")
              .withColumn("with", other).withColumns({"low": F.least("tile", "with"), "high": F.greatest("tile", "with")}))
    part = paired.groupBy("lang", "block", "low", "high").applyInPandas(
        lambda pdf: block_distances(pdf, p), "lang string, one string, other string, value long")
    sums = part.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(
        F.struct(F.col("one").alias("source"), F.col("other").alias("item")),
        F.struct(F.col("other").alias("source"), F.col("one").alias("item")))).alias("x"), "value").select("lang", "x.*", "value")
    none = group.join(sizes, "lang", "left_anti")  # languages without kept terms
    zero = none.alias("a").join(none.alias("b"), "lang").where(F.col("a.source") != F.col("b.source")).select(
        "lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.lit(0).cast("long").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.unionByName(zero).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    # Terms: the first ranks of a group are found within tasks before rows meet.
    excess = share(F.col("n"), F.col("total"), F.col("kept"), p) - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"), p)
    more = kept.join(small(group), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), excess.alias("value")).where(F.col("value") > 0)
    terms_ = more.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank")).where(F.col("rank") <= p.ranks)
    return pairs.unionByName(terms_)


def oracle_sql(p: DivergenceParams = DivergenceParams()) -> str:
    """The same rows as DuckDB SQL over ``documents``."""
    def share_sql(count: str, total: str) -> str:
        return f"1 + ({UNIT}::HUGEINT * ({count} + {p.smooth})) // ({total} + {p.smooth} * v)"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
lt AS (
  SELECT lang, term, count(*) AS ln FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {p.min_docs}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
full_ AS (
  SELECT g.lang, g.source, lt.term, lt.ln, coalesce(c.n, 0) AS n
  FROM g JOIN lt USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = lt.term),
t AS (
  SELECT *, count(*) OVER (PARTITION BY lang, source) AS v, sum(n) OVER (PARTITION BY lang, source) AS total,
    sum(ln) OVER (PARTITION BY lang, source) AS ltotal
  FROM full_),
s AS (SELECT lang, source, term, n, {share_sql('n', 'total')} AS p, {share_sql('ln', 'ltotal')} AS q FROM t),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce((
    SELECT sum(abs(x.p - y.p)) FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM s WHERE n > 0 AND p > q),
r AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS "rank" FROM r
QUALIFY part = 'pair' OR "rank" <= {p.ranks}"""
