"""Operator 9, n-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Two sets of word shingles link when ``100 * intersection >= pct * union``. Then their prefixes (the
first n - ceil(pct * n / 100) + 1 shingles in one global order) share a shingle. The order is
rare-first, so that prefixes of unrelated documents share nothing:

1. ``marks``: shingles of two documents or more are marked in a bitmap (16 MB, growing with the text up to
   128 MB), very frequent ones in a second one. The order is: unmarked, marked, frequent; by hash within each.
2. ``prepare``: per document its set's size, 128-bit name, prefix and 512-bit signature. An unmarked
   shingle of a range with theta 2 occurs in one document only, so it needs no partner search.
   Documents whose prefix has no other shingles drop out here. Equal sets share their name: copies
   of any number are one node from here on.
3. ``near``: rows (shingle, node) meet by shingle. In a group, each node is paired with the group's
   most typical node and with its neighbour. Verified links give first components; then, for
   groups that still hold several components, all pairs between different ones that pass the length
   and positional filters, in blocks of bounded size.
4. ``verify``: pairs pass the suffix filter (signatures bound the symmetric difference), then each is
   verified once on the whole sets.

No link between different components is ever skipped, so the components of ``jaccard_components`` are
exact; pairs inside a component that is already connected are not all verified there. ``jaccard_links``
skips step 3's components: every pair of different sets that shares a prefix shingle and passes the
filters is verified, and each row has its number of links. Its work grows with the number of pairs of
different sets in a group, because each pair is a link of its own; equal sets stay one node.

Broadcast: the two bitmaps, of bounded size. A full one would mark shingles of one document, so that all
documents had prefixes to send. Hot shingles: blocks of ``block`` rows, spread by hash.

Defined results: a null, empty or wordless text has 0 shingles and is its own component; repeated
rows (also of one id) are nodes of their sets like any others; a null id takes part in links, and a
component is named by its smallest non-null id; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from hubrisk.llm.common import cut, give_back, map_batches, sized_hint
from hubrisk.llm.components import components
from hubrisk.llm.marks import MarkParams, Marks, repeated_marks
from hubrisk.llm.shingles import WordHash, set_key, shingle_set


@dataclass(frozen=True)
class JoinParams:
    width: int = 5
    pct: int = 75
    marks: MarkParams = MarkParams(spare=0, most_bits=30)
    block: int = 1500          # rows of one block of a hot shingle


def words_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))


# --- prefixes --------------------------------------------------------------------------------

SIGNATURE = 8  # longs
PREPARED = "doc_id long, n long, key binary, rare float, prefix array<long>, places array<int>, shingles binary, signature array<long>"


def signature(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 512 hash classes: two signatures differ in at most
    as many bits as the sets differ in members."""
    odd = np.bincount((s & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def prepare(words: DataFrame, p: JoinParams) -> DataFrame:
    """One row per input row. Prefix, set and signature only where the prefix can meet another one."""
    width, mp = p.width, p.marks

    def reader():
        seen = WordHash()
        return lambda t: shingle_set(seen.of(t), width)
    m = repeated_marks(words.select("text"), reader, mp)
    sent = words.sparkSession.sparkContext.broadcast((m.repeated, m.often, m.theta))  # bounded size
    sizes = m.mark_bits, m.often_bits

    def run(batches: Iterator[list[list]]) -> Iterator[dict]:
        seen, marks = WordHash(), Marks(*sent.value, *sizes)
        for ids, texts in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in PREPARED.split(", ")}
            out["doc_id"] = ids
            for t in texts:
                s = shingle_set(seen.of(t), p.width)
                n = len(s)
                level = marks.level(s)
                order = np.argsort(level, kind="stable")[:n - -(-p.pct * n // 100) + 1]
                first = s[order]
                single = marks.single(first, level[order])
                at = np.nonzero(~single)[0]
                found = len(at) > 0
                out["n"].append(n)
                out["key"].append(set_key(s))
                out["rare"].append(np.count_nonzero(level == 0) / n if n else 0.0)
                out["prefix"].append(first[at].view(np.int64) if found else None)
                out["places"].append(at if found else None)
                out["shingles"].append(s.tobytes() if found else None)
                out["signature"].append(signature(s) if found else None)
            yield out
        del seen, marks
        give_back()
    prepared = cut(map_batches(words, run, PREPARED), "shingle-sets")
    sent.destroy()
    return prepared


# --- candidates ------------------------------------------------------------------------------


def length_ok(x: Column, y: Column, pct: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * pct


def postings(nodes: DataFrame) -> DataFrame:
    """(gram, place, key, n, rare) of every prefix shingle that may have a partner."""
    return nodes.select("key", "n", "rare", F.explode(F.arrays_zip("prefix", "places")).alias("x")).select(
        F.col("x.prefix").alias("gram"), F.col("x.places").alias("place"), "key", "n", "rare")


def star_pairs(posts: DataFrame, p: JoinParams) -> DataFrame:
    """Each node with the most typical one of its shingle's group (fewest rare shingles) and with the
    one before it. Groups are salted by 16: a hot shingle is 16 sorted runs, whose heads meet again."""
    def linked(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("rare", "key")
        me = F.struct("key", "n")
        return rows.withColumns({"head": F.first(me).over(w), "prev": F.lag(me).over(w)})
    runs = linked(posts.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(16))), ["gram", "salt"])
    heads = linked(runs.filter("prev IS NULL").drop("head", "prev"), ["gram"])
    out = None
    for rows in (runs, heads):
        for partner in ("head", "prev"):
            pairs = rows.filter(F.col(partner).isNotNull() & (F.col(f"{partner}.key") != F.col("key"))
                                & length_ok(F.col("n"), F.col(f"{partner}.n"), p.pct)).select(
                F.least("key", f"{partner}.key").alias("a"), F.greatest("key", f"{partner}.key").alias("b"))
            out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def cross_pairs(posts: DataFrame, comps: DataFrame | None, nodes: DataFrame, p: JoinParams) -> DataFrame:
    """Pairs of different components that share a prefix shingle and pass the length, positional and
    suffix filters. Without ``comps`` each set is its own component: all such pairs of different sets."""
    if comps is None:
        named = posts.drop("rare").withColumn("component", F.col("key"))
    else:
        named = posts.drop("rare").join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn(
            "component", F.coalesce("component", "key"))
        named = cut(named, "postings", posts.count())
    groups = named.groupBy("gram").agg(F.count("*").alias("rows"), F.min("component").alias("lo"),
                                       F.max("component").alias("hi")).filter("lo <> hi")
    groups = groups.select("gram", F.ceil(F.col("rows") / p.block).cast("int").alias("blocks"))
    rows = named.join(groups, "gram").join(nodes.select("key", "signature"), "key").withColumn("own", F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("gram", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"),
                       (F.col("own") <= F.col("other")).alias("left"), "key", "component", "n", "place", "signature")
    # Rows of a group (gram, b1, b2) meet; left rows are block b1, the others block b2.
    spread = rows.repartition("gram", "b1", "b2").sortWithinPartitions("gram", "b1", "b2")
    pct = p.pct

    def meet(batches: Iterator[list[list]]) -> Iterator[dict]:
        held: list[tuple] = []

        def pairs() -> dict:
            diagonal = held[0][1] == held[0][2]
            left = [r for r in held if r[3]]
            right = left if diagonal else [r for r in held if not r[3]]
            out: set[tuple[bytes, bytes]] = set()
            if left and right:
                rn, rp = (np.array([r[k] for r in right], np.int64) for k in (6, 7))
                names = {c: i for i, c in enumerate({r[5] for r in left} | {r[5] for r in right})}
                rc = np.array([names[r[5]] for r in right])
                rs = np.array([r[8] for r in right], np.int64).view(np.uint64)
                for k, r in enumerate(left):
                    n, place = r[6], r[7]
                    ok = (rc != names[r[5]]) & (100 * np.minimum(n, rn) >= pct * np.maximum(n, rn))
                    most = 1 + np.minimum(n - place, rn - rp) - 1
                    ok &= (100 + pct) * most >= pct * (n + rn)
                    if diagonal:
                        ok[:k + 1] = False
                    near = np.nonzero(ok)[0]
                    # intersection >= pct / (100 + pct) * total: the sets differ in at most the rest
                    differ = np.bitwise_count(rs[near] ^ np.array(r[8], np.int64).view(np.uint64)).sum(1, dtype=np.int64)
                    for j in near[differ * (100 + pct) <= (n + rn[near]) * (100 - pct)]:
                        x, y = r[4], right[j][4]
                        out.add((x, y) if x < y else (y, x))
            return {"a": [x for x, _ in out], "b": [y for _, y in out]}
        for cols in batches:
            for row in zip(*cols):
                if held and row[:3] != held[0][:3]:
                    if len(held) > 1:
                        yield pairs()
                    held = []
                held.append(row)
        if len(held) > 1:
            yield pairs()
    return map_batches(spread, meet, "a binary, b binary").distinct()


# --- verification ----------------------------------------------------------------------------


def verify(pairs: DataFrame, nodes: DataFrame, p: JoinParams) -> DataFrame:
    """The pairs that link: suffix filter on signatures, then one exact comparison of the whole sets."""
    side = lambda k, *cols: nodes.select(F.col("key").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in cols])
    close = pairs.join(side("a", "n", "signature"), "a").join(side("b", "n", "signature"), "b")
    differ = sum((F.bit_count(F.get("signature_a", F.lit(i)).bitwiseXOR(F.get("signature_b", F.lit(i))))
                  for i in range(SIGNATURE)), F.lit(0))
    # intersection >= pct / (100 + pct) * total, so the sets differ in at most (100 - pct) / (100 + pct) of it
    close = close.filter(differ * (100 + p.pct) <= (F.col("n_a") + F.col("n_b")) * (100 - p.pct)).select("a", "b")
    both = close.join(side("a", "shingles"), "a").join(side("b", "shingles"), "b")
    pct = p.pct

    def compare(batches: Iterator[list[list]]) -> Iterator[dict]:
        for a, b, x, y in batches:
            keep = []
            for k, (s, t) in enumerate(zip(x, y)):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                common = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * common >= pct * (len(s) + len(t) - common):
                    keep.append(k)
            yield {"a": [a[k] for k in keep], "b": [b[k] for k in keep]}
    return map_batches(both.select("a", "b", "shingles_a", "shingles_b"), compare, "a binary, b binary")


def written_nodes(prepared: DataFrame) -> DataFrame:
    """One row of each set that may have a partner; rows hold whole sets, so files have fewer of them."""
    nodes = prepared.filter("prefix IS NOT NULL").drop("doc_id")
    return cut(nodes.dropDuplicates(["key"]), "nodes", nodes.count(), 4096)


def near(prepared: DataFrame, p: JoinParams) -> DataFrame:
    """(node, component) of every set that links with a different one."""
    nodes = written_nodes(prepared)
    posts = cut(postings(nodes), "postings")
    first = cut(verify(star_pairs(posts, p), nodes, p), "links")
    comps = cut(components(first), "components", 2 * first.count())
    more = cut(verify(cross_pairs(posts, comps, nodes, p), nodes, p), "links")
    if more.isEmpty():
        return comps
    return components(first.unionByName(more))


def all_links(prepared: DataFrame, p: JoinParams) -> DataFrame:
    """(a, b), a < b: every pair of different sets that links, once."""
    nodes = written_nodes(prepared)
    posts = cut(postings(nodes), "postings")
    return cut(verify(cross_pairs(posts, None, nodes, p), nodes, p), "links")


def jaccard_components(docs: DataFrame, params: JoinParams = JoinParams(), doc_id: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id."""
    prepared = prepare(words_of(docs, doc_id, text), params)
    return named_rows(prepared, near(prepared, params)).drop("key")


def named_rows(prepared: DataFrame, comps: DataFrame) -> DataFrame:
    """Per input row: key, doc_id, n_shingles, component_id."""
    comps = comps.withColumnRenamed("node", "key")
    rows = prepared.select("doc_id", "n", "key")
    ids = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    # Classes of one row without links need no name.
    table = ids.join(comps, "key", "left").filter("copies > 1 OR component IS NOT NULL").withColumn(
        "component", F.coalesce("component", "key"))
    lowest = table.groupBy("component").agg(F.min("low").alias("component_id"))
    names = table.join(lowest, "component").select("key", "component_id")
    return rows.join(names, "key", "left").select(
        "key", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_links(docs: DataFrame, params: JoinParams = JoinParams(), doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id and n_links, the number of other rows that it
    links with (rows with an equal set among them)."""
    prepared = prepare(words_of(docs, doc_id, text), params)
    links = all_links(prepared, params)
    copies = prepared.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("copies"))
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ways.join(copies.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.sum("copies").alias("linked"))
    counts = copies.join(linked, "key", "left").select("key", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    counts = counts.filter("n_links > 0")
    return named_rows(prepared, components(links)).join(counts, "key", "left").select(
        "doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_duplicates(docs: DataFrame, params: JoinParams = JoinParams(), doc_id: str = "doc_id", text: str = "text",
                         broadcast_rows: int = 500_000) -> DataFrame:
    """One document of each component stays, that of the smallest id. Rows of one id count as one
    document: equal texts among them are reduced to one row. Rows with a null id stay."""
    classes = cut(jaccard_components(docs, params, doc_id, text), "classes")
    drop = classes.filter("doc_id <> component_id").select(F.col("doc_id").alias("_drop")).distinct()
    twice = classes.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_drop")).count().filter("count > 1").drop("count")
    rows = classes.count()
    drop, twice = cut(drop, "drop", rows), cut(twice, "twice", rows)
    i = F.col(f"`{doc_id}`")
    drop = sized_hint(drop, drop.count(), broadcast_rows)
    kept = docs.join(drop, i == F.col("_drop"), "left_anti")
    if twice.isEmpty():
        return kept
    again = kept.join(twice, i == F.col("_drop"), "left_semi").dropDuplicates([doc_id, text])
    return kept.join(twice, i == F.col("_drop"), "left_anti").unionByName(again)


def oracle_sql(width: int = 5, pct: int = 75) -> str:
    """The same classes in DuckDB SQL over ``documents`` (distinct, non-null ids)."""
    return f"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [w]
      ELSE list_transform(generate_series(1, len(w) - {width - 1}), lambda i: w[i:i + {width - 1}]) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {pct} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, t.doc_id)::BIGINT AS component_id
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id"""
