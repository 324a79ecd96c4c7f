"""Operator 11, document fingerprints: threshold-scaled sketches of word shingles.

A text's sketch holds every five-word shingle whose hash lies below a fixed fraction of the hash range
(the first 64 bits of MD5, as hex text, which sorts like the number). The fraction is the same for all
texts, so a long text keeps proportionally more hashes than a short one, sketches of parts merge to the
sketch of the whole (``merged``), and the share of one sketch found in another estimates containment also
between very unequal documents (``containment``). A text none of whose hashes is below the threshold keeps
its smallest one instead; ``merged`` keeps to that rule, so merging stays exact.

``fingerprints`` also sets each document beside the next one in descending id order. Neighbours are found
without a global sort: splitters counted from the ids cut them into buckets, the first row of a bucket is
copied to the bucket before, and a window per bucket reads the next row. Texts are shuffled once. All
steps are built-in functions.

Defined results: a null text is ''. A text without words has an empty sketch; two empty sketches are
alike (1.0), an empty and another one are not (0.0). A text of fewer than five words is one shingle; very
long texts are read whole. Rows with a null id come after all others; rows of one id are ordered by their
text, and repeated rows follow each other (rows of one id share a bucket, which spills if it is large). The
last row is followed by the first, a single row by itself. An empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubrisk.llm.common import WHITE


@dataclass(frozen=True)
class SketchParams:
    width: int = 5             # words in a shingle
    below: str = "4"           # kept hashes sort before this hex text: a quarter of the range
    digits: int = 16           # hex digits of a hash
    buckets: int = 4           # buckets of neighbours for each shuffle partition


def shingle_hashes(text: Column, p: SketchParams = SketchParams()) -> Column:
    """Hashes of all shingles of a lower-cased text, in order; empty without words."""
    bare = F.btrim(F.lower(text), F.lit(WHITE))
    words = F.split(bare, r"[\x20\x09-\x0D]+")
    windows = lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (p.width - 1))),
        lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, p.width), " ")), 1, p.digits))
    # The words are split once: a one-element array hands them to the windows.
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(F.array(words), windows)))


def thinned(hashes: Column, p: SketchParams = SketchParams()) -> Column:
    """The sketch of a set of hashes: sorted, those below the threshold, or else the smallest."""
    low = F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < p.below)))
    return F.when(F.exists(hashes, lambda h: h < p.below), low).when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(hashes)


def sketch(text: Column, p: SketchParams = SketchParams()) -> Column:
    return F.get(F.transform(F.array(shingle_hashes(text, p)), lambda h: thinned(h, p)), 0)


def merged(one: Column, other: Column, p: SketchParams = SketchParams()) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    return thinned(F.array_union(one, other), p)


def jaccard(one: Column, other: Column) -> Column:
    """Estimated shared part of both shingle sets (0 to 1)."""
    both = F.size(F.array_intersect(one, other)).cast("double")
    return F.when((F.size(one) == 0) & (F.size(other) == 0), 1.0).otherwise(both / (F.size(one) + F.size(other) - both))


def containment(one: Column, other: Column) -> Column:
    """Estimated part of the first shingle set that the second one holds."""
    return F.when(F.size(one) == 0, F.when(F.size(other) == 0, 1.0).otherwise(0.0)).otherwise(
        F.size(F.array_intersect(one, other)).cast("double") / F.size(one))


def _bucket(key: Column, splits: list[float]) -> Column:
    """Number of splitters that the (descending) key is below: coarse splitters first, then those between."""
    if not splits:
        return F.lit(0)
    step = max(1, int(len(splits) ** 0.5))
    groups = [splits[i:i + step] for i in range(0, len(splits), step)]
    coarse = F.array(*[F.lit(g[-1]) for g in groups])
    fine = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    passed = F.size(F.filter(coarse, lambda s: key < s))
    within = F.coalesce(F.size(F.filter(F.get(fine, passed), lambda s: key < s)), F.lit(0))
    return passed * step + within


def beside_next(docs: DataFrame, id_: str, order: list[str], p: SketchParams) -> DataFrame:
    """``docs`` with the columns of the following row by descending ``id_`` (then ``order``) as ``next_<name>``;
    the last row's is the first one."""
    spark, key = docs.sparkSession, F.col(id_).cast("double")
    n = p.buckets * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.percentile_approx(key, F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(100 * n))
    splits = sorted(set(docs.agg(at.alias("at")).first().at or []), reverse=True)
    bucket = F.when(F.col(id_).isNull(), len(splits)).otherwise(_bucket(key, splits))
    placed = docs.withColumn("_bucket", bucket)
    # One row a bucket, whose number the session's partitions set.
    heads = sorted(tuple(r) for r in placed.groupBy("_bucket").agg(F.max(id_)).collect())
    before = {b: (heads[i - 1][0], head) for i, (b, head) in enumerate(heads)}
    is_head = F.lit(False)
    to = F.lit(None).cast("int")
    if before:
        first = F.create_map(*[F.lit(x) for b, (_, head) in before.items() for x in (b, head)])
        back = F.create_map(*[F.lit(x) for b, (prev, _) in before.items() for x in (b, prev)])
        is_head = F.col(id_).eqNullSafe(F.get(F.array(first[F.col("_bucket")]), 0))
        to = back[F.col("_bucket")]
    copies = F.when(is_head, F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("copy")), F.struct(to.alias("b"), F.lit(True).alias("copy")))).otherwise(
        F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("copy"))))
    dealt = placed.withColumn("_to", F.explode(copies)).drop("_bucket")
    line = Window.partitionBy("_to.b").orderBy("_to.copy", F.desc_nulls_last(id_), *order)
    # A lead for each column: one of a struct would send every column twice.
    return dealt.withColumns({f"next_{c}": F.lead(c).over(line) for c in docs.columns}).where(~F.col("_to.copy")).drop("_to")


def fingerprints(docs: DataFrame, p: SketchParams = SketchParams()) -> DataFrame:
    """One row per document of ``docs`` (``doc_id, text``): its fingerprint, that of its text with the second
    half replaced by the next document's beginning, and how alike they are."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    beside = beside_next(rows.withColumn("sketch", sketch(F.col("text"), p)), "doc_id", ["text"], p)
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    own, new, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return beside.withColumn("n_chars", n).withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), p)).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join(own, "").alias("fingerprint"), F.array_join(new, "").alias("edited_fingerprint"),
        jaccard(own, new).alias("near_edited"), jaccard(own, following).alias("near_next"),
        containment(own, new).alias("part_in_edited"), containment(own, following).alias("part_in_next"))


def oracle_sql(p: SketchParams = SketchParams()) -> str:
    """The same rows as DuckDB SQL over ``documents``."""
    space = "[\\x20\\x09-\\x0D]+"
    follow = ", ".join(f"lead(word, {k}) OVER l AS w{k}" for k in range(1, p.width))
    names = ", ".join(["word", *(f"w{k}" for k in range(1, p.width))])

    def near(o: str) -> str:
        both = f"len(list_intersect(sk, {o}))"
        return f"CASE WHEN len(sk) = 0 AND len({o}) = 0 THEN 1.0 ELSE {both}::DOUBLE / (len(sk) + len({o}) - {both}) END"

    def part(o: str) -> str:
        return (f"CASE WHEN len(sk) = 0 THEN CASE WHEN len({o}) = 0 THEN 1.0 ELSE 0.0 END "
                f"ELSE len(list_intersect(sk, {o}))::DOUBLE / len(sk) END")
    return f"""
WITH o AS (
  SELECT row_number() OVER w AS n, doc_id, coalesce(text, '') AS text FROM documents
  WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, coalesce(text, ''))),
e AS (
  SELECT a.n, a.doc_id, a.text, b.n AS next_n, length(a.text) AS n_chars,
    left(a.text, length(a.text) - length(a.text) // 2) || left(b.text, length(a.text) // 2) AS edited
  FROM o a JOIN o b ON b.n = CASE WHEN a.n = (SELECT max(n) FROM o) THEN 1 ELSE a.n + 1 END),
t AS (SELECT n, 0 AS kind, lower(text) AS text FROM e UNION ALL SELECT n, 1, lower(edited) FROM e),
u AS (SELECT n, kind, unnest(regexp_split_to_array(text, '{space}')) AS word, generate_subscripts(regexp_split_to_array(text, '{space}'), 1) AS pos FROM t),
f AS (SELECT n, kind, {follow}, word, row_number() OVER l AS place FROM u WHERE word <> '' WINDOW l AS (PARTITION BY n, kind ORDER BY pos)),
h AS (
  SELECT n, kind, left(md5(concat_ws(' ', {names})), {p.digits}) AS h FROM f WHERE w{p.width - 1} IS NOT NULL OR place = 1),
s AS (
  SELECT n, kind, coalesce(list_sort(list(DISTINCT h) FILTER (WHERE h < '{p.below}')), [min(h)]) AS sk FROM h GROUP BY n, kind),
k AS (
  SELECT e.*, coalesce(x.sk, []) AS sk, coalesce(y.sk, []) AS ek, coalesce(z.sk, []) AS nk
  FROM e LEFT JOIN s x ON x.n = e.n AND x.kind = 0 LEFT JOIN s y ON y.n = e.n AND y.kind = 1
    LEFT JOIN s z ON z.n = e.next_n AND z.kind = 0)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(sk, '') AS fingerprint,
  array_to_string(ek, '') AS edited_fingerprint, {near('ek')} AS near_edited, {near('nk')} AS near_next,
  {part('ek')} AS part_in_edited, {part('nk')} AS part_in_next
FROM k"""
