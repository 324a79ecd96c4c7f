"""Operator 5, URL filters: fixed host and path rules first, then a path-template tree.

Per host, the paths form a tree of segments. Typed segments (numbers, hex ids, dates) become
placeholders at once; level by level, siblings whose counts are statistically compatible with their
node's pooled ones (Hoeffding test on the share of bad labels and on the share of paths that end there)
merge into one wildcard branch, and those that differ stay branches of their own, however many siblings
there are. Thinly seen segments differ from nothing, so names that occur once are one wildcard. Levels
go on until no path has a further segment; below ``single`` segments a level takes 2, 4, 8, ... segments
together, so very long paths need few levels and still differ where their segments do. A template is rejected when its labelled purity, smoothed towards the overall rate of bad
labels, reaches ``reject``.

Everything is DataFrame code over distinct typed paths: pages are pre-aggregated (map side) before
any shuffle, so a host with a third of all rows arrives as its distinct typed paths. Nothing per
host is collected into one task. Only rejected templates go back to the pages; they are broadcast
when counted to be few, else joined.

Defined results: a null url or one without ``://`` has empty host and path, no rule, and the verdict
of the empty template; repeated rows are judged one by one; with no labels every unruled url is
allowed; ties between rules of one length go to block; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubrisk.llm.common import ascii_lower, cut, sized_hint


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str  # allow or block


#: Fixed values of the contract.
RULES: tuple[UrlRule, ...] = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class TreeParams:
    single: int = 12        # segments with a level of their own
    alpha: float = 0.05     # Hoeffding test level of a merge
    prior_weight: float = 10.0
    reject: float = 0.5
    broadcast_rows: int = 100_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: UrlRule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def by_length(rules: tuple[UrlRule, ...]) -> list[UrlRule]:
    return sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict != "block"))


def rule_of(rules: tuple[UrlRule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, null without one."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(by_length(rules)):
        ok = fits(r, host, path)
        found = F.when(ok, F.lit(r.host + r.path)).otherwise(found)
        verdict = F.when(ok, F.lit(r.verdict)).otherwise(verdict)
    return found, verdict


def typed_segments(path: Column, single: int) -> Column:
    """Array of segments with variable ones typed; those after the first ``single`` in runs of 2, 4, 8, ..."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    typed = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(
        s, r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", "{date}"),
        r"\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}\b", "{hex}"), r"[0-9]+", "{num}"))

    def runs(t: Column) -> Column:
        ends = F.sequence(F.lit(1), F.ceil(F.log2(F.size(t) - single + 2)).cast("int"))  # run k begins after single + 2**k - 2
        deep = F.transform(ends, lambda k: F.array_join(F.slice(t, (F.pow(F.lit(2), k) - 1 + single).cast("int"), F.pow(F.lit(2), k).cast("int")), "/"))
        return F.when(F.size(t) > single, F.concat(F.slice(t, 1, single), F.filter(deep, lambda s: s != ""))).otherwise(t)
    # The typed segments are made once: a one-element array hands them on.
    return F.get(F.transform(F.array(typed), runs), 0)


def _bound(alpha: float, n: Column, m: Column) -> Column:
    return F.lit(math.sqrt(0.5 * math.log(2.0 / alpha))) * (1 / F.sqrt(n) + 1 / F.sqrt(m))


def template_tree(counts: DataFrame, p: TreeParams) -> DataFrame:
    """``counts``: host, typed (array), n, labelled, bad, one row per distinct typed path. Adds ``template``."""
    work, done, level = counts.withColumn("template", F.lit("")), [], 0
    while True:
        more = F.size("typed") > level
        done.append(work.filter(~more))
        at = work.filter(more).withColumn("seg", F.get("typed", F.lit(level))).withColumn(
            "stops", F.when(F.size("typed") == level + 1, F.col("n")).otherwise(F.lit(0)))
        child = at.groupBy("host", "template", "seg").agg(
            *[F.sum(c).alias(c) for c in ("n", "labelled", "bad", "stops")])
        node = child.groupBy("host", "template").agg(
            F.count("*").alias("children"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad", "stops")])
        rate = lambda x, y: F.try_divide(F.col(x), F.col(y))
        same_bad = F.coalesce(F.abs(rate("bad", "labelled") - rate("all_bad", "all_labelled")) <= _bound(
            p.alpha, F.col("labelled"), F.col("all_labelled")), F.lit(True))
        same_stop = F.abs(rate("stops", "n") - rate("all_stops", "all_n")) <= _bound(p.alpha, F.col("n"), F.col("all_n"))
        new = F.when((F.col("children") > 1) & same_bad & same_stop, F.lit("{~}")).otherwise(F.col("seg"))
        names = child.join(node, ["host", "template"]).select("host", "template", "seg", new.alias("new"))
        # Each level reads the one before it several times.
        work = cut(at.join(names, ["host", "template", "seg"]).withColumn("template", F.concat("template", F.lit("/"), "new")).drop(
            "seg", "stops", "new"), "url-tree")
        level += 1
        if not work.take(1):
            return reduce(DataFrame.unionByName, done)


def rejected(templates: DataFrame, p: TreeParams) -> DataFrame:
    """(host, template, purity) of the templates to reject."""
    total = templates.agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")).first()
    prior = (total.b or 0) / total.l if total.l else 0.0
    sums = templates.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    purity = (F.col("bad") + p.prior_weight * prior) / (F.col("labelled") + p.prior_weight)
    return sums.withColumn("purity", purity).filter(F.col("purity") >= p.reject)


def url_filter(pages: DataFrame, labels: DataFrame, rules: tuple[UrlRule, ...] = RULES, params: TreeParams = TreeParams(),
               page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict. ``labels``: (url_key string, bad boolean), matched
    with the last segment of a path without its extension."""
    u = F.col(f"`{url}`")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    found, verdict = rule_of(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": found, "ruled": verdict})
    typed = typed_segments(F.col("path"), params.single)
    key = F.regexp_extract("path", r"([^/.]+)(?:\.[^/]*)?/*$", 1)
    marks = labels.filter("url_key IS NOT NULL").groupBy("url_key").agg(
        F.max(F.col("bad").cast("int")).alias("bad"))  # one row a key: a repeated label counts once
    shaped = rows.select("host", typed.alias("typed"), key.alias("url_key"))
    counts = cut(shaped.join(marks, "url_key", "left").groupBy("host", "typed").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "url-counts")
    tree = template_tree(counts, params)
    no = cut(tree.join(rejected(tree, params), ["host", "template"], "left_semi").select(
        "host", "typed", F.lit(True).alias("no")), "url-rejects")
    no = sized_hint(no, no.count(), params.broadcast_rows)
    judged = rows.withColumn("typed", typed).join(no, ["host", "typed"], "left")
    own = F.when(F.col("no"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"))


def table_labels(labels: DataFrame) -> DataFrame:
    """Labels of the ``labels`` table: the sites' paths end in the number of the document they show."""
    return labels.select(F.col("doc_id").cast("string").alias("url_key"),
                         ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
