"""Path-template tree: verdicts do not depend on the number of siblings or on depth; a brute-force tree."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hubrisk.llm import queries
from hubrisk.llm import url_templates as U
from llm_helpers import SF

LABELS = "url_key string, bad boolean"


def verdicts(spark, rows, labels):
    pages = spark.createDataFrame(rows, "page_id long, url string")
    return {r.page_id: r.verdict for r in U.url_filter(pages, spark.createDataFrame(labels, LABELS)).collect()}


@pytest.mark.parametrize("sections", [8, 32, 33, 100, 2000])
def test_one_bad_section_among_any_number(spark, sections):
    rows = [(s * 100 + i, f"http://h.org/sec{chr(97 + s % 26)}{'x' * (s // 26)}/{s * 100 + i}") for s in range(sections) for i in range(20 if s < 40 else 1)]
    got = verdicts(spark, rows, [(str(i), i < 100) for i, _ in rows])
    assert {got[i] for i, _ in rows if i < 100} == {"block"} and {got[i] for i, _ in rows if i >= 100} == {"allow"}


@pytest.mark.parametrize("depth", [2, 6, 7, 11, 12, 13, 14, 15, 16, 40, 300])
def test_deep_branches_are_judged_apart(spark, depth):
    head = "/".join(f"d{chr(97 + k % 26)}" for k in range(depth))
    rows = [(i, f"http://h.org/{head}/{'bad' if i < 30 else 'good'}/{i}") for i in range(60)]
    got = verdicts(spark, rows, [(str(i), i < 30) for i in range(60)])
    assert {got[i] for i in range(30)} == {"block"} and {got[i] for i in range(30, 60)} == {"allow"}


def test_segments_are_kept_whole(spark):
    paths = ["", "/", "/a", *["/" + "/".join(f"s{chr(97 + k % 26)}" for k in range(n)) for n in (11, 12, 13, 14, 15, 18, 19, 26, 500)]]
    for r in spark.createDataFrame([(p,) for p in paths], "path string").select("path", U.typed_segments(F.col("path"), 12).alias("t")).collect():
        segments = [x for x in r.path.split("/") if x]
        assert "/".join(r.t) == "/".join(segments) and r.t[:12] == segments[:12] and len(r.t) <= 12 + math.log2(len(segments) + 2) + 1


def plain_tree(counts, p):
    """(host, typed) -> template, from (host, typed, n, labelled, bad)."""
    bound = lambda n, m: math.sqrt(0.5 * math.log(2 / p.alpha)) * (n ** -0.5 + m ** -0.5)
    out = {}

    def walk(rows, level, template):
        children = {}
        for r in rows:
            if len(r[1]) == level:
                out[r[0], r[1]] = template
            else:
                children.setdefault(r[1][level], []).append(r)
        add = lambda rs: [sum(r[k] for r in rs) for k in (2, 3, 4)] + [sum(r[2] for r in rs if len(r[1]) == level + 1)]
        n, labelled, bad, stops = add([r for c in children.values() for r in c])
        merged = {}
        for seg, c in children.items():
            cn, cl, cb, cs = add(c)
            same = abs(cs / cn - stops / n) <= bound(cn, n) and (not cl or abs(cb / cl - bad / labelled) <= bound(cl, labelled))
            merged.setdefault("{~}" if len(children) > 1 and same else seg, []).extend(c)
        for seg, c in merged.items():
            walk(c, level + 1, f"{template}/{seg}")
    for host in {r[0] for r in counts}:
        walk([r for r in counts if r[0] == host], 0, "")
    return out


def test_tree_equals_a_plain_one(spark):
    rnd, p = random.Random(3), U.TreeParams()
    counts = {}
    for _ in range(600):
        typed = tuple(rnd.choice("abcdefgh") + rnd.choice(["", "", "x", "y"]) for _ in range(rnd.randrange(6)))
        n = rnd.choice([1, 3, 40, 200])
        labelled = rnd.randrange(n + 1)
        counts[rnd.choice(["h", "h", "g"]), typed] = (n, labelled, labelled * (typed[:1] == ("a",)) if rnd.random() < 0.8 else rnd.randrange(labelled + 1))
    rows = [(h, t, *c) for (h, t), c in counts.items()]
    df = spark.createDataFrame([(h, list(t), *c) for h, t, *c in rows], "host string, typed array<string>, n long, labelled long, bad long")
    got = {(r.host, tuple(r.typed)): r.template for r in U.template_tree(df, p).collect()}
    assert got == plain_tree(rows, p) and len(set(got.values())) > 20


def test_query_verdicts_equal_a_plain_version(spark):
    """Host, path, rule and verdict of every page of the table."""
    got = queries.QUERIES["op5_url_filters"](spark, SF).collect()
    marks = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        bad = None if r.quality is None and r.toxic is None else bool(r.quality == 0 or r.toxic == 1)
        marks[str(r.doc_id)] = max(x for x in (marks.get(str(r.doc_id)), bad, False) if x is not None)
    counts, shapes, p = {}, {}, U.TreeParams()
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", U.typed_segments(U.path_of(F.col("url")), p.single).alias("typed")).collect()
    for r in pages:
        head, sep, rest = (r.url or "").partition("://")
        host, path = "", ""
        if sep:
            end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = rest[:end].translate({c: c + 32 for c in range(65, 91)})
            path = rest[end:].split("?")[0].split("#")[0]
        last = path.rstrip("/").rsplit("/", 1)[-1]
        key = last.split(".")[0] if "/" in path else ""
        fitting = [u for u in U.RULES if (host == u.host or host.endswith("." + u.host)) and path.startswith(u.path)]
        rule = max(fitting, key=lambda u: len(u.host + u.path), default=None)
        shapes[r.page_id] = (host, path, rule, tuple(r.typed))
        c = counts.setdefault((host, tuple(r.typed)), [0, 0, 0])
        c[0] += 1
        c[1] += key in marks
        c[2] += marks.get(key, False)
    tree = plain_tree([(*k, *c) for k, c in counts.items()], p)
    sums = {}
    for k, (_, labelled, bad) in counts.items():
        s = sums.setdefault((k[0], tree[k]), [0, 0])
        s[0] += labelled
        s[1] += bad
    prior = sum(s[1] for s in sums.values()) / max(1, sum(s[0] for s in sums.values()))
    for r in got:
        host, path, rule, typed = shapes[r.page_id]
        labelled, bad = sums[host, tree[host, typed]]
        own = "block" if (bad + p.prior_weight * prior) / (labelled + p.prior_weight) >= p.reject else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule.host + rule.path if rule else None, rule.verdict if rule else own)
    assert len(got) == len(pages)
