"""Document fingerprints against a plain version, and edge cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hubrisk.llm import fingerprints as G
from hubrisk.llm import queries
from llm_helpers import LONG, SF


def plain_sketch(text, p=G.SketchParams()):
    words = text.lower().split()
    cut = [words[i:i + p.width] for i in range(max(1, len(words) - p.width + 1))] if words else []
    hashes = {hashlib.md5(" ".join(w).encode()).hexdigest()[:p.digits] for w in cut}
    return sorted(h for h in hashes if h < p.below) or sorted(hashes)[:1]


def alike(a, b):
    return 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))


def check(rows, got):
    """``rows`` (id, text) by descending id, nulls last, then text; ``got`` in any order."""
    texts = [(i, t or "") for i, t in rows]
    texts.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for k, (i, t) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        a, b, c = map(plain_sketch, (t, edited, following))
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), alike(a, b), alike(a, c)))
    assert sorted(want) == sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got)


def test_equals_plain_version_over_edge_cases(spark, odd):
    check([(r.doc_id, r.text) for r in odd.collect()], G.fingerprints(odd).collect())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40])
def test_neighbours_of_sparse_ids(spark, n):
    """Ids far apart, negative and repeated, over more buckets than rows; the last row wraps round."""
    pick = random.Random(n)
    rows = [(pick.choice([pick.randrange(-10**12, 10**12), pick.randrange(5)]), f"{k} é " + " ".join(pick.choices("abcdef", k=pick.randrange(12)))) for k in range(n)]
    check(rows, G.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_null_ids_and_one_hot_id(spark):
    rows = [(None, "a b"), (None, "c d e f g h"), *[(7, f"w{k} x y z u v") for k in range(30)], (3, "t"), (3, "t")]
    check(rows, G.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_sketches_merge_and_estimate_containment(spark):
    words = LONG.split()
    long, part = " ".join(words), " ".join(words[:2000])
    r = spark.createDataFrame([(long, part, "a b", "")], "a string, b string, c string, d string").select(
        *[G.sketch(F.col(c)).alias(c) for c in "abcd"]).select(
            "a", "b", G.merged(F.col("a"), F.col("b")).alias("ab"), G.merged(F.col("b"), F.col("c")).alias("bc"), G.merged(F.col("c"), F.col("d")).alias("cd"),
            "c", "d", G.containment(F.col("b"), F.col("a")).alias("inside"), G.containment(F.col("a"), F.col("b")).alias("share"),
            G.jaccard(F.col("d"), F.col("d")).alias("none")).first()
    assert r.a == plain_sketch(long) and r.ab == r.a and r.cd == r.c and r.d == []
    assert r.bc == sorted(h for h in {*r.b, *r.c} if h < "4")  # a fallback hash goes when others are below the threshold
    assert r.inside == 1.0 and abs(r.share - 0.1) < 0.03 and r.none == 1.0


def test_no_python_on_executors(spark):
    plan = queries.QUERIES["op11_document_fingerprints"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan and plan.count("Exchange") == 1
