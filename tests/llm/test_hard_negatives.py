"""Hard negatives against a brute-force version: clustered vectors of unequal lengths, ties, odd rows."""

import math
import random

import numpy as np
import pytest

from hubrisk.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, anchor int"


def brute(rows, p):
    seen = set()
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        seen.add((i, label, tuple(max(-H.LIMIT, min(H.LIMIT, math.floor(p.scale * float(np.float32(x))))) for x in v)))
    out = []
    for a in seen:
        if a[0] % p.every:
            continue
        score = lambda b, a=a: sum(x * y for x, y in zip(a[2], b[2], strict=False))
        first = lambda found, k: sorted(((-score(b), b[0]) for b in found))[:k]
        for s, positive in first([b for b in seen if b != a and b[1] == a[1]], p.positives):
            ps = -s
            ok = [b for b in seen if b[1] != a[1] and p.low_pct * ps <= 100 * score(b) <= p.high_pct * ps]
            out += [(a[0], positive, rank, i, ps, -ns) for rank, (ns, i) in enumerate(first(ok, p.negatives), 1)]
    return sorted(out)


def mined(spark, rows, p):
    df = spark.createDataFrame([(i, v, x, 1) for i, v, x in rows], SCHEMA)
    got = H.mine(df, p=p)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def clustered(n, dims, spread, seed):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(12, dims))
    v = centres[pick.integers(0, 12, n)] + spread * pick.normal(size=(n, dims))
    v *= np.exp(pick.normal(size=(n, 1)))
    return [(int(i), [float(x) for x in row], int(pick.integers(0, 4))) for i, row in enumerate(v)]


@pytest.mark.parametrize(("dims", "spread", "p"), [
    (6, 0.05, H.MineParams(every=10, bucket_rows=32, least_rows=8, chunk=16, block=8)),
    (6, 0.05, H.MineParams(every=10, bucket_rows=64, least_rows=64, dense=1.0)),
    (3, 1.0, H.MineParams(every=7, bucket_rows=16, least_rows=4, dense=0.0, focus=2, positives=3, negatives=7, low_pct=95)),
    (20, 0.3, H.MineParams(every=25))])
def test_equals_brute_force(spark, dims, spread, p):
    rows = clustered(600, dims, spread, dims)
    assert mined(spark, rows, p) == brute(rows, p)


def test_ties_copies_and_odd_rows(spark):
    pick = random.Random(3)
    rows = [(i, [pick.choice([0.0, 0.25, -0.5]) for _ in range(3)], i % 3) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.5, 0.5], 1) for i in range(200)]                       # one vector in many rows
    rows += [(400, [0.5, 0.5, 0.5], 0), (400, [0.5, 0.5, 0.5], 0), (400, [0.25, 0.5, 0.5], 0), (400, [0.5, 0.5, 0.5], 1)]
    rows += [(None, [1.0, 1.0, 1.0], 0), (500, None, 0), (600, [1.0, None, 0.0], 0), (700, [1.0, float("nan"), 0.0], 0),
             (800, [float("inf"), 0.0, 0.0], 0), (900, [1.0, 0.0, 0.0], None), (1100, [], 0), (1200, [1.0], 0), (1300, [1.0, 0.5, 0.25, 2.0], 2)]
    rows += [(1400, [1e30, -1e30, 3e7], 0), (1500, [1e30, 1e30, 1.0], 0), (1501, [9e29, 1e30, 1.0], 1), (1502, [900.0, 40000.0, 7.5], 1)]
    p = H.MineParams(bucket_rows=32, least_rows=8)
    assert mined(spark, rows, p) == brute(rows, p)


def test_empty_and_anchorless(spark):
    assert mined(spark, [], H.MineParams()) == [] and mined(spark, [(1, [1.0], 0), (2, [1.0], 1)], H.MineParams()) == []


def test_ranges_prune(spark):
    """Close vectors of one length: most rows of a bucket fall outside the focus ranges and are never scored."""
    rows = clustered(600, 6, 0.02, 9)
    ids, labels, v = np.arange(600), np.array([r[2] for r in rows], np.int32), np.array([r[1] for r in rows])
    q = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    order = np.argsort(-(q * q).sum(axis=1), kind="stable")
    index = H._bucket([(int(i), int(labels[i]), q[i].tolist(), int((q[i] * q[i]).sum())) for i in order])
    b = H.Bucket(*(x[0] for x in index.values()))
    none = np.zeros((1, 1), np.int64)
    best = int((q[5] @ q.T).max())
    block = H.Block(H.Queries(False, 5, ids[5:6], labels[5:6], q[5:6], none + best * 9 // 10, none + H.MOST, none, none), 0, H.MineParams())
    low, high, alive = block.ranges(b.longest, b.shortest)
    inside = np.all([(b.unit[:, f] >= low[0, k]) & (b.unit[:, f] <= high[0, k]) for k, f in enumerate(block.focus[0])], axis=0)
    score = b.m.astype(np.int64) @ q[5]
    assert alive[0] and inside.sum() < 100 and inside[score >= best * 9 // 10].all()
