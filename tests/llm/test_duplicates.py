"""Jaccard join and suffix-array dedup against brute force."""

import hashlib
import random
import re

from hubrisk.llm import jaccard_join as J
from hubrisk.llm import queries
from hubrisk.llm import suffix_dedup as X
from hubrisk.llm.components import components
from hubrisk.llm.marks import MarkParams

from llm_helpers import LOW, WORD

SF = "/root/testdata/sf0.001"


def brute_components(rows, pct=75):
    """(doc_id, text) rows -> (set size, smallest id reached) per row."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if find(m) == find(k) and rows[m][0] is not None]
        out.append((i, len(sets[k]), min(ids) if ids else None))
    return sorted(out, key=str)


def joined(df, params=J.JoinParams()):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df, params).collect()), key=str)


def near_copies(seed, n):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(5, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = f"w{rnd.randint(0, 400)}"
        rows.append((i if rnd.random() > 0.05 else None, " ".join(w).upper() if rnd.random() < 0.1 else " ".join(w)))
    return rows + rows[:5]


def test_join_query_equals_brute_force(spark, sf_docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.QUERIES["op9_ngram_jaccard_join"](spark, SF).collect()), key=str)
    assert got == brute_components(list(sf_docs.items()))


def test_join_of_near_copies_with_small_blocks_and_full_bitmaps(spark):
    rows = near_copies(1, 120)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component_id int")
    want = brute_components(rows)
    assert joined(df, J.JoinParams(block=7)) == want
    assert joined(df, J.JoinParams(marks=MarkParams(mark_bits=13, often_bits=10, often=2, flush=50))) == want


def test_join_edge_cases(spark, odd, nothing):
    assert joined(odd) == brute_components([(r.doc_id, r.text) for r in odd.collect()])
    assert joined(nothing) == []
    ties = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "a b c d e f g h i j k l m z"), (3, "a b c d"), (4, "A B  C D"), (5, "a b c")], "doc_id long, text string")
    assert joined(ties) == brute_components([(r.doc_id, r.text) for r in ties.collect()])


def test_one_document_of_each_group_stays(spark, odd):
    rows = near_copies(2, 60)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string")
    out = J.drop_near_duplicates(df)
    assert out.columns == df.columns
    want = {c for i, _, c in brute_components(rows) if i is not None}
    kept = [r.doc_id for r in out.collect()]
    assert sorted(i for i in kept if i is not None) == sorted(want) and kept.count(None) == sum(i is None for i, _ in rows)
    assert sorted(str(r.doc_id) for r in J.drop_near_duplicates(odd).collect()) == sorted(["1", "2", "3", "4", "None", "5", "6"])


def test_components_of_a_chain_and_stars(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200)]
    rnd.shuffle(edges)
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def brute_removal(rows, size=100):
    seen, out = set(), []
    for i, t in sorted({(-1 if i is None else i, (t or "").encode()) for i, t in rows}):
        gone, end = bytearray(len(t)), 0
        for p in range(len(t) - size + 1):
            w = t[p:p + size]
            if w in seen:
                a = max(p, end)
                gone[a:p + size] = b"\x01" * (p + size - a)
                end = p + size
            seen.add(w)
        keep = bytes(x for x, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(keep).hexdigest()))
    return out


def removed(df, params=X.SuffixParams()):
    return sorted({(-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in X.dedup(df, params).collect()})


def test_dedup_query_equals_brute_force(spark, sf_docs):
    got = sorted(tuple(r) for r in queries.QUERIES["op6_suffix_array_dedup"](spark, SF).collect())
    assert got == sorted(brute_removal(list(sf_docs.items())))


def test_dedup_of_hot_and_periodic_texts(spark):
    rnd = random.Random(6)
    part = ["".join(rnd.choice("abcdé \x00") for _ in range(rnd.randint(60, 160))) for _ in range(8)]
    rows = [(i, "".join(rnd.choice(part) for _ in range(rnd.randint(0, 4))) + "ab" * rnd.choice([0, 90])) for i in range(60)]
    rows += [(70, "abcabcabc" * 40), (71, "x" * 300), (72, "x" * 100), (73, "x" * 99), (None, part[0] * 2)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, hash int")
    want = sorted(brute_removal(rows))
    assert removed(df) == want
    # every repeated value counts as frequent: all shards are salted and merged
    assert removed(df, X.SuffixParams(salts=3, flush=2000, marks=MarkParams(mark_bits=14, often_bits=10, often=1))) == want


def test_dedup_edge_cases(spark, odd, nothing):
    got = removed(odd)
    assert got == sorted(set(brute_removal([(r.doc_id, r.text) for r in odd.collect()])))
    assert X.dedup(nothing).count() == 0
    assert X.dedup(odd).count() == odd.count()


def test_suffix_arrays_and_prefixes():
    import numpy as np
    rnd = random.Random(7)
    for _ in range(20):
        s = bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randint(1, 150)))
        assert X.suffix_array(np.frombuffer(s, np.uint8).astype(np.uint16) + 1).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_anchor_values_lie_evenly():
    """Minima of hashes crowd near 0; marks and shards are dealt by their mixed values."""
    import numpy as np
    rnd = random.Random(8)
    p = X.SuffixParams()
    v = X.anchors(bytes(rnd.choice(b"abcdefgh ") for _ in range(200_000)), p)
    slices = np.bincount((v >> np.uint64(60)).astype(np.int64), minlength=16)
    assert slices.max() < 1.3 * slices.mean() and slices.min() > 0.7 * slices.mean()
    raw = np.arange(1000, dtype=np.uint64)
    assert len(np.unique(X.spread(raw))) == 1000


def test_windows_around_a_hot_passage_are_dealt_to_many_ranges():
    """Segments of one anchor value with different texts around it: no range gets a large share of their windows."""
    rnd = random.Random(9)
    p = X.SuffixParams()
    core, sizes = "".join(rnd.choice("abcdefgh ") for _ in range(60)), {}
    for d in range(300):
        edge = "".join(rnd.choice("abcdefgh ") for _ in range(46))
        text = (edge + core + edge[::-1]).encode()
        for g, _, _, s, b in X.dealt_anew((d, 0, 0, text), None, p, 8):
            assert text[s:s + len(b)] == b
            sizes[g] = sizes.get(g, 0) + len(b) - p.size + 1
    total = 300 * (60 + 92 - p.size + 1)
    assert sum(sizes.values()) == total and max(sizes.values()) < total / 20
