"""Source divergence against a plain version: trees over several blocks and tiles, edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from hubrisk.llm import source_divergence as V

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, p):
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall((text or "").translate(LOW))
        counts[lang or "", source or ""].update(found)
        langs[lang or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= p.min_docs)

        def share(c, kept=kept):
            whole = sum(c[t] for t in kept) + p.smooth * len(kept)
            return {t: 1 + V.UNIT * (c[t] + p.smooth) // whole for t in kept}
        of = {s: share(c) for (x, s), c in counts.items() if x == lang}
        own = share(langs[lang])
        for s, mine in of.items():
            pairs = [(sum(abs(mine[t] - q[t]) for t in kept), o) for o, q in of.items() if o != s]
            more = [(mine[t] - own[t], t) for t in kept if counts[lang, s][t] and mine[t] > own[t]]
            for part, found, most in (("pair", pairs, None), ("term", more, p.ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("p", [V.DivergenceParams(min_docs=3, block_terms=16, tile=3, flush=50, slice=7, ranks=5),
                               V.DivergenceParams(min_docs=2, broadcast_rows=0)])
def test_equals_plain_version(spark, p):
    pick = random.Random(1)
    words = [f"{a}{b}" for a in "abcdeñß" for b in "xyzABC é"] + ["中文", "ﬀ", "I"]
    rows = []
    for _ in range(250):
        text = pick.choice([" ", "1", "-", " ", "\n"]).join(pick.choices(words, weights=range(1, len(words) + 1), k=pick.randrange(30)))
        rows.append((pick.choice([text, text, text, None, ""]), pick.choice(["en", "en", "en", "fr", None, ""]), pick.choice(["s0", "s0", "s0", *[f"s{k}" for k in range(8)], "S", "é", None])))
    rows += [(None, "xx", "only"), ("one two", "yy", "a"), ("three", "yy", "b"), ("three", "yy", None)] + rows[:20]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "text string, lang string, source string, term int, n string")
    got = V.divergence(df, p)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, p)


def test_empty_and_very_long(spark, nothing):
    schema = "text string, lang string, source string"
    assert V.divergence(spark.createDataFrame([], schema)).count() == 0
    long = "alpha beta " * 300_000
    rows = [(long, "en", "a"), ("beta beta", "en", "b"), ("beta alpha", "en", "b")]
    p = V.DivergenceParams(min_docs=2, slice=1000)
    assert sorted(tuple(r) for r in V.divergence(spark.createDataFrame(rows, schema), p).collect()) == brute(rows, p)


def test_equal_subtrees_are_one_node():
    leaves = np.zeros((3, 1024), np.int64)
    leaves[0, 5], leaves[1, 5], leaves[2, 700] = 4, 4, 4
    levels, values, children = V.consed(leaves)
    assert levels[0][0, 0] == levels[0][1, 0] != levels[0][2, 0]
    assert sum(map(len, children)) <= 3 * 9 + 2 and values.tolist() == [0, 4]  # a level's nodes: zeros, and the 4 at two places
    seen = []

    def price(a, b):
        seen.append(len(a))
        return np.abs(a - b)
    assert V.priced(levels[0][0, 0], levels[0][2, 0], values, children, price) == 8 and seen[0] <= 3


def test_shares_are_exact():
    p = V.DivergenceParams()
    counts = np.array([0, 1, 7, 10**9, 2 * 10**14])
    for whole in (int(counts.sum()) + 35, 28 * 10**13):
        assert V.shares(counts, whole, p).tolist() == [1 + V.UNIT * (int(c) + 5) // whole for c in counts]


def test_blocks_name_a_pair_alike_whatever_the_order_of_rows():
    rows = pd.DataFrame({"lang": "en", "source": ["b", "a", "é"], "tile": 0, "low": 0, "high": 0, "width": 2, "kept": 2, "total": [3, 1, 0],
                         "places": [[0, 1], [1], None], "counts": [[1, 2], [1], None]})
    one, other = (V.block_distances(x.reset_index(drop=True), V.DivergenceParams()) for x in (rows, rows[::-1]))
    assert sorted(one.itertuples(index=False)) == sorted(other.itertuples(index=False))
    assert sorted(zip(one["one"], one["other"], strict=True)) == [("a", "b"), ("a", "é"), ("b", "é")]
