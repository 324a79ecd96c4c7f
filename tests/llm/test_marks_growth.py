"""The bitmap of repeated shingles grows with the text, so that documents without a partner send nothing."""

import random
from dataclasses import replace

import numpy as np
import pytest

from hubrisk.llm import jaccard_join as J
from hubrisk.llm import marks as M


@pytest.mark.parametrize("wide", [None, 1000])
def test_documents_without_partner_send_no_prefix(spark, wide):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    rows, want = [], {}
    for i in range(2600):
        rows.append((i, " ".join(word() for _ in range(60))))
        want[i] = i
    for i in range(400):  # near copies: the last word differs
        rows.append((10_000 + i, rows[i][1][:-8] + word()))
        want[10_000 + i] = i
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    small = replace(J.JoinParams().marks, mark_bits=13, often_bits=10, **({"wide": wide} if wide else {}))
    params = replace(J.JoinParams(), marks=small)
    prepared = J.prepare(J.words_of(docs, "doc_id", "text"), params)
    assert 800 <= prepared.filter("prefix IS NOT NULL").count() < 1000
    got = J.named_rows(prepared, J.near(prepared, params)).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)


def test_sorted_values_come_back():
    rng = np.random.default_rng(1)
    for bits, kind, planes in ((32, np.uint32, 4), (40, np.uint64, 5)):
        for size in (0, 1, 1000):
            values = np.sort(rng.integers(0, 1 << bits, size, np.uint64).astype(kind))
            back = M.unpack_sorted(M.pack_sorted(values), planes)
            assert back.dtype == kind and (back == values).all() and len(M.pack_sorted(values)) == planes * size


def test_size_follows_the_text(spark):
    texts = spark.createDataFrame([("x" * 1000,), (None,), ("é" * 500,)], "text string")
    p = M.MarkParams(mark_bits=5, often_bits=4, most_bits=30, wide=2000)
    assert M.fitted(texts, p) == replace(p, mark_bits=6, often_bits=5, prefix=40)  # 2000 bytes: 62 bits
    assert M.fitted(texts, replace(p, mark_bits=27, wide=2001)) == replace(p, mark_bits=27, wide=2001)
    assert M.fitted(texts.limit(0), p) == p and M.fitted(texts, replace(p, most_bits=None)) == replace(p, most_bits=None)
