"""Decontamination, licence scan, language model and pipeline."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from hubrisk.llm import decontaminate as D
from hubrisk.llm import licenses as L
from hubrisk.llm import lm as M
from hubrisk.llm import queries
from hubrisk.session import scratch_path

from llm_helpers import words

SF = "/root/testdata/sf0.001"
RANKS = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
ITEM = "Tom has 3 apples and buys 5 more apples at the store near Boston for 7 dollars in total today"


def test_leak_query_finds_all_whole_items(spark, sf_docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op4_decontamination"](spark, SF).collect()}
    assert got >= {(i, k) for i, t in sf_docs.items() for k, x in items.items() if x in t}
    folded = {i: " ".join(re.findall(r"\w+", t.lower())) for i, t in sf_docs.items()}
    assert all(re.sub(r"\W+", " ", items[k].lower()).strip()[:40] in folded[i] for i, k in got)


def test_new_numbers_names_and_inconsistent_slots(spark, odd, nothing):
    bench = spark.createDataFrame([(1, ITEM, 0), (2, "so 3", 0), (3, None, 0), (4, "Short item of five words", 0)], "item_id long, text string, hash int")
    texts = [(10, "Well. " + ITEM.replace("Tom", "Ann").replace("Boston", "Denver").replace("3", "4").replace("5", "9") + " ok."),
             (11, ITEM.lower()), (12, "A short item of five words here"), (13, "Short item"), (14, None),
             (15, "nothing that looks like the items at all, only other words in a row"), (16, "x " + ITEM[:40]), (None, ITEM)]
    got = {(r.doc_id, r.item_id): r for r in D.leaks(spark.createDataFrame([(*t, "c") for t in texts], "doc_id long, text string, hash string"), bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (12, 4), (None, 1)}
    assert got[(10, 1)].n_changed >= 3 and got[(11, 1)].n_changed == 0
    pair = spark.createDataFrame([(1, "take 5 red beads and then 5 blue beads and 5 green beads from the box")], "item_id long, text string")
    same = [(1, "take 8 red beads and then 8 blue beads and 8 green beads from the box"), (2, "take 8 red beads and then 9 blue beads and 6 green beads from the box")]
    assert [r.doc_id for r in D.leaks(spark.createDataFrame(same, "doc_id long, text string"), pair).collect()] == [1]
    assert D.leaks(odd, bench).count() == 0 and D.leaks(nothing, bench).count() == 0 and D.leaks(odd, bench.limit(0)).count() == 0
    left = D.decontaminate(odd, spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string"))
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "5", "6", "None"]


def test_license_query_finds_the_notices(spark, sf_docs):
    got = {(r.doc_id, r.start): r for r in queries.QUERIES["op8_license_scan"](spark, SF).collect()}
    family = {"Released under the MIT": "MIT", "Licensed under the Apache": "Apache", "GNU General Public": "GPL", "CC BY-NC": "CC-BY-NC"}
    for i, t in sf_docs.items():
        for line in re.finditer(r"[^\n]+", t):
            for cue, name in family.items():
                if cue in line.group() and len(line.group()) < 120:
                    assert got[(i, line.start())].family == name


def test_license_held_out_accuracy_and_edge_cases(spark, odd, nothing):
    told = {"MIT": "This package is released under the MIT license.", "GPL": "It is licensed under the GNU General Public License, version 2.",
            "Apache": "Code licensed under the Apache License, Version 2.0", "BSD": "Distributed and released under the BSD 3-Clause License"}
    rows = [(i, f"first line\n{t}\nlast line é", 1) for i, t in enumerate(told.values())]
    rows += [(10, "He renewed his driving license at the town hall."), (11, "MIT students met."), (12, " ".join(["filler"] * 300) + " Released under the MIT License. " + " ".join(["filler"] * 300))]
    docs = spark.createDataFrame([(r[0], r[1], 0.5) for r in rows], "doc_id long, text string, probability double")
    got = collections.defaultdict(list)
    for r in L.license_scan(docs).collect():
        got[r.doc_id].append(r)
    assert [got[i][0].family for i in range(4)] == list(told) and not got[10] and not got[11]
    assert (got[0][0].paragraph, got[0][0].start, got[0][0].end) == (1, 11, 11 + len(told["MIT"])) and got[12][0].family == "MIT"
    assert L.license_scan(odd).count() == 0 and L.license_scan(nothing).count() == 0


def test_lm_query_base_scores_and_held_out_gain(spark, sf_docs):
    rows = queries.QUERIES["op7_lm_score"](spark, SF).collect()
    tokens = {i: words(t) + [" "] for i, t in sf_docs.items()}
    counts = collections.Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(w)
    n, down = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    for r in rows:
        w = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / down) for x in w), rel=1e-9)
    held = [r for r in rows if r.held_out]
    subwords = M.Subwords(*RANKS)
    ids = {i: subwords.encode(M.lowered(t)) for i, t in sf_docs.items()}
    seen = collections.Counter(int(x) for i, v in ids.items() if zlib.crc32(str(i).encode()) % 10 for x in v)
    total = sum(seen.values())
    unigram = sum(math.log10((seen[int(x)] + 0.1) / (total + 0.1 * 50257)) for r in held for x in ids[r.doc_id])
    assert sum(r.score for r in held) > unigram  # better than subword counts on texts it has not seen


def test_lm_rare_words_by_join_edge_cases(spark, odd, nothing):
    few = M.lm_score(odd, RANKS, M.LmParams(frequent=2, flush=3)).collect()
    many = M.lm_score(odd, RANKS).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens)
    for a, b in zip(sorted(few, key=key), sorted(many, key=key)):
        assert (a.n_known, a.train_tokens) == (b.n_known, b.train_tokens) and a.base_score == pytest.approx(b.base_score, rel=1e-9)
    assert len(few) == odd.count() and all(r.score < 0 for r in many)
    assert M.lm_score(nothing, RANKS).count() == 0


def test_lm_gradients_and_single_scoring():
    p = M.LmParams(singles=10, bands=2, width=6, hidden=5, window=8, stride=4, batch=4)
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in M.start_weights(p).items()}
    x, y = rng.integers(0, 13, (3, 8)), rng.integers(-1, 12, (3, 8))
    _, g = M.gradients(w, x, y)
    for n in w:
        i = tuple(int(rng.integers(0, s)) for s in w[n].shape)
        old = w[n][i]
        w[n][i] = old + 1e-5
        up = M.gradients(w, x, y)[0]
        w[n][i] = old - 1e-5
        down = M.gradients(w, x, y)[0]
        w[n][i] = old
        assert (up - down) / 2e-5 == pytest.approx(g[n][i], abs=1e-6)
    light = M.start_weights(p)
    texts = [rng.integers(0, 12, k) for k in (1, 7, 8, 9, 12, 13, 40)]
    scores = M.score_batch(light, texts, p)
    assert [len(s) for s in scores] == [len(t) for t in texts]
    c, seen = texts[-1], np.concatenate([[12], texts[-1]])
    for i in (0, 5, 7, 8, 11, 12, 20, 39):
        start = 0 if i < 8 else ((i - 8) // 4 + 1) * 4
        z, _ = M.forward(light, seen[start:i + 1][None], 0)
        assert M.log_softmax(z)[0, -1][c[i]] == pytest.approx(scores[-1][i], abs=1e-4)
    z, _ = M.forward(light, seen[None, :8], 0)
    changed = seen[None, :8].copy()
    changed[0, 5:] = 0
    assert np.allclose(z[0, :5], M.forward(light, changed, 0)[0][0, :5], atol=1e-5)  # causal


def test_pipeline_equals_the_stages_brute_force(spark, sf_docs):
    from test_archive_packing import covered
    from test_duplicates import brute_components
    kept = {r.doc_id for r in queries.QUERIES["op1_quality_rules"](spark, SF).collect() if r.kept}
    rows = [(i, t) for i, t in sf_docs.items() if i in kept]
    first = sorted({c for _, _, c in brute_components(rows)})
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [(i, sf_docs[i]) for i in first if not any(x in sf_docs[i] for x in items)]
    got = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in got}
    assert ids <= {i for i, _ in clean} and len(ids) >= len(clean) - 2  # case-changed leaks are found too
    covered([r for r in got if not secret(sf_docs[r.doc_id])], [c for c in clean if c[0] in ids and not secret(c[1])])


def secret(text):
    from test_secrets import brute
    return bool(brute(text)) or re.search(r"[A-Za-z0-9+/_=-]{16,}", text) is not None


def test_pipeline_stages_keep_the_columns(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(40), SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), SF).count() == 0
