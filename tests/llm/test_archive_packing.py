import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hubrisk.llm import packing as P
from hubrisk.llm import queries
from hubrisk.llm import warc as W
from hubrisk.session import scratch_path

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_archive_round_trip_restores_payloads(spark):
    big, other = "<p>" + "x\r\n\r\nWARC/1.1\r\n" * 100, "é" * 700
    rows = [(1, "http://a/1", big), (7, "http://a/7 b\r\nX: y", big), (3, None, big), (4, "u", "small"), (5, "u", "small"),
            (6, "u", None), (8, "u", ""), (9, "u", other), (9, "u", other), (2, "u", other), (None, "n", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int")
    path = scratch_path(spark, "t-warc")
    W.write_archive(pages, path)
    got = W.reconstruct(W.read_archive(spark, path)).collect()
    texts = collections.Counter((i, (h or "").encode()) for i, _, h in rows)
    assert collections.Counter((r.page_id, bytes(r.payload)) for r in got) == texts
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert (7, "response", None) in kinds and (1, "revisit", 7) in kinds and (3, "revisit", 7) in kinds
    assert (2, "revisit", 9) in kinds and (9, "response", None) in kinds and (None, "response", None) in kinds
    assert (4, "response", None) in kinds and (5, "response", None) in kinds
    assert all(r.payload_bytes == len(r.payload) for r in got)
    headers = {bytes(r.header) for r in got}
    stored = {r.header.encode() for r in spark.read.parquet(f"{path}/headers").collect()}
    assert headers == stored
    assert W.round_trip(pages.limit(0)).count() == 0


def test_records_are_rebuilt_from_headers_and_payloads(spark):
    long = "z\r\n\r\n" * 60_000
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (3, None, None), (4, "u", "x"), (5, "u", "x"), (None, "n", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch_path(spark, "t-rebuild")
    W.write_archive(pages, path)
    got = W.rebuild(spark, path).collect()
    headers = {r.page_id: r.header.encode() for r in spark.read.parquet(f"{path}/headers").collect()}
    texts = {i: (h or "").encode() for i, _, h in rows}
    assert {r.page_id: bytes(r.record) for r in got} == {i: headers[i] + texts[i] for i in texts}
    assert all(r.payload_digest == hashlib.sha1(texts[r.page_id]).hexdigest() and r.payload_bytes == len(texts[r.page_id]) for r in got)
    short = {tuple(r) for r in W.rebuild(spark, path, with_payload=False).drop("record").collect()}
    assert short == {tuple(r)[:-1] for r in got}


def test_a_header_without_its_payload_fails(spark):
    path, other = scratch_path(spark, "t-missing"), scratch_path(spark, "t-missing-other")
    W.write_archive(spark.createDataFrame([(1, "u", "a" * 2000)], "page_id long, url string, html string"), path)
    W.write_archive(spark.createDataFrame([(1, "u", "b" * 2000)], "page_id long, url string, html string"), other)
    spark.read.parquet(f"{other}/headers").write.mode("append").parquet(f"{path}/headers")
    with pytest.raises(Exception, match="no stored payload"):
        W.rebuild(spark, path, with_payload=False).collect()


def test_a_changed_payload_is_noticed():
    import gzip
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 6\r\n\r\nH\r\n\r\nx\r\n\r\n"
    fields, _, payload = next(W.parse(gzip.decompress(gzip.compress(record))))
    assert payload == b"x" and fields["WARC-Type"] == "response"
    with pytest.raises(ValueError):
        list(W.parse(record.replace(b"Length: 6", b"Length: 5")))


def covered(rows, texts):
    """Every id of every document lies in exactly one piece."""
    tok = Tokenizer.from_file(PATH)
    ids = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for _, t in texts]
    want = collections.Counter((i, len(x)) for (i, _), x in zip(texts, ids))
    got = collections.Counter()
    for r in rows:
        got[(r.doc_id, r.doc_tokens)] += r.length
        assert any(i == r.doc_id and len(x) == r.doc_tokens and zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32
                   for (i, _), x in zip(texts, ids))
    assert got == collections.Counter({k: k[1] * n for k, n in want.items()})


def hold(rows, texts, capacity=2048):
    """All ids covered once, sequences gapless; returns the padding."""
    covered(rows, texts)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing_query_equals_the_tokenizer(spark, sf_docs):
    rows = queries.QUERIES["op10_packing"](spark, SF).collect()
    assert hold(rows, list(sf_docs.items())) == 0


def test_packing_edge_cases(spark, odd, nothing):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    assert hold(P.pack(odd.coalesce(1), PATH).collect(), texts) == 0
    assert P.pack(nothing, PATH).count() == 0


def test_word_cache_is_exact_on_odd_text():
    import random
    rnd = random.Random(5)
    words = P.WordIds(PATH, 1000)
    letters = "aAéÉİßσΣ'’-_.,!? \n\t\x1c\u0301½٣한하漢🙂<|>stemdlrv"
    texts = ["".join(rnd.choice(letters) for _ in range(50)) for _ in range(400)] + ["<|endoftext|> x", "don't I'll it's.", "İ. É하."]
    for t, ids in zip(texts, words.encode(texts)):
        assert ids.tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_costs_are_balanced():
    docs = [(i, np.full(n, 7, np.int32)) for i, n in enumerate([2000, 1500, 1200, 900, 700, 500, 300, 300, 200, 100, 60, 5000])]
    out, used = P.pack_pool(docs, P.PackParams(), 0)
    fill, pieces = collections.Counter(), collections.Counter()
    for s, n in zip(out["sequence_id"], out["length"]):
        fill[s] += n
    assert sum(fill.values()) == sum(len(x) for _, x in docs) and used == len(fill)
    assert sum(n == 2048 for n in fill.values()) == sum(len(x) for _, x in docs) // 2048


def test_merges_follow_the_tokenizer_word_by_word():
    import random
    rnd = random.Random(6)
    words = P.WordIds(PATH, 10_000)
    texts = [" ".join("".join(rnd.choice("etaoinshrdluETAOINzq") for _ in range(rnd.randint(1, 30))) + rnd.choice(["", "", ".", "?!", ",", "'s"])
                      for _ in range(60)) for _ in range(100)] + ["the theme THE The, the. there", "a", "", "   "]
    assert words.merges is not None
    for t, ids in zip(texts, words.encode(texts), strict=True):
        assert ids.tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_accented_words_and_marks_at_the_end_are_merged_together(monkeypatch):
    import random
    rnd = random.Random(7)
    words = P.WordIds(PATH, 10_000)
    letters = "eaoinslrtEAON" + "".join(P.ACCENTED)
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 14))) + rnd.choice(["", "***", "%%%", ",&&&", "!", "-)"])
            for _ in range(2000)]
    made = [w for w in made if len(w.rstrip("*%&,!-)").encode()) <= P.Merges.LONGEST]
    odd = ["a×b", "a÷b", "×", "é\u0301a", "œuvre", "ÿŸ", "ß", "Straße", "é's", "é***'s", "a*****", "****", "***é", "Ç'", "ª", "éº", "é1", "é" * 13]
    slow = []
    one_by_one = words.ids_of
    monkeypatch.setattr(words, "ids_of", lambda new: slow.extend(new) or one_by_one(new))
    for text, ids in zip([" ".join(made), " ".join(odd)], words.encode([" ".join(made), " ".join(odd)]), strict=True):
        assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    for w, ids in zip(made + odd, words.encode(made + odd), strict=True):
        assert ids.tolist() == words.tokenizer.encode(w, add_special_tokens=False).ids, w
    assert not set(slow) & set(made) and {"a×b", "a÷b", "œuvre", "é's"} <= set(slow)


def test_new_words_are_merged_in_bounded_memory():
    import tracemalloc
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 25, 240_000)
    starts = np.cumsum(sizes) - sizes
    data = rng.integers(ord("a"), ord("z") + 1, int(sizes.sum())).astype(np.uint8)
    merges = P.Merges.of(PATH)
    tracemalloc.start()
    counts, ids = merges.encode(data, starts, sizes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20  # all words at once take about twice that
    words = P.WordIds(PATH, 100)
    some = [*range(0, 240_000, 3989), 8191, 8192, 239_999]
    want = [np.frombuffer(x, np.int32).tolist() for x in words.alone([data[starts[k]:starts[k] + sizes[k]].tobytes().decode() for k in some])]
    at = np.cumsum(counts) - counts
    assert [ids[at[k]:at[k] + counts[k]].tolist() for k in some] == want
