"""Operator 6, suffix-array dedup: remove every byte covered by a ``size``-byte string that starts earlier.

Texts are UTF-8 bytes, strings never cross documents and are judged on the input. "Earlier" is a
smaller doc_id, or an earlier start in one document. All copies but the first are removed, in whole.

1. Sieve. In each window of ``size`` bytes the smallest hash of its ``gram``-byte grams is its anchor
   value. Equal windows have equal anchor values, so a window whose value occurs once in the corpus
   repeats nowhere. ``marks`` counts all values; only windows with repeated values go on.
   (Anchors are minima, so they crowd at low numbers: ``spread`` mixes them before anything is dealt by them.)
2. Shards. Neighbouring windows with one value form a segment (its bytes once), which goes to the
   shard of its value: equal windows always meet in one shard, wherever they lie. Very frequent
   values are salted by document into ``salts`` shards, or more where the session has many shuffle partitions.
3. Per shard: identical segments are reduced to the first, and those left without a partner of their
   value are done. The others get a suffix array by
   Larsson-Sadakane refinement (sort by seven symbols, then double the sorted depth, re-sorting
   only groups still tied) and Kasai's common prefixes (all segments in step); runs of common
   prefixes of ``size`` or more are equal windows, the earliest of which stays.
4. Merge. The first windows of salted shards meet again, dealt anew by the anchors of longer grams
   (``fine`` bytes): the many different texts around one hot passage go to as many ranges. In a range each
   shard's sorted windows are looked up in those of the shards before it by binary search.
5. Removed runs are joined to the texts by id.

Memory: a shard holds its share of the repeated segments; the number of shards follows the
session's shuffle partitions. The broadcast bitmaps have a fixed size. Texts travel once, in the join of step 5.

Defined results: null text is empty (0 bytes, SHA-256 of nothing); texts under ``size`` bytes never
lose anything; rows repeated in id and text count as one document (both get the same result), rows of
one id with different texts are ordered by their texts' hash; a null id comes before all others; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubrisk.llm.common import cut, map_batches
from hubrisk.llm.marks import MarkParams, Marks, log2_ranges, repeated_marks
from hubrisk.llm.shingles import P1, SHIFT

NO_ID = -(1 << 63)


@dataclass(frozen=True)
class SuffixParams:
    size: int = 100
    gram: int = 48              # long enough that equal grams by chance are rare
    fine: int = 88              # grams by which the first windows of salted shards are dealt anew
    salts: int = 16             # shards of a very frequent value, at least
    salt_share: int = 32        # shuffle partitions of the session that give one salt
    flush: int = 32 << 20       # segment bytes a task holds before it sends them
    shard_bits: int = 5         # shards of a hash range: a shard is to hold a few MB at most
    merge_bits: int = 2         # ranges of a hash range for the first windows of salted shards
    marks: MarkParams = MarkParams(often_bits=20)


# --- anchors ---------------------------------------------------------------------------------

BYTE_HASH = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def power(k: int) -> np.uint64:
    return np.uint64(pow(int(MULTIPLIER), k, 1 << 64))


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hashes of all grams, put together from power-of-two lengths."""
    h, span = BYTE_HASH[b], 1
    out, have = None, 0
    rest = gram
    while rest:
        if rest & 1:
            if out is None:
                out, have = h, span
            else:
                n = len(b) - have - span + 1
                out = h[:n] * power(have) + out[span:span + n]
                have += span
        rest >>= 1
        if rest:
            h = h[:-span] * power(span) + h[span:]
            span *= 2
    out = out ^ (out >> SHIFT)
    out *= P1
    return out ^ (out >> np.uint64(29))


def sliding(values: np.ndarray, width: int, op: Callable) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours."""
    out, span = values, 1
    while 2 * span <= width:
        out = op(out[:-span], out[span:])
        span *= 2
    return op(out[:len(out) - (width - span)], out[width - span:]) if span < width else out


def window_values(text: bytes, p: SuffixParams) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, anchor value of each window)."""
    h = gram_hashes(np.frombuffer(text, np.uint8), p.gram)
    return h, sliding(h, p.size - p.gram + 1, np.minimum)


def spread(values: np.ndarray) -> np.ndarray:
    """A one-to-one mix: minima of many hashes lie near 0 and would fill the first ranges, shards and slices of
    bitmaps; their mixed values lie evenly."""
    v = values ^ (values >> np.uint64(32))
    v *= MULTIPLIER
    v ^= v >> np.uint64(29)
    v *= P1
    return v ^ (v >> np.uint64(32))


def anchors(text: bytes | None, p: SuffixParams) -> np.ndarray:
    """The spread anchor values of a text, once for each place where one lies."""
    if text is None or len(text) < p.size:
        return np.empty(0, np.uint64)
    h, low = window_values(text, p)
    pad = np.zeros(p.size - p.gram, np.uint64)
    return spread(h[sliding(np.concatenate([pad, low, pad]), p.size - p.gram + 1, np.maximum) == h])


# --- suffix arrays ---------------------------------------------------------------------------


def sevens(symbols: np.ndarray) -> np.ndarray:
    """Seven symbols from each place (0 beyond the end) as one number."""
    n = len(symbols)
    wide = np.concatenate([symbols, np.zeros(7, symbols.dtype)])
    key = np.zeros(n, np.int64)
    for k in range(7):
        key <<= 9
        key |= wide[k:n + k]
    return key


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of symbols below 512 (Larsson-Sadakane: groups tied at depth h are re-sorted by
    the rank h places on)."""
    n = len(symbols)
    key = sevens(symbols)
    sa = np.argsort(key, kind="stable")
    first = np.ones(n + 1, bool)
    first[1:n] = key[sa[1:]] != key[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first[:n], np.arange(n), 0))
    h = 7
    while True:
        tied = np.flatnonzero(~(first[:n] & first[1:]))
        if not len(tied):
            return sa
        s = sa[tied]
        on = s + h
        key = rank[s] * (n + 1) + np.where(on < n, rank[np.minimum(on, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        s, key = s[order], key[order]
        sa[tied] = s
        new = np.ones(len(s), bool)
        new[1:] = key[1:] != key[:-1]
        first[tied] |= new
        rank[s] = np.maximum.accumulate(np.where(new, tied, 0))
        h *= 2


#: The lowest bits of the seven symbols of a key, last symbol first.
SYMBOL_BITS = np.int64(1) << np.arange(0, 63, 9, dtype=np.int64)


def common_prefixes(symbols: np.ndarray, sa: np.ndarray, starts: np.ndarray, windows: np.ndarray, cap: int) -> np.ndarray:
    """Kasai: by suffix-array place, the common prefix (at most ``cap``, not across symbol 0) with the
    suffix before it, for the first ``windows`` places of each segment. All segments move in step,
    each keeping its last length less one."""
    n = len(sa)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    padded = np.concatenate([symbols, np.zeros(cap + 8, symbols.dtype)])
    key = sevens(padded)
    # From each place, symbols before the next separator (7 at most are looked at).
    to_zero = np.minimum.accumulate(np.where(padded == 0, np.arange(len(padded)), len(padded))[::-1])[::-1] - np.arange(len(padded))
    out = np.zeros(n, np.int64)
    by_length = np.argsort(-windows, kind="stable")
    starts, windows = starts[by_length], windows[by_length]
    length = np.zeros(len(starts), np.int64)
    ends = np.searchsorted(-windows, -np.arange(int(windows[0])), side="left") if len(windows) else []
    for t, m in enumerate(ends):  # m segments have more than t windows
        i = starts[:m] + t
        at = place[i]
        j = sa[at - 1]
        l = np.maximum(length[:m] - 1, 0)
        l[at == 0] = 0
        live = at.nonzero()[0]
        a, b = i + l, j + l
        if len(live) < m:
            a, b = a[live], b[live]
        while len(live):  # equal symbols among the next seven: read off the highest bit that differs
            same = np.minimum(7 - SYMBOL_BITS.searchsorted(key[a] ^ key[b], side="right"), to_zero[a])
            now = l[live] + same
            l[live] = now
            on = ((same == 7) & (now < cap)).nonzero()[0]
            live, a, b = live[on], a[on] + 7, b[on] + 7
        np.minimum(l, cap, out=l)
        out[at] = l
        length[:m] = l
    return out


# --- shards ----------------------------------------------------------------------------------

#: A list of segments: owner id, hash of the owner's text, start; sizes and bytes.
Segments = list[tuple[int, int, int, bytes]]


STEP = 32  # windows that one run of Kasai's algorithm covers


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def reduce_copies(segments: Segments) -> tuple[Segments, list[tuple[int, int, int, int]]]:
    """The first of identical segments; runs (id, hash, from, to) of the others. The same segment of a
    repeated row is no copy of itself."""
    first: dict[bytes, tuple[int, int, int]] = {}
    gone = []
    for d, t, s, b in segments:
        mine = (d, t, s)
        have = first.get(b)
        if have is None:
            first[b] = mine
        elif have != mine:
            if mine < have:
                first[b], mine = mine, have
            gone.append((mine[0], mine[1], mine[2], mine[2] + len(b)))
    return [(*o, b) for b, o in first.items()], gone


def without_partner(segments: Segments, gram: int) -> np.ndarray:
    """True for a (distinct) segment whose anchor value no other one has and that holds it once: none of
    its windows can equal another. The value is the smallest gram hash of the segment."""
    sizes = np.array([len(b) for *_, b in segments], np.int64)
    total = int(sizes.sum())
    h = np.full(total + 1, np.iinfo(np.uint64).max, np.uint64)
    h[:total - gram + 1] = gram_hashes(np.frombuffer(b"".join(b for *_, b in segments), np.uint8), gram)
    starts = np.cumsum(sizes) - sizes
    spans = np.column_stack([starts, starts + sizes - gram + 1]).ravel()  # grams that lie inside a segment
    value = np.minimum.reduceat(h, spans)[::2]
    times = np.add.reduceat(np.append(h[:total] == np.repeat(value, sizes), False).astype(np.int64), spans)[::2]
    _, number, count = np.unique(value, return_inverse=True, return_counts=True)
    return (count[number] == 1) & (times == 1)


def repeated_windows(segments: Segments, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per (distinct) segment: which of its windows also start earlier, by suffix array; and the bytes
    that they cover as rows (id, hash, from, to)."""
    sizes = np.array([len(b) for *_, b in segments], np.int64)
    symbols = np.frombuffer(b"".join(b for *_, b in segments), np.uint8).astype(np.uint16) + np.uint16(1)
    symbols = np.insert(symbols, np.cumsum(sizes), 0)  # a separator after each segment
    starts = np.cumsum(sizes + 1) - sizes - 1
    windows = sizes - size + 1
    sa = suffix_array(symbols)
    # Long segments move on in parts, so that no few of them set the number of steps.
    parts = -(-windows // STEP)
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    counts = np.minimum(np.repeat(windows, parts) - step * STEP, STEP)
    equal = common_prefixes(symbols, sa, np.repeat(starts, parts) + step * STEP, counts, size) >= size
    group = np.cumsum(~equal)
    many = np.flatnonzero(equal | np.append(equal[1:], False))  # places in groups of two or more
    text_at = sa[many]
    owner = np.searchsorted(starts, text_at, side="right") - 1
    offset = text_at - starts[owner]
    ids, texts, first = (np.array([x[k] for x in segments], np.int64) for k in range(3))
    d, t, s, g = ids[owner], texts[owner], first[owner] + offset, group[many]
    order = np.lexsort((s, t, d, g))
    head = np.ones(len(order), bool)
    head[1:] = g[order][1:] != g[order][:-1]
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    later = np.empty(len(order), bool)
    later[order] = (d[order] != d[lead]) | (t[order] != t[lead]) | (s[order] != s[lead])
    hit = np.zeros(len(symbols), bool)
    hit[text_at[later]] = True
    # No window starts in a segment's last bytes, so runs end with their segment.
    edge = np.flatnonzero(hit[1:] != hit[:-1]) + 1
    a, b = (edge[::2], edge[1::2]) if not hit[0] else (np.append(0, edge[1::2]), edge[::2])
    owner = np.searchsorted(starts, a, side="right") - 1
    to = first[owner] - starts[owner]
    covered = np.column_stack([ids[owner], texts[owner], a + to, b + to - 1 + size])
    return [hit[x:x + w] for x, w in zip(starts, windows)], covered


def merged_windows(shards: list[Segments], size: int) -> list[list[np.ndarray]]:
    """Windows that start earlier in another shard, or are not the earliest of theirs: each shard's
    sorted windows are looked up in the merged list of those before it by binary search."""
    texts, owners = np.empty(0, f"S{size}"), np.empty((0, 5), np.int64)  # owner: id, hash, start, shard, window number
    hits = []
    for k, segments in enumerate(shards):
        windows = np.array([len(b) - size + 1 for *_, b in segments])
        words = np.concatenate([np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(
            np.frombuffer(b, np.uint8), size)).view(f"S{size}").ravel() for *_, b in segments])
        number = np.arange(len(words))
        step = number - np.repeat(np.cumsum(windows) - windows, windows)
        d, t, s = (np.repeat(np.array([x[c] for x in segments], np.int64), windows) for c in range(3))
        mine = np.column_stack([d, t, s + step, np.full(len(words), k), number])
        hit = np.zeros(len(words), bool)
        hits.append(hit)
        at = np.searchsorted(texts, words)
        known = np.zeros(len(words), bool)
        inside = at < len(texts)
        known[inside] = texts[at[inside]] == words[inside]
        for j in np.flatnonzero(known):
            lead, me = tuple(owners[at[j]][:3]), tuple(mine[j][:3])
            if me < lead:
                was = owners[at[j]]
                hits[was[3]][was[4]] = True
                owners[at[j]] = mine[j]
            elif me != lead:
                hit[j] = True
        fresh = np.flatnonzero(~known)
        number = np.unique(words[fresh], return_inverse=True)[1]
        by = np.lexsort((mine[fresh, 2], mine[fresh, 1], mine[fresh, 0], number))
        # The earliest of each window stands for the shard; it has dealt with the others already.
        unique = fresh[by[np.append(True, number[by][1:] != number[by][:-1])]] if len(fresh) else fresh
        to = np.searchsorted(texts, words[unique])
        texts, owners = np.insert(texts, to, words[unique]), np.insert(owners, to, mine[unique], axis=0)
    return [np.split(h, np.cumsum([len(b) - size + 1 for *_, b in s])[:-1]) for h, s in zip(hits, shards)]


# --- Spark -----------------------------------------------------------------------------------

SENT = "shard int, salt int, docs array<long>, hashes array<long>, starts array<int>, sizes array<int>, data binary"
RUN = ("doc", "hash", "start", "stop")
FOUND = "shard int, salt int, doc long, hash long, start long, stop long, data binary"


def send_segments(texts: DataFrame, p: SuffixParams) -> DataFrame:
    """Segments of windows that may repeat, packed by shard; copies within a task as runs without bytes."""
    marked = repeated_marks(texts.select("text"), lambda: lambda t: anchors(t, p), p.marks)
    sent = texts.sparkSession.sparkContext.broadcast((marked.repeated, marked.often, marked.theta))  # fixed size
    shard_bits, mp = log2_ranges(texts, p.marks) + p.shard_bits, p.marks
    salts = max(p.salts, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // p.salt_share)
    names = [c.split()[0] for c in SENT.split(", ")]

    def run(batches: Iterator[list[list]]) -> Iterator[dict]:
        marks = Marks(*sent.value, mp.mark_bits, mp.often_bits)
        held: defaultdict[tuple[int, int], Segments] = defaultdict(list)
        size = 0

        def out() -> dict:
            rows: dict[str, list] = {n: [] for n in names}
            for (shard, salt), segments in held.items():
                stay, gone = reduce_copies(segments)
                for kind, items in ((0, stay), (1, [(d, t, a, b"") for d, t, a, _ in gone])):
                    if items:
                        sizes = [len(x[3]) for x in items] if kind == 0 else [a - b for _, _, b, a in gone]
                        for n, v in zip(names, (shard, salt, *([x[k] for x in items] for k in range(3)), sizes,
                                                b"".join(x[3] for x in items) if kind == 0 else None)):
                            rows[n].append(v)
            return rows
        for ids, hashes, values in batches:
            for d, t, text in zip(ids, hashes, values):
                if text is None or len(text) < p.size:
                    continue
                low = window_values(text, p)[1]
                a = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
                v, b = spread(low[a]), np.append(a[1:], len(low))
                level = marks.level(v)
                k = np.flatnonzero(~marks.single(v, level))
                salt = 1 + hash(d) % salts
                places = zip((v[k] >> np.uint64(64 - shard_bits)).tolist(), np.where(level[k] == 2, salt, 0).tolist(),
                             a[k].tolist(), (b[k] - 1 + p.size).tolist())
                for *key, x, y in places:
                    held[*key].append((d, t, x, text[x:y]))
                    size += y - x
            if size >= p.flush:
                yield out()
                held, size = defaultdict(list), 0
        if size:
            yield out()
    return map_batches(texts, run, SENT)


def dealt_anew(segment: tuple[int, int, int, bytes], hit: np.ndarray | None, p: SuffixParams,
               bits: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(range, id, hash, start, bytes) of the windows of a segment that are not ``hit``: neighbours with one
    anchor of ``fine`` bytes together, since equal windows have equal ones."""
    d, t, s, b = segment
    low = spread(window_values(b, replace(p, gram=p.fine))[1])
    open_ = np.ones(len(low), bool) if hit is None else ~hit
    a = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (open_[1:] != open_[:-1])]))
    for x, y in zip(a.tolist(), np.append(a[1:], len(low)).tolist()):
        if open_[x]:
            yield int(low[x]) >> (64 - bits), d, t, s + x, b[x:y - 1 + p.size]


def resolve_shard(p: SuffixParams, bits: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    size = p.size

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        segments: Segments = []
        gone: list[tuple[int, int, int, int]] = []
        for docs, hashes, starts, sizes, data in zip(*(pdf[c] for c in ("docs", "hashes", "starts", "sizes", "data"))):
            rows = zip(docs.tolist(), hashes.tolist(), starts.tolist(), sizes.tolist())
            if data is None:
                gone += [(d, t, s, s + n) for d, t, s, n in rows]
                continue
            at = 0
            for d, t, s, n in rows:
                segments.append((d, t, s, data[at:at + n]))
                at += n
        stay, more = reduce_copies(segments)
        gone += more
        alone = without_partner(stay, p.gram) if stay else []
        rest = [x for x, no in zip(stay, alone) if not no]
        hits, covered = repeated_windows(rest, size) if rest else ([], np.empty((0, 4), np.int64))
        shard, salt = int(pdf["shard"].iloc[0]), int(pdf["salt"].iloc[0])
        spans = np.concatenate([np.array(gone, np.int64).reshape(-1, 4), covered])
        out = pd.DataFrame({"shard": shard, "salt": salt, **{n: spans[:, k] for k, n in enumerate(RUN)}, "data": None})
        if not salt:
            return out
        # The first windows of a salted shard meet those of the other salts.
        first = [(x, None) for x, no in zip(stay, alone) if no] + list(zip(rest, hits))
        again = [(g, salt, d, t, s, s + len(b), b) for x, hit in first for g, d, t, s, b in dealt_anew(x, hit, p, bits)]
        return pd.concat([out, pd.DataFrame(again, columns=out.columns)]) if again else out
    return resolve


def merge_salts(p: SuffixParams) -> Callable[[pd.DataFrame], pd.DataFrame]:
    size = p.size

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        segments = list(zip(*(pdf[c].tolist() for c in RUN[:3]), pdf["data"]))
        by_salt: defaultdict[int, Segments] = defaultdict(list)
        for salt, segment, alone in zip(pdf["salt"].tolist(), segments, without_partner(segments, p.fine).tolist()):
            if not alone:  # most texts around a hot passage are
                by_salt[salt].append(segment)
        shards = [by_salt[k] for k in sorted(by_salt)]
        rows = [(-1, 0, d, t, s + a, s + b - 1 + size, None)
                for segments, hits in zip(shards, merged_windows(shards, size))
                for (d, t, s, _), hit in zip(segments, hits) for a, b in runs(hit)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])
    return merge


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(t).alias("hash"), t.cast("binary").alias("text"))


def removed_runs(docs: DataFrame, params: SuffixParams = SuffixParams(), doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc, hash, start, stop) of removed bytes; runs of one document may overlap. ``hash`` names the text."""
    sent = send_segments(keyed(docs, doc_id, text), params)
    bits = log2_ranges(docs, params.marks) + params.merge_bits
    found = cut(sent.groupBy("shard", "salt").applyInPandas(resolve_shard(params, bits), FOUND), "suffix-runs")
    again = found.filter("data IS NOT NULL").groupBy("shard").applyInPandas(merge_salts(params), FOUND)
    return found.filter("data IS NULL").unionByName(again).select("doc", "hash", "start", "stop")


def dedup(docs: DataFrame, params: SuffixParams = SuffixParams(), doc_id: str = "doc_id", text: str = "text",
          with_text: bool = False) -> DataFrame:
    """Per row: sizes, number of maximal removed runs and the SHA-256 of what is left (with ``with_text``
    also those bytes as ``kept``)."""
    gone = removed_runs(docs, params, doc_id, text).groupBy("doc", "hash").agg(
        F.collect_set(F.struct("start", "stop")).alias("runs"))
    both = keyed(docs, doc_id, text).join(gone, ["doc", "hash"], "left").select(
        "doc", "text", F.col("runs.start").alias("starts"), F.col("runs.stop").alias("stops"))

    def run(batches: Iterator[list[list]]) -> Iterator[dict]:
        for ids, texts, starts, stops in batches:
            rows = []
            for d, t, a, b in zip(ids, texts, starts, stops):
                keep, merged = t, []
                for x, y in sorted(zip(a or (), b or ())):
                    if merged and x <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], y)
                    else:
                        merged.append([x, y])
                if merged:
                    edges = [0, *(e for m in merged for e in m), len(t)]
                    keep = b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2]))
                rows.append((None if d == NO_ID else d, len(t), len(t) - len(keep), len(merged),
                             hashlib.sha256(keep).hexdigest(), keep))
            cols = list(zip(*rows)) or [[]] * 6
            names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
            yield dict(zip(names, cols))
    return map_batches(both, run, RESULT + (", kept binary" if with_text else ""))
