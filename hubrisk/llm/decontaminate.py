"""Operator 4, benchmark decontamination: template canonicalisation.

Texts become token sequences in which numbers, units after numbers and names (capitalised words,
those that begin a sentence too) are typed placeholders. Windows of ``window`` tokens are hash-joined
with those of the benchmark items; a second set of windows keeps names as lower-case words, so that
leaks whose capitals changed are found too. Windows with fewer literal than placeholder tokens are
matched by their exact values instead. Within a joined window each placeholder's value in the item must
map to one value in the document (slot consistency): a passage with new numbers is found, an accidental
mix of values is not; a window that fails does not spoil the others. A document is contaminated by an item
when consistent windows cover at least ``min_cover`` per cent of the item's windows, or ``run_tokens``
consecutive tokens of it.

A fixed-size bitmap of the benchmark's window hashes goes to every task, so only windows that may
match leave the tasks; it loses none. The join is on the hash; the benchmark side is broadcast when
counted to be small, else joined by shuffle (split by adaptive execution when skewed). Groups are
(document, item), never larger than the document's own matches.

Defined results: null, empty or tokenless texts and items match nothing; items of fewer than
``min_tokens`` tokens are not searched, items shorter than a window match as a whole; very long texts
are read whole; rows that share an id are judged together; ties cannot arise, every item is judged alone;
repeated items give a row each; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubrisk.llm.common import cut, map_batches, need, sized_hint
from hubrisk.llm.shingles import P1, P2, SHIFT


@dataclass(frozen=True)
class LeakParams:
    window: int = 8
    min_tokens: int = 4
    min_cover: int = 50            # per cent of an item's windows
    run_tokens: int = 40           # consecutive tokens of a longer item that are a leak whatever they cover
    bitmap_bits: int = 24
    broadcast_rows: int = 1_000_000


UNITS = frozenset((
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l ms s sec min h hr hrs hour hours day days week weeks month months "
    "year years mph kmh kph w kw kwh v a hz khz mhz ghz kb mb gb tb bit bits byte bytes dollars dollar euros euro cents "
    "percent meters metres meter metre miles mile inches feet degrees minutes seconds stunden tage jahre heures jours horas").split())
NUMBER = re.compile(r"[+-]?[$€£]?[0-9]+(?:[.,:/-][0-9]+)*%?")
TRIM = re.compile(r"^[\W_]+|[\W_]+$")
LITERAL, NUM, UNIT, NAME = 0, 1, 2, 3
SLOT = np.array([0, 0x517CC1B727220A95, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85], np.uint64)


class Tokens:
    """Per white-space word, remembered up to a bound: hash, value, and what it may become."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.values: list[str] = []
        self.hash, self.flags = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint8)

    def learn(self, word: str) -> int:
        k = len(self.values)
        if k == len(self.hash):
            self.hash, self.flags = np.resize(self.hash, 2 * k), np.resize(self.flags, 2 * k)
        core = TRIM.sub("", word)
        low = core.lower()
        number = bool(core) and core[0].isdigit() and NUMBER.fullmatch(core) is not None
        self.hash[k] = xxhash.xxh3_64_intdigest(low.encode())
        # 1 number, 2 unit, 4 capitalised, 16 no token
        self.flags[k] = (number | (low in UNITS) << 1 | (core[:1].isupper() and not number) << 2 | (not core) << 4)
        self.values.append(low)
        self.index[word] = k
        return k

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers, hashes, kinds) of the tokens of a text."""
        if len(self.values) > self.limit:
            self.clear()
        get, learn = self.index.get, self.learn
        at = np.array([learn(w) if (k := get(w)) is None else k for w in (text or "").split()], np.int64)
        at = at[(self.flags[at] & 16) == 0]
        flags = self.flags[at]
        after_number = np.zeros(len(at), bool)
        after_number[1:] = (flags[:-1] & 1) > 0
        kinds = np.where(flags & 1, NUM, np.where((flags & 2 > 0) & after_number, UNIT, np.where(
            flags & 4 > 0, NAME, LITERAL))).astype(np.uint8)
        return at, self.hash[at], kinds


def windows(hashes: np.ndarray, kinds: np.ndarray, size: int, names: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window, whether it has at least as many literal tokens as placeholders). With names as
    words, the other windows' hashes are those of their exact values."""
    slot = kinds if names else np.where(kinds == NAME, LITERAL, kinds)
    tokens = np.where(slot == LITERAL, hashes, SLOT[slot])
    n = len(tokens) - size + 1
    h = np.full(n, 2 * size + names, np.uint64) * P1
    for k in range(size):
        h = (h ^ tokens[k:n + k]) * P2
        h ^= h >> SHIFT
    literal = np.concatenate([[0], np.cumsum(slot == LITERAL)])
    ok = 2 * (literal[size:] - literal[:-size]) >= size
    if not names and not ok.all():
        exact = np.flatnonzero(~ok)
        x = np.full(len(exact), 64 + size, np.uint64) * P1
        for k in range(size):
            x = (x ^ hashes[exact + k]) * P2
            x ^= x >> SHIFT
        h[exact] = x
    return h * P1, ok


FOUND = "id long, hash array<long>, place array<int>, slots array<array<string>>, tokens int"


def find(rows: DataFrame, sizes: list[int], bitmap: bytes | None, p: LeakParams) -> DataFrame:
    """Per row (id, text) its windows and their slot values; with a bitmap, those that may match only."""
    sc = rows.sparkSession.sparkContext
    sent = sc.broadcast(bitmap)  # 2 ** bitmap_bits bits

    def run(batches: Iterator[list[list]]) -> Iterator[dict]:
        seen = Tokens()
        bits = None if sent.value is None else np.frombuffer(sent.value, np.uint8)
        for ids, texts in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in FOUND.split(", ")}
            for i, t in zip(ids, texts):
                at, hashes, kinds = seen.of(t)
                n, found = len(at), ([], [], [])
                chosen = sizes if bits is not None else [min(n, p.window)] if n >= p.min_tokens else []
                for size in chosen:
                    for names in (True, False):
                        if n < size:
                            continue
                        h, ok = windows(hashes, kinds, size, names)
                        used = ok if names else np.ones(len(ok), bool)
                        if bits is not None:
                            b = (h >> np.uint64(64 - p.bitmap_bits)).astype(np.int64)
                            used = used & ((bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 > 0)
                        for k in np.nonzero(used)[0]:
                            found[0].append(int(h[k].view(np.int64)))
                            found[1].append(int(k))
                            found[2].append([seen.values[at[j]] for j in range(k, k + size)
                                             if kinds[j] and (names or kinds[j] != NAME)] if ok[k] else [])
                if found[0]:
                    for c, v in zip(out, (i, *found, n)):
                        out[c].append(v)
            yield out
    return map_batches(rows, run, FOUND)


def bitmap_of(hashes: DataFrame, bits: int) -> bytes:
    """The bitmap of the leading bits of a hash column, built by the executors in pieces of 4 KB."""
    place = F.shiftrightunsigned("hash", 64 - bits) + 1
    out = bytearray(1 << (bits - 3))
    pieces = hashes.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()  # fixed total size
    for r in pieces:
        out[(r.b - 1) * 4096:r.b * 4096] = r.m
    return bytes(out)


def flat(found: DataFrame, prefix: str) -> DataFrame:
    return found.select("id", F.explode(F.arrays_zip("hash", "place", "slots")).alias("x")).select(
        F.col("id").alias(f"{prefix}_id"), "x.hash", F.col("x.place").alias(f"{prefix}_place"),
        F.col("x.slots").alias(f"{prefix}_slots"))


def leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams(), doc_id: str = "doc_id",
          text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Contaminated (doc_id, item_id): windows found and searched, cover in per cent, slots, changed slots."""
    p = params
    rows = lambda df, i, t: df.select(F.col(f"`{i}`").cast("long").alias("id"), F.col(f"`{t}`").alias("text"))
    items = cut(find(rows(benchmark, item_id, item_text), [], None, p), "items")
    sizes = sorted(r[0] for r in items.select(F.least("tokens", F.lit(p.window))).distinct().collect())  # at most window
    wanted = cut(flat(items, "item"), "item-windows")
    total = wanted.groupBy("item_id").agg(F.countDistinct("item_place").alias("item_windows"))
    wanted = wanted.join(total, wanted.item_id.eqNullSafe(total.item_id)).drop(total.item_id)
    wanted = cut(wanted, "item-windows")
    wanted = sized_hint(wanted, wanted.count(), p.broadcast_rows)
    found = flat(find(rows(docs, doc_id, text), sizes, bitmap_of(wanted, p.bitmap_bits), p), "doc")
    met = found.join(wanted, "hash").withColumn("shift", F.col("doc_place") - F.col("item_place"))
    slots = F.array_distinct(F.zip_with("item_slots", "doc_slots", lambda x, y: F.struct(x.alias("i"), y.alias("d"))))
    consistent = F.size(F.array_distinct(F.transform("slots", lambda s: s["i"]))) == F.size("slots")
    met = met.withColumn("slots", slots).filter(consistent)
    runs = met.groupBy("doc_id", "item_id", "item_windows", "shift").agg(
        F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    out = runs.withColumn("run", longest_run(F.sort_array("places"))).groupBy("doc_id", "item_id", "item_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_windows"),
        F.max("run").cast("long").alias("n_run_windows"),
        F.max(F.size("slots")).cast("long").alias("n_slots"),
        F.max(F.size(F.filter("slots", lambda s: s["i"] != s["d"]))).cast("long").alias("n_changed"))
    out = out.withColumn("cover_pct", F.floor(F.col("n_windows") * 100 / F.col("item_windows")))
    return out.filter((F.col("cover_pct") >= p.min_cover) | (F.col("n_run_windows") + p.window - 1 >= p.run_tokens)).select(
        "doc_id", "item_id", "n_windows", "item_windows", "cover_pct", "n_slots", "n_changed", "n_run_windows")


def longest_run(places: Column) -> Column:
    """Length of the longest run of consecutive numbers in a sorted array."""
    zero = F.struct(F.lit(0).alias("best"), F.lit(0).alias("now"), F.lit(-2).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        now = F.when(x == acc["last"] + 1, acc["now"] + 1).otherwise(1)
        return F.struct(F.greatest(acc["best"], now).alias("best"), now.alias("now"), x.alias("last"))
    return F.aggregate(places, zero, step, lambda acc: acc["best"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams(), doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents; rows with a null id stay."""
    bad = need(leaks(docs, benchmark, params, doc_id, text), "doc_id").distinct().withColumnRenamed("doc_id", "_leak")
    return docs.join(bad, F.col(f"`{doc_id}`") == F.col("_leak"), "left_anti")
