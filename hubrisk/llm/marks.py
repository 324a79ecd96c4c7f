"""Marks of repeated 64-bit values: which of the corpus' shingles or anchors occur more than once.

Every task sends the sorted 32-bit prefixes of its values, delta coded, to hash ranges (about 2
bytes a value are shuffled). A range counts them and marks in its slice of a bitmap those
found ``theta`` times or more; theta is 2 unless a quarter of the slice's bits (``spare``) would be set, then the
next power of two that fits. A second, smaller bitmap marks very frequent values. Counts cover all
values of all rows; a chance match of prefixes can only mark more.

The bitmap has a fixed size, or (``most_bits``) grows with the text up to a bound; prefixes are then of 40 bits
from ``wide`` bytes on, as those of 32 bits meet by chance as soon as there are many values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubrisk.llm.common import give_back, map_batches


@dataclass(frozen=True)
class MarkParams:
    mark_bits: int = 27        # log2 of the bitmap's size (2**27 bits are 16 MB)
    often_bits: int = 22       # of the bitmap of very frequent values
    often: int = 64            # "very frequent": theta * often occurrences
    flush: int = 1 << 22       # values a task holds before it sends them
    spare: int = 2             # theta rises where more than 1 of 2**spare bits of a slice would be set
    prefix: int = 32           # bits of a value that are counted: 32 or 40
    most_bits: int | None = None  # log2 of the size that the bitmap may grow to with the text; None: it does not
    wide: int = 1 << 30        # bytes of text from which a growing bitmap's prefixes have 40 bits


TEXT_A_BIT = 32  # bytes of text for a bit of a growing bitmap: some 5 shingles, of which most occur once


def fitted(texts: DataFrame, p: MarkParams) -> MarkParams:
    """``p`` for the bytes of a one-column text table."""
    if p.most_bits is None:
        return p
    size = texts.agg(F.sum(F.octet_length(F.col(texts.columns[0])))).first()[0] or 0
    more = min(p.most_bits, max(p.mark_bits, (size // TEXT_A_BIT).bit_length())) - p.mark_bits
    return replace(p, mark_bits=p.mark_bits + more, often_bits=p.often_bits + more, prefix=40 if size >= p.wide else p.prefix)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint32 values, or uint64 ones of 40 bits, as byte planes of their differences (high planes are nearly
    all zero)."""
    wide = values.dtype.itemsize
    deltas = np.diff(values, prepend=values.dtype.type(0)).astype(f"<u{wide}")
    return deltas.view(np.uint8).reshape(-1, wide).T[:min(wide, 5)].tobytes()


def unpack_sorted(blob: bytes, planes: int = 4) -> np.ndarray:
    rows = np.frombuffer(blob, np.uint8).reshape(planes, -1)
    wide = 4 if planes == 4 else 8
    deltas = np.zeros((rows.shape[1], wide), np.uint8)
    deltas[:, :planes] = rows.T
    return np.cumsum(deltas.view(f"<u{wide}").ravel(), dtype=f"u{wide}")


@dataclass(frozen=True)
class Marks:
    """Bitmaps of repeated and of very frequent values; theta by hash range."""

    repeated: np.ndarray
    often: np.ndarray
    theta: np.ndarray
    mark_bits: int
    often_bits: int

    def level(self, values: np.ndarray) -> np.ndarray:
        """0 unmarked, 1 repeated, 2 very frequent."""
        def test(bits: np.ndarray, log2: int) -> np.ndarray:
            at = (values >> np.uint64(64 - log2)).astype(np.int64)
            return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return test(self.repeated, self.mark_bits) + test(self.often, self.often_bits)

    def single(self, values: np.ndarray, level: np.ndarray) -> np.ndarray:
        """True where a value certainly occurs once."""
        shift = np.uint64(64 - (len(self.theta) - 1).bit_length())
        return (level == 0) & (self.theta[(values >> shift).astype(np.int64)] == 2)


def log2_ranges(df: DataFrame, p: MarkParams) -> int:
    """Hash ranges grow with the shuffle partitions the session is sized for."""
    return min(max(4, (2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()), p.often_bits - 3)


def repeated_marks(texts: DataFrame, reader: Callable[[], Callable[[bytes | None], np.ndarray]], p: MarkParams) -> Marks:
    """Marks of the values that ``reader()`` (made once per task) finds in each row of the one column."""
    least, p = p, fitted(texts, p)
    ranges = min(log2_ranges(texts, p) + p.mark_bits - least.mark_bits, p.often_bits - 3)
    prefix, kind = p.prefix, np.uint32 if p.prefix == 32 else np.uint64

    def send(batches: Iterator[list[list]]) -> Iterator[dict]:
        read, held, size = reader(), [], 0

        def out() -> dict:
            values = np.sort(np.concatenate(held))
            ends = np.searchsorted(values, np.arange(1, 1 << ranges, dtype=np.uint64) << np.uint64(prefix - ranges))
            parts = np.split(values, ends)
            return {"part": range(len(parts)), "hashes": [pack_sorted(x) for x in parts]}
        for (rows,) in batches:
            for t in rows:
                held.append((read(t) >> np.uint64(64 - prefix)).astype(kind))
                size += len(held[-1])
            if size >= p.flush:
                yield out()
                held, size = [], 0
        if size:
            yield out()
        del read, held
        give_back()

    mark_bits, often_bits, often, spare = p.mark_bits, p.often_bits, p.often, p.spare

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        values, n = np.unique(np.concatenate([unpack_sorted(b, prefix // 8) for b in pdf["hashes"]]), return_counts=True)

        def bitmap(chosen: np.ndarray, log2: int) -> bytes:
            size = 1 << (log2 - ranges)
            bits = np.zeros(size, np.uint8)
            bits[(chosen >> kind(prefix - log2)).astype(np.int64) - part * size] = 1
            return np.packbits(bits, bitorder="little").tobytes()
        theta = 2
        while np.count_nonzero(n >= theta) > 1 << (mark_bits - ranges - spare):
            theta *= 2
        return pd.DataFrame({"part": [part], "theta": [theta], "repeated": [bitmap(values[n >= theta], mark_bits)],
                             "often": [bitmap(values[n >= theta * often], often_bits)]})

    sent = map_batches(texts, send, "part int, hashes binary")
    rows = sent.groupBy("part").applyInPandas(count, "part int, theta int, repeated binary, often binary").collect()
    n = 1 << ranges  # one row a range, slices of fixed size
    repeated, often_map, theta = np.zeros((n, (1 << mark_bits) // n // 8), np.uint8), np.zeros(
        (n, (1 << often_bits) // n // 8), np.uint8), np.full(n, 2, np.int64)
    for r in rows:
        repeated[r.part] = np.frombuffer(r.repeated, np.uint8)
        often_map[r.part] = np.frombuffer(r.often, np.uint8)
        theta[r.part] = r.theta
    return Marks(repeated.ravel(), often_map.ravel(), theta, mark_bits, often_bits)
