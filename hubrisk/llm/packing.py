"""Operator 10, packing: cost-balanced sequences of subword ids.

Each task tokenises its share of the documents and packs it in pools of a few million tokens: a
document is cut into full sequences and one rest; the rests, in descending order of estimated
attention cost (linear plus quadratic in the piece's length), go to the lowest-cost open sequence
that has room for them. A pool opens as many sequences as its rests fill exactly, and a rest that
fits nowhere is cut, so those sequences end full. What is left of a pool (less than one sequence)
becomes sequences of power-of-two lengths, which need no padding.

Nothing is shuffled and no key is grouped, so hot sources cost nothing; a task holds one pool of ids
(4 bytes each), the texts of one look-up and a bounded word cache. Sequence ids are the task's partition number and a counter,
so a task that runs again after a lost executor gives the same rows.

Defined results: a null or empty text has the end id alone; repeated rows are packed one by one;
ties of length keep the input's order; an empty table gives no sequences; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubrisk.llm.common import give_back, map_batches


@dataclass(frozen=True)
class PackParams:
    capacity: int = 2048
    end_id: int = 1
    linear: float = 1.0            # cost of a token outside attention
    quadratic: float = 1.0 / 4096  # cost of a token pair inside one piece, in the same unit
    pool_tokens: int = 1 << 21
    cache_words: int = 400_000
    batch_chars: int = 1 << 21     # characters whose words are looked up together


# Bytes of letters U+0041 to U+005A, U+0061 to U+007A and U+00C0 to U+00FF in UTF-8: the latter are 0xC3 and a byte
# of 0x80 to 0xBF. No other letter is of these bytes alone. Their small forms are one byte off, but for U+00DF.
ASCII_LETTERS = np.zeros(256, bool)
ASCII_LETTERS[ord("A"):ord("Z") + 1] = ASCII_LETTERS[ord("a"):ord("z") + 1] = True
LETTERS = ASCII_LETTERS.copy()
LETTERS[[0xC3, *range(0x80, 0xC0)]] = True
LETTERS[[0x97, 0xB7]] = False  # the signs for times and divided by
SMALL = np.arange(256, dtype=np.uint8)
SMALL[ord("A"):ord("Z") + 1] += 32
SMALL[0x80:0x9F] += 32
ACCENTED = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]

MARKS = np.zeros(256, bool)  # ASCII marks but the apostrophe, which starts endings like 's
MARKS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True


def byte_signs() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class Merges:
    """The tokenizer's merges for words of small letters, many words at a time: one row of symbols a
    word, one merge a row and step (the lowest rank, leftmost among equals), rows without a merge are done."""

    WIDTHS, NONE = (7, 12, 24), np.iinfo(np.int32).max
    LONGEST = WIDTHS[-1]
    ROWS = 1 << 13  # words merged at a time: a few arrays of that many rows, however many words are new

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        key = left << 32 | right
        by = np.argsort(key, kind="stable")
        self.key, self.rank = np.append(key[by], np.iinfo(np.int64).max), np.append(by, 0).astype(np.int32)
        # A merge drops the prefix of its right part; there is none (else this class is not used).
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.inner, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        signs = byte_signs()
        self.letters = LETTERS if all(c in vocab and c + suffix in vocab for c in map(signs.__getitem__, np.flatnonzero(LETTERS))) else ASCII_LETTERS
        for b in np.flatnonzero(self.letters & (SMALL == np.arange(256))):
            self.inner[b], self.last[b] = vocab[signs[b]], vocab[signs[b] + suffix]
        # Ranks of pairs of single bytes; the last row and column are for places without a symbol.
        size = int(max(self.inner.max(), self.last.max())) + 2
        self.first = np.full((size, size), self.NONE, np.int32)
        single = np.flatnonzero((left < size - 1) & (right < size - 1))[::-1]  # the lowest rank of a pair stays
        self.first[left[single], right[single]] = single

    @classmethod
    def of(cls, path: str) -> Merges | None:
        """None if the tokenizer's merging model has parts that this class does not follow."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not (
            model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
        return cls(model) if plain else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.rank[at], self.NONE)

    def encode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids) for words of 1 to ``LONGEST`` bytes of letters in ``data``."""
        data = SMALL[data]
        counts, parts = np.zeros(len(starts), np.int64), []
        for least, most in zip((0, *self.WIDTHS), self.WIDTHS):
            fitting = np.flatnonzero((sizes > least) & (sizes <= most))
            place = np.arange(most)
            for rows in (fitting[k:k + self.ROWS] for k in range(0, len(fitting), self.ROWS)):
                self.merge(rows, place, data, starts, sizes, counts, parts)
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for rows, ids in parts:
            flat[spread(starts[rows], counts[rows])] = ids
        return counts, flat

    def merge(self, rows: np.ndarray, place: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
              counts: np.ndarray, parts: list) -> None:
        """Merge the words ``rows`` to their end; enters ``counts`` and adds (rows, ids) to ``parts``."""
        text = data[np.minimum(starts[rows, None] + place, len(data) - 1)]
        end = sizes[rows, None] - 1
        symbols = np.where(place < end, self.inner[text], np.where(place == end, self.last[text], np.int32(-1)))
        ranks = self.first[symbols[:, :-1], symbols[:, 1:]]
        while len(rows):
            at = ranks.argmin(1)
            low = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            if (done := low == self.NONE).any():
                final = symbols[done]
                inside = final >= 0
                counts[rows[done]] = inside.sum(1)
                parts.append((rows[done], final[inside]))
                rows, symbols, ranks, at, low = (x[~done] for x in (rows, symbols, ranks, at, low))
            row, after = np.arange(len(rows)), np.arange(symbols.shape[1] - 1) >= at[:, None]
            ranks = np.append(np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1]),
                              np.full((len(rows), 1), self.NONE), 1)
            symbols = np.append(np.where(after, symbols[:, 1:], symbols[:, :-1]),
                                np.full((len(rows), 1), np.int32(-1)), 1)
            symbols[row, at] = self.made[low]
            for k, j in ((row[at > 0], at[at > 0] - 1), (row, at)):  # the pairs that end and start in the new symbol
                ranks[k, j] = self.ranks(symbols[k, j], symbols[k, j + 1])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordIds:
    """Subword ids of texts, word by word with a cache. Exact for tokenizers whose pieces never span a
    blank or line feed (they drop white space before merging); each new word is seen once.

    Arrow splits the texts of a batch and numbers their different words. New words of ASCII or accented
    Latin letters (capitals are made small, marks at the end are put apart) are merged together (``Merges``); others of letters go to the tokenizer many
    at a time, joined by blanks: each ends in exactly one token that
    carries the word-end mark, which is where the ids are cut. If the marks do not add up (or the
    tokenizer has none), and for all other words, it gets them one by one."""

    MARK, TAIL, JOIN = "</w>", ".,;:!?", 256
    END = 4  # marks at the end that are put apart

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.merges = Tokenizer.from_file(path), limit, Merges.of(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(self.MARK) for i in range(size)])
        self.tail = {c: self.alone([c])[0] for c in self.TAIL} if self.ends.any() else {}
        self.tail[""] = b""
        self.marks: dict[int, np.ndarray | None] = {}  # ids of the marks at a word's end, None if they aren't apart
        if self.merges is not None and self.merges.letters is LETTERS:
            probes = [x + c for c in ACCENTED for x in ("", "a")]
            data, sizes = [p.encode() for p in probes], np.array([len(p.encode()) for p in probes])
            counts, ids = self.merges.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes, sizes)
            if b"".join(self.alone(probes)) != ids.tobytes() or any(len(x) != 4 * n for x, n in zip(self.alone(probes), counts)):
                self.merges.letters = ASCII_LETTERS
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.cores: dict[str, tuple[bytes, bool]] = {}  # ids, whether in one piece
        self.flat, self.start = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.size, self.used = np.zeros(1 << 14, np.int64), 0

    def alone(self, words: list[str]) -> list[bytes]:
        """Ids (int32 bytes, which the garbage collector need not follow) of each text."""
        return [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def letters(self, words: list[str]) -> list[tuple[bytes, bool]]:
        """Ids of words of letters only, and whether the word is one piece."""
        out: list[tuple[bytes, bool]] = []
        groups = [words[i:i + self.JOIN] for i in range(0, len(words), self.JOIN)]
        for group, ids in zip(groups, self.alone([" ".join(g) for g in groups])):
            at = 4 * (np.flatnonzero(self.ends[np.frombuffer(ids, np.int32)]) + 1)
            if len(at) == len(group) and at[-1] == len(ids):
                cuts = [0, *at.tolist()]
                out += [(ids[a:b], True) for a, b in zip(cuts, cuts[1:])]
            else:
                out += [(i, np.count_nonzero(self.ends[np.frombuffer(i, np.int32)]) == 1) for i in self.alone(group)]
        return out

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of words of any kind."""
        parts = []
        for w in words:
            core, tail = (w[:-1], w[-1]) if w[-1] in self.tail else (w, "")
            # The tokenizer lower-cases; letters beyond ASCII are left to it.
            parts.append((core.lower() if core.isascii() else core, tail) if core.isalpha() else (None, ""))
        new = list({core for core, _ in parts if core} - self.cores.keys()) if len(self.tail) > 1 else []
        self.cores.update(zip(new, self.letters(new)))
        ids: list[bytes | None] = []
        for core, tail in parts:
            found, whole = self.cores.get(core, (None, False))
            # A letter that lower-cases to more than letters takes the mark after it into one piece.
            ids.append(found + self.tail[tail] if whole or found is not None and not tail else None)
        other = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(other, self.alone([words[k] for k in other])):
            ids[k] = x
        return ids

    def marks_of(self, key: int) -> np.ndarray | None:
        """Ids of marks that follow letters (their bytes are ``key``'s, the last one lowest)."""
        if key not in self.marks:
            tail = key.to_bytes(self.END, "big").lstrip(b"\0").decode()
            whole, letter, ids = self.alone(["a" + tail, "a", tail])
            self.marks[key] = np.frombuffer(ids, np.int32) if whole == letter + ids else None
        return self.marks[key]

    def plain(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Which words are letters of a length that ``Merges`` takes, but for up to ``END`` marks at the end, how many
        marks, which of the different ends (-1 none), and the ids of each end."""
        ends, which = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
        if self.merges is None:
            return ends > 0, ends, which, []
        keys, run = np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
        for k in range(1, self.END + 1):
            last = data[np.maximum(starts + sizes - k, 0)]
            run &= (sizes > k) & MARKS[last]
            ends += run
            keys += run * (last.astype(np.int64) << 8 * (k - 1))
        core, letters = sizes - ends, np.append(0, np.cumsum(self.merges.letters[data]))
        plain = (core <= Merges.LONGEST) & (letters[starts + core] - letters[starts] == core)
        marked = np.flatnonzero(plain & (ends > 0))
        different, which[marked] = np.unique(keys[marked], return_inverse=True)
        ids = [self.marks_of(k) for k in different.tolist()]
        apart = np.array([x is not None for x in ids], bool)
        plain[marked] = apart[which[marked]]
        return plain, ends, which, [np.empty(0, np.int32) if x is None else x for x in ids]

    def learn(self, words: pa.Array) -> None:
        """Enter new words (not empty)."""
        texts = words.to_numpy(zero_copy_only=False).tolist()
        _, offsets, data = words.buffers()
        data = np.frombuffer(data, np.uint8)
        cuts = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1]
        starts, lengths = cuts[:-1], np.diff(cuts)
        plain, ends, which, end_ids = self.plain(data, starts, lengths)
        easy, hard = np.flatnonzero(plain), np.flatnonzero(~plain)
        marked = np.flatnonzero(plain & (ends > 0))
        end_sizes = np.array([len(x) for x in end_ids], np.int64)
        sizes, n = np.zeros(len(texts), np.int64), len(self.index)
        if len(easy):
            counts, found = self.merges.encode(data, starts[easy], (lengths - ends)[easy])
            sizes[easy] = counts
            sizes[marked] += end_sizes[which[marked]]
        ids = self.ids_of([texts[k] for k in hard.tolist()])
        sizes[hard] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = self.used + np.cumsum(sizes) - sizes
        self.used += int(sizes.sum())
        while n + len(texts) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        if len(easy):
            self.flat[spread(first[easy], counts)] = found
        if len(marked):
            m, of = end_sizes[which[marked]], which[marked]
            self.flat[spread(first[marked] + sizes[marked] - m, m)] = np.concatenate(end_ids)[
                spread((np.cumsum(end_sizes) - end_sizes)[of], m)]
        self.flat[spread(first[hard], sizes[hard])] = np.frombuffer(b"".join(ids), np.int32)
        self.start[n:n + len(texts)], self.size[n:n + len(texts)] = first, sizes
        self.index.update(zip(texts, range(n, n + len(texts))))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; the words of one batch are learned and looked up together."""
        lines = pc.replace_substring(pc.fill_null(pa.array(texts, pa.large_string()), ""), "\n", " ")
        split = pc.split_pattern(lines, " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.index) + len(words) > self.limit:
            self.reset()
        known = list(map(self.index.get, words))
        if new := [k for k, x in enumerate(known) if x is None]:
            known_before = len(self.index)
            self.learn(coded.dictionary.take(pa.array(new, pa.int64())))
            for k, x in zip(new, range(known_before, len(self.index))):
                known[k] = x
        at = np.array(known, np.int64)[coded.indices.to_numpy()]
        sizes = self.size[at]
        ids = self.flat[spread(self.start[at], sizes)]
        cuts = np.append(0, np.cumsum(sizes))[split.offsets.to_numpy()].tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield ids[a:b]


def pack_pool(docs: list[tuple[int | None, np.ndarray]], p: PackParams, first_sequence: int) -> tuple[dict, int]:
    """Pieces of one pool and the number of sequences used."""
    cap = p.capacity
    out: dict[str, list] = {k: [] for k in NAMES}

    def emit(k: int, start: int, length: int, sequence: int, offset: int) -> None:
        doc, ids = docs[k]
        for name, v in zip(NAMES, (doc, start, length, zlib.crc32(ids[start:start + length].astype("<u4").tobytes()),
                                   len(ids), first_sequence + sequence, offset)):
            out[name].append(v)

    sequences = 0
    rests: list[tuple[int, int]] = []  # (document, start)
    for k, (_, ids) in enumerate(docs):
        full = len(ids) // cap
        for j in range(full):
            emit(k, j * cap, cap, sequences, 0)
            sequences += 1
        if len(ids) > full * cap:
            rests.append((k, full * cap))
    lengths = np.array([len(docs[k][1]) - s for k, s in rests], np.int64)
    n = int(lengths.sum()) // cap
    room, cost = np.full(n, cap, np.int64), np.zeros(n)
    tail: list[tuple[int, int, int]] = []
    # Descending by cost: cost grows with length, so by length; what a cut leaves goes back in its place.
    todo = [(int(lengths[i]), *rests[i]) for i in np.argsort(-lengths, kind="stable")][::-1]
    while todo:
        length, k, start = todo.pop()
        if not n or not room.any():
            tail.append((length, k, start))
            continue
        fits = room >= length
        j = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, np.inf)))
        take = min(length, int(room[j]))
        emit(k, start, take, sequences + j, cap - int(room[j]))
        room[j] -= take
        cost[j] += p.linear * take + p.quadratic * take * take
        if take < length:
            rest, at = (length - take, k, start + take), len(todo)
            while at and todo[at - 1][0] < rest[0]:
                at -= 1
            todo.insert(at, rest)
    sequences += n
    left = sum(x[0] for x in tail)
    while left:  # power-of-two sequences
        size = 1 << (left.bit_length() - 1)
        offset = 0
        while offset < size:
            length, k, start = tail.pop(0)
            take = min(length, size - offset)
            emit(k, start, take, sequences, offset)
            offset += take
            if take < length:
                tail.insert(0, (length - take, k, start + take))
        sequences += 1
        left -= size
    return out, sequences


def joined(batches: Iterator[list[list]], chars: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of batches put together up to a number of characters, so that a word is looked up less often."""
    ids, texts, size = [], [], 0
    for more, found in batches:
        ids, texts, size = ids + more, texts + found, size + sum(len(t) for t in found if t)
        if size >= chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
PIECES = ", ".join(f"{n} long" for n in NAMES)


def pack(docs: DataFrame, tokenizer: str, params: PackParams = PackParams(), doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Pieces of packed sequences; ``tokenizer`` is the path of a tokenizers file on the executors."""
    def run(batches: Iterator[list[list]]) -> Iterator[dict]:
        words = WordIds(tokenizer, params.cache_words)
        give_back()  # what reading the tokenizer took besides
        sequence = TaskContext.get().partitionId() << 32
        pool: list[tuple[int | None, np.ndarray]] = []
        held = 0
        end = np.array([params.end_id], np.int32)
        for ids, texts in joined(batches, params.batch_chars):
            for i, found in zip(ids, words.encode(texts)):
                pool.append((i, np.concatenate([found, end])))
                held += len(pool[-1][1])
                if held >= params.pool_tokens:
                    out, used = pack_pool(pool, params, sequence)
                    yield out
                    sequence, pool, held = sequence + used, [], 0
        if pool:
            yield pack_pool(pool, params, sequence)[0]
        del words, pool
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return map_batches(src, run, PIECES)
