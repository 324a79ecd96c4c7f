"""Operator 2, secret scans: probabilistic automata inferred from labelled credentials.

1. One pass over the whole texts finds the base spans (three fixed patterns) and all candidate
   tokens (long runs of credential characters with a digit and a letter).
2. The base spans are the labelled credentials. Per kind, a bounded sample trains an automaton: a
   prefix tree whose statistically compatible states are merged (red/blue order, Hoeffding test).
3. Every candidate is scored by its format likelihood: log2 likelihood under the best automaton
   against a uniform draw from the candidate alphabet. Those above the thresholds add ``format``
   spans; base spans always stay.

Only the sample (at most ``sample`` values of at most ``max_train_chars`` characters per kind)
reaches the driver, and the automata sent to the tasks are no larger than it. Rows are judged
alone, nothing but the sample is shuffled, so hot sources need no care.

Defined results: a null or empty text has no spans; repeated rows are scanned one by one; ties in
the sample are broken by value; an empty table or one without credentials gives base spans only;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubrisk.llm.common import cut, map_batches, need

#: The base kinds, in the order that breaks ties of equal starts.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Every access, hex or candidate span lies within a run of 16 or more printable ASCII characters.
DENSE = re.compile(r"[!-~]{16,}")
HEX_LONG = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = 66  # characters of CANDIDATE


@dataclass(frozen=True)
class SecretParams:
    sample: int = 400           # training values per kind
    max_train_chars: int = 200  # longer values are not used for training
    alpha: float = 0.05         # Hoeffding test level of a merge
    min_bits: float = 16.0      # log2 likelihood gain of a whole candidate
    min_bits_per_char: float = 0.75


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind index, end, credential) of the three base kinds, sorted."""
    out = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    for run in DENSE.finditer(text):
        a, b = run.span()
        out += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 18]
        out += [(m.start(), 2, m.end(), m.group()) for m in HEX_LONG.finditer(text, a, b)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidate tokens with a digit and a letter that touch no base span."""
    out = []
    for run in DENSE.finditer(text):
        for m in CANDIDATE.finditer(text, *run.span()):
            s = m.group()
            if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and not any(
                    a < m.end() and m.start() < b for a, _, b, _ in taken):
                out.append((m.start(), 3, m.end(), s))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# --- probabilistic automata -----------------------------------------------------------------


def infer(values: list[str], alpha: float) -> list[dict]:
    """Merge compatible prefix-tree states. State: {"n": visits, "end": stops, "next": {char: [state, count]}}."""
    states: list[dict] = [{"n": 0, "end": 0, "next": {}}]
    for v in sorted(values):
        at = 0
        states[0]["n"] += 1
        for c in v:
            edge = states[at]["next"].get(c)
            if edge is None:
                states.append({"n": 0, "end": 0, "next": {}})
                edge = states[at]["next"][c] = [len(states) - 1, 0]
            edge[1] += 1
            at = edge[0]
            states[at]["n"] += 1
        states[at]["end"] += 1
    bound = math.sqrt(0.5 * math.log(2.0 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(r: int, b: int) -> bool:
        todo = [(r, b)]
        while todo:
            x, y = (states[i] for i in todo.pop())
            if differ(x["end"], x["n"], y["end"], y["n"]):
                return False
            for c in x["next"].keys() | y["next"].keys():
                ex, ey = x["next"].get(c), y["next"].get(c)
                if differ(ex[1] if ex else 0, x["n"], ey[1] if ey else 0, y["n"]):
                    return False
                if ex and ey:
                    todo.append((ex[0], ey[0]))
        return True

    def fold(r: int, b: int) -> None:
        todo = [(r, b)]
        while todo:
            i, j = todo.pop()
            x, y = states[i], states[j]
            x["n"] += y["n"]
            x["end"] += y["end"]
            for c, (to, count) in y["next"].items():
                edge = x["next"].get(c)
                if edge is None:
                    x["next"][c] = [to, count]
                else:
                    edge[1] += count
                    if edge[0] != to:
                        todo.append((edge[0], to))

    red, seen = [0], {0}
    while True:
        blue = next(((p, c, e[0]) for p in red for c, e in sorted(states[p]["next"].items()) if e[0] not in seen), None)
        if blue is None:
            break
        parent, c, b = blue
        for r in red:
            if compatible(r, b):
                states[parent]["next"][c][0] = r
                fold(r, b)
                break
        else:
            red.append(b)
            seen.add(b)
    index = {s: i for i, s in enumerate(red)}
    return [{"n": states[s]["n"], "end": states[s]["end"],
             "next": {c: [index[to], count] for c, (to, count) in states[s]["next"].items()}} for s in red]


def bits(automaton: list[dict], s: str) -> float:
    """log2 likelihood of ``s`` (with its end), add-half smoothed. An edge that was never seen keeps
    the state, at the smoothed price."""
    at, total = 0, 0.0
    for c in s:
        st = automaton[at]
        edge = st["next"].get(c)
        total += math.log2(((edge[1] if edge else 0) + 0.02) / (st["n"] + 0.02 * (ALPHABET + 1)))
        at = edge[0] if edge else at
    st = automaton[at]
    return total + math.log2((st["end"] + 0.02) / (st["n"] + 0.02 * (ALPHABET + 1)))


def gain(automata: list[list[dict]], s: str) -> float:
    """Bits that the best automaton saves against uniform characters of the candidate alphabet."""
    return max((bits(a, s) for a in automata), default=-math.inf) + len(s) * math.log2(ALPHABET)


# --- Spark ----------------------------------------------------------------------------------

FOUND = ("doc_id long, text_key string, starts array<int>, kinds array<int>, ends array<int>, values array<string>, "
         "base_sha256 string")


def text_key(text: str) -> Column:
    """SHA-256 of a text: with the id, it tells which rows a scan's spans belong to."""
    return F.sha2(F.col(f"`{text}`").cast("binary"), 256)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base spans and candidates of every document (one row each, in the input's order)."""
    def scan(batches: Iterator[list[list]]) -> Iterator[dict]:
        for ids, texts, keys in batches:
            out: dict[str, list] = {"doc_id": ids, "text_key": keys, "starts": [], "kinds": [], "ends": [], "values": [], "base_sha256": []}
            for t in texts:
                base = base_spans(t or "")
                found = base + candidates(t or "", base)
                for k, name in enumerate(("starts", "kinds", "ends", "values")):
                    out[name].append([x[k] for x in found])
                out["base_sha256"].append(hashlib.sha256(joined([x[:3] for x in base]).encode()).hexdigest())
            yield out
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), text_key(text).alias("text_key"))
    return map_batches(src, scan, FOUND)


def train(found: DataFrame, p: SecretParams) -> list[list[dict]]:
    """One automaton per base kind, from the sample of distinct values with the smallest hashes."""
    automata = []
    flat = found.select(F.explode(F.arrays_zip("kinds", "values")).alias("x")).select("x.kinds", "x.values")
    for kind in range(3):
        values = (flat.filter((F.col("kinds") == kind) & (F.length("values") <= p.max_train_chars))
                  .select("values").distinct().orderBy(F.xxhash64("values"), "values").limit(p.sample).collect())
        if len(values) >= 10:
            automata.append(infer([r[0] for r in values], p.alpha))
    return automata


RESULT_NAMES = ("doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans")
SCANNED_NAMES = (*RESULT_NAMES, "text_key")
SCANNED = ("doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string, "
           "text_key string")


def secret_scan(docs: DataFrame, params: SecretParams = SecretParams(), doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """Per document: counts by kind, the digest of the base spans and all spans (start order); and the key
    of the text, for ``redact``."""
    found = cut(find(docs, doc_id, text), "secret-spans")
    sent = found.sparkSession.sparkContext.broadcast(train(found, params))  # bounded by the sample

    def judge(batches: Iterator[list[list]]) -> Iterator[dict]:
        automata = sent.value
        for cols in batches:
            rows = []
            for i, key, a, k, b, v, digest in zip(*cols):
                spans = []
                for s, kind, e, value in zip(a, k, b, v):
                    if kind == 3:
                        g = gain(automata, value)
                        if g < params.min_bits or g < params.min_bits_per_char * len(value):
                            continue
                    spans.append((s, kind, e))
                n = [sum(1 for x in spans if x[1] == kind) for kind in range(4)]
                rows.append((i, *n, digest, joined(sorted(spans)), key))
            yield dict(zip(SCANNED_NAMES, zip(*rows) if rows else [[]] * len(SCANNED_NAMES)))
    return map_batches(found, judge, SCANNED)


def redact(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text",
           mark: str = "<secret>", length: str | None = None) -> DataFrame:
    """``docs`` with every span (overlaps merged) of whole texts replaced by ``mark``, and the column
    ``length`` (if any) set to the new text's code points; documents without spans are unchanged, byte
    for byte. ``spans``: rows of ``secret_scan``, joined by id (null ids too) and text, so that rows which share an
    id are each cut by the spans of their own text."""
    names = docs.columns
    hit = need(spans.filter("spans <> ''"), "doc_id", "text_key", "spans").dropDuplicates(["doc_id", "text_key"]).withColumnsRenamed(
        {"doc_id": "_id", "text_key": "_key", "spans": "_spans"})
    same = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("_id")) & (text_key(text) == F.col("_key"))
    both = docs.join(hit, same, "left").drop("_id", "_key")

    @F.pandas_udf("string")
    def mask(texts: pd.Series, where: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, where):
            cuts: list[list[int]] = []
            for a, b in sorted(tuple(map(int, x.split(":")[1:])) for x in s.split(",")):
                if cuts and a < cuts[-1][1]:
                    cuts[-1][1] = max(cuts[-1][1], b)
                else:
                    cuts.append([a, b])
            at, parts = 0, []
            for a, b in cuts:
                parts += [t[at:a], mark]
                at = b
            out.append("".join(parts) + t[at:])
        return pd.Series(out)

    dirty = both.filter("_spans IS NOT NULL").withColumn(text, mask(F.col(f"`{text}`"), F.col("_spans")))
    if length in names:
        dirty = dirty.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return both.filter("_spans IS NULL").unionByName(dirty).select(*[F.col(f"`{n}`") for n in names])
