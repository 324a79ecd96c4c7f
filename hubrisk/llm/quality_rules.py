"""Operator 1, quality rules: a threshold table compiled into one Spark projection.

``metrics`` computes length, symbol, stop-word and line counts of whole texts with built-in
functions only; ``apply_rules`` compiles a table of ``Rule`` rows into Boolean expressions over
them. No Python runs on the executors and nothing is shuffled: each row is judged alone, so hot
sources and copies cost nothing extra.

Defined results: a null text counts as having no words (all counts 0) and fails the base rules,
like an empty one; repeated rows and ties are judged one by one; an empty table gives an empty
result; extra columns pass through, but columns named like a metric or flag are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubrisk.llm.common import WHITE


@dataclass(frozen=True)
class Rule:
    """Reject when ``100 * part > max_pct * whole`` or ``100 * part < min_pct * whole``;
    judged only when ``whole`` is at least ``least``."""

    name: str
    part: str
    whole: str
    max_pct: int | None = None
    min_pct: int | None = None
    least: int = 0


@dataclass(frozen=True)
class BaseRules:
    min_words: int = 50
    max_repeat_pct: int = 50


#: The threshold table. A word count of 50 and a repeated-window share of 50 % are the base rules.
RULES: tuple[Rule, ...] = (
    Rule("symbols", "n_symbols", "n_words", max_pct=10),
    Rule("short_words", "word_chars", "n_words", min_pct=200),
    Rule("long_words", "word_chars", "n_words", max_pct=1500),
    Rule("repeated_lines", "n_dup_lines", "n_lines", max_pct=30, least=4),
    Rule("bullets", "n_bullet_lines", "n_lines", max_pct=90, least=4),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", max_pct=30, least=4),
    Rule("no_stop_words", "n_stop_words", "n_words", min_pct=1, least=50),
)

#: Frequent function words of the corpus languages.
STOP_WORDS: tuple[str, ...] = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "are", "this", "be", "have",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "des", "ein", "eine", "nicht", "er",
    "le", "la", "les", "des", "et", "un", "une", "du", "que", "est", "dans", "pour", "qui", "sur", "pas", "au",
    "el", "los", "las", "y", "en", "por", "con", "una", "se", "su", "de", "lo", "como", "no",
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bullet_lines",
          "n_ellipsis_lines", "n_stop_words")


def _stop_words() -> list[str]:
    """Lower-case and capitalised forms."""
    return sorted({f for w in STOP_WORDS for f in (w, w.capitalize())})


def _windows(words: Column) -> Column:
    """64-bit hash of every 3-word window, by place. Within a text of n words a chance match of two
    different windows has odds below n * n / 2**65."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                       lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))


def _covered(pairs: Column) -> Column:
    """Words in [place, place + 3) of any window that has an equal neighbour in sorted (hash, place) pairs."""
    places = F.sort_array(F.filter(
        F.transform(pairs, lambda x, k: F.when(
            (x["h"] == F.get(pairs, k - 1)["h"]) | (x["h"] == F.get(pairs, k + 1)["h"]), x["p"])),
        lambda p: p.isNotNull()))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(
        places, zero,
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("n"),
                                p.alias("last")),
        lambda acc: acc["n"])


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the long columns of ``COUNTS`` added. Lines are \\n-split pieces with a word."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bare = lambda s: F.btrim(s, F.lit(WHITE))
    out = (
        docs.drop(*COUNTS)
        .withColumn("_bare", bare(t))
        .withColumn("_words", F.when(F.col("_bare") == "", F.array().cast("array<string>"))
                    .otherwise(F.split("_bare", r"[\x20\x09-\x0D]+")))
        .withColumn("_lines", F.filter(F.split(t, "\n"), lambda s: bare(s) != ""))
        .withColumn("_hashes", F.when(F.size("_words") >= 4, _windows(F.col("_words"))))
        # Most texts repeat no window, which a hash set tells; the others' windows are sorted.
        .withColumn("_pairs", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(
            F.transform("_hashes", lambda h, p: F.struct(h.alias("h"), p.alias("p"))))))
    )
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.length(F.regexp_replace("_bare", r"[^#*$%&|<>]+", "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(_covered(F.col("_pairs")), F.lit(0)),
        "n_bullet_lines": F.size(F.filter("_lines", lambda s: F.substring(bare(s), 1, 1).isin("-", "*", "•"))),
        "n_ellipsis_lines": F.size(F.filter("_lines", lambda s: bare(s).endswith("...") | bare(s).endswith("…"))),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(_stop_words()))),
    }
    return out.withColumns({k: v.cast("long") for k, v in counts.items()}).drop(
        "_bare", "_words", "_lines", "_hashes", "_pairs")


def _fails(r: Rule) -> Column:
    part, whole = F.col(r.part) * 100, F.col(r.whole)
    tests = []
    if r.max_pct is not None:
        tests.append(part > whole * r.max_pct)
    if r.min_pct is not None:
        tests.append(part < whole * r.min_pct)
    return reduce(lambda a, b: a | b, tests) & (whole >= max(r.least, 1))


def apply_rules(measured: DataFrame, rules: tuple[Rule, ...] = RULES, base: BaseRules = BaseRules()) -> DataFrame:
    """Add ``base_failed``, ``failed_rules`` (comma-joined names of the table's rules that reject
    the row, '' for none) and ``kept``."""
    base_failed = (F.col("n_words") < base.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * base.max_repeat_pct)
    failed = F.concat_ws(",", *[F.when(_fails(r), F.lit(r.name)) for r in rules])
    return measured.withColumns({"base_failed": base_failed, "failed_rules": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES,
                  base: BaseRules = BaseRules()) -> DataFrame:
    return apply_rules(metrics(docs, text), rules, base)


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: BaseRules = BaseRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns as they were. The verdict filters through a
    generator: a plain filter would be pushed below the projections, and the metric expressions copied
    into it, where they would be evaluated again for every window of a text."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    renamed = docs.select(F.col(f"`{text}`").alias("_text"), F.struct(*columns).alias("_row"))
    judged = quality_rules(renamed, "_text", rules, base)
    return judged.select("_row", F.explode(F.when(F.col("kept"), F.array(F.lit(1)))).alias("_one")).select("_row.*")


def oracle_sql(rules: tuple[Rule, ...] = RULES, base: BaseRules = BaseRules()) -> str:
    """The same table as DuckDB SQL over ``documents``."""
    def fails(r: Rule) -> str:
        tests = [f"100 * {r.part} > {r.max_pct} * {r.whole}"] if r.max_pct is not None else []
        tests += [f"100 * {r.part} < {r.min_pct} * {r.whole}"] if r.min_pct is not None else []
        return f"(({' OR '.join(tests)}) AND {r.whole} >= {max(r.least, 1)})"
    failed = ", ".join(f"CASE WHEN {fails(r)} THEN '{r.name}' END" for r in rules)
    stop = ", ".join(f"'{w}'" for w in _stop_words())
    ws = r"[\x20\x09-\x0D]"
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '{WORD_SQL}')) AS lines
  FROM documents),
pos AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM t WHERE len(words) >= 3),
win AS (SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS w FROM pos),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         len(list_filter(lines, lambda s: regexp_matches(s, '^{ws}*[-*\\x{{2022}}]'))) AS n_bullet_lines,
         len(list_filter(lines, lambda s: regexp_matches(s, '(\\.\\.\\.|\\x{{2026}}){ws}*$'))) AS n_ellipsis_lines,
         len(list_filter(words, lambda w: w IN ({stop}))) AS n_stop_words
  FROM t LEFT JOIN cov ON t.doc_id = cov.doc_id),
f AS (
  SELECT *, n_words < {base.min_words} OR 100 * n_repeat_words > {base.max_repeat_pct} * n_words AS base_failed,
         concat_ws(',', {failed}) AS failed_rules FROM m)
SELECT doc_id, {', '.join(f'{c}::BIGINT AS {c}' for c in COUNTS)}, base_failed, failed_rules,
       NOT base_failed AND failed_rules = '' AS kept
FROM f"""


WORD_SQL = r"[^\x20\x09-\x0D]"
