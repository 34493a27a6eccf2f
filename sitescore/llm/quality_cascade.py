"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule's cost and rejections are measured on a sample; the cascade then tries the rules, those of
the base among them, in the order of rejections per cost, and a text that one rule rejects isn't
tried by the later ones. The order changes the work, never the verdict. screen() computes a measure
only where a rule that is reached asks for it; quality() reports all measures of every text, so
there only what the rules do beside them is saved.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, checkpoint

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SAMPLE_ROWS = 2_000
#: So often a rule is timed over the sample; the shortest time counts.
TIMES = 2
#: So many repeated windows of a text are looked up in a list; more are found by sorting.
FEW = 64
MEASURES = "__quality_measures"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeat_words(words: Column) -> Column:
    """The words inside windows of WINDOW words that are found twice or more in the array."""

    def covered(windows: Column) -> Column:
        again = let(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
        starts = let(again, lambda r: F.when(F.size(r) <= FEW, found(windows, r)).otherwise(placed(windows)))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])

    def found(windows: Column, again: Column) -> Column:
        """The places of windows that are in again, a short list."""
        return F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: F.array_contains(again, F.get(windows, i)))

    def placed(windows: Column) -> Column:
        """The places of windows that occur twice or more, by sorting them with their places."""
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        same = lambda s, i, x: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        twice = let(pairs, lambda s: F.filter(s, lambda x, i: same(s, i - 1, x) | same(s, i + 1, x)))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def joined(a: Column, b: Column, shift: int) -> Column:
        """The hashes of a, each with that of b shift places on, where there is one."""
        return F.zip_with(F.slice(a, F.lit(1), F.size(b) - shift), F.slice(b, F.lit(shift + 1), F.size(b) - shift), lambda x, y: F.xxhash64(x, y))

    def windows(h: Column) -> Column:
        """Each word's hash with those of the next four: pairs, pairs of pairs, and one more."""
        pairs = joined(h, h, 1)
        fours = let(pairs, lambda p: joined(p, p, 2))
        return let(fours, lambda f: joined(f, h, WINDOW - 1))

    def of(w: Column) -> Column:
        hashes = let(F.transform(w, lambda x: F.xxhash64(x)), windows)
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    return let(words, lambda w: F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(of(w)))


def lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def measured(text: Column, w: Column) -> dict[str, Column]:
    """The measures of a text and its words w."""
    own = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeat_words(w),
    }
    return {k: v.cast("long") for k, v in own.items()}


def lazily(text: Column) -> dict[str, Column]:
    """The measures as expressions, each from the text alone."""
    return measured(text, words(text))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the struct MEASURES of the measures of their text. A null text counts as empty."""
    w, t = F.col("__quality_words"), F.coalesce(F.col(text), F.lit(""))
    own = measured(t, w)
    return docs.withColumn("__quality_words", words(F.col(text))).withColumn(MEASURES, F.struct(*(v.alias(k) for k, v in own.items()))).drop("__quality_words")


def few_words(m) -> Column:
    return m["n_words"] < MIN_WORDS


def repeated(m) -> Column:
    return 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]


def base_failed(m: Column) -> Column:
    return few_words(m) | repeated(m)


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


#: Rejecting rules by name, each from the measures m and the text t; the first two are the base.
RULES: dict[str, Callable] = {
    "few_words": lambda m, t: few_words(m),
    "repeats": lambda m, t: repeated(m),
    "symbols": lambda m, t: 10 * m["n_symbols"] > m["n_words"],
    "word_length": lambda m, t: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]),
    "duplicate_lines": lambda m, t: 10 * m["n_dup_lines"] > 3 * F.size(lines(t)),
    "upper_case": lambda m, t: 2 * F.regexp_count(t, F.lit(r"\p{Lu}")) > letters(t),
    "few_letters": lambda m, t: 2 * letters(t) < m["word_chars"],
}


def plan(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, rules: dict[str, Callable] | None = None, lazy: bool = False) -> list[tuple[str, float, float]]:
    """The rules as (name, rejected share, seconds a row), those with the most rejections per second first.

    Measured on an even hash sample of about sample_rows documents. A rule's first run compiles
    it and counts its rejections, the next ones are timed, and what a rule that reads no text
    takes is subtracted, so a job's start doesn't count. A rule's
    seconds are what it adds to the measures, or, where lazy, those that it computes for itself.
    Rules that reject nothing come last, cheap ones first; ties, and an empty table, keep the order of names.
    """
    rules = RULES if rules is None else rules
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select("doc_id", "text").where(F.xxhash64("doc_id", F.lit("sample")).bitwiseAND((1 << 30) - 1) <= int(share * (1 << 30)))
    t = F.coalesce(F.col("text"), F.lit(""))
    sample = checkpoint(sample.select("text") if lazy else measures(sample).select("text", MEASURES))
    m = lazily(t) if lazy else F.col(MEASURES)

    def measure(rejects: Column) -> tuple[int, int, float]:
        """The sample's rows, those of them that are rejected, and the seconds."""
        count = sample.agg(F.count("*"), F.count_if(rejects))
        rows, out = count.first()
        best = float("inf")
        for _ in range(TIMES):
            began = time.perf_counter()
            count.first()
            best = min(best, time.perf_counter() - began)
        return rows, out, best

    found = []
    rows, _, nothing = measure(F.length(t) < 0)
    n = max(1, rows)
    for name in sorted(rules):
        _, out, seconds = measure(rules[name](m, t))
        found.append((name, out / n, max(seconds - nothing, 1e-4) / n))
    return sorted(found, key=lambda x: (-x[1] / x[2], x[2] if x[1] == 0 and rows else 0, x[0]))


def cascade(order: list[str], rules: dict[str, Callable] | None = None, text: str = "text", lazy: bool = False) -> Column:
    """The first rule, in order, that rejects a row of measures() (of any table, where lazy); null if none does."""
    rules = RULES if rules is None else rules
    t = F.coalesce(F.col(text), F.lit(""))
    m = lazily(t) if lazy else F.col(MEASURES)
    name, *rest = order
    first = F.when(rules[name](m, t), F.lit(name))
    for name in rest:
        first = first.when(rules[name](m, t), F.lit(name))
    return first


def tried(order: list[str], rejected_by: Column) -> Column:
    """How many rules were tried on a row."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), rejected_by), F.lit(len(order)))


def screen(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, those that quality() calls kept, with the columns of docs; no
    measure is computed for a text that an earlier rule rejects."""
    order = [name for name, _, _ in plan(docs, sample_rows, lazy=True)]
    return docs.where(cascade(order, lazy=True).isNull())


def quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    rejected_by) for each row of docs(doc_id, text, ...).

    A null text has no words and fails the base, as an empty one does; texts of any length count whole.
    rejected_by is the first rule of the measured order that rejects the text, so it can differ
    between runs; kept cannot. Repeated rows come back as often as they came; other columns are ignored.
    """
    order = [name for name, _, _ in plan(docs, sample_rows)]
    rated = measures(docs.select("doc_id", "text"))
    m = F.col(MEASURES)
    rated = rated.select("doc_id", MEASURES, cascade(order).alias("rejected_by"))
    return rated.select("doc_id", *(m[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base_failed(m).alias("base_failed"), F.col("rejected_by").isNull().alias("kept"), "rejected_by")


#: The same in DuckDB.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS c FROM (SELECT rid, i + unnest([0, 1, 2, 3, 4]) AS p FROM rep) GROUP BY rid),
m AS (
  SELECT doc_id, t, l, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(c, 0) AS n_repeat_words,
         len(regexp_extract_all(t, '\p{Lu}')) AS n_upper, len(regexp_extract_all(t, '\p{L}')) AS n_letters
  FROM d LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_dup_lines > 3 * len(l) OR 2 * n_upper > n_letters OR 2 * n_letters < word_chars) AS kept
FROM b
"""
