"""Quality rules as a short-circuit cascade.

A rule is a condition under which a document is rejected. Each rule's cost and
selectivity are measured on a bounded sample, and the rules then run in the order of
rejections per cost inside one CASE expression, so that a document pays only for the
rules up to the one that rejects it. Rules are a conjunction: the order decides what
the work costs, never which documents stay.

All of it is DataFrame expressions over one row; there is no shuffle.

Defined cases: a null or empty text has no words and is rejected (`few_words`); repeated
rows are judged alike, each for itself; the id is not looked at; an empty table gives an
empty result; other columns pass through, and a column named like a metric is replaced only
in `measure`, whose result has only the id and the metrics.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import materialize, words

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2_000

Metric = Callable[[Column, Column], Column]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times within one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)


def n_words(text: Column, ws: Column) -> Column:
    return F.size(ws).cast("bigint")


def word_chars(text: Column, ws: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(ws, "")).cast("bigint")


def n_symbols(text: Column, ws: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint")


def _written_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_lines(text: Column, ws: Column) -> Column:
    """Lines with a word."""
    return F.size(_written_lines(text)).cast("bigint")


def n_dup_lines(text: Column, ws: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    return bind(_written_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def n_capitals(text: Column, ws: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{Lu}]+", "")).cast("bigint")


def n_repeat_words(text: Column, ws: Column) -> Column:
    """Words in 3-word windows found twice or more in the text.

    Most texts repeat no window: a set of window hashes as large as their number tells so.
    For the others the windows are sorted, hash first and words on equal hashes, so that
    equal windows become neighbours and a hash collision cannot join two different ones.
    """
    def covered(marks: Column) -> Column:
        return bind(F.sort_array(marks), lambda at: _total(F.transform(
            at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1), p + 3) - p).cast("bigint"))))

    def repeated(rows: Column) -> Column:
        def has_twin(row: Column, k: Column) -> Column:
            def same(other: Column) -> Column:
                return F.coalesce((other["h"] == row["h"]) & (other["g"] == row["g"]), F.lit(False))
            return ((k > 0) & same(F.get(rows, k - 1))) | same(F.get(rows, k + 1))
        return covered(F.transform(F.filter(rows, has_twin), lambda row: row["i"]))

    def sort_windows(hashes: Column) -> Column:
        rows = F.transform(hashes, lambda h, i: F.struct(
            h.alias("h"), F.concat_ws(" ", ws[i], ws[i + 1], ws[i + 2]).alias("g"), i.alias("i")))
        return bind(F.sort_array(rows), repeated)

    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(ws[i], ws[i + 1], ws[i + 2]))
    found = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint"))
                 .otherwise(sort_windows(h)))
    return F.when(F.size(ws) < 3, F.lit(0).cast("bigint")).otherwise(found)


@dataclass(frozen=True)
class Rule:
    """A document is rejected where ``fails(text, words)`` holds; it must not be null."""

    name: str
    fails: Metric


BASE_RULES = (
    Rule("few_words", lambda t, w: n_words(t, w) < 50),
    Rule("repeated_words", lambda t, w: n_repeat_words(t, w) * 100 > n_words(t, w) * 50),
)
RULES = BASE_RULES + (
    Rule("symbols", lambda t, w: n_symbols(t, w) * 10 > n_words(t, w) * 3),
    Rule("repeated_lines", lambda t, w: n_dup_lines(t, w) * 100 > n_lines(t, w) * 50),
    Rule("word_length", lambda t, w: (word_chars(t, w) < n_words(t, w) * 2) | (word_chars(t, w) > n_words(t, w) * 15)),
    Rule("capitals", lambda t, w: n_capitals(t, w) * 2 > word_chars(t, w)),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    rejected: float
    seconds: float

    @property
    def rank(self) -> float:
        """Rejections per second; a rule that rejects nothing still runs after those that do."""
        return (self.rejected + 1e-6) / max(self.seconds, 1e-6)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Measure each rule alone on at most ``sample_rows`` rows, taken by a hash of the text."""
    buckets = max(1, docs.count() // sample_rows)
    picked = docs.where(F.pmod(F.xxhash64("text"), F.lit(buckets)) == 0).select("text").limit(sample_rows)
    sample = materialize(picked, "quality-sample").withColumn("words", words(F.col("text")))
    found = []
    for rule in (None, *rules):  # the first run, without a rule, only warms up
        fails = rule.fails(F.col("text"), F.col("words")) if rule else F.lit(False)
        start = time.perf_counter()
        share = sample.agg(F.avg(fails.cast("double"))).first()[0]
        if rule:
            found.append(Estimate(rule, share or 0.0, time.perf_counter() - start))
    return found


def order_rules(estimates: list[Estimate]) -> list[Rule]:
    return [e.rule for e in sorted(estimates, key=lambda e: (-e.rank, e.rule.name))]


def rejected_by(text: Column, ws: Column, rules: list[Rule]) -> Column:
    """Name of the first rule of the cascade that rejects, or null."""
    verdict = F
    for rule in rules:
        verdict = verdict.when(rule.fails(text, ws), F.lit(rule.name))
    return verdict.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``docs`` that no rule rejects, with all their columns."""
    ordered = order_rules(estimate(docs, rules, sample_rows))
    # The words are bound inside the condition: a column of them would be split anew wherever it is used.
    text = F.col("text")
    return docs.where(bind(words(text), lambda ws: rejected_by(text, ws, ordered)).isNull())


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES[len(BASE_RULES):], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: its id, the metrics, whether a base rule rejects it, and the verdict.

    ``kept`` is false where a base rule rejects; else the cascade of ``rules`` decides.
    """
    ordered = order_rules(estimate(docs, rules, sample_rows))
    text, ws = F.col("text"), F.col("_words")
    metrics = (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)
    rows = docs.select("doc_id", "text").withColumn("_words", words(text))
    rows = rows.select("doc_id", "text", "_words", *(m(text, ws).alias(m.__name__) for m in metrics))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rows = rows.withColumn("base_failed", failed)
    kept = F.when(F.col("base_failed"), False).otherwise(rejected_by(text, ws, ordered).isNull())
    return rows.select("doc_id", *(m.__name__ for m in metrics), "base_failed", kept.alias("kept"))
