"""Language identification by word-first backoff.

Every word that the model knows is scored by the logarithm of its frequency in each
language. A word it does not know falls back to the longest character n-grams it has in
common with the model, and from there to shorter ones. A text's score is the sum over its
words; the result is a probability over the languages.

Frequencies are counted over all texts that may be learned from. The model keeps the
``MAX_WORDS`` most frequent words and ``MAX_GRAMS`` most frequent n-grams, so that what is
sent to the executors has a fixed bound; rarer words are scored as unknown ones, by n-grams
that were counted over all words.

Defined cases: a null text and one without a letter are ``und`` with score 0. Without any
text to learn from every document is ``und``. Repeated rows are scored alike. Other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import held_out, materialize
from labelloom.llm.wordcount import letter_words, word_counts

MAX_WORDS = 200_000
MAX_GRAMS = 200_000
ORDER = 4
SMOOTH = 0.5
CACHE = 200_000
UNKNOWN = "und"


@dataclass
class Model:
    """Log frequencies by language: words, and n-grams of each length; ``floor`` is an unseen letter's."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray

    def backoff(self, word: str) -> np.ndarray:
        """Mean score of the word's n-grams of the greatest length that the model knows any of."""
        padded = f"<{word}>"
        for n in range(min(ORDER, len(padded)), 0, -1):
            known = [k for k in (self.grams.get(padded[i:i + n]) for i in range(len(padded) - n + 1)) if k is not None]
            if known:
                return self.gram_scores[known].mean(axis=0)
        return np.zeros(len(self.languages))


def _log_table(pairs: list[tuple[str, str, int]], totals: dict, languages: list[str], kind) -> tuple[dict[str, int], np.ndarray]:
    names: dict[str, int] = {}
    for _, name, _ in pairs:
        names.setdefault(name, len(names))
    counts = np.full((len(names), len(languages)), SMOOTH)
    column = {x: k for k, x in enumerate(languages)}
    for label, name, n in pairs:
        counts[names[name], column[label]] += n
    total = np.array([[totals.get((x, kind(name)), 0) + 1.0 for x in languages] for name in names]) if names else counts
    return names, np.log(counts / total)


def train(docs: DataFrame) -> Model:
    """``docs`` (text, lang): learn from rows whose language is not null."""
    counts = materialize(word_counts(docs.where("lang IS NOT NULL AND text IS NOT NULL"), "lang"), "words")
    padded = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    pieces = [F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i, n=n: F.substring(padded, i, F.lit(n)))
              for n in range(1, ORDER + 1)]
    # A padded word has three characters at least.
    pieces = [p if n < 4 else F.when(F.length(padded) >= n, p).otherwise(F.array().cast("array<string>"))
              for n, p in enumerate(pieces, 1)]
    grams = materialize(counts.select("label", "n", F.explode(F.concat(*pieces)).alias("word")).groupBy("label", "word").agg(
        F.sum("n").alias("n")), "grams")

    def top(table: DataFrame, most: int) -> list[tuple[str, str, int]]:
        best = table.groupBy("word").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "word").limit(most)
        return [tuple(r) for r in table.join(best, "word").select("label", "word", "n").toArrow().to_pandas().itertuples(index=False)]

    def totals(table: DataFrame, length) -> dict:
        return {(r["label"], r["k"]): r["n"] for r in table.groupBy("label", length.alias("k")).agg(F.sum("n").alias("n")).collect()}

    languages = sorted(r["label"] for r in counts.select("label").distinct().collect())
    words, word_scores = _log_table(top(counts, MAX_WORDS), totals(counts, F.lit(0)), languages, lambda _: 0)
    gram_names, gram_scores = _log_table(top(grams, MAX_GRAMS), totals(grams, F.length("word")), languages, len)
    return Model(languages, words, word_scores, gram_names, gram_scores)


def scorer(model: Model):
    """Predict one text after another; words met before are kept in a bounded cache."""
    known, table = model.words, model.word_scores
    cache: dict[str, np.ndarray] = {}

    def unknown(word: str) -> np.ndarray:
        found = cache.get(word)
        if found is None:
            if len(cache) >= CACHE:
                cache.clear()
            found = cache[word] = model.backoff(word)
        return found

    def predict(text: str | None) -> tuple[str, float]:
        words = letter_words(text) if text else []
        if not model.languages or not any(any(c.isalpha() for c in w) for w in words):
            return UNKNOWN, 0.0
        at = [known.get(w, -1) for w in words]
        rows = np.array(at)
        total = table[rows[rows >= 0]].sum(axis=0) if len(table) else np.zeros(len(model.languages))
        for k, w in zip(at, words):
            if k < 0:
                total = total + unknown(w)
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return model.languages[best], float(odds[best] / odds.sum())

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, held_out, text) -> (doc_id, held_out, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = scorer(shared.value)
        for batch in batches:
            found = [predict(text) for text in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()),
                                   pa.array([y for _, y in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", "text").mapInArrow(
        run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learn from documents that are not held out and predict all of them."""
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return identify(rows, train(rows.where("NOT held_out")))
