"""Toxicity with noisy-channel deobfuscation.

Tokens that look disguised (digits or signs among letters, stretched letters, single letters
set apart) become character lattices: every sign may stand for the letters that it resembles,
a stretched letter for one or two, a gap for nothing. A Viterbi search under a character
language model picks the likeliest reading. The language model's trigrams come from the word
counts of the whole corpus. The text's own words and the restored ones are then scored
together.

The score is a logistic model over the words and word beginnings that are most tied to the
label. Which those are is counted over all labelled texts that may be learned from; the
weights are fitted on about ``FIT_ROWS`` of them. ``FEATURES`` and ``MAX_GRAMS`` bound the
model and the language model.

Defined cases: a null or empty text scores as a text without any of the words. Repeated rows
are scored alike. A document with several labels is toxic if one of them says so; a null label
is none. Without labels on both sides every score is the share of toxic ones (0 without any).
Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import BROADCAST_KEYS, held_out, materialize
from labelloom.llm.wordcount import letter_words, word_counts

THRESHOLD = 0.3
FEATURES = 4_000
FIT_ROWS = 20_000
MAX_GRAMS = 100_000
BEGINNINGS = (4, 5, 6)
CACHE = 300_000
BEAM = 24

# Signs and the letters that they resemble.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i",
}
SIGN_COST, STRETCH_COST, GAP_COST = 0.7, 0.3, 0.1
_GAPS = ".-_*"
_OUTER = ".,;:?!%&*#\"'()[]{}<>/\\-_=~^`|+"
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_DISGUISE = re.compile(rf"[^\W\d_{re.escape(_GAPS)}]|[{re.escape(''.join(LOOKS_LIKE) + _GAPS)}]")
LONGEST = 32


def disguised(token: str) -> str | None:
    """The part of a token that may hide a word, or None: what is between its outer signs and not plain."""
    core = token.strip(_OUTER)
    if core.endswith("$$$"):
        core = core.rstrip("$")
    if not 3 <= len(core) <= LONGEST:  # longer ones are keys, rulers and links
        return None
    if core.isalpha():
        return core if _STRETCHED.search(core) else None
    if sum(c.isalpha() for c in core) < 2 or not all(map(_DISGUISE.match, core)):
        return None
    return core


@dataclass
class CharModel:
    """Letter trigrams with backoff to shorter ones; a word is padded with two spaces and ends with one."""

    grams: dict[str, int] = field(default_factory=dict)

    def cost(self, before: str, letter: str) -> float:
        for context, fine in ((before, 0.0), (before[-1:], 1.0), ("", 2.0)):
            whole = self.grams.get("#" + context)
            seen = self.grams.get(context + letter)
            if whole and seen:
                return fine - math.log(seen / whole)
        return 14.0

    def word(self, word: str) -> float:
        padded = f"  {word} "
        return sum(self.cost(padded[i - 2:i], padded[i]) for i in range(2, len(padded)))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each piece of the token the readings and their costs."""
    out: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(token):
        c, end = token[at], at
        while end < len(token) and token[end] == c:
            end += 1
        length = end - at
        if c.isalpha():
            readings = [(c, 0.0)]
        elif c in LOOKS_LIKE:
            readings = [(x, SIGN_COST) for x in LOOKS_LIKE[c]]
            if c in "!|+(":
                readings.append(("", SIGN_COST))
        else:
            readings = [("", GAP_COST)]
        if length > 2 or (length == 2 and not c.isalpha()):
            readings = [(x * k, cost + STRETCH_COST) for x, cost in readings for k in ((1, 2) if x else (1,))]
        elif length == 2:
            readings = [(x * 2, cost) for x, cost in readings]
        out.append(readings)
        at = end
    return out


def restore(token: str, model: CharModel) -> str:
    """The likeliest reading of a disguised token, by a beam over the last two letters."""
    states: dict[str, tuple[float, str]] = {"  ": (0.0, "")}
    for readings in lattice(token):
        after: dict[str, tuple[float, str]] = {}
        for state, (cost, text) in states.items():
            for letters, own in readings:
                now, total = state, cost + own
                for letter in letters:
                    total += model.cost(now, letter)
                    now = now[-1:] + letter
                if now not in after or total < after[now][0]:
                    after[now] = (total, text + letters)
        states = dict(sorted(after.items(), key=lambda s: s[1][0])[:BEAM])
    return min((cost + model.cost(state, " "), text) for state, (cost, text) in states.items())[1]


def set_apart(tokens: list[str]) -> list[str]:
    """Words written as four or more single letters with spaces between.

    The outer letters may be words of their own (a, I, y), so each reading without one counts too.
    """
    marks = "".join(["1" if len(t) == 1 else "0" for t in tokens])
    if "1111" not in marks:
        return []
    runs = ["".join(tokens[m.start():m.end()]) for m in re.finditer("1{4,}", marks)]
    return [part for run in runs for part in (run, run[1:], run[:-1]) if len(part) > 3]


def words_of(token: str, model: CharModel) -> list[str]:
    """The words of letters in a token, and the reading of what may be disguised in it."""
    words, hidden = letter_words(token), disguised(token)
    return words + [restore(hidden, model)] if hidden else words


def char_model(docs: DataFrame) -> CharModel:
    """Trigram counts from the words of all texts."""
    counts = word_counts(docs.where("text IS NOT NULL").withColumn("_all", F.lit("all")), "_all")
    padded = F.concat(F.lit("  "), F.col("word"), F.lit(" "))
    places = F.sequence(F.lit(3), F.length(padded))
    grams = F.flatten(F.transform(places, lambda i: F.array(
        F.substring(padded, i - 2, F.lit(3)), F.concat(F.lit("#"), F.substring(padded, i - 2, F.lit(2))),
        F.substring(padded, i - 1, F.lit(2)), F.concat(F.lit("#"), F.substring(padded, i - 1, F.lit(1))),
        F.substring(padded, i, F.lit(1)), F.lit("#"))))
    table = counts.select("n", F.explode(grams).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n"))
    return CharModel({r["gram"]: r["n"] for r in table.orderBy(F.desc("n"), "gram").limit(MAX_GRAMS).collect()})


def tokens_of(text: str | None) -> set[str]:
    tokens = text.lower().split() if text else []
    return {*tokens, *set_apart(tokens)}


class Reader:
    """Something that follows from a token alone, kept for tokens met before."""

    def __init__(self, read):
        self.read, self.known = read, {}

    def __call__(self, text: str | None) -> set:
        out = set()
        for token in tokens_of(text):
            found = self.known.get(token)
            if found is None:
                if len(self.known) >= CACHE:
                    self.known.clear()
                found = self.known[token] = tuple(self.read(token))
            if found:
                out.update(found)
        return out


def features_of(word: str) -> list[str]:
    return ["=" + word, *(f"{n}{word[:n]}" for n in BEGINNINGS if len(word) >= n)]


def label_counts(docs: DataFrame, shared) -> DataFrame:
    """(word, toxic, n): in how many labelled texts each word stands, and in how many toxic ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Reader(lambda token: words_of(token, shared.value))
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for word in words(text):
                    cell = seen.setdefault(word, [0, 0])
                    cell[0] += toxic
                    cell[1] += 1
            yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array([c[0] for c in seen.values()], pa.int64()),
                                   pa.array([c[1] for c in seen.values()], pa.int64())], names=["word", "toxic", "n"])

    return docs.select("text", "toxic").mapInArrow(run, "word string, toxic bigint, n bigint").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def choose_features(counts: DataFrame, rate: float) -> list[str]:
    """The ``FEATURES`` words and beginnings whose toxic share is furthest above ``rate``, in standard errors."""
    word = F.col("word")
    kinds = [F.array(F.concat(F.lit("="), word))]
    kinds += [F.when(F.length(word) >= n, F.array(F.concat(F.lit(str(n)), F.substring(word, 1, n)))).otherwise(
        F.array().cast("array<string>")) for n in BEGINNINGS]
    table = counts.select("toxic", "n", F.explode(F.concat(*kinds)).alias("feature")).groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    lift = (F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) + 1)
    best = table.where((F.col("toxic") >= 3) & (F.col("toxic") > 2 * rate * F.col("n"))).withColumn("lift", lift)
    return [r["feature"] for r in best.orderBy(F.desc("lift"), "feature").limit(FEATURES).collect()]


@dataclass
class Model:
    chars: CharModel
    features: dict[str, int]
    weights: np.ndarray
    bias: float

    def ids(self, token: str) -> set[int]:
        """Features of a token."""
        found = {self.features.get(f) for word in words_of(token, self.chars) for f in features_of(word)}
        return found - {None}


def fit(rows: list[tuple[list[int], int]], n_features: int, steps: int = 400, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model by accelerated gradient descent."""
    y = np.array([r[1] for r in rows], dtype=float)
    column = np.array([k for ids, _ in rows for k in ids], dtype=np.int64)
    row = np.repeat(np.arange(len(rows)), [len(ids) for ids, _ in rows])
    rate = min(max(y.mean() if len(y) else 0.0, 0.0), 1.0)
    if not 0 < rate < 1:
        return np.zeros(n_features), math.log((rate + 1e-9) / (1 - rate + 1e-9))
    use = np.bincount(column, minlength=n_features) + 4 * ridge  # a bound on each weight's curvature
    w, b = np.zeros(n_features), math.log(rate / (1 - rate))
    v, vb = w.copy(), b
    widest = max(1, int(np.bincount(row, minlength=len(rows)).max(initial=1)))
    for k in range(steps):
        p = 1 / (1 + np.exp(-(vb + np.bincount(row, v[column], len(rows)))))
        slope = np.bincount(column, (p - y)[row], n_features) + ridge * v
        w_next = v - 4 * slope / (use * min(widest, 8))
        b_next = vb - 4 * (p - y).sum() / (len(rows) * 8)
        pull = k / (k + 3)
        v, vb = w_next + pull * (w_next - w), b_next + pull * (b_next - b)
        w, b = w_next, b_next
    return w, b


def train(docs: DataFrame, labels: DataFrame, corpus: DataFrame) -> Model:
    """``docs`` (doc_id, text) with their ``labels`` (doc_id, toxic); characters from all of ``corpus``."""
    spark = docs.sparkSession
    chars = char_model(corpus)
    marks = materialize(labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        (F.max("toxic") > 0).cast("bigint").alias("toxic")), "labels")
    n_labels = marks.count()
    labelled = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(marks) if n_labels <= BROADCAST_KEYS else marks, "doc_id")
    rate = marks.agg(F.avg("toxic")).first()[0] or 0.0
    shared = spark.sparkContext.broadcast(chars)
    chosen = choose_features(label_counts(labelled, shared), rate) if 0 < rate < 1 else []
    model = Model(chars, {f: k for k, f in enumerate(chosen)}, np.zeros(len(chosen)), 0.0)
    handed = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Reader(handed.value.ids)
        for batch in batches:
            ids = [sorted(ids_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(ids, pa.list_(pa.int32())), batch.column("toxic")], names=["ids", "toxic"])

    part = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n_labels // FIT_ROWS)))) == 0)
    rows = part.select("text", "toxic").mapInArrow(encode, "ids array<int>, toxic bigint").collect()
    model.weights, model.bias = fit([(list(r["ids"]), r["toxic"]) for r in rows], len(chosen))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, held_out, text) -> (doc_id, held_out, score, predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        ids_of = Reader(m.ids)
        for batch in batches:
            sums = [m.bias + float(m.weights[sorted(ids_of(t))].sum()) for t in batch.column("text").to_pylist()]
            found = 1 / (1 + np.exp(-np.clip(np.array(sums, dtype=float), -500, 500)))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(found),
                                   pa.array((found >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", "text").mapInArrow(
        run, "doc_id bigint, held_out boolean, score double, predicted int")


def predict_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels of documents that are not held out and score all documents."""
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    known = labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    return score(rows, train(rows.where("NOT held_out"), known, rows))
