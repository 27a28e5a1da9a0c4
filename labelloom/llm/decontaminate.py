"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits. All n-grams of the items are looked up in
all texts, and every n-gram of an item is a seed, however frequent or rare it is: an edited
copy has lost the rarest ones first, and an item which a third of all texts quote is still
found. A text and an item that share ``MIN_SEEDS`` seeds close together are aligned there
word by word. The share of the best possible score tells a copy, also an edited one. Whether
a text is aligned with an item follows from the two alone, not from other texts.

Not aligned are copies whose edits leave fewer than ``MIN_SEEDS`` n-grams whole, such as one
with every third word changed.

Items are handled in blocks of ``BLOCK_WORDS`` words, which bounds what is sent to the
executors; more items mean more blocks. Each item is compared with all texts.

Defined cases: a null or empty text or item matches nothing. An item with fewer words than an
n-gram is one seed, and one seed is enough where an item has no more. Repeated items or texts
under one id give the best score of any. Null ids take no part, and such documents are kept.
Other columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import BROADCAST_KEYS, materialize, plain_names, rows_of
from labelloom.llm.repeats import BROADCAST_SPANS

WORDS = re.compile(r"[^\W_]+")
GRAM = 3
MIN_SEEDS = 2
THRESHOLD = 0.5
BLOCK_WORDS = 500_000
MATCH, MISMATCH, GAP = 2, -1, -1


def split_words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


@dataclass
class Items:
    """A block of items as word numbers, and their n-grams as sorted keys."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    keys: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        vocabulary: dict[str, int] = {}
        ids, words = [], []
        for item, text in rows:
            found = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in split_words(text)]
            if found:
                ids.append(item)
                words.append(np.array(found, dtype=np.int64))
        base = len(vocabulary) + 1
        if base ** GRAM > 2 ** 63:
            raise ValueError("a block's vocabulary must fit into n-gram keys of 63 bits")
        keys = [gram_keys(w, base) for w in words]
        return cls(ids, words, vocabulary, np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64))

    @property
    def base(self) -> int:
        return len(self.vocabulary) + 1

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in split_words(text)], dtype=np.int64)


def gram_keys(words: np.ndarray, base: int, size: int = GRAM) -> np.ndarray:
    """Keys of the n-grams; a text that is shorter is one n-gram, padded with zeros."""
    if len(words) < size:
        words = np.concatenate([words, np.zeros(size - len(words), dtype=np.int64)])
    n = len(words) - size + 1
    out = np.zeros(n, dtype=np.int64)
    for k in range(size):
        out = out * base + words[k:k + n]
    return out


def text_keys(words: np.ndarray, base: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """n-gram keys of a text and their places; ``short`` adds those of one and two words, padded."""
    keys, places = [gram_keys(words, base)], [np.arange(max(len(words) - GRAM + 1, 1))]
    if short:
        for size in range(1, GRAM):
            if len(words) >= size:
                part = gram_keys(words, base, size) * base ** (GRAM - size)
                keys.append(part)
                places.append(np.arange(len(part)))
    return np.concatenate(keys), np.concatenate(places)


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and where in the text it ends (exclusive)."""
    cells = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        step = np.zeros(len(text) + 1, dtype=np.int64)
        step[1:] = np.maximum(row[:-1] + np.where(text == word, MATCH, MISMATCH), row[1:] + GAP)
        step = np.maximum(step, 0)
        row = np.maximum.accumulate(step - GAP * cells) + GAP * cells  # gaps in the item
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def clusters(places: np.ndarray, seeds: np.ndarray, reach: int, least: int) -> Iterator[tuple[int, int]]:
    """Ranges of seed places without a gap over ``reach`` that have ``least`` different seeds."""
    order = np.argsort(places, kind="stable")
    places, seeds = places[order], seeds[order]
    for part in np.split(np.arange(len(places)), np.flatnonzero(np.diff(places) > reach) + 1):
        if len(np.unique(seeds[part])) >= least:
            yield int(places[part[0]]), int(places[part[-1]])


def _hits(shared):
    """(doc_id, grams, places): the item n-grams in each text that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        short = any(len(w) < GRAM for w in items.words)
        for batch in batches:
            ids, grams, at = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = items.numbers(text)
                if not words.any():
                    continue
                keys, places = text_keys(words, items.base, short)
                where = np.searchsorted(items.keys, keys)
                hit = items.keys[np.minimum(where, len(items.keys) - 1)] == keys
                if hit.any():
                    ids.append(doc)
                    grams.append(where[hit].astype(np.int32))
                    at.append(places[hit].astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(grams, kind), pa.array(at, kind)], names=["doc_id", "grams", "places"])
    return run


def choose_seeds(items: Items) -> list[tuple[int, int, int]]:
    """(gram, item, how many are needed): all n-grams of each item."""
    out = []
    for k, words in enumerate(items.words):
        grams = np.unique(np.searchsorted(items.keys, gram_keys(words, items.base))).tolist()
        out += [(g, k, min(MIN_SEEDS, len(grams))) for g in grams]
    return out


def _aligned(shared, threshold: float):
    """Align each text with its candidate items (parallel arrays item, place, gram of seed hits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, needed = shared.value
        for batch in batches:
            out = [[], [], [], [], [], []]
            for doc, text, item, place, gram in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "item", "place", "gram"))):
                words, item, place, gram = items.numbers(text), np.array(item), np.array(place), np.array(gram)
                for k in np.unique(item):
                    mine, own = items.words[k], item == k
                    best = (0.0, 0, 0)
                    for first, last in clusters(place[own], gram[own], len(mine), needed[k]):
                        lo, hi = max(0, first - len(mine)), min(len(words), last + GRAM + len(mine))
                        score, end = align(words[lo:hi], mine)
                        share = score / (MATCH * len(mine))
                        if share > best[0]:
                            best = (share, lo, lo + end)
                    if best[0] >= threshold:
                        share, lo, end = best
                        back, length = align(words[lo:end][::-1], mine[::-1])
                        for part, value in zip(out, (doc, items.ids[k], share, end - length, end, int(own.sum()))):
                            part.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(p, t) for p, t in zip(out, kinds)],
                                  names=["doc_id", "item_id", "score", "first_word", "last_word", "n_seeds"])
    return run


def _block(slim: DataFrame, items: Items, threshold: float) -> DataFrame:
    spark = slim.sparkSession
    hits = materialize(slim.mapInArrow(_hits(spark.sparkContext.broadcast(items)), "doc_id bigint, grams array<int>, places array<int>"), "hits")
    seeds = choose_seeds(items)
    needed = {k: need for _, k, need in seeds}
    table = spark.createDataFrame(seeds or [(0, 0, 0)], "gram int, item int, need int")
    single = hits.select("doc_id", F.explode(F.arrays_zip("grams", "places")).alias("h")).select(
        "doc_id", F.col("h.grams").alias("gram"), F.col("h.places").alias("place")).join(F.broadcast(table), "gram")
    # The seeds of one text and one item; a text is one row of the hits, so this is bounded by its length.
    pairs = single.groupBy("doc_id", "item").agg(
        F.collect_list(F.struct("place", "gram")).alias("s"), F.count_distinct("gram").alias("n"), F.first("need").alias("need")).where("n >= need")
    lists = pairs.select("doc_id", F.explode(F.transform("s", lambda x: F.struct(
        F.col("item").alias("item"), x["place"].alias("place"), x["gram"].alias("gram")))).alias("s")).groupBy("doc_id").agg(
        F.collect_list("s").alias("s"))
    lists = materialize(lists.select("doc_id", *(F.col(f"s.{c}").alias(c) for c in ("item", "place", "gram"))), "candidates")
    total = lists.agg(F.sum(F.size("item") + 2)).first()[0] or 0
    texts = rows_of(slim, lists, "doc_id").join(F.broadcast(lists) if total <= BROADCAST_SPANS else lists, "doc_id")
    return texts.mapInArrow(_aligned(spark.sparkContext.broadcast((items, needed)), threshold),
                            "doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint, n_seeds bigint")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word, n_seeds): texts that hold an item, and the best place."""
    slim = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    tests = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    size = tests.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_WORDS))
    found = None
    for k in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        items = Items.of([(r["item_id"], r["text"]) for r in rows])
        if len(items.keys):
            part = _block(slim, items, threshold)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint, n_seeds bigint")
    best = F.max_by(F.struct("score", "first_word", "last_word", "n_seeds"), F.struct("score", -F.col("first_word"))).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that hold an item. Other columns pass through whatever their names."""
    inner = plain_names(docs)
    bad = materialize(leaks(inner, benchmark, threshold).select(F.col("doc_id").alias("_leak")).distinct(), "leaking")
    few = bad.count() <= BROADCAST_KEYS
    return inner.join(F.broadcast(bad) if few else bad, F.col("doc_id") == F.col("_leak"), "left_anti").toDF(*docs.columns)
