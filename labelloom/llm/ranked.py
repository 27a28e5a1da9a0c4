"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds, for each small group of documents, a matrix of bits: a row for every position
of a Bloom filter and a column for every document. Documents of a group need filters of about the
same length, so that all are filled alike. A term enters its document's filter once for each of
``LEVELS`` that its number of occurrences reaches. To look a term up is to take the rows of its
positions and let only the bits stay that are set in all of them, for all documents of the group
at once; a document that lacks a level surely holds the term less often than that.

So the bitmaps bound every term's occurrences from above, and the weighted sum of what those could
score bounds each document's score. The documents with the greatest bounds are scored first, on
their texts, which gives each item a score that its last result reaches. All documents whose
bound is not below that are then scored exactly; the others are provably not among the results.

Items come in blocks of about ``BLOCK_TERMS`` terms, and each block is held against the whole index.

Defined cases: a null text has no terms, and a text without terms is in no count and no result. A
document without an id counts in the statistics but is no result. Rows that repeat an id are
ranked each. Rows that repeat an item's id are one item with the terms of all of them, and an item
without an id or terms has no results. Equal scores rank by ascending id; ids keep their types. Only the
id and the text are read of either table. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import BROADCAST_KEYS, materialize
from labelloom.llm.rolling import U, mix
from labelloom.llm.texts import hash_strings, pieces, runs_of, small_letters

DEPTH = 50
# A term is in the filter once for each of these numbers of occurrences that it reaches.
LEVELS = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 377, 987, 2584, 6765, 17711)
BITS_EACH = 12
POSITIONS = 4
LEAST_WIDTH = 64
PIECE = 1 << 23
# Bits of one matrix while it is built, and scores that are summed at once.
CELLS = 1 << 26
SUMS = 1 << 20
BLOCK_TERMS = 100_000

_TERM = np.ones(256, dtype=bool)
_TERM[:128] = [chr(k).isalnum() for k in range(128)]


class Terms:
    """The terms of many texts: ``pairs`` are (text, code, occurrences) of each term in each text."""

    def __init__(self, texts: pa.Array):
        found = runs_of(texts, _TERM, small_letters)
        coded = found.values.dictionary_encode()
        self.vocabulary = coded.dictionary
        self.n = np.diff(found.first)
        text = np.repeat(np.arange(len(self.n)), self.n)
        size = max(len(self.vocabulary), 1)
        key, self.tf = np.unique(text * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        self.text, self.code = key // size, key % size


def positions(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """Filter positions of terms at a level, one row a term."""
    own = mix(hashes + U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    step = (own >> U(32)) | U(1)
    each = own[:, None] + step[:, None] * np.arange(POSITIONS, dtype=np.uint64)
    return (each & U(width - 1)).astype(np.int64)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (p for b in batches for p in pieces(b, PIECE)):
        terms = Terms(batch.column("text"))
        hashes = hash_strings(terms.vocabulary)[terms.code]
        entries = np.zeros(len(batch), dtype=np.int64)
        for least in LEVELS:
            entries += np.bincount(terms.text[terms.tf >= least], minlength=len(batch))
        need = np.maximum(entries * BITS_EACH, LEAST_WIDTH)
        width = np.where(entries > 0, 1 << np.ceil(np.log2(need)).astype(np.int64), 0)
        for size in np.unique(width[width > 0]).tolist():
            docs = np.flatnonzero(width == size)
            most = max(8, CELLS // size)
            for part in (docs[k:k + most] for k in range(0, len(docs), most)):
                column = np.full(len(batch), -1)
                column[part] = np.arange(len(part))
                own = column[terms.text] >= 0
                at, tf, hashed = column[terms.text[own]], terms.tf[own], hashes[own]
                bits = np.zeros((size, len(part)), dtype=bool)
                for level, least in enumerate(LEVELS):
                    held = tf >= least
                    if not held.any():
                        break
                    bits[positions(hashed[held], level, size), at[held][:, None]] = True
                ids = batch.column("doc_id").take(pa.array(part))
                ends = pa.array(np.array([0, len(part)], dtype=np.int32))
                yield pa.record_batch([
                    pa.array([size], pa.int32()), pa.ListArray.from_arrays(ends, ids),
                    pa.ListArray.from_arrays(ends, pa.array(terms.n[part])), pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary())],
                    names=["width", "docs", "n", "slices"])


def index(docs: DataFrame) -> DataFrame:
    """(width, docs, n, slices): the signatures of all documents that have an id and a term."""
    ids = T.ArrayType(docs.schema["doc_id"].dataType)
    schema = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("docs", ids),
                           T.StructField("n", T.ArrayType(T.LongType())), T.StructField("slices", T.BinaryType())])
    slim = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(_index, schema)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = Terms(batch.column("text"))
        yield pa.record_batch([batch.column("item_id").take(pa.array(terms.text)), terms.vocabulary.take(pa.array(terms.code)).cast(pa.string())],
                              names=["item_id", "term"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""
    schema = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("term", T.StringType())])
    slim = items.where("item_id IS NOT NULL").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(_item_terms, schema).distinct()


@dataclass
class Queries:
    """A block of items: their terms, and for each term the items that hold it."""

    terms: pa.Array
    items: list
    first: np.ndarray  # of each term's items
    item: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Queries:
        terms, items = (rows.column(c).combine_chunks().dictionary_encode() for c in ("term", "item_id"))
        code, item = (np.asarray(x.indices.to_numpy(zero_copy_only=False), dtype=np.int64) for x in (terms, items))
        order = np.argsort(code, kind="stable")
        size = len(terms.dictionary)
        return cls(terms.dictionary.cast(pa.large_string()), items.dictionary.to_pylist(),
                   np.concatenate([[0], np.cumsum(np.bincount(code, minlength=size))]), item[order])


@dataclass
class Scoring:
    """The statistics of the corpus and what they make of occurrences."""

    documents: int
    occurrences: int
    weights: np.ndarray

    @classmethod
    def of(cls, documents: int, occurrences: int, df: np.ndarray) -> Scoring:
        return cls(documents, occurrences, np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64))

    def lengths(self, n: np.ndarray) -> np.ndarray:
        return 100 - 50 + (50 * n * self.documents) // max(self.occurrences, 1)

    def parts(self, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def statistics(docs: DataFrame, queries: Queries) -> Scoring:
    """Counts over all documents: those with a term, their terms, and those with each of the queries' terms."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, occurrences = np.zeros(len(shared.value), dtype=np.int64), 0, 0
        for batch in (p for b in batches for p in pieces(b, PIECE)):
            terms = Terms(batch.column("text"))
            documents += int((terms.n > 0).sum())
            occurrences += int(terms.n.sum())
            held = pa.compute.index_in(terms.vocabulary, value_set=shared.value).fill_null(-1).to_numpy(zero_copy_only=False)
            mine = held[terms.code]
            df += np.bincount(mine[mine >= 0], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([df[some], [documents, occurrences]]))],
                              names=["term", "n"])

    slim = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = slim.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    found = dict(zip(counts.column("term").to_pylist(), counts.column("n").to_pylist()))
    return Scoring.of(found.get(-1, 0), found.get(-2, 0), np.array([found.get(k, 0) for k in range(len(queries.terms))], dtype=np.int64))


def _sums(queries: Queries, term: np.ndarray, doc: np.ndarray, parts: np.ndarray, docs: int) -> np.ndarray:
    """Sum of the parts of each item and document."""
    n = queries.first[term + 1] - queries.first[term]
    begin = np.cumsum(n) - n
    item = queries.item[np.repeat(queries.first[term] - begin, n) + np.arange(int(n.sum()))]
    # Sums stay below 2**53, where doubles are exact.
    total = np.bincount(item * docs + np.repeat(doc, n), weights=np.repeat(parts, n).astype(np.float64), minlength=len(queries.items) * docs)
    return total.astype(np.int64).reshape(len(queries.items), docs)


def bounds(queries: Queries, scoring: Scoring, hashes: np.ndarray, width: int, n: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """No document's score for an item is above its bound (items by documents)."""
    docs = len(n)
    m = scoring.lengths(n)
    terms, at, most = [], [], []
    step = max(1, 4 * SUMS // (docs + 8))
    for k in range(0, len(hashes), step):
        alive = np.arange(k, min(k + step, len(hashes)))
        held = np.zeros((len(alive), docs), dtype=np.int64)
        before = np.full((len(alive), slices.shape[1]), 255, dtype=np.uint8)
        row = np.arange(len(alive))
        for level in range(len(LEVELS)):
            rows = positions(hashes[alive[row]], level, width)
            now = before[row]
            for j in range(POSITIONS):
                now &= slices[rows[:, j]]
            some = now.any(axis=1)
            row = row[some]
            if not len(row):
                break
            before[row] = now[some]
            bits = np.unpackbits(now[some], axis=1, count=docs).astype(bool)
            below = LEVELS[level + 1] - 1 if level + 1 < len(LEVELS) else np.iinfo(np.int64).max
            held[row] = np.where(bits, np.minimum(below, n), held[row])
        t, d = np.nonzero(held)
        terms.append(alive[t])
        at.append(d)
        most.append(held[t, d])
    term, doc, tf = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (terms, at, most))
    return _sums(queries, term, doc, scoring.parts(term, tf, m[doc]), docs)


def _bounded(shared, use: Callable) -> Callable:
    """Kernel over signatures: ``use`` takes the bounds of each group of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, scoring, extra = shared.value
        hashes = hash_strings(queries.terms)

        def groups() -> Iterator[tuple]:
            for batch in batches:
                for k in range(len(batch)):
                    width = batch.column("width")[k].as_py()
                    ids, n = (batch.column(c)[k].values for c in ("docs", "n"))
                    data = np.frombuffer(batch.column("slices")[k].as_buffer(), dtype=np.uint8).reshape(width, -1)
                    most = max(8, SUMS // len(queries.items) // 8 * 8)
                    for a in range(0, len(ids), most):
                        part = ids.slice(a, most)
                        yield part, bounds(queries, scoring, hashes, width, n.slice(a, most).to_numpy(), data[:, a // 8:(a + most) // 8])
        yield from use(groups(), extra)
    return run


def _greatest(depth: int) -> Callable:
    """The documents of the greatest bounds that a task has seen."""
    def use(groups: Iterator[tuple], _) -> Iterator[pa.RecordBatch]:
        best, ids, kind = None, None, None
        for part, found in groups:
            kind = part.type
            own = np.broadcast_to(part.to_numpy(zero_copy_only=False), found.shape)
            best, ids = (found, own) if best is None else (np.concatenate([best, found], axis=1), np.concatenate([ids, own], axis=1))
            if best.shape[1] > depth:
                order = np.argpartition(-best, depth - 1, axis=1)[:, :depth]
                best, ids = np.take_along_axis(best, order, axis=1), np.take_along_axis(ids, order, axis=1)
        if best is not None:
            item, at = np.nonzero(best)
            yield pa.record_batch([pa.array(item), pa.array(ids[item, at], kind), pa.array(best[item, at])], names=["item", "doc_id", "bound"])
    return use


def _reaching(groups: Iterator[tuple], least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The documents whose bound is not below what their item's results reach."""
    for part, found in groups:
        item, at = np.nonzero(found >= least[:, None])
        yield pa.record_batch([pa.array(item), part.take(pa.array(at)), pa.array(found[item, at])], names=["item", "doc_id", "bound"])


def rescore(docs: DataFrame, pairs: DataFrame, shared) -> DataFrame:
    """(item, doc_id, score): exact scores above 0 of ``pairs`` (item, doc_id), from the texts."""
    wanted = materialize(pairs.groupBy("doc_id").agg(F.collect_set("item").alias("items")), "wanted")  # at most a block's items each
    few = (wanted.agg(F.sum(F.size("items"))).first()[0] or 0) <= BROADCAST_KEYS
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, scoring, _ = shared.value
        most = max(1, SUMS // len(queries.items))
        for batch in (p for b in batches for p in pieces(b, PIECE)):
            for part in (batch.slice(k, most) for k in range(0, len(batch), most)):
                terms = Terms(part.column("text"))
                held = pa.compute.index_in(terms.vocabulary, value_set=queries.terms).fill_null(-1).to_numpy(zero_copy_only=False)[terms.code]
                mine = held >= 0
                term, doc = held[mine], terms.text[mine]
                score = _sums(queries, term, doc, scoring.parts(term, terms.tf[mine], scoring.lengths(terms.n)[doc]), len(part))
                lists = part.column("items")
                item = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
                found = score[item, doc]
                some = np.flatnonzero(found)
                yield pa.record_batch([pa.array(item[some]), part.column("doc_id").take(pa.array(doc[some])), pa.array(found[some])],
                                      names=["item", "doc_id", "score"])

    return texts.mapInArrow(run, _pairs_schema(docs, "score"))


def _pairs_schema(docs: DataFrame, value: str) -> T.StructType:
    return T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField(value, T.LongType())])


def _top(rows: DataFrame, value: str, depth: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc(value), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def search_block(docs: DataFrame, signatures: DataFrame, queries: Queries, depth: int) -> DataFrame:
    """(item, doc_id, score, rank) of one block of items; ``item`` is the place in ``queries.items``."""
    spark = docs.sparkSession
    scoring = statistics(docs, queries)
    first = spark.sparkContext.broadcast((queries, scoring, None))
    seeds = signatures.mapInArrow(_bounded(first, _greatest(depth)), _pairs_schema(docs, "bound"))
    scored = _top(rescore(docs, materialize(_top(seeds, "bound", depth), "seeds").select("item", "doc_id"), first), "score", depth)
    last = materialize(scored.where(F.col("rank") == depth).select("item", F.col("doc_id").alias("last_id"), F.col("score").alias("least")), "reached")
    rows = last.select("item", "least").toArrow()  # one row an item of the block
    least = np.ones(len(queries.items), dtype=np.int64)
    least[rows.column("item").to_numpy()] = rows.column("least").to_numpy()
    second = spark.sparkContext.broadcast((queries, scoring, least))
    found = signatures.mapInArrow(_bounded(second, _reaching), _pairs_schema(docs, "bound"))
    # Of equal scores the smaller id ranks first, so a bound that only equals the last score needs a smaller id.
    open_ = found.join(F.broadcast(last), "item", "left").where(
        F.col("least").isNull() | (F.col("bound") > F.col("least")) | (F.col("doc_id") <= F.col("last_id")))
    ranked = _top(rescore(docs, materialize(open_.select("item", "doc_id").distinct(), "candidates"), second), "score", depth)
    out = materialize(ranked, "ranked")
    first.destroy()
    second.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, depth: int = DEPTH, signatures: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``depth`` documents of the highest scores above 0.

    ``signatures`` is a stored ``index`` of the same documents; without one it is built here.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signatures = materialize(index(slim), "signatures") if signatures is None else signatures
    terms = materialize(item_terms(items), "item-terms")
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    fields = [T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("rank", T.IntegerType()), slim.schema["doc_id"],
              T.StructField("score", T.LongType())]
    out = spark.createDataFrame([], T.StructType(fields))
    for block in range(blocks):
        queries = Queries.of(terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow())
        if not queries.items:
            continue
        names = spark.createDataFrame([(k, i) for k, i in enumerate(queries.items)], T.StructType([T.StructField("item", T.LongType()), fields[0]]))
        found = search_block(slim, signatures, queries, depth).join(F.broadcast(names), "item")
        out = out.unionByName(found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


def oracle(depth: int = DEPTH) -> str:
    """SQL twin: scores of all documents that hold a term of an item."""
    def terms(name: str) -> str:
        return (f"SELECT {name}_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM ")
    return f"""
WITH d AS ({terms("doc")} documents),
q AS (SELECT DISTINCT * FROM ({terms("item")} benchmark)),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS l FROM n),
f AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
p AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // l))))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN n USING (doc_id), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM p WHERE score > 0 QUALIFY rank <= {depth}
"""
