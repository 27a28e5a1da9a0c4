"""Phrases whose words stand together far more often than apart, mined after Toivonen.

A sample of the documents proposes phrases: those that are frequent in it under a lowered
threshold. One full pass then counts, exactly and over all documents, every proposed phrase
and the negative border, which are the phrases that were not proposed but whose two parts of
one word less were (for single words: all others). A border phrase that proves frequent means
that longer phrases may have been missed; it joins the proposed ones, and a further pass counts
what that admits. When no frequent phrase is outside the proposed ones, every frequent phrase
has been counted, since all parts of a frequent phrase are frequent.

Proposed phrases go to the tasks as a Bloom filter of at most ``MOST_BITS`` bits. A phrase that
the filter holds by mistake is only counted without need; the counts are of the words
themselves. What a pass admits depends on the phrase alone, so each phrase is counted whole in
the first pass that admits it. Tasks add up the phrases of about ``HELD`` bytes of text
before they leave Python, and Spark adds up again before the shuffle, so a hot phrase or
language arrives as a few rows a task.

Defined cases: a null or empty text has no words, a null language is ``und``. Rows that repeat
an id are counted each, as the id only decides the sample. Ties go by count, then by the
phrase's bytes. Only the id, the text and the language are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import materialize
from labelloom.llm.rolling import U, mix
from labelloom.llm.texts import hash_strings, pieces, runs_of, small_letters

LEAST = 30
LONGEST = 4
TOP = 2_000
# One document in so many is in the sample.
SAMPLE_ONE_IN = 16
# Bits of the filter for each proposed phrase, at least and at most.
BITS_EACH = 32
LEAST_BITS = 1 << 16
MOST_BITS = 1 << 28
HELD = 1 << 22
# Rows that leave a task at once.
ROWS_OUT = 50_000

_NEXT = U(0xA0761D6478BD642F)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_SEPARATOR
_INSIDE[[0x20, 0x09]] = False

PHRASES = "lang string, phrase string, n bigint"


class Words:
    """The words of many texts: their codes in a vocabulary, and which follow the one before in a piece."""

    def __init__(self, texts: pa.Array):
        found = runs_of(texts, _INSIDE, small_letters)
        # Words of one piece are of one text and have the same number of separators before them.
        before = np.cumsum(_SEPARATOR[found.data], dtype=np.int32)[found.begin]
        self.follows = np.zeros(len(before), dtype=bool)
        self.follows[1:] = before[1:] == before[:-1]
        self.follows[found.first[found.first < len(before)]] = False
        coded = found.values.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.hashes = hash_strings(coded.dictionary)
        self.vocabulary = coded.dictionary.cast(pa.string())

    def places(self, length: int) -> np.ndarray:
        """Where phrases of ``length`` words begin."""
        fits = np.ones(max(len(self.codes) - length + 1, 0), dtype=bool)
        for k in range(1, length):
            fits &= self.follows[k:k + len(fits)]
        return np.flatnonzero(fits)

    def phrase_hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        found = self.hashes[self.codes[at]]
        for k in range(1, length):
            found = mix(found * _NEXT + self.hashes[self.codes[at + k]])
        return found

    def counts(self, at: np.ndarray, length: int) -> tuple[pa.Array, np.ndarray]:
        """The different phrases that begin ``at``, and how often each does."""
        size = max(len(self.vocabulary), 1)
        key, inner = self.codes[at].astype(np.int64), []
        for k in range(1, length):
            if size ** (k + 1) >= 1 << 63:  # keys are made dense again, so that they stay within 64 bits
                known, key = np.unique(key, return_inverse=True)
                inner.append((k, known))
            key = key * size + self.codes[at + k]
        key = np.sort(key)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        n, key = np.diff(np.append(first, len(key))), key[first]
        parts: list[pa.Array] = []
        for k in range(length - 1, -1, -1):
            key, code = (key // size, key % size) if k else (key, key)
            parts.insert(0, self.vocabulary.take(pa.array(code)))
            if inner and inner[-1][0] == k:
                key = inner.pop()[1][key]
        return pa.compute.binary_join_element_wise(*parts, " ") if length > 1 else parts[0], n


def _language(lang: str) -> np.uint64:
    return hash_strings(pa.array([lang], pa.large_string()))[0]


def keys_of(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """Filter keys of phrases (words joined by one space) of given languages."""
    split = pa.compute.split_pattern(phrases.cast(pa.large_string()), " ")
    own, starts = hash_strings(pa.compute.list_flatten(split).cast(pa.large_string())), split.offsets.to_numpy().astype(np.int64)
    starts, size = starts - starts[0], np.diff(starts)
    found = own[starts[:-1]] if len(own) else np.zeros(0, dtype=np.uint64)
    for k in range(1, int(size.max(initial=1))):
        longer = np.flatnonzero(size > k)
        found[longer] = mix(found[longer] * _NEXT + own[starts[longer] + k])
    coded = langs.dictionary_encode()
    each = np.array([_language(x) for x in coded.dictionary.to_pylist()], dtype=np.uint64)
    return mix(found ^ each[coded.indices.to_numpy(zero_copy_only=False)]) if len(found) else found


class Filter:
    """A Bloom filter with two bits a key."""

    def __init__(self, bits: int):
        self.bits = bits
        self.data = np.zeros(bits // 64, dtype=np.uint64)

    def positions(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = U(self.bits - 1)
        return (keys & last).astype(np.int64), ((keys >> U(32)) * U(0x9E3779B1) & last).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for at in self.positions(keys):
            found &= (self.data[at >> 6] >> (at & 63).astype(np.uint64) & U(1)).astype(bool)
        return found

    def with_keys(self, phrases: DataFrame) -> Filter:
        """This filter and the keys of ``phrases``; what reaches the driver is at most the filter's own size."""
        shape = Filter(64)
        shape.bits = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.concatenate(shape.positions(keys_of(batch.column("lang"), batch.column("phrase"))))
                yield pa.record_batch([pa.array(at)], names=["at"])

        at = phrases.select("lang", "phrase").mapInArrow(run, "at bigint")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
        slots = at.groupBy(F.shiftright("at", 6).alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
        out = Filter(self.bits)
        out.data = self.data.copy()
        out.data[slots.column("slot").to_numpy()] |= slots.column("bits").to_numpy().view(np.uint64)
        return out


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    coded = batch.column("lang").dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    for code, lang in enumerate(coded.dictionary.to_pylist()):
        yield lang, batch.column("text").take(pa.array(np.flatnonzero(index == code)))


def _admitted(words: Words, lang: str, longest: int, known: Filter) -> Iterator[np.ndarray]:
    """For 2, 3 ... words: a flag at each place whose phrase has both its parts of one word less in
    the filter, which also had to be admitted themselves."""
    own, end = _language(lang), np.zeros(1, dtype=bool)
    held = known.holds(mix(words.hashes ^ own))[words.codes] if len(words.codes) else np.zeros(0, dtype=bool)
    for length in range(2, longest + 1):
        flags = held & np.concatenate([held[1:], end])
        fits = np.zeros(len(flags), dtype=bool)
        fits[words.places(length)] = True
        flags &= fits
        yield flags
        at = np.flatnonzero(flags)
        held = np.zeros(len(flags), dtype=bool)
        held[at] = known.holds(mix(words.phrase_hashes(at, length) ^ own)) if length < longest else False


def _counted(words: Words, lang: str, longest: int, now: Filter | None, before: Filter | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Phrases and their counts that filter ``now`` admits and ``before`` did not; without filters all."""
    if before is None:
        yield words.counts(words.places(1), 1)
    if now is None:
        for length in range(2, longest + 1):
            yield words.counts(words.places(length), length)
        return
    earlier = _admitted(words, lang, longest, before) if before is not None else iter(lambda: None, 0)
    for length, flags, done in zip(range(2, longest + 1), _admitted(words, lang, longest, now), earlier):
        yield words.counts(np.flatnonzero(flags if done is None else flags & ~done), length)


def _count(docs: DataFrame, longest: int, now: Filter | None, before: Filter | None, least: int) -> DataFrame:
    """(lang, phrase, n) of the phrases with ``least`` occurrences in ``docs``; a null phrase stands for all words."""
    shared = docs.sparkSession.sparkContext.broadcast((now, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, HELD)):
            for lang, texts in _by_language(batch):
                words = Words(texts)
                total = pa.array([None], pa.string()), np.array([len(words.codes)])
                for phrases, n in chain([total], _counted(words, lang, longest, *shared.value)):
                    langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), dtype=np.int64)))
                    rows = pa.record_batch([langs, phrases, pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"])
                    yield from (rows.slice(k, ROWS_OUT) for k in range(0, len(rows), ROWS_OUT))
                    del langs, phrases, rows
                del words
            pa.default_memory_pool().release_unused()

    counts = docs.select("lang", "text").mapInArrow(run, PHRASES).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    out = materialize(counts.where(F.col("phrase").isNull() | (F.col("n") >= least)), "counted")
    shared.destroy()
    return out


def _outside(phrases: DataFrame, known: Filter) -> DataFrame:
    """Those of ``phrases`` that the filter does not hold."""
    shared = phrases.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~shared.value.holds(keys_of(batch.column("lang"), batch.column("phrase")))))

    out = materialize(phrases.mapInArrow(run, PHRASES), "outside")
    shared.destroy()
    return out


def _length(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.translate(phrase, " ", "")) + 1


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, one_in: int = SAMPLE_ONE_IN) -> DataFrame:
    """(lang, phrase, n) of every phrase of up to ``longest`` words with ``least`` occurrences or more, and
    for each language a row with a null phrase and the number of its words."""
    slim = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    sample = slim.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0)
    enough = max(2, least // (2 * one_in))
    proposed = _count(sample, longest - 1, None, None, enough).where(F.col("phrase").isNotNull())
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < BITS_EACH * proposed.count():
        bits *= 2
    before, now = None, Filter(bits).with_keys(proposed)
    found = counted = _count(slim, longest, now, None, least)
    while True:
        inner = counted.where(F.col("phrase").isNotNull() & (_length(F.col("phrase")) < longest))
        missed = _outside(inner, now)
        if missed.isEmpty():
            return found
        before, now = now, now.with_keys(missed)
        counted = _count(slim, longest, now, before, least).where(F.col("phrase").isNotNull())
        found = found.unionByName(counted)


def _parts(words: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def _cuts(words: Column) -> Column:
    size = F.size(words)
    return F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(
        k.alias("k"), _parts(words, F.lit(1), k).alias("first"), _parts(words, k + 1, size - k).alias("rest")))


def _inner(words: Column) -> Column:
    """Shorter phrases of two words or more inside one."""
    size = F.size(words)
    return F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda at: _parts(words, at, n))))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, one_in: int = SAMPLE_ONE_IN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two words or more."""
    frequent = frequent_phrases(docs, least, longest, one_in)
    counts = frequent.where(F.col("phrase").isNotNull())
    totals = frequent.where(F.col("phrase").isNull()).select("lang", F.col("n").alias("total"))
    phrases = counts.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1).withColumnRenamed("n", "a")
    cuts = phrases.select("lang", "phrase", "a", F.inline(_cuts(F.col("words"))))
    sides = [counts.select("lang", F.col("phrase").alias(p), F.col("n").alias(c)) for p, c in (("first", "l"), ("rest", "r"))]
    score = F.expr("cast((cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r) as bigint)")
    scored = cuts.join(sides[0], ["lang", "first"]).join(sides[1], ["lang", "rest"]).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    longer = phrases.where(F.size("words") > 2).select("lang", F.explode(F.array_distinct(_inner(F.col("words")))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (100 * F.col("around").cast("decimal(20,0)") < 80 * F.col("a").cast("decimal(20,0)")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def oracle(least: int = LEAST, top: int = TOP) -> str:
    """SQL twin: all phrases are counted, then scored, dropped and ranked by the same rules."""
    def grams(n: int) -> str:
        text = " || ' ' || ".join(f"ws[i + {k}]" if k else "ws[i]" for k in range(n))
        return (f"SELECT lang, {n} AS k, {text} AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) - {n - 2})) AS i "
                f"FROM w WHERE len(ws) >= {n})")
    return rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS ({" UNION ALL ".join(grams(n) for n in range(1, LONGEST + 1))}),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {least}),
t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
x AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
c AS (SELECT lang, phrase, a, ws, unnest(range(1, k)) AS cut FROM x),
d AS (
  SELECT c.lang, c.phrase, c.a, cut, y.a AS l, z.a AS r, (c.a::HUGEINT * 2000000) // (y.a + z.a) AS score FROM c
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[1:cut], ' ')
  JOIN f z ON z.lang = c.lang AND z.phrase = array_to_string(ws[cut + 1:], ' ')),
s AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, a, unnest(list_concat(
        list_transform(range(1, len(ws)), lambda q: array_to_string(ws[q:q + 1], ' ')),
        CASE WHEN k > 3 THEN list_transform(range(1, len(ws) - 1), lambda q: array_to_string(ws[q:q + 2], ' ')) ELSE [] END)) AS phrase
      FROM x WHERE k > 2),
o AS (SELECT lang, phrase, max(a) AS around FROM i GROUP BY ALL),
k AS (SELECT s.* FROM s LEFT JOIN o ON o.lang = s.lang AND o.phrase = s.phrase WHERE around IS NULL OR 100 * around < 80 * s.a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT q.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM q JOIN t ON t.lang = q.lang WHERE rank <= {top}
"""
