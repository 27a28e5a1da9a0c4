"""Removal of word windows that repeat one of another document, by recompression.

The words of a text are names. A round first names runs of one symbol, then pairs of
neighbours of which the left one belongs to the left half of all names and the right one to
the right half. The name of a run or pair is a hash of what it is made of, and the half is a
bit of the name, so naming is global without any exchange: equal texts get equal symbols,
except for at most a run and a pair at either end of each round, where the neighbour outside
decides. What of a window is sure to be named alike wherever the window stands follows from
the window alone.

A window's key is the least of its sequences of ``SYMBOLS`` sure symbols, in the highest round
that has one. ``repeats`` then settles whole contexts that are equal, and where a sequence
stands in different contexts the single windows of those contexts are verified by two hashes
of all their words.

Defined cases: a null or empty text has no words, and one with fewer words than the window
loses none. Rows that repeat an id are one document. A null id is after all others and takes
no part. Only the id and the text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.repeats import ROWS, Kernel, batch_of, hot_keys, resolve, sampled, with_spans
from labelloom.llm.rolling import PrefixHash, U, mix
from labelloom.llm.texts import Texts, WordTexts, pieces

WINDOW = 50
ROUNDS = 3
SYMBOLS = 4

_RUN, _PAIR = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)


class Level:
    """Symbols of many texts after a round, and for every window the sure ones [lo, hi)."""

    def __init__(self, names: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.names, self.text, self.lo, self.hi = names, text, lo, hi

    def runs(self) -> Level:
        """Runs of one symbol become one; the outer runs of a window may go on outside."""
        new = np.ones(len(self.names), dtype=bool)
        new[1:] = (self.names[1:] != self.names[:-1]) | (self.text[1:] != self.text[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(new)))
        single = self.names[head]
        names = np.where(count > 1, mix(single * _RUN + count.astype(np.uint64)), single)
        at = np.append(np.cumsum(new) - 1, len(head))
        sure = self.lo < self.hi
        lo = np.where(sure, at[self.lo] + 1, 0)
        hi = np.where(sure, at[np.maximum(self.hi - 1, 0)], 0)
        return Level(names, self.text[head], lo, hi)

    def pairs(self, round_: int) -> Level:
        """Neighbours from the left and the right half become one symbol."""
        right = (mix(self.names ^ U(round_ + 1)) & U(1)).astype(bool)
        joined = np.zeros(len(self.names), dtype=bool)  # with the one before
        joined[1:] = right[1:] & ~right[:-1] & (self.text[1:] == self.text[:-1])
        head = np.flatnonzero(~joined)
        names = self.names[head]
        after = np.minimum(head + 1, max(len(self.names) - 1, 0))
        pair = (head + 1 < len(self.names)) & joined[after]
        names = np.where(pair, mix(names * _PAIR + mix(self.names[after])), names)
        at = np.append(np.cumsum(~joined) - 1, len(head))
        sure = self.lo < self.hi
        last = np.maximum(self.hi - 1, 0)
        first = np.minimum(self.lo, max(len(self.names) - 1, 0))
        lo = np.where(sure, at[first] + right[first], 0)
        hi = np.where(sure, at[last] + right[last], 0)
        return Level(names, self.text[head], lo, hi)


def least_symbols(words: WordTexts, window: int, rounds: int, symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window: its first word, its text, its key, and a number that tells its symbols' place apart."""
    counts = np.diff(words.starts)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words.hashes))
    fits = place + window <= words.starts[text + 1]
    start = place[fits]
    level = Level(words.hashes, text, start, start + window)
    levels = [level]
    for k in range(rounds):
        level = level.runs().pairs(k)
        levels.append(level)
    key, symbol = np.zeros(len(start), dtype=np.uint64), np.full(len(start), -1)
    base = 0
    for k in range(rounds, -1, -1):
        level = levels[k]
        todo = np.flatnonzero((symbol < 0) & (level.lo < level.hi - (symbols - 1)))
        lo, hi = level.lo[todo], level.hi[todo] - (symbols - 1)
        ranks = level.names.copy()
        for j in range(1, symbols):
            after = np.zeros_like(ranks)
            after[:-j] = level.names[j:]
            ranks = mix(ranks * _PAIR + after)
        ranks = mix(ranks + U(k))
        best, at = np.full(len(todo), np.iinfo(np.uint64).max, dtype=np.uint64), lo.copy()
        for step in range(int((hi - lo).max(initial=0))):
            here = lo + step
            value = ranks[np.minimum(here, len(ranks) - 1)]
            better = (here < hi) & (value < best)
            best, at = np.where(better, value, best), np.where(better, here, at)
        key[todo], symbol[todo] = best, at + base
        base += len(level.names)
    return start, text[start], key, symbol


def symbol_rows(window: int, rounds: int) -> Kernel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces(batch)):
            whole, parts = WordTexts.of(Texts.of(piece)), [[] for _ in range(5)]
            for at, words in whole.segments(window - 1):
                start, text, key, symbol = least_symbols(words, window, rounds)
                if not len(start):
                    continue
                new = np.ones(len(start), dtype=bool)
                new[1:] = (symbol[1:] != symbol[:-1]) | (text[1:] != text[:-1])
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(start)))
                lo, owner = start[head], text[head]
                ctx = mix(PrefixHash(words.hashes).window(lo, n - 1 + window) + n.astype(np.uint64))
                for part, value in zip(parts, (key[head], ctx, words.ids[owner], lo + at - whole.starts[owner], n)):
                    part.append(value)
            if parts[0]:
                rows = [np.concatenate(p) for p in parts]
                yield batch_of(*rows, np.zeros(len(rows[0]), dtype=np.int64), by_place=False)
    return run


def window_rows(window: int) -> Kernel:
    """The single windows of open rows (a = first word, b = windows), keyed by all their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            texts = Texts.of(batch)
            words = WordTexts.of(texts)
            hashes = PrefixHash(words.hashes)
            other = PrefixHash(WordTexts.of(texts, 1).hashes)
            text = np.repeat(np.arange(len(texts.ids)), np.diff(batch.column("a").offsets.to_numpy()))
            a, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in "ab")
            row = np.repeat(np.arange(len(a)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            place, owner = a[row] + step, text[row]
            at = place + words.starts[owner]
            yield batch_of(hashes.window(at, window), other.window(at, window), texts.ids[owner], place,
                           np.ones(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int64), by_place=False)
    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, a, b): word ranges covered by a window that also starts in a document with a smaller id."""
    slim = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kernel = symbol_rows(window, rounds)
    hot = hot_keys(sampled(slim).mapInArrow(kernel, ROWS))
    wide = resolve(slim.mapInArrow(kernel, ROWS), hot, False, "symbols")
    rows = wide.where("NOT done").select(F.col("doc").alias("doc_id"), F.col("lo").alias("a"), F.col("n").cast("bigint").alias("b"))
    single = with_spans(slim, rows, "inner", False, "open-rows").mapInArrow(window_rows(window), ROWS)
    narrow = resolve(single, [], False, "windows")
    return wide.unionByName(narrow).where("done").select(
        F.col("doc").alias("doc_id"), F.col("lo").alias("a"), (F.col("lo") + F.col("n") + window - 1).alias("b"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], []]
        for text, a, b in zip(batch.column("text"), batch.column("a"), batch.column("b")):
            words, kept, at = text.as_py().encode().split(), [], 0
            spans = list(zip(a.as_py() or (), b.as_py() or ()))
            for x, y in spans:
                kept += words[at:x]
                at = y
            kept += words[at:]
            for part, value in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())):
                part.append(value)
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(p, t) for p, t in zip(out, (pa.int64(), pa.int64(), pa.string())))],
                              names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: ``n_words``, ``n_removed`` and ``kept_sha256`` of the words that stay."""
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return with_spans(whole, repeated_spans(docs, window), "left", True, "removed").mapInArrow(
        _cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
