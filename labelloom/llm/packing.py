"""Packing of tokenized documents into sequences of fixed length, by bounded-space best fit.

A task reads its documents in order and keeps a fixed number of bins open. A bitset holds the
free space of the open bins, so the best-fitting bin for a piece is the lowest set bit at or
above the piece's length, and the fullest bin, which closes when a new one has no room, is the
lowest set bit of all. Pieces need no shuffle for that, and a task holds no more than its open
bins and one batch.

Bins that are still open when a task ends are not left half empty: their pieces are dealt out
again over few tasks, longest first, and packed by the same rule. They are at most ``OPEN``
bins of each task.

A document's ids are those of the tokenizer, then the id that ends a document. The tokenizer
splits at white space and around signs, so a Python worker encodes each different word once as long
as it remembers it (``WORDS_HELD`` words), and ids of texts are put together from ids of words.

Defined cases: a null or empty text is the end id alone. Only documents longer than a sequence
are cut. Rows that repeat an id are packed each; a null id is an id like others, and ids keep
their type. Only the id and the text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import materialize
from labelloom.llm.texts import pieces, runs_of, small_letters

LENGTH = 2048
OPEN = 256
END = 0
VOCABULARY = "word_bpe_49k.json"
# Different words whose ids a Python worker remembers, the longest word that is remembered, and how
# many the tokenizer takes at once.
WORDS_HELD = 400_000
LONGEST_HELD = 64
ENCODED = 5_000
# Tokens of left-over bins that one task packs again, and of rows that leave a task at once.
TAIL_TOKENS = 8_000_000
OUT_TOKENS = 1_000_000

# White space of the tokenizer; there is more of it, which stays inside words and is split there.
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09, 0x0A, 0x0D]] = False
# The tokenizer also splits between a letter (1) and one of these signs (2), which begin no special
# token and no shortened word.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[k for k in range(128) if chr(k).isalpha()]] = 1
_KIND[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = 2
# A word of small letters alone is what the tokenizer's normalizer and splitter leave as it is.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _latin(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the second bytes of the letters U+00C0 to U+00FF."""
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = data[at]
    letter = (second != 0x97) & (second != 0xB7)
    return at[letter], second[letter]


def _kinds(data: np.ndarray) -> np.ndarray:
    out = _KIND[data]
    at, _ = _latin(data)
    out[at] = 1
    out[at - 1] = 1
    return out


def _small(data: np.ndarray) -> np.ndarray:
    """Small letters for A-Z and for the capitals U+00C0 to U+00DE, as the tokenizer has them."""
    out = small_letters(data)
    at, second = _latin(data)
    out[at[second < 0x9F]] |= 0x20
    return out


def vocabulary(path: str | None = None) -> str:
    """The tokenizer file's text, read by the driver and sent to the tasks."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


class WordIds:
    """Ids of texts, put together from remembered ids of words."""

    def __init__(self, spec: str, held: int = WORDS_HELD):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.held = Tokenizer.from_str(spec), held
        self.model = self.tokenizer.model
        self.byte_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._forget()

    def _forget(self) -> None:
        """Start anew with the words that were met in the most pieces, if they were in two at least."""
        uses = self.uses if hasattr(self, "uses") else np.zeros(0, dtype=np.int64)
        kept = np.flatnonzero(uses > 1)
        kept = np.sort(kept[np.argsort(-uses[kept], kind="stable")[:self.held // 2]])
        words, flat, starts = (list(self.known), self.flat, self.starts) if len(kept) else ([], np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64))
        self.known = {words[k]: n for n, k in enumerate(kept.tolist())}
        size = starts[kept + 1] - starts[kept]
        self.starts = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.flat = flat[np.repeat(starts[kept] - self.starts[:-1], size) + np.arange(self.starts[-1])]
        self.uses = np.ones(len(kept), dtype=np.int64)

    def _encode(self, found: list[str]) -> list[list[int]]:
        """Ids of words; those of small letters alone need the model's merges only."""
        out: list[list[int] | None] = []
        for w in found:
            if _PLAIN.fullmatch(w):
                own = w if w.isascii() else self.byte_letters.pre_tokenize_str(w)[0][0]
                out.append([t.id for t in self.model.tokenize(own)])
            else:
                out.append(None)
        rest = [k for k, ids in enumerate(out) if ids is None]
        for part in (rest[k:k + ENCODED] for k in range(0, len(rest), ENCODED)):
            for k, e in zip(part, self.tokenizer.encode_batch_fast([found[k] for k in part], add_special_tokens=False)):
                out[k] = e.ids
        return out

    def _lookup(self, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and size of each word's ids, and the ids."""
        if len(self.known) + len(found) > self.held:
            self._forget()
        row = np.array([self.known.get(w, -1) for w in found], dtype=np.int64)
        new = np.flatnonzero(row < 0)
        # Words that are too long to be remembered come last.
        new = new[np.argsort([len(found[k]) > LONGEST_HELD for k in new], kind="stable")]
        row[new] = len(self.known) + np.arange(len(new))
        order = [found[k] for k in new]
        ids = self._encode(order)
        starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(i) for i in ids], dtype=np.int64)])
        flat = np.concatenate([self.flat, np.array(list(chain.from_iterable(ids)), dtype=np.int32)])
        before = len(self.known)
        self.known.update((w, before + k) for k, w in enumerate(order) if len(w) <= LONGEST_HELD)
        held = len(self.known)
        self.flat, self.starts = flat[:starts[held]], starts[:held + 1]
        self.uses = np.concatenate([self.uses, np.zeros(held - len(self.uses), dtype=np.int64)])
        self.uses[row[row < held]] += 1
        return starts[row], starts[row + 1] - starts[row], flat

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` with the end id after each, and where each text's ids begin."""
        # Special tokens hold a bar and are told by their case, so only other texts are put to small letters here.
        bars = pa.compute.any(pa.compute.match_substring(texts, "|")).as_py()
        found = runs_of(texts, _WORD, None if bars else _small, _kinds)
        coded = found.values.dictionary_encode()
        begin, size, flat = self._lookup(coded.dictionary.to_pylist())
        # The end of a text is one more word, with the end id alone.
        code = np.insert(coded.indices.to_numpy(zero_copy_only=False), found.first[1:], len(begin))
        begin, size, flat = np.append(begin, len(flat)), np.append(size, 1), np.append(flat, np.int32(END))
        begin, size = begin[code], size[code]
        reach = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(begin - reach[:-1], size) + np.arange(reach[-1])]
        return ids, reach[found.first + np.arange(len(found.first))]


@lru_cache(maxsize=1)
def coder(spec: str) -> WordIds:
    """One for all tasks of a Python worker, as the words that it remembers serve them all."""
    return WordIds(spec)


class Bins:
    """Open bins under a bitset of their free space; rows leave with the bin that closes."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.free = 0
        self.by_free: dict[int, list[list]] = {}
        self.count = 0

    def _take(self, room: int) -> list:
        same = self.by_free[room]
        found = same.pop()
        if not same:
            self.free ^= 1 << room
        self.count -= 1
        return found

    def _least(self, room: int) -> int:
        """Least free space of an open bin that is ``room`` or more, or -1."""
        fitting = self.free >> room
        return room + (fitting & -fitting).bit_length() - 1 if fitting else -1

    def place(self, size: int, row: tuple) -> Iterator[list]:
        """Put a piece of ``size`` tokens into a bin; the bins that close by that."""
        room = self._least(size)
        if room >= 0:
            held = self._take(room)
        else:
            if self.count >= self.most and size < self.length:
                yield self._take(self._least(0))
            room, held = self.length, []
        held.append((row, self.length - room))
        room -= size
        if room == 0:
            yield held
            return
        self.by_free.setdefault(room, []).append(held)
        self.free |= 1 << room
        self.count += 1

    def rest(self) -> Iterator[list]:
        for same in self.by_free.values():
            yield from same
        self.by_free, self.free, self.count = {}, 0, 0


def _schema(kind: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("closed", T.BooleanType())])


class _Out:
    """Rows of closed bins, collected into batches."""

    def __init__(self, kind: pa.DataType, phase: int):
        self.kind, self.rows, self.tokens = kind, [], 0
        self.number, self.base = 0, TaskContext.get().partitionId() << 32 | phase

    def add(self, held: list, closed: bool) -> None:
        sequence = self.base + 2 * self.number
        self.number += 1
        for (doc, piece, start, ids), offset in held:
            self.rows.append((doc, piece, start, len(ids) // 4, ids, sequence, offset, closed))
            self.tokens += len(ids) // 4

    def batch(self) -> pa.RecordBatch:
        doc, piece, start, length, ids, sequence, offset, closed = zip(*self.rows) if self.rows else ((),) * 8
        self.rows, self.tokens = [], 0
        return pa.record_batch([
            pa.array(doc, self.kind), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
            pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(closed, pa.bool_())],
            names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "closed"])


def _packed(rows: Iterator[tuple], kind: pa.DataType, length: int, most: int, phase: int) -> Iterator[pa.RecordBatch]:
    bins, out = Bins(length, most), _Out(kind, phase)
    for row in rows:
        for held in bins.place(len(row[3]) // 4, row):
            out.add(held, True)
        if out.tokens > OUT_TOKENS:
            yield out.batch()
    for held in bins.rest():
        out.add(held, phase > 0)
        if out.tokens > OUT_TOKENS:
            yield out.batch()
    yield out.batch()


def _first(spec, length: int, most: int):
    """Tokenize and pack; bins that are open at the end leave as such."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches, None)
        if head is None:
            return

        def rows() -> Iterator[tuple]:
            own_coder = coder(spec.value)
            for batch in (p for b in chain([head], batches) for p in pieces(b)):
                ids, starts = own_coder.encode(batch.column("text").cast(pa.large_string()))
                ids = ids.astype("<u4")
                for doc, a, b in zip(batch.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
                    for piece, start in enumerate(range(a, b, length)):
                        yield doc, piece, start - a, ids[start:min(start + length, b)].tobytes()
        yield from _packed(rows(), head.column("doc_id").type, length, most, 0)
    return run


def _again(length: int, most: int):
    """Pack the pieces of left-over bins; what is open at the end stays so."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches, None)
        if head is None:
            return

        def rows() -> Iterator[tuple]:
            for batch in chain([head], batches):
                yield from zip(*(batch.column(c).to_pylist() for c in ("doc_id", "piece", "start", "ids")))
        yield from _packed(rows(), head.column("doc_id").type, length, most, 1)
    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, most: int = OPEN) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): one row per piece, placed in its sequence.

    ``path`` is the tokenizer's file. ``ids`` are unsigned little-endian numbers of 32 bits.
    Sequence numbers are unique, not dense.
    """
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = _schema(docs.schema["doc_id"].dataType)
    first = materialize(slim.mapInArrow(_first(spec, length, most), schema), "packed")
    spec.destroy()
    left = first.where("NOT closed")
    parts = -(-(left.agg(F.sum("length")).first()[0] or 0) // TAIL_TOKENS)
    dealt = left.select("doc_id", "piece", "start", "length", "ids").repartition(max(1, parts), "doc_id", "piece")
    longest = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece").select("doc_id", "piece", "start", "ids")
    return first.where("closed").unionByName(longest.mapInArrow(_again(length, most), schema)).drop("closed")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the ids of each sequence in place, at most its length."""
    own = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return own.select("sequence_id", F.aggregate("p.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def digests(packed: DataFrame) -> DataFrame:
    """``packed`` with the checksum of each piece's ids in place of the ids."""
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
