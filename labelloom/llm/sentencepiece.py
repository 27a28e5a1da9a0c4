"""SentencePiece encoding and decoding over a relational lattice.

A text is cut where no piece of the model can reach across, which is wherever two neighbouring
characters never stand together in a piece; what is between cuts (a chunk) is encoded on its
own. Each different chunk is encoded once: its substrings up to the longest piece are
exploded and equi-joined with the piece table, the edges are grouped by chunk, and a
higher-order ``aggregate`` folds them into the best path.

A unigram model's path is the one of the greatest score (Viterbi). A BPE model's scores are
merge priorities, and the path of the greatest sum is not what such a model encodes to, so
for that type the fold takes the edge of the highest priority that joins two symbols, until
none is left. Both folds run over the same edges. A chunk too long for the bits of a long is
folded by the same rule with a heap.

Chunks are counted over all texts. Those counted twice or more, up to the ``HOT_CHUNKS`` most
frequent, go to the executors as one table. A chunk counted once keeps the key of its text from the
counting on, so its ids reach that text by the key alone; only chunks between the two, if there are
any, need the texts that hold them looked up and a join on the chunk. Texts are packed while they wait for it.

Defined cases: a null or empty text has no ids. Characters that no piece has become bytes if
the model has byte pieces, else the unknown id. A text that holds the model's own space sign
decodes to a space there, and ``exact`` is false. Repeated rows are encoded alike. Null ids are
ids like others. Only the id and the text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from labelloom.llm.common import materialize
from labelloom.llm.rolling import LONG, PrefixHash, mix
from labelloom.llm.texts import PIECE, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
HOT_CHUNKS = 2_000_000
MASK_CHARS = 60
# The lattice of so many chunks is one task.
TASK_CHUNKS = 20_000
# Arrays of eight bytes for each character or id are held for so many of them at once: a worker keeps what it once took.
SEGMENT = 1 << 17

# Fixed values of the model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE = 1, 2, 6


@dataclass
class Model:
    """The piece table of a model file; ``pieces`` are (text, id, score) of the normal pieces."""

    kind: int
    pieces: list[tuple[str, int, float]]
    bytes_: list[int]
    unknown: int
    texts: list[bytes]
    prefix: bool

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as proto

        found = proto.ModelProto()
        with open(path, "rb") as f:
            found.ParseFromString(f.read())
        if found.normalizer_spec.precompiled_charsmap or found.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        rows = [(p.piece, i, p.score, p.type) for i, p in enumerate(found.pieces)]
        return cls.of(found.trainer_spec.model_type, rows, found.normalizer_spec.add_dummy_prefix)

    @classmethod
    def of(cls, kind: int, rows: list[tuple[str, int, float, int]], prefix: bool = True) -> Model:
        if kind not in (UNIGRAM, BPE):
            raise ValueError("unigram and BPE models are supported")
        value = {i: int(p[3:5], 16) for p, i, _, t in rows if t == BYTE}
        texts = [bytes([value[i]]) if i in value else p.replace(SPACE, " ").encode() if t == NORMAL else b"" for p, i, _, t in rows]
        by_byte = {v: i for i, v in value.items()}
        return cls(kind, [(p, i, s) for p, i, s, t in rows if t == NORMAL], [by_byte[v] for v in range(256)] if len(by_byte) == 256 else [],
                   next((i for _, i, _, t in rows if t == UNKNOWN), 0), texts, prefix)

    @cached_property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)

    @cached_property
    def joins(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each character of a piece (0: none), and which pairs stand in a piece."""
        alphabet = sorted({c for p, _, _ in self.pieces for c in p})
        number = np.zeros(0x110000, dtype=np.int32)
        for k, c in enumerate(alphabet, 1):
            number[ord(c)] = k
        pair = np.zeros((len(alphabet) + 1, len(alphabet) + 1), dtype=bool)
        for p, _, _ in self.pieces:
            for a, b in zip(p, p[1:]):
                pair[number[ord(a)], number[ord(b)]] = True
        return number, pair


def _long_hash(chunk: str) -> int:
    return xxh64_intdigest(chunk.encode("utf-8", "surrogatepass"))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hashes(joined: str, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each of the chunks from ``begin`` to ``end``, which follow each other in ``joined``."""
    hashes = np.zeros(len(begin), dtype=np.uint64)
    # The chunks of a segment begin within as many characters, and there are no more of them.
    firsts = np.searchsorted(begin, np.arange(0, len(joined), SEGMENT)).tolist()
    for k, until in zip(firsts, [*firsts[1:], len(begin)]):
        if k < until:
            first, size = begin[k:until], end[k:until] - begin[k:until]
            part = PrefixHash(mix(_points(joined[begin[k]:end[until - 1]]).astype(np.uint64) + np.uint64(1)))
            hashes[k:until] = mix(part.window(first - first[0], size) + size.astype(np.uint64))
    for k in np.flatnonzero(end - begin >= LONG):
        hashes[k] = _long_hash(joined[begin[k]:end[k]])
    return hashes


def _gather(source: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` items of ``source`` from each ``start``, one after the other."""
    parts = [source[:0]]
    for k in range(0, len(start), SEGMENT):
        first, n = start[k:k + SEGMENT], size[k:k + SEGMENT]
        parts.append(source[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
    return np.concatenate(parts)


@dataclass
class Chunks:
    """The chunks of some texts: begin and end in the joined text, a hash, and each text's first chunk."""

    joined: str
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[str], model: Model) -> Chunks:
        number, pair = model.joins
        lead = SPACE if model.prefix else ""
        marked = [lead + t.replace(" ", SPACE) if t else "" for t in texts]
        joined = "".join(marked)
        borders = np.concatenate([[0], np.cumsum([len(t) for t in marked])]).astype(np.int64)
        del marked
        cut = np.ones(len(joined) + 1, dtype=bool)
        for at in range(0, len(joined), SEGMENT):
            symbols = number[_points(joined[at:at + SEGMENT + 1])]
            cut[at + 1:at + len(symbols)] = ~pair[symbols[:-1], symbols[1:]]
        cut[borders] = True
        places = np.flatnonzero(cut) if joined else np.zeros(1, dtype=np.int64)
        begin, end = places[:-1], places[1:]
        return cls(joined, begin, end, _hashes(joined, begin, end), np.searchsorted(begin, borders))

    def text(self, k: int) -> str:
        return self.joined[self.begin[k]:self.end[k]]


def text_key(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a key of the row. Rows that share one only see each other's chunks."""
    return docs.withColumn("key", F.xxhash64("doc_id", "text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))


def chunk_counts(docs: DataFrame, model: Model) -> DataFrame:
    """(chunk, n, key) over all texts (doc_id, text); ``key`` is that of the text that holds a chunk counted once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            chunks = Chunks.of(batch.column("text").to_pylist(), shared.value)
            _, first, n = np.unique(chunks.hashes, return_index=True, return_counts=True)
            keys = batch.column("key").to_numpy()[np.searchsorted(chunks.starts, first, side="right") - 1]
            yield pa.record_batch([pa.array([chunks.text(k) for k in first.tolist()], pa.string()), pa.array(n.astype(np.int64)),
                                   pa.array(np.where(n == 1, keys, 0).astype(np.int32))], names=["chunk", "n", "key"])

    slim = text_key(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("text", "key")
    return slim.mapInArrow(run, "chunk string, n bigint, key int").groupBy("chunk").agg(F.sum("n").alias("n"), F.max("key").alias("key"))


def lattice(chunks: DataFrame, model: Model) -> DataFrame:
    """(chunk, n, key, edges): each chunk with the pieces that are substrings of it, and every single character.

    ``chunks`` (chunk, n, key) comes dealt out by chunk, and neither the explosion nor the join
    with the piece table, whose size is that of the model, moves a row.
    """
    # An Arrow table becomes rows without a Python worker on the executors.
    piece, number, score = zip(*(model.pieces or [("", 0, 0.0)]))
    rows = pa.table({"piece": pa.array(piece, pa.string()), "id": pa.array(number, pa.int32()), "score": pa.array(score, pa.float64())})
    table = F.broadcast(chunks.sparkSession.createDataFrame(rows))
    ends = chunks.select("chunk", "n", "key", F.explode(F.sequence(F.lit(0), F.length("chunk") - 1)).alias("at"))
    spans = ends.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.length("chunk") - F.col("at")))).alias("size"))
    parts = spans.select("*", F.substring(F.col("chunk"), F.col("at") + 1, F.col("size")).alias("piece"))
    edges = parts.join(table, "piece", "left").where("id IS NOT NULL OR size = 1")
    return edges.groupBy("chunk").agg(F.first("n").alias("n"), F.first("key").alias("key"), F.collect_list(F.struct(
        (-F.col("score")).alias("cost"), "at", "size", "id")).alias("edges"))


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times within one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))


def _merged(chunk: Column, edges: Column) -> Column:
    """Bits of the symbol borders that are left when no edge joins two symbols any more.

    An edge joins two symbols where both its ends are borders and one border is inside. Once none does,
    the sign bit tells the steps that are left.
    """
    longer = F.filter(edges, lambda e: (e["size"] > 1) & e["id"].isNotNull())
    ranked = F.transform(F.sort_array(longer), lambda e: F.struct(
        _bit(e["at"]).bitwiseOR(_bit(e["at"] + e["size"])).alias("ends"),
        (_bit(e["at"] + e["size"]) - _bit(e["at"] + 1)).alias("inside")))

    over = F.lit(-1 << 63).cast("bigint")

    def fold(joins: Column) -> Column:
        def step(borders: Column, _: Column) -> Column:
            fitting = F.filter(joins, lambda e: (borders.bitwiseAND(e["ends"]) == e["ends"]) & (
                F.bit_count(borders.bitwiseAND(e["inside"])) == 1))
            best = F.get(fitting, F.lit(0))["inside"]
            return F.when(borders < 0, borders).otherwise(F.coalesce(borders.bitwiseAND(F.bitwise_not(best)), borders.bitwiseOR(over)))
        return F.aggregate(F.sequence(F.lit(1), F.length(chunk)), _bit(F.length(chunk) + 1) - 1, step).bitwiseAND(F.bitwise_not(over))

    return _bind(ranked, fold)


def _viterbi(chunk: Column, edges: Column, unknown_cost: float) -> Column:
    """Bits of the borders of the cheapest path; of equally cheap ones that with the longer last piece."""
    def step(best: Column, end: Column) -> Column:
        incoming = F.transform(F.filter(edges, lambda e: e["at"] + e["size"] == end), lambda e: F.struct(
            (F.get(best, e["at"])["cost"] + F.coalesce(e["cost"], F.lit(unknown_cost))).alias("cost"),
            e["at"].alias("at"), F.get(best, e["at"])["borders"].bitwiseOR(_bit(end)).alias("borders")))
        return F.concat(best, F.array(F.array_min(incoming)))
    first = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("at"), F.lit(1).cast("bigint").alias("borders")))
    paths = F.aggregate(F.sequence(F.lit(1), F.length(chunk)), first, step)
    return F.get(paths, F.length(chunk))["borders"]


def _ids(chunk: Column, edges: Column, borders: Column, model: Model) -> Column:
    """Piece ids of the symbols between borders: each is the edge that has a border at both ends and none inside."""
    def between(e: Column) -> Column:
        ends = _bit(e["at"]).bitwiseOR(_bit(e["at"] + e["size"]))
        reach = _bit(e["at"] + e["size"] + 1) - _bit(e["at"])
        return borders.bitwiseAND(reach) == ends

    def symbol(e: Column) -> Column:
        if model.bytes_:
            table = F.array(*(F.lit(i) for i in model.bytes_))
            digits = F.hex(F.encode(F.substring(chunk, e["at"] + 1, e["size"]), "utf-8"))
            other = F.transform(F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int")), lambda k: F.get(
                table, F.conv(F.substring(digits, (k * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")))
        else:
            other = F.array(F.lit(model.unknown))
        return F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(other)

    mine = F.transform(F.filter(edges, between), lambda e: F.struct(e["at"].alias("at"), e["size"].alias("size"), e["id"].alias("id")))
    return F.flatten(F.transform(F.sort_array(mine), symbol))


def fold_long(chunk: str, edges: list[tuple[float, int, int, int]], model: Model) -> list[int]:
    """The same folds for a chunk of any length: merges by a heap, the cheapest path by its last piece."""
    n = len(chunk)
    cost = {(at, size): (c, i) for c, at, size, i in edges if i is not None}
    if model.kind == BPE:
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int, int]] = []

        def offer(at: int) -> None:
            middle = after[at]
            if middle < n:
                found = cost.get((at, after[middle] - at))
                if found:
                    heapq.heappush(heap, (found[0], at, middle, after[middle]))
        for at in range(n - 1):
            offer(at)
        while heap:
            _, at, middle, end = heapq.heappop(heap)
            if not alive[at] or not alive[middle] or after[at] != middle or after[middle] != end:
                continue
            alive[middle] = False
            after[at] = end
            if end < n:
                before[end] = at
            offer(at)
            if before[at] >= 0:
                offer(before[at])
        cuts = [(at, after[at]) for at in range(n) if alive[at]]
    else:
        best: list[tuple[float, int]] = [(0.0, 0)]
        plain = unknown_cost(model)
        for end in range(1, n + 1):
            best.append(min((best[at][0] + cost.get((at, end - at), (plain, 0))[0], at)
                            for at in range(max(0, end - model.longest), end) if end - at == 1 or (at, end - at) in cost))
        cuts, end = [], n
        while end:
            cuts.append((best[end][1], end))
            end = best[end][1]
        cuts.reverse()
    out: list[int] = []
    for at, end in cuts:
        if (at, end - at) in cost:
            out.append(cost[at, end - at][1])
        else:
            out += [model.bytes_[b] for b in chunk[at:end].encode()] if model.bytes_ else [model.unknown]
    return out


def unknown_cost(model: Model) -> float:
    return 10.0 - min((s for _, _, s in model.pieces), default=0.0)


def encode_chunks(chunks: DataFrame, model: Model) -> DataFrame:
    """``chunks`` (chunk, n, key) -> (chunk, n, key, ids)."""
    edges = lattice(chunks.where(F.length("chunk") <= MASK_CHARS), model)
    chunk, e = F.col("chunk"), F.col("edges")
    borders = _merged(chunk, e) if model.kind == BPE else _viterbi(chunk, e, unknown_cost(model))
    # Bound inside the expression: a column of it would be folded anew for every character.
    short = edges.select("chunk", "n", "key", _bind(borders, lambda b: _ids(chunk, e, b, model)).alias("ids"))
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fold_long(c, [(x["cost"], x["at"], x["size"], x["id"]) for x in rows], shared.value)
                     for c, rows in zip(batch.column("chunk").to_pylist(), batch.column("edges").to_pylist())]
            yield pa.record_batch([batch.column("chunk"), batch.column("n"), batch.column("key"), pa.array(found, pa.list_(pa.int32()))],
                                  names=["chunk", "n", "key", "ids"])

    # The rows of long chunks come from an own, small part of the input, so that the others need no Python.
    long = lattice(chunks.where(F.length("chunk") > MASK_CHARS), model).mapInArrow(
        run, "chunk string, n bigint, key int, ids array<int>")
    return short.unionByName(long)


def hash_chunks(chunks: pa.Array) -> np.ndarray:
    """The hash of each chunk, as ``Chunks`` has it."""
    parts = [np.zeros(0, dtype=np.uint64)]
    for k in range(0, len(chunks), 1 << 16):
        part = chunks.slice(k, 1 << 16).to_pylist()
        end = np.cumsum([len(c) for c in part])
        parts.append(_hashes("".join(part), np.concatenate([[0], end[:-1]]), end))
    return np.concatenate(parts)


@dataclass
class Table:
    """Ids of known chunks: sorted hashes, and where each one's ids begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, chunks: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> Table:
        """``flat`` has the ids of all ``chunks`` in turn, ``sizes`` how many each has."""
        return cls.sorted(hash_chunks(chunks), flat, sizes)

    @classmethod
    def sorted(cls, hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> Table:
        order = np.argsort(hashes)
        begin = np.cumsum(sizes) - sizes
        starts = np.concatenate([[0], np.cumsum(sizes[order])])
        return cls(hashes[order], starts, _gather(flat, begin[order], sizes[order]))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def hot_table(encoded: DataFrame, most: int) -> tuple[Table, DataFrame | None]:
    """The table of chunks counted at least 2**b times, with the least b from 1 on that keeps it below ``most`` rows.

    Also the chunks counted twice or more that are not in it, if there are any.
    """
    level = F.floor(F.log2("n")).cast("int")
    sizes_by_level = {r["b"]: r["count"] for r in encoded.groupBy(level.alias("b")).count().collect()}  # at most 63 rows
    total, least = 0, 1
    for b in sorted((b for b in sizes_by_level if b >= least), reverse=True):
        total += sizes_by_level[b]
        if total > most:
            least = b + 1
            break
    # Tasks hash the chunks, so that the driver gets their hashes and ids alone.
    rows = encoded.where(level >= least).select("chunk", "ids").mapInArrow(_packed, "hashes binary, sizes binary, ids binary").toArrow()
    hashes, sizes, ids = (np.concatenate([np.zeros(0, dtype=kind), *(np.frombuffer(x.as_buffer(), dtype=kind) for x in rows.column(c))])
                          for c, kind in (("hashes", np.uint64), ("sizes", np.int32), ("ids", np.int32)))
    del rows
    pa.default_memory_pool().release_unused()
    between = encoded.where((F.col("n") > 1) & (level < least)) if any(0 < b < least for b in sizes_by_level) else None
    return Table.sorted(hashes, ids, sizes.astype(np.int64)), between


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        parts = (hash_chunks(batch.column("chunk")), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32),
                 lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32))
        yield pa.record_batch([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["hashes", "sizes", "ids"])


class Encoder:
    def __init__(self, model: Model, table: Table):
        self.model, self.table = model, table
        sizes = np.array([len(t) for t in model.texts])
        self.piece_start = np.concatenate([[0], np.cumsum(sizes)])
        self.piece_bytes = np.frombuffer(b"".join(model.texts) + b"\0", dtype=np.uint8)

    def missing(self, texts: list[str]) -> list[list[str]]:
        """Chunks of each text that the table does not have."""
        chunks = Chunks.of(texts, self.model)
        lost = np.flatnonzero(self.table.find(chunks.hashes) < 0)
        out: list[list[str]] = [[] for _ in texts]
        for k, t in zip(lost.tolist(), (np.searchsorted(chunks.starts, lost, side="right") - 1).tolist()):
            out[t].append(chunks.text(k))
        return [sorted(set(x)) for x in out]

    def encode(self, texts: list[str], own: Table | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin; ``own`` has the chunks that the table lacks."""
        chunks = Chunks.of(texts, self.model)
        distinct, back = np.unique(chunks.hashes, return_inverse=True)
        row = self.table.find(distinct)
        known = row >= 0
        size = np.where(known, self.table.starts[row + 1] - self.table.starts[row], 0)
        start = np.cumsum(size) - size
        source = _gather(self.table.ids, self.table.starts[row], size)
        if own is not None and len(own.hashes):
            other = own.find(distinct)
            start = np.where(known, start, own.starts[other] + len(source))
            size = np.where(known, size, own.starts[other + 1] - own.starts[other])
            source = np.concatenate([source, own.ids])
        elif not known.all():
            raise ValueError("a chunk without ids")
        size = size[back]
        ids = _gather(source, start[back], size)
        return ids, np.concatenate([[0], np.cumsum(size)])[chunks.starts]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        size = (self.piece_start[1:] - self.piece_start[:-1])[ids]
        data = _gather(self.piece_bytes, self.piece_start[ids], size).tobytes()
        cuts = np.concatenate([[0], np.cumsum(size)])[starts].tolist()
        skip = 1 if self.model.prefix else 0
        return [data[a + skip if data[a:a + 1] == b" " and skip and a < b else a:b] for a, b in zip(cuts[:-1], cuts[1:])]


OUT = "doc_id bigint, ids array<int>, n_tokens bigint, exact boolean"


def encode(docs: DataFrame, model: Model, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """(doc_id, ids, n_tokens, exact): ids of every text; ``exact`` tells that they decode to the text again."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = materialize(chunk_counts(slim, model), "chunk-counts")
    # The rows are few and small here and grow a hundredfold in the lattice, so they are dealt out by number.
    counts = counts.repartition(max(1, -(-counts.count() // TASK_CHUNKS)), "chunk")
    encoded = materialize(encode_chunks(counts, model), "chunks")
    table, between = hot_table(encoded, hot_chunks)
    shared = docs.sparkSession.sparkContext.broadcast((model, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in (p for b in batches for c in pieces(b, PIECE // 4, "packed") for p in pieces(_unpacked(c))):
            texts = batch.column("text").to_pylist()
            rare = {c: i for cs, ls in zip(batch.column("rare").to_pylist(), batch.column("rare_ids").to_pylist())
                    for c, i in zip(cs or (), ls or ())}
            own = Table.of(pa.array(list(rare), pa.string()), np.array([i for x in rare.values() for i in x], dtype=np.int32),
                               np.array([len(x) for x in rare.values()], dtype=np.int64))
            ids, starts = encoder.encode(texts, own)
            same = [a == t.encode("utf-8", "surrogatepass") for a, t in zip(encoder.decode(ids, starts), texts)]
            yield pa.record_batch([
                batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32))),
                pa.array(np.diff(starts)), pa.array(same)], names=["doc_id", "ids", "n_tokens", "exact"])

    return _with_rare(slim, encoded, between, shared).mapInArrow(run, OUT)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the shuffle."""
    codec = pa.Codec("zstd", compression_level=3)
    for batch in (p for b in batches for p in pieces(b)):
        raw = batch.column("text").cast(pa.binary()).to_pylist()
        yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array([codec.compress(t, asbytes=True) for t in raw], pa.binary()),
                               pa.array([len(t) for t in raw], pa.int32())], names=["doc_id", "key", "packed", "size"])


def _unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    codec = pa.Codec("zstd")
    texts = [codec.decompress(p, n, asbytes=True) for p, n in zip(batch.column("packed").to_pylist(), batch.column("size").to_pylist())]
    return batch.append_column("text", pa.array(texts, pa.binary()).cast(pa.string()))


def _with_rare(slim: DataFrame, encoded: DataFrame, between: DataFrame | None, shared) -> DataFrame:
    """``slim``, packed, with the chunks that are not in the shared table, and their ids, by a join on the key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in (p for b in batches for p in pieces(b)):
            yield pa.record_batch([batch.column("key"), pa.array(
                encoder.missing(batch.column("text").to_pylist()), pa.list_(pa.string()))], names=["key", "rare"])

    keyed = text_key(slim)
    rare = encoded.where("n = 1").select("key", "chunk", "ids")
    if between is not None:
        wanted = keyed.select("key", "text").mapInArrow(run, "key int, rare array<string>").select("key", F.explode("rare").alias("chunk")).distinct()
        rare = rare.unionByName(wanted.join(between.select("chunk", "ids"), "chunk"))
    found = rare.groupBy("key").agg(F.collect_list(F.struct("chunk", "ids")).alias("r"))  # at most the chunks of the texts of a key
    found = found.select("key", F.col("r.chunk").alias("rare"), F.col("r.ids").alias("rare_ids"))
    return keyed.mapInArrow(_pack, "doc_id bigint, key int, packed binary, size int").join(found, "key", "left")


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text)."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        encoder = Encoder(shared.value, Table(none.astype(np.uint64), np.zeros(1, dtype=np.int64), none))
        for batch in batches:
            column = batch.column("ids")
            texts = encoder.decode(column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py())
            yield pa.record_batch([batch.column("doc_id"), pa.array([t.decode(errors="replace") for t in texts], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(
        run, "doc_id bigint, text string")
