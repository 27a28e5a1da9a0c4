"""Removal of byte strings that repeat an earlier one, by hash-compared suffix sort.

A suffix is looked at to a depth of ``depth`` bytes: only then can it repeat a whole string.
A sort of all suffixes of a corpus would move every byte more than ten times, so suffixes are
first put into buckets by hashes of parts of their content (see ``repeats``): by the least of
the hashes of the short strings inside, then, where a bucket holds different contents, by the
bytes that eight neighbouring suffixes share. Whole contexts that are equal settle in those
two shuffles. Where a bucket still holds different contexts its suffixes are sorted, compared
by common extensions of prefix polynomial hashes, and equal ones verified on their bytes.

Defined cases: a null or empty text has no bytes, and one shorter than the depth loses none.
Rows that repeat an id are one document: a place counts as the same place, so equal texts under
one id are treated alike. A null id is after all others and takes no part; it loses nothing.
Only the id and the text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.repeats import ROWS, Kernel, batch_of, hot_keys, resolve, sampled, with_spans
from labelloom.llm.rolling import PrefixHash, U, mix, sliding_argmin
from labelloom.llm.suffix_sort import Suffixes
from labelloom.llm.texts import Texts, pieces

DEPTH = 100
SEED = 32
NEIGHBOURS = 8
BLOCK = 1 << 18


def bucket_rows(depth: int, seed: int) -> Kernel:
    """Rows of consecutive suffixes whose least ``seed``-byte hash is at the same place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            texts = Texts.of(batch)
            parts = [[] for _ in range(6)]
            for at in range(0, len(texts.data), BLOCK):
                data = texts.data[at:at + BLOCK + depth - 1]
                hashes = PrefixHash.of_bytes(data)
                short = hashes.all_windows(seed)
                least = sliding_argmin(short, depth - seed + 1)
                place = np.arange(len(least))
                text = texts.text_of(place + at)
                inside = place + at + depth <= texts.starts[text + 1]
                place, least, text = place[inside], least[inside], text[inside]
                new = np.ones(len(place), dtype=bool)
                new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(place)))
                lo, anchor, text = place[head], least[head], text[head]
                ctx = hashes.window(lo, n - 1 + depth) + n.astype(np.uint64)
                for part, value in zip(parts, (short[anchor], mix(ctx), texts.ids[text], lo + at - texts.starts[text], n, anchor - lo)):
                    part.append(value)
            if parts[0]:
                yield batch_of(*(np.concatenate(p) for p in parts), by_place=True)
    return run


def _spans(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All spans of a batch, and the text of each."""
    a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in "ab")
    return a, b, np.repeat(np.arange(batch.num_rows), np.diff(batch.column("a").offsets.to_numpy()))


def _blocks(places: np.ndarray) -> Iterator[slice]:
    """Ranges of sorted places that lie in one block of the buffer."""
    cuts = np.flatnonzero(np.diff(places // BLOCK)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(places)]):
        if a < b:
            yield slice(int(a), int(b))


def neighbour_rows(depth: int) -> Kernel:
    """The spans of open rows (a = place * 256 + anchor, b = suffixes) in pieces of eight neighbours.

    Pieces are counted from the anchor, so the bytes common to all places of a piece are a
    matter of content; they are the key.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            texts = Texts.of(batch)
            packed, n, text = _spans(batch)
            lo, anchor = packed // 256 + texts.starts[text], packed % 256
            for at in _blocks(lo):
                base = lo[at][0]
                hashes = PrefixHash.of_bytes(texts.data[base:lo[at][-1] + 256 + depth])
                low, high = (anchor[at] - n[at] + 1) // NEIGHBOURS, anchor[at] // NEIGHBOURS
                many = high - low + 1
                row = at.start + np.repeat(np.arange(len(many)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many - low, many)
                point = lo[row] + anchor[row]
                first = np.maximum(lo[row], point - NEIGHBOURS * piece - NEIGHBOURS + 1)
                last = np.minimum(lo[row] + n[row] - 1, point - NEIGHBOURS * piece)
                key = hashes.window(point - NEIGHBOURS * piece - base, depth - NEIGHBOURS + 1) + piece.astype(np.uint64)
                count = last - first + 1
                ctx = hashes.window(first - base, count - 1 + depth) + count.astype(np.uint64) + (point - first).astype(np.uint64) * U(1 << 32)
                owner = text[row]
                yield batch_of(mix(key), mix(ctx), texts.ids[owner], first - texts.starts[owner], count, point - first, by_place=True)
    return run


def suffix_rows(depth: int, hot: frozenset[int]) -> Kernel:
    """(bucket, doc, lo, n, anchor, bytes) of open pieces (a = place * 2**16 + anchor * 2**8 + n, b = key).

    Pieces of a hot key are dealt out suffix by suffix, by the hash of the whole suffix.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            texts = Texts.of(batch)
            packed, key, text = _spans(batch)
            lo, anchor, n = packed >> 16, (packed >> 8) & 255, packed & 255
            is_hot = np.isin(key, np.array(sorted(hot), dtype=np.int64))
            times = np.where(is_hot, n, 1)
            row = np.repeat(np.arange(len(lo)), times)
            step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            lo, anchor, n, is_hot = lo[row] + step, anchor[row] - step, np.where(is_hot[row], 1, n[row]), is_hot[row]
            begin, bucket = lo + texts.starts[text[row]], key[row]
            for at in _blocks(begin):
                own = np.flatnonzero(is_hot[at]) + at.start
                if len(own):
                    hashes = PrefixHash.of_bytes(texts.data[begin[own[0]]:begin[own[-1]] + depth])
                    bucket[own] = hashes.window(begin[own] - begin[own[0]], depth).view(np.int64)
            raw = texts.data.tobytes()
            yield pa.record_batch([
                pa.array(bucket), pa.array(texts.ids[text[row]]), pa.array(lo), pa.array(n.astype(np.int32)),
                pa.array(anchor.astype(np.int32)),
                pa.array([raw[b:b + k - 1 + depth] for b, k in zip(begin.tolist(), n.tolist())], pa.binary())],
                names=["bucket", "doc", "lo", "n", "anchor", "bytes"])
    return run


def _sorted_repeats(table: pa.Table, depth: int) -> pa.RecordBatch:
    cells = table.column("bytes").combine_chunks()
    if isinstance(cells, pa.ChunkedArray):
        cells = cells.chunk(0)
    data = np.frombuffer(b"".join(cells.to_pylist()), dtype=np.uint8)
    bucket, doc, lo, n, anchor = (table.column(c).to_numpy().astype(np.int64) for c in ("bucket", "doc", "lo", "n", "anchor"))
    start = np.concatenate([[0], np.cumsum(n - 1 + depth)])[:-1]
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    place = lo[row] + step
    group = mix(bucket[row].view(np.uint64) + (anchor[row] - step).astype(np.uint64))
    by = np.argsort(group, kind="stable")
    group, row, step, place = group[by], row[by], step[by], place[by]
    suffixes = Suffixes(data, start[row] + step, depth)
    order = suffixes.sort(group)
    family = np.cumsum(~suffixes.equal_to_previous(order, group))
    owner, place = doc[row[order]], place[order]
    by = np.lexsort((place, owner, family))
    family, owner, place = family[by], owner[by], place[by]
    new = np.ones(len(family), dtype=bool)
    new[1:] = family[1:] != family[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    gone = (owner != owner[lead]) | (place != place[lead])
    return pa.record_batch([pa.array(owner[gone]), pa.array(place[gone]), pa.array(place[gone] + depth)], names=["doc_id", "a", "b"])


def sort_buckets(depth: int) -> Kernel:
    """Sort the suffixes of whole buckets; the rows come sorted by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1], side="left"))
            if cut:
                yield _sorted_repeats(pa.Table.from_batches([*waiting, batch.slice(0, cut)]), depth)
                waiting = []
            elif waiting and waiting[-1].column("bucket")[-1].as_py() != bucket[0]:
                yield _sorted_repeats(pa.Table.from_batches(waiting), depth)
                waiting = []
            waiting.append(batch.slice(cut))
        if waiting:
            yield _sorted_repeats(pa.Table.from_batches(waiting), depth)
    return run


def repeated_spans(docs: DataFrame, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """(doc_id, a, b): byte ranges covered by a string of ``depth`` bytes that also starts earlier."""
    if not NEIGHBOURS < seed < depth < 250:
        raise ValueError("a bucket's place and size are packed in one byte each")
    slim = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kernel = bucket_rows(depth, seed)
    hot = hot_keys(sampled(slim).mapInArrow(kernel, ROWS))
    wide = resolve(slim.mapInArrow(kernel, ROWS), hot, True, "buckets")

    def finished(rows: DataFrame) -> DataFrame:
        return rows.where("done").select(F.col("doc").alias("doc_id"), F.col("lo").alias("a"), (F.col("lo") + F.col("n") + depth - 1).alias("b"))

    rows = wide.where("NOT done").select(F.col("doc").alias("doc_id"), (F.col("lo") * 256 + F.col("anchor")).alias("a"), F.col("n").cast("bigint").alias("b"))
    texts = with_spans(slim, rows, "inner", False, "open-rows")
    kernel = neighbour_rows(depth)
    hot = hot_keys(sampled(texts).mapInArrow(kernel, ROWS))
    narrow = resolve(texts.mapInArrow(kernel, ROWS), hot, True, "pieces")
    left = narrow.where("NOT done")
    hot = hot_keys(left.withColumn("ctx", F.lit(0)))
    pieces = left.select(
        F.col("doc").alias("doc_id"), (F.col("lo") * 65536 + F.col("anchor") * 256 + F.col("n")).alias("a"), F.col("key").alias("b"))
    suffixes = with_spans(slim, pieces, "inner", False, "open-pieces").mapInArrow(
        suffix_rows(depth, frozenset(hot)), "bucket bigint, doc bigint, lo bigint, n int, anchor int, bytes binary")
    found = suffixes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        sort_buckets(depth), "doc_id bigint, a bigint, b bigint")
    return finished(wide).unionByName(finished(narrow)).unionByName(found)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], []]
        for text, a, b in zip(batch.column("text"), batch.column("a"), batch.column("b")):
            raw, spans = text.as_py().encode(), list(zip(a.as_py() or (), b.as_py() or ()))
            digest, at = hashlib.sha256(), 0
            for x, y in spans:
                digest.update(raw[at:x])
                at = y
            digest.update(raw[at:])
            for part, value in zip(out, (len(raw), sum(y - x for x, y in spans), len(spans), digest.hexdigest())):
                part.append(value)
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(p, t) for p, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string())))],
                              names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per document: ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of the rest."""
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(docs, depth)
    return with_spans(whole, spans, "left", True, "removed").mapInArrow(
        _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
