"""Repeated windows of fixed length, found through keys that their content determines.

A window is a run of items (bytes or words) of one text. Every window gets a key from its own
content alone, so that equal windows have equal keys; consecutive windows of one key are a
row. ``ctx`` is a hash of all the content that a row's windows cover. Rows of one (key, ctx)
hold the same windows: all but the first row are repeats of it. Where a key has more than one
ctx, some of the windows may be equal and others not; the first rows of each ctx go on to a
finer look. All other windows are unique.

One shuffle by key does this. A key that a sample of the texts shows to hold a large share of
all rows is dealt out by ctx instead and always goes on to the finer look, so that no task gets
more than its share; at most ``1 / HOT_SHARE`` keys can be of that kind. Rows that repeat within
a batch never enter the shuffle as such.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import materialize

ROWS = "key bigint, ctx bigint, doc bigint, lo bigint, n int, anchor int"
ARROW = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("doc", pa.int64()), ("lo", pa.int64()),
                   ("n", pa.int32()), ("anchor", pa.int32())])
HOT_SHARE = 1 / 500
SAMPLE_DOCS = 2_000
# Spans of documents go to every executor only up to this many, of 16 bytes each.
BROADCAST_SPANS = 4_000_000

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def batch_of(key, ctx, doc, lo, n, anchor, by_place: bool) -> pa.RecordBatch:
    """Rows of one batch; those that repeat an earlier one of the batch become finished spans (null ctx)."""
    key, ctx = key.view(np.int64), ctx.view(np.int64)
    order = np.lexsort((lo, doc, ctx, key))
    new = np.ones(len(key), dtype=bool)
    k, c, d = key[order], ctx[order], doc[order]
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    late = d != d[lead]
    if by_place:
        late |= lo[order] != lo[order][lead]
    repeat = np.zeros(len(key), dtype=bool)
    repeat[order] = late
    keep = np.flatnonzero(~repeat)
    # Neighbouring finished rows of one text join into one span.
    gone = np.flatnonzero(repeat)
    gone = gone[np.lexsort((lo[gone], doc[gone]))]
    start, end, owner = lo[gone], lo[gone] + n[gone], doc[gone]
    head = np.ones(len(gone), dtype=bool)
    head[1:] = (owner[1:] != owner[:-1]) | (start[1:] != end[:-1])
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(gone)) - 1 if len(gone) else heads
    span_doc, span_lo, span_n = owner[heads], start[heads], end[tails] - start[heads]
    pad = np.zeros(len(heads), dtype=np.int64)
    null = np.concatenate([np.zeros(len(keep), dtype=bool), np.ones(len(heads), dtype=bool)])
    return pa.record_batch([
        pa.array(np.concatenate([key[keep], span_doc])), pa.array(np.concatenate([ctx[keep], pad]), mask=null),
        pa.array(np.concatenate([doc[keep], span_doc])), pa.array(np.concatenate([lo[keep], span_lo])),
        pa.array(np.concatenate([n[keep], span_n]).astype(np.int32)),
        pa.array(np.concatenate([anchor[keep], pad]).astype(np.int32))], schema=ARROW)


def sampled(docs: DataFrame, rows: int = SAMPLE_DOCS) -> DataFrame:
    """About ``rows`` documents by a hash of the id; they only tell which keys to deal out otherwise."""
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // rows))) == 0)


def hot_keys(rows: DataFrame) -> list[int]:
    counts = materialize(rows.where("ctx IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "sample-keys")
    least = (counts.agg(F.sum("rows")).first()[0] or 0) * HOT_SHARE
    return [r["key"] for r in counts.where(F.col("rows") > max(least, 20)).collect()]  # at most 1 / HOT_SHARE


def resolve(rows: DataFrame, hot: list[int], by_place: bool, label: str) -> DataFrame:
    """(doc, lo, n, anchor, key, done): spans of repeats (done), and first rows of keys with several ctx.

    The first row of a (key, ctx) is that of the least document, or with ``by_place`` the
    least document and place.
    """
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    dealt = rows.withColumn("hot", is_hot & F.col("ctx").isNotNull()).withColumn(
        "pkey", F.when(F.col("hot"), F.col("ctx")).otherwise(F.col("key"))).repartition("pkey")
    own: Column = F.struct("doc", "lo") if by_place else F.struct("doc")
    same = Window.partitionBy("pkey", "ctx", "key").orderBy("doc", "lo")
    group = Window.partitionBy("pkey")
    seen = dealt.withColumn("late", F.first(own).over(same) != own).withColumn("a", F.min("ctx").over(group)).withColumn(
        "b", F.max("ctx").over(group))
    done = F.col("ctx").isNull() | F.col("late")
    found = seen.select("doc", "lo", "n", "anchor", "key", done.alias("done"), (F.col("hot") | (F.col("a") != F.col("b"))).alias("open"))
    return materialize(found.where("done OR open").drop("open"), label)


def _merge(spans: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in spans:
        rows = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            out_a, out_b = [], []
            for x, y in zip(a, b):
                if out_b and x <= out_b[-1]:
                    out_b[-1] = max(out_b[-1], y)
                else:
                    out_a.append(x)
                    out_b.append(y)
            rows.append((out_a, out_b))
        kind = pa.list_(pa.int64())
        yield pa.record_batch([batch.column("doc_id"), pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)],
                              names=["doc_id", "a", "b"])


def with_spans(docs: DataFrame, spans: DataFrame, how: str, merged: bool, label: str) -> DataFrame:
    """``docs`` with arrays a and b of the document's ``spans`` (doc_id, a, b), sorted by a.

    ``merged`` joins spans that touch. The texts need no shuffle where all spans, counted
    first, are few enough to be sent to every executor; beyond that the same join is a shuffle.
    """
    packed = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("s")).select(
        "doc_id", F.transform("s", lambda x: x["a"]).alias("a"), F.transform("s", lambda x: x["b"]).alias("b"))
    if merged:
        packed = packed.mapInArrow(_merge, "doc_id bigint, a array<bigint>, b array<bigint>")
    packed = materialize(packed, label)
    total = packed.agg(F.sum(F.size("a") + 2)).first()[0] or 0
    return docs.join(F.broadcast(packed) if total <= BROADCAST_SPANS else packed, "doc_id", how)
