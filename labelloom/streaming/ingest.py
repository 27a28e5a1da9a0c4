"""Append-only, replay-safe verdict ingest as a stream (V2)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from labelloom.model import PlanError, VerdictSchema
from labelloom.operators.intake import first_by, mark_errors
from labelloom.sources.sinks import exists, remove
from labelloom.streaming import ids, retract

_ROW = "_row"


def accepted_path(sink: str) -> str:
    return f"{sink.rstrip('/')}/accepted"


def quarantine_path(sink: str) -> str:
    return f"{sink.rstrip('/')}/quarantine"


def repeated_path(sink: str) -> str:
    return f"{sink.rstrip('/')}/repeated"


def incoming_path(sink: str) -> str:
    """Rows of the micro-batch that is being added; a replay overwrites what a writer that died left here."""
    return f"{sink.rstrip('/')}/incoming"


def absorb_batch(batch: DataFrame, batch_id: int, sink: str, stream_id: str, schema: VerdictSchema,
                 version: str, order_cols: Sequence[str] = ()) -> None:
    """Add one micro-batch to the accepted, quarantine and repeated tables; each id is accepted once.

    Bad rows leave before ids are compared, so rows without id cannot swallow
    each other. The part of ``(stream_id, batch_id)`` is overwritten and not
    compared with itself: a replay ends in the same tables. Of equal ids in one
    micro-batch the first by ``order_cols`` stays, by default the first line; the others,
    and rows whose id was accepted before, are kept as repeated. An id that was taken back
    (see ``retract``) counts as new. Rows of line files keep their place as ``src``:
    ``batch_id, src`` is the order of arrival.
    """
    spark = batch.sparkSession
    part = ids.part_of(stream_id, batch_id)
    by_line = {"_file", "_block"} <= set(batch.columns)
    if by_line:
        place = F.struct(F.col("_file").alias("file"), F.col("_block").alias("block"), F.monotonically_increasing_id().alias("row"))
        batch = batch.withColumn("src", place).drop("_file", "_block")
    order_cols = order_cols or (["src"] if by_line else [])
    # Written once, so that whole rows are neither computed again nor kept in memory, and ids are compared without them.
    incoming = f"{incoming_path(sink)}/{part}"
    marked = mark_errors(batch, schema, version).withColumn(_ROW, F.monotonically_increasing_id())
    try:
        marked.write.mode("overwrite").parquet(incoming)
        marked = spark.read.schema(marked.schema).parquet(incoming)
        key = schema.id_field
        marked.where(F.size("errors") > 0).drop(_ROW).write.mode("overwrite").parquet(f"{quarantine_path(sink)}/{part}")
        clean = marked.where(F.size("errors") == 0).drop("errors", "malformed")
        good = first_by(clean.select(*dict.fromkeys([key, *order_cols, _ROW])), [key], [*order_cols, _ROW]).select(key, _ROW).persist()
        try:
            # Counting fills the cache, whose exact size then decides how the ids are joined.
            good.count()
            if not exists(spark, ids.sizes_path(sink)) and exists(spark, accepted_path(sink)):
                ids.rebuild(spark, sink, _parts(spark, accepted_path(sink)), key)
            known = ids.known_ids(good, sink, key, accepted_path(sink), stream_id, batch_id)
            fresh = good
            if known is not None:
                known = retract.live(known, retract.read_retracted(spark, sink), key)
                fresh = good.join(known.select(key), key, "left_anti")
            fresh = fresh.persist()
            try:
                taken = fresh.select(_ROW)
                again = clean.join(taken, _ROW, "left_anti").drop(_ROW)
                again.withColumn("errors", F.array(F.lit("repeated"))).write.mode("overwrite").parquet(f"{repeated_path(sink)}/{part}")
                # Ids go first: rows without ids could be accepted twice, ids without rows do not count.
                ids.add_part(fresh.select(key), sink, stream_id, batch_id, key)
                clean.join(taken, _ROW, "left_semi").drop(_ROW).write.mode("overwrite").parquet(f"{accepted_path(sink)}/{part}")
            finally:
                fresh.unpersist()
        finally:
            good.unpersist()
    finally:
        remove(spark, incoming)


def ingest_stream(stream: DataFrame, sink: str, checkpoint: str, stream_id: str, schema: VerdictSchema,
                  version: str, order_cols: Sequence[str] = (), once: bool = True) -> StreamingQuery:
    """Start the ingest; ``once`` handles what is there and stops.

    ``stream_id`` names the checkpoint: a new checkpoint needs a new name, as
    its batch numbers start again. One writer per sink at a time.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", stream_id):
        raise PlanError(f"stream_id is a plain folder name, got {stream_id!r}")
    writer = (stream.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, n: absorb_batch(df, n, sink, stream_id, schema, version, order_cols)))
    return (writer.trigger(availableNow=True) if once else writer).start()


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """A table of parts; stream names stay text, whatever they look like."""
    fields = [f for f in spark.read.parquet(path).schema if f.name not in ("stream_id", "batch_id")]
    return spark.read.schema(T.StructType(fields).add("stream_id", "string").add("batch_id", "long")).parquet(path)


def read_accepted(spark: SparkSession, sink: str, key: str = "task_id") -> DataFrame:
    """The accepted rows that were not taken back."""
    return retract.live(_parts(spark, accepted_path(sink)), retract.read_retracted(spark, sink), key)


def read_quarantine(spark: SparkSession, sink: str) -> DataFrame:
    return _parts(spark, quarantine_path(sink))


def read_repeated(spark: SparkSession, sink: str) -> DataFrame:
    """Acceptable rows that came after another one of their id, with ``errors = ["repeated"]``."""
    return _parts(spark, repeated_path(sink))
