"""Take accepted verdicts back, so that their tasks can be done again (V4).

The accepted table only grows. What is taken back is a log of its own: a row names an id and
the micro-batch up to which its rows no longer count. Readers and the ingest subtract the log, so
the id is pending again, and a verdict that comes later, under whatever stream, counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.cluster import materialize
from labelloom.operators.intake import stuck_batches
from labelloom.sources.sinks import exists, swap_in


def retracted_path(sink: str) -> str:
    return f"{sink.rstrip('/')}/retracted"


def read_retracted(spark: SparkSession, sink: str) -> DataFrame | None:
    """The log (batch_idx, task_id, stream_id, up_to, run), or None if nothing was ever taken back."""
    path = retracted_path(sink)
    if not exists(spark, path):
        return None
    found = spark.read.parquet(path)
    return spark.read.schema(T.StructType([f for f in found.schema if f.name != "run"] + [T.StructField("run", T.StringType())])).parquet(path)


def live(rows: DataFrame, log: DataFrame | None, key: str) -> DataFrame:
    """``rows`` (key, stream_id, batch_id, ...) that were not taken back."""
    if log is None:
        return rows
    gone = log.groupBy(F.col("task_id").alias("_id"), F.col("stream_id").alias("_stream")).agg(F.max("up_to").alias("_up_to"))
    return rows.join(gone, (F.col(key) == F.col("_id")) & (F.col("stream_id") == F.col("_stream")) & (F.col("batch_id") <= F.col("_up_to")),
                     "left_anti")


def retract(rows: DataFrame, sink: str) -> None:
    """Add ``rows`` (batch_idx, task_id, stream_id, up_to) to the log, all of them or none."""
    spark, run = rows.sparkSession, uuid.uuid4().hex
    staging = f"{sink.rstrip('/')}/.staging-{run}"
    rows.select("batch_idx", "task_id", "stream_id", "up_to").write.parquet(staging)
    swap_in(spark, staging, f"{retracted_path(sink)}/run={run}")


def recover(accepted: DataFrame, sink: str, stories: DataFrame, batch_tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """Take back the verdicts of batches that were tried, did not pass and are fully seen.

    ``accepted`` are the live rows of the sink. Returns the batches (``batch_idx, n_tasks``) that are
    to be done again. Run twice, it finds nothing the second time, as the ids are unseen by then.
    """
    slim = accepted.select(F.col(key).alias("task_id"), "stream_id", "batch_id")
    reset = materialize(stuck_batches(stories, batch_tasks, slim), "reset")
    tasks = batch_tasks.select("batch_idx", "task_id").join(reset, "batch_idx", "left_semi")
    gone = slim.join(tasks, "task_id").groupBy("task_id", "stream_id").agg(
        F.min("batch_idx").alias("batch_idx"), F.max("batch_id").alias("up_to"))
    if not reset.isEmpty():
        retract(gone, sink)
    return tasks.groupBy("batch_idx").agg(F.count(F.lit(1)).alias("n_tasks"))
