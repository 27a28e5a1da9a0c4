"""Check incoming verdicts and find what is left to do (V1, V3, V4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.columns import row_errors, true, with_chars
from labelloom.model import VerdictSchema


def mark_errors(verdicts: DataFrame, schema: VerdictSchema, version: str) -> DataFrame:
    """Add the reason's length and ``errors ARRAY<STRING>``, empty for an acceptable row.

    A row with its raw text in ``malformed`` has that one error.
    """
    errors = row_errors(schema, version)
    if "malformed" in verdicts.columns:
        errors = F.when(F.col("malformed").isNotNull(), F.array(F.lit("malformed"))).otherwise(errors)
    added = [c for c in with_chars(verdicts, schema).columns if c not in (*verdicts.columns, schema.chars_field)]
    return with_chars(verdicts, schema).withColumn("errors", errors).drop(*added)


def validate_rows(verdicts: DataFrame, schema: VerdictSchema, version: str) -> tuple[DataFrame, DataFrame]:
    """Split into accepted rows and rows to quarantine with their errors (V1)."""
    marked = mark_errors(verdicts, schema, version)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def first_by(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """The first row per key by ``order_cols``, as a combinable aggregate."""
    rest = [c for c in df.columns if c not in keys and c not in order_cols]
    best = F.min(F.struct(*order_cols, *rest)).alias("_best")
    if any(df.schema[c].dataType.typeName() in ("map", "variant") for c in rest):
        best = F.min_by(F.struct(*order_cols, *rest), F.struct(*order_cols)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def seen_ids(verdicts: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    return verdicts.select(*keys).distinct()


def pending(batch_tasks: DataFrame, verdicts: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Tasks without a verdict (V3). The join reuses the shuffle of the distinct ids."""
    return batch_tasks.join(seen_ids(verdicts, keys), list(keys), "left_anti")


def stuck_batches(stories: DataFrame, batch_tasks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Batches (``batch_idx``) that were tried, did not pass, and are fully seen."""
    stuck = stories.where((F.col("attempts") > 0) & ~true(F.col("passes"))).select("batch_idx")
    tasks = batch_tasks.select("batch_idx", "task_id").join(stuck, "batch_idx", "left_semi")
    state = tasks.join(seen_ids(verdicts).withColumn("_seen", F.lit(True)), "task_id", "left")
    return state.groupBy("batch_idx").agg(F.bool_and(true(F.col("_seen"))).alias("_full")).where("_full").select("batch_idx")


def auto_recover(stories: DataFrame, batch_tasks: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop verdicts of batches that were tried, did not pass, and are fully seen (V4).

    ``stories`` carries ``batch_idx``. Returns the kept verdicts and the reset
    batches (``batch_idx``); a reset batch is pending again as its ids are unseen.
    :func:`labelloom.streaming.retract.recover` does the same to a sink.
    """
    reset = stuck_batches(stories, batch_tasks, verdicts)
    dropped = batch_tasks.select("batch_idx", "task_id").join(reset, "batch_idx", "left_semi").select("task_id")
    return verdicts.join(dropped, "task_id", "left_anti"), reset
