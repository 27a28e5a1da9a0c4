"""Cut a task table into numbered batches (P1) and render labeller input (P10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.columns import batch_label, fill_placeholders
from labelloom.model import BATCH_SIZE, PlanError
from labelloom.operators.index import dense_index


def batchify(tasks: DataFrame, order_cols: Sequence[str], batch_size: int = BATCH_SIZE,
             start_idx: int = 1) -> DataFrame:
    """Add ``pos`` (1..N) and ``batch_idx``: contiguous slices, the last may be short.

    Pass only the id and order columns of wide tasks; join the payload later.
    """
    if batch_size < 1:
        raise PlanError(f"batch_size must be positive, got {batch_size}")
    numbered = dense_index(tasks, order_cols, name="pos")
    return numbered.withColumn("batch_idx", slice_number(F.col("pos"), batch_size, start_idx))


def slice_number(pos: Column, batch_size: int, start_idx: int = 1) -> Column:
    """Which slice of ``batch_size`` a 1-based position falls in, in whole-number arithmetic."""
    return F.call_function("div", pos - 1, F.lit(batch_size)) + start_idx


def batch_table(batch_tasks: DataFrame, input_prefix: str = "stories") -> DataFrame:
    """One row per batch: ``batch_idx, story_id, input_file, n_tasks``."""
    number = F.format_string("%03d", F.col("batch_idx"))
    return batch_tasks.groupBy("batch_idx").agg(F.count(F.lit(1)).alias("n_tasks")).select(
        "batch_idx",
        batch_label(F.col("batch_idx")).alias("story_id"),
        F.concat(F.lit(f"{input_prefix}/batch-"), number, F.lit(".jsonl")).alias("input_file"),
        "n_tasks",
    )


def render_template(df: DataFrame, template: str, mapping: Mapping[str, str | Column],
                    name: str = "prompt") -> DataFrame:
    """Fill ``{{NAME}}`` placeholders per row; unknown placeholders stay."""
    columns = {k: F.col(v) if isinstance(v, str) else v for k, v in mapping.items()}
    return df.withColumn(name, fill_placeholders(template, columns))


def shard_prompt_columns(shard_root: Column) -> dict[str, Column]:
    """The placeholder set of a shard prompt, over :func:`shard_headers` rows."""
    # Placeholder names.
    return {
        "SHARD_ID": F.col("shard_id"),
        "SHARD_ROOT": shard_root,
        "BATCH_RANGE": F.col("batch_range"),
        "N_BATCHES": F.col("n_batches"),
        "N_TASKS": F.col("total_tasks"),
        "COMPLETE_THRESHOLD": F.col("n_batches"),
    }
