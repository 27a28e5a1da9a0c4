"""Move unfinished tasks from stopped shards to others."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.cluster import as_lookup
from labelloom.functions.columns import batch_label
from labelloom.model import BATCH_SIZE, REBALANCED_TIMEOUT_SECONDS, PlanError
from labelloom.operators.index import dense_index
from labelloom.operators.intake import first_by, pending
from labelloom.plans.batches import slice_number


def drain(members: DataFrame, verdicts: DataFrame, from_shards: Sequence[str]) -> DataFrame:
    """Members of the stopped shards without a verdict in their own shard."""
    stopped = F.col("shard_id").isin(list(from_shards))
    return pending(members.where(stopped), verdicts.where(stopped), ["shard_id", "task_id"])


def drain_counts(drained: DataFrame) -> DataFrame:
    return drained.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_drained"))


def _rank_of(shard: Column, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in order]), shard)


def pool(drained: DataFrame, shard_order: Sequence[str]) -> DataFrame:
    """Each drained task once: first by shard order, then batch, then line (R2)."""
    ranked = drained.select(
        "task_id", _rank_of(F.col("shard_id"), shard_order).alias("shard_rank"), "batch_idx", "pos", "shard_id")
    return first_by(ranked, ["task_id"], ["shard_rank", "batch_idx", "pos"])


def rebatch(pooled: DataFrame, targets: Sequence[str], batch_size: int = BATCH_SIZE) -> DataFrame:
    """Slice the pool and deal the slices round-robin to ``targets``.

    Adds ``slice`` (0-based over all targets), ``target`` and ``ordinal``
    (0-based within the target).
    """
    if not targets:
        raise PlanError("no target shards")
    k = len(targets)
    order = ["shard_rank", "batch_idx", "pos"]
    numbered = dense_index(pooled, order, name="pool_pos").withColumn("slice", slice_number(F.col("pool_pos"), batch_size, 0))
    names = F.array(*[F.lit(t) for t in targets])
    return (numbered.withColumn("target", F.element_at(names, (F.col("slice") % k + 1).cast("int")))
            .withColumn("ordinal", F.call_function("div", F.col("slice"), F.lit(k))))


def next_ids(plan: DataFrame, existing: DataFrame, scope: str = "global") -> DataFrame:
    """Give new slices batch numbers after the existing ones.

    ``global`` numbers over all shards and cannot clash; ``target`` continues
    each target's own numbers, which different shards may then share.
    ``existing`` holds ``shard_id, batch_idx``.
    """
    if scope == "global":
        top = existing.agg(F.coalesce(F.max("batch_idx"), F.lit(0))).first()[0]
        return plan.withColumn("new_batch_idx", F.col("slice") + (top + 1))
    if scope != "target":
        raise PlanError(f"scope is 'global' or 'target', got {scope!r}")
    tops = as_lookup(existing.groupBy(F.col("shard_id").alias("target")).agg(F.max("batch_idx").alias("_top")))
    return (plan.join(tops, "target", "left")
            .withColumn("new_batch_idx", F.coalesce("_top", F.lit(0)) + F.col("ordinal") + 1).drop("_top"))


def new_batches(plan: DataFrame) -> DataFrame:
    """One row per new batch: ``shard_id, batch_idx, story_id, n_tasks, ordinal``."""
    return plan.groupBy(F.col("target").alias("shard_id"), F.col("new_batch_idx").alias("batch_idx")).agg(
        F.count(F.lit(1)).alias("n_tasks"), F.min("ordinal").alias("ordinal"),
    ).withColumn("story_id", batch_label(F.col("batch_idx")))


def new_stories(added: DataFrame, stories: DataFrame, root_prefix: str = ".shard-") -> DataFrame:
    """Stories for new batches: priority after the shard's largest, in batch order."""
    tops = as_lookup(stories.groupBy("shard_id").agg(F.max("priority").alias("_top"), F.max("pos").alias("_last")))
    numbered = added.withColumn("_n", F.col("ordinal") + 1).join(tops, "shard_id", "left")
    root = F.concat(F.lit(root_prefix), F.col("shard_id"), F.lit("/"))
    # What this engine writes for a batch: its verdicts, those it refuses, and the story state.
    touched = ["accepted", "quarantine", "stories"]
    return numbered.select(
        "shard_id", "story_id", "batch_idx",
        F.format_string("%s: %d moved tasks", F.col("story_id"), F.col("n_tasks")).alias("title"),
        F.lit("data-fill").alias("story_type"),
        F.col("n_tasks").alias("entry_count"),
        F.array(*[F.concat(root, F.lit(t)) for t in touched]).alias("modifies"),
        F.array().cast("array<string>").alias("creates"),
        F.array(F.format_string("n_rows = %d", F.col("n_tasks")), F.lit("default gate")).alias("acceptance_criteria"),
        F.format_string("moved tasks, generation batch %d", F.col("batch_idx")).alias("notes"),
        (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("bigint").alias("pos"),
        (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("bigint").alias("priority"),
        F.lit(False).alias("passes"),
        F.lit(0).cast("bigint").alias("attempts"),
        F.lit(REBALANCED_TIMEOUT_SECONDS).cast("string").alias("timeout_text"),
    )


def append_plan(batches: DataFrame, stories: DataFrame, plan: DataFrame,
                root_prefix: str = ".shard-") -> Mapping[str, DataFrame]:
    """Grown plan tables: ``batches``, ``stories``, ``totals`` and one ``log`` row per target."""
    added = new_batches(plan)
    grown = batches.select("shard_id", "batch_idx", "story_id", "n_tasks").unionByName(
        added.select("shard_id", "batch_idx", "story_id", "n_tasks"))
    all_stories = stories.unionByName(new_stories(added, stories, root_prefix), allowMissingColumns=True)
    totals = grown.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("n_tasks").alias("total_tasks"))
    log = added.groupBy("shard_id").agg(
        F.min("batch_idx").alias("first_batch"), F.max("batch_idx").alias("last_batch"),
        F.count(F.lit(1)).alias("added_batches"), F.sum("n_tasks").alias("added_tasks"),
    ).withColumn("ts", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                                     "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return {"batches": grown, "stories": all_stories, "totals": totals, "log": log}


def first_assignments(members: DataFrame) -> DataFrame:
    """Assignments ``task_id, shard_id, batch_idx, pos, generation, active`` of a fresh plan."""
    return members.select("task_id", "shard_id", "batch_idx", "pos", F.lit(0).cast("bigint").alias("generation"),
                          F.lit(True).alias("active"))


def reassign(assignments: DataFrame, drained: DataFrame, plan: DataFrame, generation: int) -> DataFrame:
    """Close the drained rows and add the planned ones as a new generation.

    Finished tasks stay with their shard. Audits use :func:`active_members`, so
    a moved task counts once; a merge takes the verdicts of all generations.
    """
    keys = ["shard_id", "task_id"]
    moved = drained.select(*keys).distinct().withColumn("_moved", F.lit(True))
    kept = assignments.join(moved, keys, "left").select(
        "task_id", "shard_id", "batch_idx", "pos", "generation", (F.col("active") & F.col("_moved").isNull()).alias("active"))
    added = plan.select(
        "task_id", F.col("target").alias("shard_id"), F.col("new_batch_idx").alias("batch_idx"),
        F.col("pool_pos").alias("pos"), F.lit(generation).cast("bigint").alias("generation"), F.lit(True).alias("active"))
    return kept.unionByName(added)


def active_members(assignments: DataFrame) -> DataFrame:
    return assignments.where("active").select("shard_id", "batch_idx", "task_id", "pos")


def check_rebalance(from_shards: Sequence[str], keep_shards: Sequence[str], target: str = "keep") -> None:
    """Refuse shard lists that clash or a keep target without shards."""
    both = sorted(set(from_shards) & set(keep_shards))
    if target not in ("keep", "baseline"):
        raise PlanError(f"target is 'keep' or 'baseline', got {target!r}")
    if target == "keep" and not keep_shards:
        raise PlanError("target 'keep' needs the shards to keep")
    if both:
        raise PlanError(f"shards both drained and kept: {both}")


def collisions(added: DataFrame, existing: DataFrame, scope: str = "global") -> DataFrame:
    """New batches whose number already exists (R6); must be empty."""
    keys = ["batch_idx"] if scope == "global" else ["shard_id", "batch_idx"]
    return added.join(existing.select(*keys).distinct(), keys, "left_semi")
