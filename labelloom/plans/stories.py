"""Story tables of shards: rebase (P7) and refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.columns import swap_prefix
from labelloom.operators.index import dense_index


def rebase_stories(stories: DataFrame, assignments: DataFrame, old_prefix: str = ".baseline/",
                   root_prefix: str = ".shard-") -> DataFrame:
    """Move stories to their shards: priorities 1..k by old priority, state reset, paths re-rooted.

    ``assignments`` holds ``story_id, shard_id``. Ties keep list order (``pos``).
    """
    moved = stories.drop("shard_id").join(assignments.select("story_id", "shard_id"), "story_id")
    ranked = dense_index(moved.withColumnRenamed("priority", "old_priority"),
                         ["old_priority", "pos"], ["shard_id"], "priority")
    new_root = F.concat(F.lit(root_prefix), F.col("shard_id"), F.lit("/"))
    paths = F.transform(F.coalesce("modifies", F.array().cast("array<string>")),
                        lambda p: swap_prefix(p, old_prefix, new_root))
    return (ranked.withColumn("modifies", paths)
            .withColumn("passes", F.lit(False))
            .withColumn("attempts", F.lit(0).cast("bigint"))
            .drop("old_priority"))


def story_headers(heads: DataFrame, project: str, branch: str, description: str = "") -> DataFrame:
    """Document fields of every shard's story list, over :func:`shard_headers` rows."""
    span = F.concat(F.lit("shard "), F.col("shard_id"), F.lit(" ("), F.col("batch_range"), F.lit(")"))
    return heads.select(
        "shard_id", F.concat(F.lit(f"{project}-shard-"), F.col("shard_id")).alias("project"), F.lit(branch).alias("branch"),
        (F.concat(F.lit(f"{description} · "), span) if description else span).alias("description"))


def refresh_stories(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Re-planned stories keep ``passes`` and ``attempts`` of those already known."""
    known = existing.select("shard_id", "story_id", F.col("passes").alias("_passes"),
                            F.col("attempts").alias("_attempts"))
    return (new.drop("passes", "attempts").join(known, ["shard_id", "story_id"], "left")
            .withColumn("passes", F.coalesce("_passes", F.lit(False)))
            .withColumn("attempts", F.coalesce("_attempts", F.lit(0).cast("bigint")))
            .drop("_passes", "_attempts"))
