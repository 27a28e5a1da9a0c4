"""Control-state analytics over tables of many stories and iterations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.cluster import as_lookup
from labelloom.functions.columns import strip, true
from labelloom.model import DEFAULT_TIMEOUT_SECONDS, MAX_RETRIES, TRIPPED_PRIORITY

# Promise tokens in labeller output.
COMPLETE_TOKEN = "<promise>COMPLETE</promise>"
YIELD_TOKEN = "<promise>YIELD</promise>"
VIOLATION_PATTERN = "<promise>VIOLATION</promise>|VIOLATION: "


def next_story(stories: DataFrame, group_cols: Sequence[str] = ("shard_id",)) -> DataFrame:
    """Pending story with the least priority per group, ties by list order; else ``ALL_DONE`` (L1)."""
    best = F.min(F.when(~true(F.col("passes")), F.struct("priority", "pos", "story_id")))
    return stories.groupBy(*group_cols).agg(F.coalesce(best["story_id"], F.lit("ALL_DONE")).alias("next_story"))


def counter(text: Column) -> Column:
    """Whole number from counter text; anything else counts as 0."""
    return F.when(text.rlike("^[0-9]+$"), F.coalesce(text.try_cast("bigint"), F.lit(0))).otherwise(0)


def circuit_break(stories: DataFrame, attempts: DataFrame, max_retries: int = MAX_RETRIES,
                  picked: DataFrame | None = None) -> DataFrame:
    """Count one more attempt and push stories over the limit to the end (L2).

    ``attempts`` holds ``shard_id, story_id, counter_text``. Adds ``attempt``
    and ``tripped``. With ``picked`` (``shard_id, story_id``) only those stories
    are attempted now; the others keep their count and priority.
    """
    keys = ["shard_id", "story_id"]
    counted = stories.join(attempts, keys, "left").withColumn("_now", F.lit(True))
    if picked is not None:
        now = picked.select(*keys).distinct().withColumn("_now", F.lit(True))
        counted = counted.drop("_now").join(now, keys, "left").withColumn("_now", true(F.col("_now")))
    attempt = F.coalesce(counter(F.col("counter_text")), F.lit(0)) + F.col("_now").cast("int")
    tripped = F.col("_now") & (F.col("attempt") > max_retries)
    return (counted.withColumn("attempt", attempt.cast("bigint")).withColumn("tripped", tripped)
            .withColumn("priority", F.when(F.col("tripped"), TRIPPED_PRIORITY).otherwise(F.col("priority")).cast("bigint"))
            .drop("counter_text", "_now"))


def reset_pending(stories: DataFrame, retries: DataFrame, alive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recovery of shards without a live process (L3).

    Pending stories get their list position as priority and lose their retry
    counters. Returns stories and the remaining retries. ``pos`` is the
    1-based position in the shard's list.
    """
    marked = stories.join(alive.select("shard_id", "alive"), "shard_id", "left")
    reset = ~true(F.col("passes")) & ~true(F.col("alive"))
    stories_out = marked.withColumn("priority", F.when(reset, F.col("pos")).otherwise(F.col("priority")))
    cleared = marked.where(reset).select("shard_id", "story_id")
    return stories_out.drop("alive"), retries.join(cleared, ["shard_id", "story_id"], "left_anti")


def changes(before: DataFrame, after: DataFrame, locks: DataFrame, detect_deleted: bool = False) -> DataFrame:
    """Stories of every iteration with both values, the lock and whether they changed."""
    keys = ["iteration", "story_id"]
    old = before.select(*keys, F.col("passes").alias("before"), F.lit(True).alias("_known"))
    new = after.select(*keys, F.col("passes").alias("after"), F.lit(True).alias("_kept"))
    both = new.join(old, keys, "full" if detect_deleted else "left").join(
        locks.select("iteration", "locked_id"), "iteration", "left")
    changed = F.col("_known").isNull() | F.col("_kept").isNull() | ~F.col("before").eqNullSafe(F.col("after"))
    return both.select(*keys, "before", "after", "locked_id", changed.alias("changed"),
                       (F.col("story_id") == F.col("locked_id")).alias("is_locked"))


def snapshot_diff(before: DataFrame, after: DataFrame, locks: DataFrame, detect_deleted: bool = False) -> DataFrame:
    """Verdict per iteration on which stories moved (L4).

    ``NO_CHANGE``; ``OK`` or ``OK_NO_PASS`` when only the locked story moved to
    true or false; else ``VIOLATION``. The moved stories are rows of :func:`changes`.
    """
    rows = changes(before, after, locks, detect_deleted)
    locked = F.col("changed") & true(F.col("is_locked"))
    per = rows.groupBy("iteration").agg(
        F.count_if("changed").alias("n_changed"),
        F.count_if(locked).alias("n_locked"),
        F.bool_or(F.when(locked, true(F.col("after")))).alias("_now"))
    only_locked = (F.col("n_changed") == 1) & (F.col("n_locked") == 1)
    result = (
        F.when(F.col("n_changed") == 0, "NO_CHANGE")
        .when(only_locked & F.col("_now"), "OK")
        .when(only_locked, "OK_NO_PASS")
        .otherwise("VIOLATION"))
    return per.select("iteration", "n_changed", result.alias("result"))


def heal(before: DataFrame, after: DataFrame, locks: DataFrame) -> DataFrame:
    """Non-locked stories go back to their earlier value, unknown ones to false."""
    rows = changes(before, after, locks)
    restored = F.when(true(F.col("is_locked")), F.col("after")).otherwise(F.coalesce("before", F.lit(False)))
    return rows.select("iteration", "story_id", restored.alias("passes"),
                       (~restored.eqNullSafe(F.col("after"))).alias("healed"))


def claims(outputs: DataFrame, stories: DataFrame) -> DataFrame:
    """Token per output; ``COMPLETE`` is believed only when its shard has nothing pending."""
    text = F.col("output")
    token = (
        F.when(F.contains(text, F.lit(COMPLETE_TOKEN)), "COMPLETE")
        .when(F.contains(text, F.lit(YIELD_TOKEN)), "YIELD")
        .when(text.rlike(VIOLATION_PATTERN), "VIOLATION"))
    left = stories.groupBy("shard_id").agg(F.count_if(~true(F.col("passes"))).alias("n_pending"))
    rows = outputs.withColumn("token", token).join(as_lookup(left), "shard_id", "left")
    believed = F.when(F.col("token") == "COMPLETE", F.coalesce("n_pending", F.lit(0)) == 0).otherwise(
        F.col("token").isNotNull())
    return rows.withColumn("believed", believed).drop("n_pending")


def summary_rows(stories: DataFrame) -> DataFrame:
    """PASS or TODO per story."""
    return stories.select("shard_id", "story_id", F.when(true(F.col("passes")), "PASS").otherwise("TODO").alias("status"))


def summary(stories: DataFrame) -> DataFrame:
    """Passed, total and percent, halves rounded to even; no stories give 0 percent."""
    counted = stories.agg(F.count_if(true(F.col("passes"))).alias("passed"), F.count(F.lit(1)).alias("total"))
    percent = F.coalesce(F.try_divide(F.col("passed") * F.lit(100.0), F.col("total")), F.lit(0.0))
    return counted.select("passed", "total", F.bround(percent, 0).cast("bigint").alias("percent"))


def run_outcomes(runs: DataFrame, stories: DataFrame, default: int = DEFAULT_TIMEOUT_SECONDS) -> DataFrame:
    """Outcome per run against its story's time limit.

    A limit that is not a positive whole number means ``default``. Adds
    ``limit_seconds, outcome, code`` (124 for a time-out).
    """
    # A story id may stand in several shards; runs that name their shard are matched on both.
    keys = [c for c in ("shard_id", "story_id") if c in runs.columns and c in stories.columns]
    limits = stories.select(*keys, F.when(strip(F.col("timeout_text")).rlike("^[0-9]+$"),
                                               strip(F.col("timeout_text")).try_cast("bigint")).alias("_limit"))
    rows = runs.join(limits, keys, "left")
    limit = F.when(F.col("_limit") > 0, F.col("_limit")).otherwise(default)
    over, error = F.col("seconds") > limit, F.col("exit_code") != 0
    return (rows.withColumn("limit_seconds", limit.cast("bigint"))
            .withColumn("outcome", F.when(over, "TIMEOUT").when(error, "ERROR").otherwise("OK"))
            .withColumn("code", F.when(over, 124).otherwise(F.col("exit_code")).cast("bigint"))
            .drop("_limit"))
