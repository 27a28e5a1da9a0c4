"""Progress and log analytics over all shards at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.columns import true, with_chars
from labelloom.model import SAMPLE_SIZE, TAIL_LINES, VerdictSchema
from labelloom.operators.index import dense_index

# Patterns that decide results.
ERROR_PATTERN = "429|rate_limit_exceeded|overloaded_error"
LIMIT_PATTERN = "(?i)(You've hit your limit|rate[ _-]?limit|429)"
DIRTY_PHRASE = "working tree is dirty"
BAR_WIDTH = 20

# Ordered causes: the first rule with a matching line wins.
CAUSE_RULES: tuple[tuple[str, str], ...] = (
    ("dirty_tree", "(?:" + DIRTY_PHRASE + ")"),
    ("rate_limit", LIMIT_PATTERN),
)


def progress(stories: DataFrame) -> DataFrame:
    """Done, total and pending stories per shard (D1); the ids are in :func:`pending_stories`."""
    return stories.groupBy("shard_id").agg(
        F.count_if(true(F.col("passes"))).alias("done"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(~true(F.col("passes"))).alias("n_pending"),
    )


def pending_stories(stories: DataFrame) -> DataFrame:
    """Pending story ids per shard in list order, as rows with ``seq`` 1..k.

    Rows instead of one list per shard, because a shard may have millions.
    """
    open_ones = stories.where(~true(F.col("passes"))).select("shard_id", "pos", "story_id")
    return dense_index(open_ones, ["pos"], ["shard_id"], "seq").select("shard_id", "seq", "story_id")


def error_counts(logs: DataFrame, pattern: str = ERROR_PATTERN) -> DataFrame:
    """Lines (not matches) per shard that show the pattern (D3)."""
    return logs.groupBy("shard_id").agg(F.count_if(F.col("line").rlike(pattern)).alias("n_errors"))


def tail_n(df: DataFrame, group_cols: Sequence[str], order_col: str, n: int = TAIL_LINES) -> DataFrame:
    """Last ``n`` rows per group with their order ``rn`` (1 = oldest kept).

    A group gathers ``n`` rows per input partition at most, whatever ``n`` is: Spark cuts each
    partition's rows to ``n`` below the shuffle up to its own threshold, beyond that a rank
    per partition does.
    """
    newest = Window.partitionBy(*group_cols).orderBy(F.col(order_col).desc())
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        part = Window.partitionBy(*group_cols, "_part").orderBy(F.col(order_col).desc())
        df = (df.withColumn("_part", F.spark_partition_id())
              .withColumn("_back", F.row_number().over(part)).where(F.col("_back") <= n).drop("_part", "_back"))
    kept = df.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= n)
    oldest = Window.partitionBy(*group_cols).orderBy(F.col("_back").desc())
    return kept.withColumn("rn", F.row_number().over(oldest).cast("bigint")).drop("_back")


def recent_mean_len(verdicts: DataFrame, order_col: str = "seq", n: int = SAMPLE_SIZE,
                    schema: VerdictSchema = VerdictSchema()) -> DataFrame:
    """Mean length of the last ``n`` text reasons per shard, cut to a whole number."""
    chars = schema.chars_field
    lengths = with_chars(verdicts, schema).select("shard_id", order_col, chars).where(F.col(chars).isNotNull())
    recent = tail_n(lengths, ["shard_id"], order_col, n)
    return recent.groupBy("shard_id").agg(F.floor(F.avg(chars)).cast("bigint").alias("mean_len"))


def bar(done: Column, total: Column, width: int = BAR_WIDTH) -> Column:
    filled = F.call_function("div", done * width, F.greatest(total, F.lit(1).cast("bigint")))
    return F.concat(F.lit("["), F.rpad(F.repeat(F.lit("#"), filled.cast("int")), width, "."), F.lit("]"))


def dashboard(stories: DataFrame, logs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Progress, error lines, recent mean and bar per shard, and a TOTAL row."""
    rows = (progress(stories).join(error_counts(logs), "shard_id", "left")
            .join(recent_mean_len(verdicts), "shard_id", "left"))
    total = F.grouping("shard_id") == 1
    return rows.rollup("shard_id").agg(
        F.sum("done").alias("done"), F.sum("total").alias("total"),
        F.coalesce(F.sum("n_errors"), F.lit(0)).cast("bigint").alias("n_errors"),
        F.when(total, None).otherwise(F.max("mean_len")).alias("mean_len"),
        F.when(total, "TOTAL").otherwise(F.col("shard_id")).alias("shard"),
    ).select("shard", "done", "total", "n_errors", "mean_len", bar(F.col("done"), F.col("total")).alias("bar"))


def classify(tails: DataFrame, rules: Sequence[tuple[str, str]] = CAUSE_RULES) -> DataFrame:
    """Cause per shard from its log tails: first rule with any matching line, else ``other``."""
    hits = tails.groupBy("shard_id").agg(
        *[F.bool_or(F.col("line").rlike(p)).alias(f"_{i}") for i, (_, p) in enumerate(rules)])
    cause = F.lit("other")
    for i, (name, _) in reversed(list(enumerate(rules))):
        cause = F.when(true(F.col(f"_{i}")), name).otherwise(cause)
    return hits.select("shard_id", cause.alias("cause"))


# Alert per cause.
CAUSE_ALERTS = {"dirty_tree": "DIRTY_INPUT", "rate_limit": "RATE_LIMITED"}


def health_alerts(progress_rows: DataFrame, alive: DataFrame, causes: DataFrame,
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """Alert class per shard and, as ``shard_id = NULL`` rows, per sweep.

    ``group_cols`` (for instance a sweep number) keep several sweeps apart.
    """
    keys = [*group_cols, "shard_id"]
    rows = progress_rows.join(alive, keys, "left").join(causes, keys, "left")
    living, complete = true(F.col("alive")), F.col("done") == F.col("total")
    by_cause = F.lit("UNKNOWN")
    for cause, name in CAUSE_ALERTS.items():
        by_cause = F.when(F.col("cause") == cause, name).otherwise(by_cause)
    alert = F.when(complete, "COMPLETE").when(living, "RUNNING").otherwise(by_cause)
    per_shard = rows.select(*keys, alert.alias("alert"))
    sweep = rows.groupBy(*group_cols).agg(F.bool_and(complete).alias("_all"), F.bool_or(living).alias("_any"))
    level = F.when(F.col("_all"), "READY_TO_MERGE").when(~true(F.col("_any")), "ALL_DEAD")
    flags = sweep.select(*group_cols, F.lit(None).cast("string").alias("shard_id"), level.alias("alert")).where(
        F.col("alert").isNotNull())
    return per_shard.unionByName(flags)


def unexpected_paths(paths: DataFrame, allow: DataFrame, ignore_prefix: str = ".shard-") -> DataFrame:
    """Changed paths outside the ignored prefix and the allow-list."""
    return paths.where(~F.startswith("path", F.lit(ignore_prefix))).join(
        allow.select("path").distinct(), "path", "left_anti")


def status_json(progress_rows: DataFrame, alive: DataFrame, iteration: int, ts: Column, tz: str = "UTC") -> DataFrame:
    """Status snapshot as one JSON text per shard, time shown in ``tz``.

    Pending ids stay rows (:func:`pending_stories`); the text carries their number.
    """
    rows = progress_rows.join(alive, "shard_id", "left")
    shown = F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM-dd HH:mm:ss")
    body = F.struct(
        shown.alias("ts"), F.lit(iteration).alias("iteration"), F.col("shard_id").alias("shard"),
        true(F.col("alive")).alias("alive"), "done", "total", "n_pending")
    return rows.select("shard_id", F.to_json(body).alias("status"))
