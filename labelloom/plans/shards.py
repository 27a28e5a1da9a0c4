"""Give batches to shards (P2, P3), check ranges (P4) and describe shards."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.functions.columns import batch_label, range_label, shard_name, shard_name_of
from labelloom.model import PlanError, ShardRange
from labelloom.operators.index import dense_index
from labelloom.operators.report import check_rows

# Ranges and batches meet by blocks of so many batch numbers.
RANGE_BLOCK = 65_536


def even_ranges(total_batches: int, n_shards: int, wide: bool = False) -> list[ShardRange]:
    """Even ranges; the last shard takes the remainder."""
    base = total_batches // n_shards
    if base == 0:
        raise PlanError(f"{n_shards} shards for only {total_batches} batches")
    last = n_shards - 1
    return [
        ShardRange(shard_name(i, wide), i * base + 1, total_batches if i == last else (i + 1) * base)
        for i in range(n_shards)
    ]


def named_ranges(splits: Sequence[tuple[int, int]], n_shards: int | None = None,
                 wide: bool = False) -> list[ShardRange]:
    if n_shards is not None and n_shards != len(splits):
        raise PlanError(f"{n_shards} shards but {len(splits)} ranges")
    return [ShardRange(shard_name(i, wide), lo, hi) for i, (lo, hi) in enumerate(splits)]


def parse_splits(text: str) -> list[tuple[int, int]]:
    """Read ``"1-13,14-26"``, a JSON list of pairs, or ``{"splits": [...]}``."""
    body = text.strip()
    if body[:1] in "[{" and body:
        doc = json.loads(body)
        pairs = doc.get("splits") if isinstance(doc, dict) else doc
        if not isinstance(pairs, list) or any(not isinstance(p, list) or len(p) != 2 for p in pairs):
            raise PlanError("splits must be a list of [start, end] pairs")
        return [(int(lo), int(hi)) for lo, hi in pairs]
    out = []
    for part in body.split(","):
        lo, dash, hi = part.strip().partition("-")
        if not (dash and lo.strip().isdigit() and hi.strip().isdigit()):
            raise PlanError(f"a range looks like 'A-B' with whole numbers, got {part.strip()!r}")
        if int(lo) > int(hi):
            raise PlanError(f"range starts after its end: {part.strip()!r}")
        out.append((int(lo), int(hi)))
    return out


def auto_split(batches: DataFrame, n_shards: int, wide: bool = False, total: int | None = None) -> DataFrame:
    """Add ``shard_id`` to rows with a ``batch_idx`` of 1..N in closed form: no join, no shuffle.

    Works on batches and, with the same ``total``, on their tasks.
    """
    if total is None:
        total = batches.agg(F.max("batch_idx")).first()[0] or 0
    base = even_ranges(total, n_shards, wide)[0].hi
    ordinal = F.least(
        F.call_function("div", F.col("batch_idx") - 1, F.lit(base)), F.lit(n_shards - 1).cast("bigint")
    )
    return batches.withColumn("shard_id", shard_name_of(ordinal))


def range_table(spark: SparkSession, ranges: Sequence[ShardRange]) -> DataFrame:
    rows = [(i, r.shard_id, r.lo, r.hi) for i, r in enumerate(ranges)]
    return spark.createDataFrame(rows, "ordinal bigint, shard_id string, lo bigint, hi bigint")


def assign_ranges(batches: DataFrame, ranges: DataFrame) -> DataFrame:
    """Give each batch the shard whose inclusive range holds it; batches in no range drop out.

    Ranges expand to blocks of batch numbers and join by equality, so that neither a
    nested loop, an array as long as a range, nor a broadcast of unknown size is needed.
    """
    def block(number) -> Column:
        return F.call_function("div", F.col(number), F.lit(RANGE_BLOCK))

    pieces = ranges.select("shard_id", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                           F.explode(F.sequence(block("lo"), block("hi"))).alias("_block"))
    return batches.withColumn("_block", block("batch_idx")).join(pieces, "_block").where(
        F.col("batch_idx").between(F.col("_lo"), F.col("_hi"))).select(*batches.columns, "shard_id")


def check_assignment(assigned: DataFrame, ranges: DataFrame) -> DataFrame:
    """Batches found per shard against the size of its range; a shortfall means absent batches."""
    found = assigned.groupBy("shard_id").agg(F.count(F.lit(1)).alias("actual"))
    rows = ranges.select("shard_id", (F.col("hi") - F.col("lo") + 1).alias("expected")).join(found, "shard_id", "left")
    actual = F.coalesce("actual", F.lit(0)).cast("bigint")
    return rows.select("shard_id", "expected", actual.alias("actual"), (actual == F.col("expected")).alias("passed"))


def _with_cursor(ranges: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """``ranges`` with ``cursor``, the largest end among the ranges before (0 for the first).

    A scan in two levels: rows are scanned inside blocks of ordinals, and blocks by one summary row each.
    Only the rows' way to their blocks is a shuffle of rows, and no window is longer than a block.
    """
    block = F.call_function("div", F.col("ordinal"), F.lit(RANGE_BLOCK))
    dealt = ranges.withColumn("_block", block)
    within = Window.partitionBy(*group_cols, "_block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group_cols).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = dealt.groupBy(*group_cols, "_block").agg(F.max("hi").alias("_top"))
    carried = tops.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group_cols)], F.col("_block").alias("_b"),
                          F.max("_top").over(before).alias("_carry"))
    same = F.col("_block") == F.col("_b")
    for k, g in enumerate(group_cols):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    inside = dealt.withColumn("_inside", F.max("hi").over(within))
    cursor = F.coalesce(F.greatest("_inside", "_carry"), F.lit(0))
    return inside.join(carried, same).select(*ranges.columns, cursor.alias("cursor"))


def check_ranges(ranges: DataFrame, total: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Problems of split sets, one row each: ``kind, ordinal, lo, hi, missing_lo, missing_hi``.

    ``out_of_range`` leaves 1..total, ``inverted`` starts after its end,
    ``overlap`` starts at or before the end of an earlier range, ``gap`` lists
    batch numbers no range holds, in front, between or (ordinal NULL) behind.
    """
    seen = _with_cursor(ranges, group_cols)
    lo, hi, cursor = F.col("lo"), F.col("hi"), F.col("cursor")
    gap = F.struct(F.lit("gap").alias("kind"), (cursor + 1).alias("missing_lo"), (lo - 1).alias("missing_hi"))

    def plain(kind: str):
        none = F.lit(None).cast("bigint")
        return F.struct(F.lit(kind).alias("kind"), none.alias("missing_lo"), none.alias("missing_hi"))

    problems = F.filter(
        F.array(
            F.when((lo < 1) | (hi > F.col(total)), plain("out_of_range")),
            F.when(lo > hi, plain("inverted")),
            F.when(lo <= cursor, plain("overlap")),
            F.when(lo > cursor + 1, gap),
        ),
        lambda p: p.isNotNull(),
    )
    per_range = seen.select(*group_cols, "ordinal", "lo", "hi", F.explode(problems).alias("p"))
    none = F.lit(None).cast("bigint")
    tails = (
        ranges.groupBy(*group_cols).agg(F.max("hi").alias("top"), F.max(total).alias("total"))
        .where(F.col("top") < F.col("total"))
        .select(*group_cols, none.alias("ordinal"), none.alias("lo"), none.alias("hi"),
                F.lit("gap").alias("kind"), (F.col("top") + 1).alias("missing_lo"), F.col("total").alias("missing_hi"))
    )
    return per_range.select(*group_cols, "ordinal", "lo", "hi", "p.*").unionByName(tails)


def assert_ranges(spark: SparkSession, ranges: Sequence[ShardRange], total: int) -> None:
    """Raise when a driver-side split list does not cut 1..total exactly."""
    if not ranges:
        raise PlanError("no ranges")
    bad = check_ranges(range_table(spark, ranges).withColumn("total", F.lit(total)), "total").collect()  # a driver-side list
    if bad:
        raise PlanError("; ".join(f"{r.kind} at range {r.ordinal} ({r.lo}..{r.hi})" for r in bad))


def shard_headers(assigned: DataFrame) -> DataFrame:
    """One row per shard: ``shard_id, batch_range, n_batches, total_tasks``."""
    return assigned.groupBy("shard_id").agg(
        range_label(F.min("batch_idx"), F.max("batch_idx")).alias("batch_range"),
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("n_tasks").alias("total_tasks"),
    )


def shard_batches(assigned: DataFrame, root_prefix: str = ".shard-") -> DataFrame:
    """The ordered batch list of every shard as rows (``seq`` 1..k), re-rooted.

    Rows instead of one array per shard: a shard may hold millions of batches.
    """
    number = F.format_string("%03d", F.col("batch_idx"))
    file = F.concat(F.lit(root_prefix), F.col("shard_id"), F.lit("/stories/batch-"), number, F.lit(".jsonl"))
    slim = assigned.select("shard_id", "batch_idx", "n_tasks")
    return dense_index(slim, ["batch_idx"], ["shard_id"], "seq").select(
        "shard_id", "seq", "batch_idx", batch_label(F.col("batch_idx")).alias("story_id"),
        file.alias("input_file"), "n_tasks",
    )


def shard_manifest(assigned: DataFrame, header: DataFrame | None = None,
                   root_prefix: str = ".shard-") -> tuple[DataFrame, DataFrame]:
    """Header rows (baseline fields carried over) and ordered batch rows of all shards."""
    heads = shard_headers(assigned).withColumn("shard_root", F.concat(F.lit(root_prefix), F.col("shard_id")))
    if header is not None:
        carried = header.select(*[c for c in ("source", "schema_version", "batch_size") if c in header.columns])
        for field, value in carried.first().asDict().items():
            heads = heads.withColumn(field, F.lit(value))
    return heads, shard_batches(assigned, root_prefix)


def check_plan(header: DataFrame, batches: DataFrame, heads: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Readiness and conservation of a plan as audit rows (layer ``plan``).

    ``header`` is the one-row baseline header with ``n_batches, total_tasks``.
    """
    floor = 0 if allow_empty else 1
    number = "bigint"
    facts = [
        header.select(F.col("n_batches").cast(number), F.col("total_tasks").cast(number)),
        batches.agg(F.count(F.lit(1)).cast(number).alias("n_rows")),
        heads.agg(F.sum("total_tasks").cast(number).alias("n_planned")),
    ]
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), facts)
    one = stacked.agg(*[F.max(c).alias(c) for c in ("n_batches", "total_tasks", "n_rows", "n_planned")])

    def check(subject: str, ok, detail):
        return F.struct(F.lit(subject).alias("subject"), F.coalesce(ok, F.lit(False)).alias("passed"),
                        detail.alias("detail"))

    text = F.format_string
    checks = F.array(
        check("n_batches positive", F.col("n_batches") >= floor, text("n_batches=%d", F.col("n_batches"))),
        check("total_tasks positive", F.col("total_tasks") >= floor, text("total_tasks=%d", F.col("total_tasks"))),
        check("n_batches matches batch rows", F.col("n_batches") == F.col("n_rows"),
              text("declared %d, rows %d", F.col("n_batches"), F.col("n_rows"))),
        check("shard totals add up", F.col("total_tasks") == F.col("n_planned"),
              text("baseline %d, shards %d", F.col("total_tasks"), F.col("n_planned"))),
    )
    rows = one.select(F.explode(checks).alias("c")).select("c.*")
    return check_rows(rows, "plan", n_bad=F.when(F.col("passed"), 0).otherwise(1))
