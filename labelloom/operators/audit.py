"""Set audits of a shard plan.

Every audit first collapses to one row per (key, ...) with additive flags, so
map-side combine removes repeats of a hot id before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from labelloom.cluster import as_lookup, materialize
from labelloom.functions.columns import fingerprint_aggs, true
from labelloom.model import EXAMPLES
from labelloom.operators.pair_tiles import BOTH, HIGH, LOW, counted_pairs, is_plain
from labelloom.operators.report import check_rows, union_reports

# Shard names in one block of a report over all pairs.
PAIR_BLOCK = 1_024

# Pairs of shards that share ids: up to so many are shuffled, beyond them a task has about so many, and
# about so many names of shards at most. A task that deals the sets out has about so many names.
SHUFFLED_PAIRS = 20_000_000
TILE_PAIRS = 32_000_000
TILE_NAMES = 2_000_000
DEALT_NAMES = 100_000


def two_sided(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which keys occur on which side: ``keys, in_left, in_right`` in one shuffle."""
    tagged = left.select(*keys, F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(
        right.select(*keys, F.lit(False).alias("l"), F.lit(True).alias("r")))
    return tagged.groupBy(*keys).agg(F.bool_or("l").alias("in_left"), F.bool_or("r").alias("in_right"))


def audit_counts(members: DataFrame, declared: DataFrame) -> DataFrame:
    """Distinct ids per shard against the declared ``total_tasks`` (A1)."""
    return against_declared(members.groupBy("shard_id").agg(F.count_distinct("task_id").alias("actual")), declared)


def against_declared(actual: DataFrame, declared: DataFrame) -> DataFrame:
    """``shard_id, actual`` beside the declared ``total_tasks``; shards of either side are kept."""
    theirs = declared.select(F.col("shard_id").alias("_shard"), F.lit(True).alias("_listed"), F.col("total_tasks").alias("declared"))
    both = actual.join(theirs, F.col("shard_id").eqNullSafe(F.col("_shard")), "full")
    return both.select(
        F.when(true(F.col("_listed")), F.col("_shard")).otherwise(F.col("shard_id")).alias("shard_id"),
        F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual"),
        F.col("declared").cast("bigint").alias("declared"),
        true(F.coalesce("actual", F.lit(0)) == F.col("declared")).alias("passed"),
    )


def repeats(df: DataFrame, group_cols: Sequence[str], key_cols: Sequence[str],
            n_examples: int = EXAMPLES) -> DataFrame:
    """Surplus rows per group and its smallest repeated keys; groups without repeats are absent."""
    per_key = df.groupBy(*group_cols, *key_cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = per_key.groupBy(*group_cols).agg(
        F.sum(F.col("n") - 1).alias("n_surplus"), F.count(F.lit(1)).alias("n_keys"))
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in key_cols])
    # A rank filter keeps a few rows per group and map task before the shuffle.
    smallest = Window.partitionBy(*group_cols).orderBy(*key_cols)
    examples = (per_key.withColumn("_rank", F.row_number().over(smallest)).where(F.col("_rank") <= n_examples)
                .groupBy(*group_cols)
                .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", text.alias("t")))),
                                              lambda x: x["t"]), ",").alias("examples")))
    return counted.join(examples, list(group_cols))


def audit_internal_dups(members: DataFrame, n_examples: int = EXAMPLES) -> DataFrame:
    """Repeated membership inside a shard: surplus count and first ids (A2)."""
    return repeats(members, ["shard_id"], ["task_id"], n_examples).select(
        "shard_id", F.col("n_surplus").alias("n_dups"), "examples")


def audit_disjoint(members: DataFrame, shards: DataFrame | None = None, every: bool = False) -> DataFrame:
    """Overlap size and smallest shared id of the shard pairs that overlap (A3).

    ``every`` also reports the pairs without a shared id, of the ``shards`` given or those
    that occur; that report is quadratic in the number of shards.
    """
    listed = (members if shards is None else shards).select("shard_id").distinct()
    return pair_overlaps(membership_sets(members), listed if every else None)


def membership_sets(members: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Count ids by where they occur: ``s, in_base, repeated, n, n_surplus, example``.

    One shuffle by id, for any number of shards. Per id the set of its shards combines before
    the shuffle; ids with equal sets then fall together, so the result has as many rows as
    there are different sets ``s``. A NULL shard is a shard.
    """
    rows = members.select("task_id", F.struct("shard_id").alias("_m"), F.lit(False).alias("_base"))
    if baseline is not None:
        none = F.lit(None).cast(rows.schema["_m"].dataType)
        rows = rows.unionByName(baseline.select("task_id", none.alias("_m"), F.lit(True).alias("_base")))
    per_id = rows.groupBy("task_id").agg(
        F.sort_array(F.collect_set("_m")).alias("_set"), F.bool_or("_base").alias("in_base"), F.count("_m").alias("_rows"))
    surplus = F.col("_rows") - F.size("_set")
    return per_id.groupBy("_set", "in_base", (surplus > 0).alias("repeated")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(surplus).alias("n_surplus"), F.min("task_id").alias("example")).select(
        F.col("_set.shard_id").alias("s"), "in_base", "repeated", "n", "n_surplus", "example")


def pair_overlaps(sets: DataFrame, listed: DataFrame | None) -> DataFrame:
    """Expand pairs from the distinct shard sets ``s, n, example``, not per id; ``listed`` adds empty pairs.

    Pairs are counted before they are made. A few are shuffled; many are made and added up within tiles,
    so that what is shuffled is the sets, once for each block of shards they have, and never a pair.
    """
    several = materialize(sets.where(F.size("s") > 1).select("s", "n", "example", F.monotonically_increasing_id().alias("_set")), "sets")
    size = F.size("s").cast("bigint")
    total, names = several.agg(F.coalesce(F.sum(F.call_function("div", size * (size - 1), F.lit(2))), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
    overlap = _tiled_pairs(several, _blocks(total, names), names // DEALT_NAMES + 1) if total > SHUFFLED_PAIRS else _added(_all_pairs(several))
    if listed is None:
        return overlap.select("shard_a", "shard_b", "n_shared", "example", F.lit(False).alias("passed"))
    o = overlap.withColumnsRenamed({"shard_a": "_a", "shard_b": "_b"})
    return shard_pairs(listed).join(
        o, F.col("shard_a").eqNullSafe(F.col("_a")) & F.col("shard_b").eqNullSafe(F.col("_b")), "left").select(
        "shard_a", "shard_b", F.coalesce("n_shared", F.lit(0)).cast("bigint").alias("n_shared"), "example",
        F.col("n_shared").isNull().alias("passed"))


def _all_pairs(sets: DataFrame) -> GroupedData:
    """The pairs ``shard_a, shard_b`` of every set with its ``n, example``."""
    first = sets.select("n", "example", "s", F.posexplode("s").alias("i", "shard_a"))
    pairs = first.select("n", "example", "shard_a",
                         F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("shard_b"))
    return pairs.groupBy("shard_a", "shard_b")


def _added(pairs: GroupedData) -> DataFrame:
    return pairs.agg(F.sum("n").alias("n_shared"), F.min("example").cast("string").alias("example"))


def _blocks(total: int, names: int) -> int:
    """Blocks of shards, so that a tile of two has neither too many pairs nor too many names of its sets.

    A set's part in a block is sent once for each other block the set is in, and no more than twice for a pair.
    """
    crowded = min(math.sqrt(4 * total / TILE_NAMES), 2 * names / TILE_NAMES)
    return math.ceil(max(1, math.sqrt(2 * total / TILE_PAIRS), crowded))


def _tiled_pairs(sets: DataFrame, blocks: int, tasks: int) -> DataFrame:
    """``shard_a, shard_b, n_shared, example`` by tiles, the pairs of two of ``blocks`` blocks of shards.

    The part of a set in a block goes to the block's tiles in which the set has a pair. A pair is of one
    tile, so a task has all of its sets.
    """
    kind = sets.schema["s"].dataType.elementType.simpleString()
    block, other = F.col("_block"), F.col("_other")
    members = sets.repartition(tasks, F.col("_set")).select("_set", "n", "example", F.explode("s").alias("shard"))
    parts = members.groupBy("_set", "n", "example", F.pmod(F.xxhash64("shard"), F.lit(blocks)).alias("_block")).agg(
        F.collect_list(F.struct("shard")).alias("names"))
    meeting = parts.withColumn("_met", F.collect_set("_block").over(Window.partitionBy("_set"))).withColumn("_other", F.explode("_met"))
    low, high = F.least(block, other), F.greatest(block, other)
    tile = (F.call_function("div", high * (high + 1), F.lit(2)) + low).cast("int")
    dealt = meeting.where((block != other) | (F.size("names") > 1)).select(
        tile.alias("_tile"), F.when(low == high, BOTH).when(block == low, LOW).otherwise(HIGH).alias("_side"), "_set", "n", "example", "names",
    ).repartitionById(blocks * (blocks + 1) // 2, F.col("_tile"))
    if not is_plain(kind):
        return _hashed_pairs(dealt)
    by_example = dealt.sortWithinPartitions("_tile", F.asc_nulls_last("example"), "_set", "_side")
    pairs = counted_pairs(by_example.select("_tile", "_side", "_set", "n", F.col("example").cast("string"), F.col("names.shard").alias("names")), kind)
    x, y = F.col("shard"), F.col("other")
    before = true(x < y) | (x.isNull() & y.isNotNull())
    return pairs.select(F.when(before, x).otherwise(y).alias("shard_a"), F.when(before, y).otherwise(x).alias("shard_b"), F.col("n").alias("n_shared"), "example")


def _hashed_pairs(dealt: DataFrame) -> DataFrame:
    """The pairs of tiles for names that Python does not compare as Spark does."""
    side = F.col("_side")
    met = dealt.groupBy("_tile", "_set", "n", "example").agg(
        F.any_value(F.when(side != HIGH, F.col("names")), F.lit(True)).alias("xs"), F.any_value(F.when(side != LOW, F.col("names")), F.lit(True)).alias("ys"), F.bool_or(side == BOTH).alias("_same"))
    pairs = met.select("*", F.explode("xs").alias("x")).select("_tile", "n", "example", "_same", F.col("x.shard").alias("x"), F.explode("ys").alias("y"))
    x, y = F.col("x"), F.col("y.shard")
    before = true(x < y) | (x.isNull() & y.isNotNull())
    return _added(pairs.where(~F.col("_same") | before).select(
        "_tile", "n", "example", F.when(before, x).otherwise(y).alias("shard_a"), F.when(before, y).otherwise(x).alias("shard_b"),
    ).groupBy("_tile", "shard_a", "shard_b")).drop("_tile")


def shard_pairs(shards: DataFrame) -> DataFrame:
    """Every unordered pair of shard names (the report is quadratic in shards, not in rows).

    Names are dealt to blocks of about ``PAIR_BLOCK``; a name meets one block at a time by
    equality, so a task holds the pairs of one block and no more.
    """
    names = as_lookup(shards.select("shard_id").distinct())
    blocks = max(1, -(-names.count() // PAIR_BLOCK))
    own = F.pmod(F.xxhash64("shard_id"), F.lit(blocks))
    left = names.select(F.col("shard_id").alias("shard_a"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("_b"))
    right = names.select(F.col("shard_id").alias("shard_b"), own.alias("_b"))
    before = (F.col("shard_a") < F.col("shard_b")) | (F.col("shard_a").isNull() & F.col("shard_b").isNotNull())
    return left.join(right, "_b").where(before).select("shard_a", "shard_b")


def coverage(left: DataFrame, right: DataFrame, key: str = "task_id") -> DataFrame:
    """One row: ids only in ``right`` (missing) and only in ``left`` (extra), with examples."""
    sides = two_sided(left.select(key), right.select(key), [key])
    missing, extra = ~F.col("in_left"), ~F.col("in_right")
    return sides.agg(
        F.count_if(missing).alias("n_missing"),
        F.count_if(extra).alias("n_extra"),
        F.min(F.when(missing, F.col(key))).cast("string").alias("missing_example"),
        F.min(F.when(extra, F.col(key))).cast("string").alias("extra_example"),
    ).withColumn("passed", (F.col("n_missing") == 0) & (F.col("n_extra") == 0))


def audit_coverage(members: DataFrame, baseline: DataFrame) -> DataFrame:
    """Union of the shards against the baseline ids (A4)."""
    return coverage(members, baseline)


def uncovered(members: DataFrame, baseline: DataFrame, key: str = "task_id") -> DataFrame:
    """The ids behind A4, one row each with the side that lacks them."""
    sides = two_sided(members.select(key), baseline.select(key), [key])
    return sides.where(~(F.col("in_left") & F.col("in_right"))).select(
        key, F.when(F.col("in_right"), "missing").otherwise("extra").alias("problem"))


def audit_batch_content(shard_rows: DataFrame, baseline_rows: DataFrame, columns: Sequence[str],
                        allow_rewritten: bool = True) -> DataFrame:
    """Each planned batch holds the same rows as the baseline's batch, in any order (A5).

    A batch unknown to the baseline was rewritten by a rebalance and only has
    to exist, unless ``allow_rewritten`` is off.
    """
    ours = shard_rows.groupBy("batch_idx").agg(*fingerprint_aggs(columns, "s_"))
    theirs = baseline_rows.groupBy("batch_idx").agg(*fingerprint_aggs(columns, "b_"))
    both = ours.join(theirs, "batch_idx", "full")
    parts = ("rows", "high", "low", "check")
    same = F.lit(True)
    for part in parts:
        same = same & true(F.col(f"s_{part}") == F.col(f"b_{part}"))
    status = (
        F.when(F.col("s_rows").isNull(), "absent")
        .when(F.col("b_rows").isNull(), "rewritten")
        .when(same, "same").otherwise("different")
    )
    fine = ["same", "rewritten"] if allow_rewritten else ["same"]
    return both.select(
        "batch_idx",
        F.coalesce("s_rows", F.lit(0)).cast("bigint").alias("shard_rows"),
        F.coalesce("b_rows", F.lit(0)).cast("bigint").alias("baseline_rows"),
        status.alias("status"), status.isin(fine).alias("passed"))


def audit_story_manifest(stories: DataFrame, batches: DataFrame) -> DataFrame:
    """Ids that only the stories or only the batch list of a shard know (A6), one row each."""
    sides = two_sided(stories, batches, ["shard_id", "story_id"])
    return sides.where(~(F.col("in_left") & F.col("in_right"))).select(
        "shard_id", "story_id", F.when(F.col("in_left"), "not in manifest").otherwise("not in stories").alias("problem"))


def audit_baseline(baseline: DataFrame, total: int | None) -> DataFrame:
    """Distinct input ids against the declared total (A7); no total, no failure."""
    return _against_total(baseline.agg(F.count_distinct("task_id").alias("actual")), total)


def _against_total(counted: DataFrame, total: int | None) -> DataFrame:
    declared = F.lit(total).cast("bigint")
    return counted.select("actual", declared.alias("declared"),
                          F.coalesce(F.col("actual") == declared, F.lit(True)).alias("passed"))


def _membership_layers(members: DataFrame, baseline: DataFrame, declared: DataFrame, total: int | None,
                       every: bool) -> list[DataFrame]:
    """A1, A2, A3, A4 and A7 from one shuffle over members and baseline."""
    listed = declared.select("shard_id").union(members.select("shard_id")).distinct() if every else None
    sets = as_lookup(membership_sets(members, baseline))
    base = sets.agg(F.coalesce(F.sum(F.when(F.col("in_base"), F.col("n"))), F.lit(0)).alias("actual"))
    per_shard = sets.select(F.explode("s").alias("shard_id"), "n").groupBy("shard_id").agg(F.sum("n").alias("actual"))
    missing, extra = F.size("s") == 0, ~F.col("in_base")
    cover = sets.agg(
        F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(F.when(extra, F.col("n"))), F.lit(0)).alias("n_extra"),
        F.min(F.when(missing, F.col("example"))).cast("string").alias("missing_example"),
        F.min(F.when(extra, F.col("example"))).cast("string").alias("extra_example"),
    ).withColumn("passed", (F.col("n_missing") == 0) & (F.col("n_extra") == 0))
    # Which shard repeats an id costs another shuffle and is asked only when one does.
    clean = sets.where("repeated").isEmpty()
    dups = audit_internal_dups(members.limit(0) if clean else members)
    return [_against_total(base, total), against_declared(per_shard, declared), dups, pair_overlaps(sets, listed), cover]


def audit_all(members: DataFrame, baseline: DataFrame, declared: DataFrame, stories: DataFrame,
              batches: DataFrame, shard_rows: DataFrame | None = None, baseline_rows: DataFrame | None = None,
              content_columns: Sequence[str] = ("task_id",), total: int | None = None,
              every_pair: bool = False) -> DataFrame:
    """All plan audits as one report (A8); stop a pipeline with ``assert_clean``.

    ``every_pair`` also reports the pairs of shards that share nothing.
    """
    text = F.format_string
    base, counts, dups, pairs, cover = _membership_layers(members, baseline, declared, total, every_pair)
    reports = [
        check_rows(base, "0 baseline", F.lit("baseline"), n_bad=F.when(F.col("passed"), 0).otherwise(1),
                   detail=text("%d ids, declared %d", F.col("actual"), F.col("declared"))),
        check_rows(counts, "1 count", F.coalesce("shard_id", F.lit("NULL")), n_bad=F.abs(F.col("actual") - F.coalesce("declared", F.lit(0))),
                   detail=text("%d ids, declared %d", F.col("actual"), F.col("declared"))),
        check_rows(dups, "1 repeats", F.col("shard_id"), F.lit(False), F.col("n_dups"), F.col("examples")),
        check_rows(pairs, "2 disjoint", F.concat_ws("/", F.coalesce("shard_a", F.lit("NULL")), F.coalesce("shard_b", F.lit("NULL"))), n_bad=F.col("n_shared")),
        check_rows(cover, "3 coverage", F.lit("union"), n_bad=F.col("n_missing") + F.col("n_extra"),
                   example=F.coalesce("missing_example", "extra_example"),
                   detail=text("missing %d, extra %d", F.col("n_missing"), F.col("n_extra"))),
    ]
    if shard_rows is not None and baseline_rows is not None:
        content = audit_batch_content(shard_rows, baseline_rows, content_columns).agg(
            F.count_if(~F.col("passed")).alias("n_bad"),
            F.min(F.when(~F.col("passed"), F.col("batch_idx"))).alias("example"))
        reports.append(check_rows(content, "4 content", F.lit("batches"), F.col("n_bad") == 0))
    agree = audit_story_manifest(stories, batches).agg(
        F.count(F.lit(1)).alias("n_bad"), F.min(F.concat_ws("/", "shard_id", "story_id")).alias("example"))
    reports.append(check_rows(agree, "5 stories", F.lit("stories and batches"), F.col("n_bad") == 0))
    return union_reports(reports)
