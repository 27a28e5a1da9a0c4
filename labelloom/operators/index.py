"""Gap-free numbering of rows without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.cluster import as_lookup, materialize

_ROW, _PART, _FIRST, _COUNT, _OFFSET = "_row", "_part", "_first", "_count", "_offset"


def dense_index(df: DataFrame, order_by: Sequence[str], group_by: Sequence[str] = (),
                name: str = "idx", start: int = 1) -> DataFrame:
    """Number rows ``start, start+1, ...`` by ``order_by`` within each group.

    One range shuffle sorts the rows; a group of any size, also one holding a
    third of the table, spreads over many partitions. The sorted rows are
    written once, so both passes see the same partitions even after executors
    are lost. The second pass needs one small row per (partition, group).
    ``group_by + order_by`` must be unique for a repeatable result.
    """
    keys = [*group_by, *order_by]
    staged = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn(_ROW, F.monotonically_increasing_id())
        .withColumn(_PART, F.shiftright(_ROW, 33)),
        "index",
    )
    runs = staged.groupBy(*group_by, _PART).agg(F.min(_ROW).alias(_FIRST), F.count(F.lit(1)).alias(_COUNT))
    # The window sees at most one row per partition and group.
    earlier = (Window.partitionBy(*group_by).orderBy(_PART)
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = runs.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group_by)],
        F.col(_PART).alias("_p"), _FIRST,
        F.coalesce(F.sum(_COUNT).over(earlier), F.lit(0)).alias(_OFFSET),
    )
    same = F.col(_PART) == F.col("_p")
    for i, g in enumerate(group_by):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    number = F.col(_OFFSET) + F.col(_ROW) - F.col(_FIRST) + start
    return staged.join(as_lookup(offsets), same).select(*df.columns, number.cast("bigint").alias(name))


def earlier_max(df: DataFrame, value: str, order_by: Sequence[str], group_by: Sequence[str] = (),
                name: str = "earlier_max", chunk: int = 65_536) -> DataFrame:
    """Largest ``value`` among the rows before this one in its group (NULL for the first).

    Works on chunks of the dense order, so no window is longer than ``chunk``
    rows plus one row per chunk.
    """
    numbered = dense_index(df, order_by, group_by, "_idx").withColumn("_chunk", F.floor((F.col("_idx") - 1) / chunk))
    before = Window.partitionBy(*group_by, "_chunk").orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
    chunk_before = Window.partitionBy(*group_by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = (numbered.groupBy(*group_by, "_chunk").agg(F.max(value).alias("_top"))
            .withColumn("_carry", F.max("_top").over(chunk_before)).drop("_top"))
    inside = numbered.withColumn("_inside", F.max(value).over(before))
    return (inside.join(tops, [*group_by, "_chunk"])
            .withColumn(name, F.greatest("_inside", "_carry"))
            .select(*df.columns, name))
