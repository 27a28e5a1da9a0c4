"""Connected components by alternating large-star and small-star rounds.

Each round is a minimum per node, which combines before its shuffle, and one join. A round's
edges are a table in the shared scratch folder, so that lost executors never start the loop
again. A star of any size is one minimum; nothing is gathered per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (a, b), a > b. Large: hang larger neighbours on the least one; small: smaller ones."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    hung = both.join(least, "u")
    if large:
        found = hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        found = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return found.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its least node."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = materialize(now, "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        now = materialize(_stars(_stars(now, True), False), "edges")
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
