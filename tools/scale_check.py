"""Multiply rows, with a third of them on one hot key, and time the operators that must stand it.

    python tools/scale_check.py [rows] [cores]
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labelloom.cluster import drop_scratch, local_session, materialize  # noqa: E402
from labelloom.operators import audit as A  # noqa: E402
from labelloom.operators import gates as G  # noqa: E402
from labelloom.operators import merge as M  # noqa: E402
from labelloom.operators import monitor as D  # noqa: E402
from labelloom.operators.index import dense_index, earlier_max  # noqa: E402
from labelloom.operators.intake import pending  # noqa: E402
from labelloom.plans.batches import batchify  # noqa: E402
from labelloom.plans.shards import auto_split  # noqa: E402
from workload.inputs import SCHEMA, VERSION  # noqa: E402


def timed(name, build):
    """Building counts too, as some operators write a scratch table first."""
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    print(f"{name:22s} {time.perf_counter() - start:7.2f}s", flush=True)


def main():
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 5_000_000
    spark = local_session("scale", sys.argv[2] if len(sys.argv) > 2 else "8", 32)
    spark.sparkContext.setLogLevel("ERROR")
    third = F.col("id") % 3 == 0
    tasks = spark.range(n).select(F.col("id").alias("task_id"))
    start = time.perf_counter()
    members = materialize(auto_split(batchify(tasks, ["task_id"]), 4), "members")
    print(f"{'batchify + split':22s} {time.perf_counter() - start:7.2f}s", flush=True)
    # A third of all memberships and verdicts repeat one id; a third of all log lines are one shard's.
    dirty = materialize(spark.range(n).select(
        F.when(third, 7).otherwise(F.col("id")).alias("task_id"), F.concat(F.lit("s"), (F.col("id") % 20).cast("string")).alias("shard_id")), "dirty")
    verdicts = materialize(spark.range(n).select(
        F.when(third, 7).otherwise(F.col("id")).alias("task_id"), F.when(F.col("id") % 5 == 0, "no").otherwise("yes").alias("qa"),
        F.repeat(F.lit("reason "), (F.col("id") % 60).cast("int")).alias("reason"), F.lit("v1").alias("schema_version"),
        F.col("id").alias("seq"), F.lit("a").alias("shard_id")), "verdicts")
    hot = spark.range(n).select(F.when(third, 0).otherwise(F.col("id") % 1000).alias("g"), F.col("id").alias("k"), (F.col("id") * 31 % 977).alias("v"))
    timed("grouped index, hot", lambda: dense_index(hot, ["k"], ["g"]))
    timed("earlier max, hot", lambda: earlier_max(hot, "v", ["k"], ["g"]))
    timed("audit_disjoint", lambda: A.audit_disjoint(dirty))
    timed("audit_internal_dups", lambda: A.audit_internal_dups(dirty))
    timed("coverage", lambda: A.coverage(dirty, members))
    timed("gate_batches", lambda: G.gate_batches(verdicts, members, SCHEMA, VERSION))
    timed("expr gate", lambda: G.ExprGate("avg(reason_chars) > 9").evaluate(verdicts, members))
    timed("pending", lambda: pending(members, verdicts))
    timed("dup_report", lambda: M.dup_report(verdicts, ["task_id"]))
    timed("ordered_merge", lambda: M.ordered_merge(verdicts, members, ["seq"]))
    timed("tail_n, hot", lambda: D.tail_n(hot, ["g"], "k"))
    drop_scratch(spark)


if __name__ == "__main__":
    main()
