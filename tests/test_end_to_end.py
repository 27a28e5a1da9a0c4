"""A whole run on the document table: plan, audit, label, gate, rebalance, merge."""

import json
import os

import pytest
from pyspark.sql import functions as F

from labelloom.model import VerdictSchema
from labelloom.operators import audit, gates, intake, merge, rebalance
from labelloom.operators.report import assert_clean
from labelloom.plans.batches import batch_table, batchify
from labelloom.plans.shards import assert_ranges, auto_split, check_plan, even_ranges, shard_manifest
from labelloom.plans.stories import rebase_stories
from labelloom.sources.files import read_lines, verdict_stream
from labelloom.streaming.ingest import ingest_stream, read_accepted

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RULES = VerdictSchema(valid_qa=("yes", "no"), min_reason_chars=10)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_lifecycle(spark, tmp_path):
    tasks = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("task_id"), "text")
    total = tasks.count()

    # Plan: batches of 20 over three shards.
    members = auto_split(batchify(tasks.select("task_id"), ["task_id"], 20), 3)
    batches = auto_split(batch_table(members), 3)
    assert_ranges(spark, even_ranges(batches.count(), 3), batches.count())
    heads, listed = shard_manifest(batches)
    stories = rebase_stories(
        batches.select("story_id", F.col("batch_idx").alias("pos"), F.col("batch_idx").alias("priority"),
                       F.array(F.lit(".baseline/state/verdicts.jsonl")).alias("modifies")), batches)
    header = batches.agg(F.count("*").alias("n_batches"), F.sum("n_tasks").alias("total_tasks"))
    assert_clean(check_plan(header, batches, heads))
    assert_clean(audit.audit_all(members, tasks, heads, stories, listed, members, members, ["task_id"], total))

    # Label: shards a and b finish, c stops half way; lines arrive as files with repeats.
    def arrive(name, rows):
        (rows.select(F.to_json(F.struct(
            "task_id", F.when(F.crc32("task_id") % 2 == 0, "yes").otherwise("no").alias("qa"),
            F.concat(F.lit("because of "), F.col("task_id")).alias("reason"), F.lit("v1").alias("schema_version"),
            "shard_id")).alias("value")).write.text(str(tmp_path / "in" / name)))

    half = members.where("shard_id <> 'c' OR pos % 2 = 0")
    arrive("one", half)
    arrive("two", half.where("shard_id = 'a'"))
    sink = str(tmp_path / "sink")

    def ingest():
        from pyspark.sql import types as T

        stream = verdict_stream(spark, str(tmp_path / "in" / "*"), RULES, [T.StructField("shard_id", T.StringType())])
        ingest_stream(stream, sink, str(tmp_path / "check"), "labels", RULES, "v1").awaitTermination()
        return read_accepted(spark, sink)

    accepted = ingest()
    assert accepted.count() == half.count()

    # Gate: full batches pass, the half-done ones fail on count and ids.
    judged = gates.gate_batches(accepted, members, RULES, "v1")
    full = batches.where("shard_id <> 'c'").count()
    assert judged.where("passed").count() == full
    assert {f.split(" ")[0] for r in judged.where("NOT passed").collect() for f in r.failures} == {"(a)", "(b)"}
    results = judged.join(batches.select("batch_idx", "shard_id", "story_id"), "batch_idx")
    done = gates.finalize(stories, results)
    assert {r.token for r in done.where("shard_id <> 'c'").collect()} == {"COMPLETE"}
    assert {r.token for r in done.where("shard_id = 'c'").collect()} == {"YIELD"}

    # Rebalance: what c left goes to a and b, and the active plan still covers everything once.
    drained = rebalance.drain(members, accepted, ["c"])
    assert drained.count() == total - accepted.count()
    plan = rebalance.next_ids(rebalance.rebatch(rebalance.pool(drained, ["c"]), ["a", "b"], 20), members)
    assignments = rebalance.reassign(rebalance.first_assignments(members), drained, plan, 1)
    active = rebalance.active_members(assignments)
    assert audit.audit_disjoint(active).where("NOT passed").count() == 0
    assert audit.coverage(active, tasks).first().passed

    # The rest arrives, nothing is pending, the merge is in baseline order.
    arrive("three", active.join(intake.pending(active, accepted), "task_id", "left_semi"))
    accepted = ingest()
    assert intake.pending(active, accepted).count() == 0
    declared = active.groupBy("shard_id").agg(F.count("*").alias("total_tasks"))
    path = merge.merge_publish(accepted.drop("stream_id", "batch_id"), members, declared, RULES, "v1", str(tmp_path / "out"), total=total)[0]
    ids = [json.loads(r.line)["task_id"] for r in read_lines(spark, path).orderBy("src").collect()]
    assert ids == [r.task_id for r in members.orderBy("pos").collect()]
    assert "reason_chars" not in read_lines(spark, path).first().line
