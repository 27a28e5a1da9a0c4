import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import LONG, rows, verdict
from labelloom.model import PlanError, VerdictSchema
from labelloom.operators.monitor import tail_n
from labelloom.operators.policy import write_audit
from labelloom.sources import files as S
from labelloom.sources import sinks as K

TASK = T.StructType([T.StructField("task_id", T.StringType()), T.StructField("text", T.StringType())])
RULES = VerdictSchema()


def write(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")
    return str(path)


def test_tasks_skip_blank_lines(spark, tmp_path):
    path = write(tmp_path / "t.jsonl", {"task_id": "s_001", "text": "a"}, "", "   ", {"task_id": "s_002", "text": "b", "more": 1})
    assert rows(S.read_tasks(spark, path, TASK)) == [("s_001", "a"), ("s_002", "b")]
    assert [r.task_id for r in S.read_tasks(spark, path, TASK, with_src=True).orderBy("src").collect()] == ["s_001", "s_002"]


@pytest.mark.parametrize("bad", ['{"task_id": "x"', {"text": "no id"}])
def test_tasks_fail_on_bad_lines(spark, tmp_path, bad):
    path = write(tmp_path / "t.jsonl", {"task_id": "s_001"}, bad)
    with pytest.raises(Exception):
        S.read_tasks(spark, path, TASK).collect()


def test_tasks_from_columns(spark, tmp_path):
    spark.createDataFrame([("a", "x")], TASK).write.parquet(str(tmp_path / "p"))
    assert rows(S.read_tasks(spark, str(tmp_path / "p"), TASK, fmt="parquet")) == [("a", "x")]


def test_verdicts_quarantine_and_meta(spark, tmp_path):
    path = write(tmp_path / "v.jsonl", verdict("t1"), {"__meta__": True, "x": 1}, {"__meta__": 1}, {**verdict("t2"), "__meta__": False}, "{bad", "")
    good, bad = S.read_verdicts(spark, path, RULES, on_bad="quarantine")
    assert rows(good, "task_id") == [("t1",), ("t2",)]
    assert rows(bad, "line") == [("{bad",)]
    assert bad.first().src.file.endswith("v.jsonl")


def test_verdicts_fail_with_file_and_text(spark, tmp_path):
    path = write(tmp_path / "v.jsonl", verdict("t1"), "{bad line")
    with pytest.raises(Exception, match="v.jsonl: .bad line"):
        S.read_verdicts(spark, path, RULES)[0].collect()


def test_verdicts_extra_fields_and_strict_keys(spark, tmp_path):
    path = write(tmp_path / "v.jsonl", verdict("t1", score=3), {**verdict("t2"), "reason": None}, {"task_id": "t3"}, {**verdict("t4"), "reason": 12})
    good, _ = S.read_verdicts(spark, path, RULES, [T.StructField("score", T.LongType())], strict=True)
    got = {r.task_id: r for r in good.collect()}
    assert got["t1"].score == 3 and got["t1"].reason == LONG
    assert "reason" in got["t2"].present_keys and got["t2"].reason is None
    assert got["t3"].present_keys == ["task_id"]
    assert got["t4"].reason is None


def test_line_numbers_over_many_splits(spark, tmp_path):
    a = write(tmp_path / "in" / "a.txt", *[f"a{i:05d}" for i in range(3000)])
    write(tmp_path / "in" / "b.txt", "b0", "", "b1")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        numbered = S.number_lines(S.read_lines(spark, str(tmp_path / "in")))
        assert S.read_lines(spark, a).select(F.spark_partition_id()).distinct().count() > 2
        got = rows(numbered, "line", "line_no")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(f"a{i:05d}", i + 1) for i in range(3000)] + [("b0", 1), ("b1", 2)]


def manifest(n=2):
    batches = [{"story_id": f"BATCH-{i:03d}", "input_file": f"stories/batch-{i:03d}.jsonl", "n_tasks": 2,
                "task_ids": [f"s_{2 * i - 1:03d}", f"s_{2 * i:03d}"]} for i in range(1, n + 1)]
    return {"source": "demo", "schema_version": "v1", "batch_size": 2, "n_batches": n, "total_tasks": 2 * n, "batches": batches, "other": 1}


def test_manifest_documents(spark, tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(manifest(), indent=2))
    header, batches, tasks = S.read_manifest(spark, str(path))
    assert rows(header, "source", "batch_size", "n_batches", "total_tasks", "shard_id") == [("demo", 2, 2, 4, None)]
    assert rows(batches, "batch_idx", "story_id", "n_tasks") == [(1, "BATCH-001", 2), (2, "BATCH-002", 2)]
    assert rows(tasks, "batch_idx", "pos", "task_id") == [(1, 1, "s_001"), (1, 2, "s_002"), (2, 1, "s_003"), (2, 2, "s_004")]


def test_story_documents_and_acceptance(spark, tmp_path):
    gate = {"type": "jsonl_schema", "schema_version": "v1", "verdict_schema": {"valid_qa": ["p", "n"], "min_reason_chars": 80}}
    doc = {"project": "demo", "userStories": [
        {"id": "BATCH-001", "title": "one", "priority": 1, "passes": False, "attempts": 0, "timeoutSeconds": 1200, "modifies": ["m"]},
        {"id": "BATCH-002", "priority": 2, "acceptanceGate": {"type": "expr", "condition": "true"}}],
        "acceptance": {"max_attempts": 3, "default_gate": gate}}
    for shard in "ab":
        (tmp_path / f".shard-{shard}").mkdir()
        (tmp_path / f".shard-{shard}" / "stories.json").write_text(json.dumps(doc, indent=1))
    stories = S.read_stories(spark, str(tmp_path / ".shard-*" / "stories.json"))
    assert rows(stories, "shard_id", "pos", "story_id", "passes", "timeout_text") == [
        ("a", 1, "BATCH-001", False, "1200"), ("a", 2, "BATCH-002", None, None),
        ("b", 1, "BATCH-001", False, "1200"), ("b", 2, "BATCH-002", None, None)]
    assert stories.where("pos = 2").first().acceptanceGate == {"type": "expr", "condition": "true"}
    acceptance = S.read_acceptance(spark, str(tmp_path / ".shard-a" / "stories.json"))
    assert acceptance["max_attempts"] == 3 and acceptance["default_gate"]["verdict_schema"]["min_reason_chars"] == 80


def test_logs_keep_line_order_and_may_be_missing(spark, tmp_path):
    write(tmp_path / ".shard-a" / "run.log", *[f"r{i}" for i in range(70)])
    write(tmp_path / ".shard-a" / "loop.log", "l0", "l1")
    write(tmp_path / ".shard-b" / "run.log", "x")
    logs = S.read_logs(spark, str(tmp_path / ".shard-*"))
    assert rows(logs.groupBy("shard_id", "source").count()) == [("a", "loop", 2), ("a", "run", 70), ("b", "run", 1)]
    tail = tail_n(logs.where("source = 'run' AND shard_id = 'a'"), ["shard_id", "source"], "seq")
    assert [r.line for r in tail.orderBy("rn").collect()] == [f"r{i}" for i in range(20, 70)]


def test_write_event_lines(spark, tmp_path):
    path = write(tmp_path / "e.jsonl", {"tool_name": "Write", "tool_input": {"file_path": ".baseline/x"}, "shard_root": ".shard-a"},
                 {"name": "Edit", "input": {"path": ".shard-a/x"}, "shard_root": ".shard-a"}, {"tool_name": "Write", "tool_input": {}, "shard_root": ".shard-a"})
    out = write_audit(S.read_write_events(spark, path), "/repo")
    assert rows(out, "reason") == [("baseline deny",), ("inside current shard",), ("no path",)]


def test_ordered_files_hold_global_order(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("v").alias("v"))
    path = str(tmp_path / "out")
    K.write_ordered(df, path, ["k"], n_files=5, drop=["v"])
    lines = [json.loads(r.line)["k"] for r in S.read_lines(spark, path).orderBy("src").collect()]
    assert lines == list(range(1000))
    assert len(list((tmp_path / "out").glob("part-*"))) == 5


def test_publish_modes(spark, make, tmp_path):
    path = str(tmp_path / "deep" / "out")
    one, two = make("a int", (1,)), make("a int", (2,))
    with pytest.raises(PlanError):
        K.publish(spark, path, lambda p: one.write.parquet(p), "refresh")
    K.publish(spark, path, lambda p: one.limit(0).write.parquet(p))
    K.publish(spark, path, lambda p: one.write.parquet(p))
    with pytest.raises(PlanError, match="rows found"):
        K.publish(spark, path, lambda p: two.write.parquet(p))
    K.publish(spark, path, lambda p: two.write.parquet(p), "refresh")
    assert rows(spark.read.parquet(path)) == [(2,)]
    with pytest.raises(PlanError):
        K.publish(spark, path, lambda p: None, "other")


def test_failed_write_keeps_the_old_table(spark, make, tmp_path):
    path = str(tmp_path / "out")
    make("a int", (1,)).write.parquet(path)
    broken = make("a int", (1,)).select(F.raise_error(F.lit("no")).cast("int").alias("a"))
    with pytest.raises(Exception):
        K.publish(spark, path, lambda p: broken.write.parquet(p), "force")
    assert rows(spark.read.parquet(path)) == [(1,)]


def test_plan_publish_guards_the_state(spark, make, tmp_path):
    root, plan = str(tmp_path / "p"), make("b int", (1,))
    state = {"verdicts": T.StructType([T.StructField("task_id", T.StringType())])}
    with pytest.raises(PlanError):
        K.publish_plan(spark, root, {"batches": plan}, state, "refresh")
    K.publish_plan(spark, root, {"batches": plan}, state)
    make("task_id string", ("x",)).write.mode("append").parquet(f"{root}/state/verdicts")
    with pytest.raises(PlanError, match="rows found"):
        K.publish_plan(spark, root, {"batches": plan}, state)
    K.publish_plan(spark, root, {"batches": make("b int", (2,))}, state, "refresh")
    assert rows(spark.read.parquet(f"{root}/plan/batches")) == [(2,)]
    assert spark.read.parquet(f"{root}/state/verdicts").count() == 1
    K.publish_plan(spark, root, {"batches": plan}, state, "force")
    assert spark.read.parquet(f"{root}/state/verdicts").count() == 0


def test_bad_lines_carry_their_line_number(spark, tmp_path):
    write(tmp_path / "in" / "a.jsonl", verdict("t1"), "", "{bad one", {"__meta__": True}, "{bad two")
    write(tmp_path / "in" / "b.jsonl", verdict("t2"), "[1, 2", verdict("t3"))
    got = S.bad_line_numbers(spark, str(tmp_path / "in"), RULES)
    assert rows(got.select(F.regexp_extract("file", "([a-z]).jsonl", 1).alias("f"), "line_no", "line")) == [
        ("a", 3, "{bad one"), ("a", 5, "{bad two"), ("b", 2, "[1, 2")]


def test_fields_without_schema_are_kept(spark, tmp_path):
    path = write(tmp_path / "v.jsonl", verdict("t1", score=3, tags=["a"], note=None))
    row = S.read_verdicts(spark, path, RULES, keep_line=True, extras=True)[0].first()
    assert row.extras == {"score": "3", "tags": '["a"]', "note": None}
    assert json.loads(row.line)["tags"] == ["a"]
