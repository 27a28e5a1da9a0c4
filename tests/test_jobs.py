import json

import pytest
from pyspark.sql import functions as F

from helpers import rows, verdict
from labelloom.jobs import main
from labelloom.sources.files import read_lines
from labelloom.sources.versions import history, read_table

IDS = [f"t{i:03d}" for i in range(50)]
CONFIG = {"project": "demo", "userStories": [], "acceptance": {"max_attempts": 2, "default_gate": {
    "type": "jsonl_schema", "schema_version": "v1", "verdict_schema": {"valid_qa": ["yes", "no"], "min_reason_chars": 5}}}}


@pytest.fixture
def project(spark, tmp_path):
    (tmp_path / "tasks.jsonl").write_text("".join(json.dumps({"task_id": t, "text": "x"}) + "\n" for t in reversed(IDS)))
    (tmp_path / "config.json").write_text(json.dumps(CONFIG, indent=1))
    (tmp_path / "in").mkdir()
    root = tmp_path / "project"

    def run(job, *args):
        return main(["--root", str(root), "--config", str(tmp_path / "config.json"), job, *args], spark)

    def plan(*args):
        return run("plan", "--tasks", str(tmp_path / "tasks.jsonl"), "--batch-size", "5", "--shards", "2", *args)

    def arrive(name, ids):
        (tmp_path / "in" / name).write_text("".join(json.dumps(verdict(t, shard_id=s, extra=[t])) + "\n" for t, s in ids))
        return run("ingest", "--source", str(tmp_path / "in"))

    return tmp_path, root, run, plan, arrive


def test_whole_project(spark, project):
    tmp, root, run, plan, arrive = project
    assert plan() == 0
    batches = read_table(spark, str(root / "plan"), "batches")
    assert rows(batches.groupBy("shard_id").agg(F.sum("n_tasks"))) == [("a", 25), ("b", 25)]
    assert run("audit") == 0
    assert run("dashboard") == 0
    out = str(tmp / "out")
    assert run("merge", "--out", out) == 1

    assert arrive("one.jsonl", [(t, "a") for t in IDS[:25]] + [(t, "b") for t in IDS[25:37]]) == 0
    assert run("gate") == 0
    stories = read_table(spark, str(root / "plan"), "stories")
    assert rows(stories.groupBy("shard_id").agg(F.count_if("passes"))) == [("a", 5), ("b", 2)]
    assert plan() == 1  # verdicts are there
    assert plan("--mode", "refresh") == 0
    stories = read_table(spark, str(root / "plan"), "stories")
    assert rows(stories.groupBy("shard_id").agg(F.count_if("passes"), F.max("attempts"))) == [("a", 5, 0), ("b", 2, 0)]  # a batch under work gets no attempt

    assert run("rebalance", "--from", "b", "--keep", "b") == 1
    assert run("rebalance", "--from", "b", "--keep", "a", "--dry-run") == 0
    assert read_table(spark, str(root / "plan"), "assignments").count() == 50
    assert run("rebalance", "--from", "b", "--keep", "a", "--batch-size", "5") == 0
    active = read_table(spark, str(root / "plan"), "assignments").where("active")
    assert rows(active.groupBy("shard_id").count()) == [("a", 38), ("b", 12)]
    assert run("audit") == 0

    assert arrive("two.jsonl", [(t, "a") for t in IDS[37:]]) == 0
    assert run("gate") == 0
    assert run("dashboard") == 0
    stories = read_table(spark, str(root / "plan"), "stories")
    assert stories.where("NOT passes").count() == 0
    assert run("merge", "--out", out, "--dry-run") == 0
    assert not (tmp / "out").exists()
    (tmp / "old.jsonl").write_text(json.dumps(verdict("old", version="v0")) + "\n")
    assert run("merge", "--out", out, "--name", "demo", "--partial", str(tmp / "old.jsonl")) == 0
    names = sorted(p.name.rsplit("_", 1)[0] for p in (tmp / "out").iterdir())
    assert names == ["demo_combined", "demo_merged"]
    for name, want in (("demo_merged", IDS), ("demo_combined", ["old", *IDS])):
        path = next((tmp / "out").glob(f"{name}_*"))
        assert [json.loads(r.line)["task_id"] for r in read_lines(spark, str(path)).orderBy("src").collect()] == want
    merged = read_lines(spark, str(next((tmp / "out").glob("demo_merged_*")))).first()
    assert json.loads(merged.line) == verdict(IDS[0], shard_id="a", extra=[IDS[0]])
    assert plan("--mode", "force") == 0
    assert not (root / "state" / "accepted").exists()


def test_splits(spark, project):
    tmp, root, run, plan, _ = project
    assert plan("--splits", "1-3,5-10") == 1
    assert plan("--splits", "1-10") == 1
    assert plan("--mode", "refresh") == 1
    (tmp / "splits.json").write_text('{"splits": [[1, 2],\n [3, 10]]}')
    assert plan("--splits-file", str(tmp / "splits.json")) == 0
    assert rows(read_table(spark, str(root / "plan"), "batches").groupBy("shard_id").count()) == [("a", 2), ("b", 8)]


def test_failed_batches_are_recovered_and_done_again(spark, project):
    tmp, root, run, plan, arrive = project
    assert plan() == 0
    first = json.loads((tmp / "config.json").read_text())
    first["acceptance"]["default_gate"]["verdict_schema"]["min_reason_chars"] = 300
    (tmp / "strict.json").write_text(json.dumps(first))

    def stories():
        return rows(read_table(spark, str(root / "plan"), "stories").groupBy("shard_id").agg(F.count_if("passes"), F.max("attempts")))

    assert arrive("one.jsonl", [(t, "a") for t in IDS[:7]]) == 0
    for _ in range(3):  # without news no batch is judged a second time, and none under work at all
        assert main(["--root", str(root), "--config", str(tmp / "strict.json"), "gate"], spark) == 0
        assert stories() == [("a", 0, 1), ("b", 0, 0)]
    assert run("recover") == 0 and run("recover") == 0
    accepted = spark.read.parquet(str(root / "state" / "retracted"))
    assert rows(accepted, "task_id", "batch_idx") == [(t, 1) for t in IDS[:5]]
    assert arrive("two.jsonl", [(t, "a") for t in IDS[:5]]) == 0
    assert run("gate") == 0
    assert stories() == [("a", 1, 1), ("b", 0, 0)]


def test_worker_files_and_reports(spark, project):
    tmp, root, run, plan, arrive = project
    assert plan() == 0
    (tmp / "prompt.txt").write_text("Shard {{SHARD_ID}}: {{N_TASKS}} tasks, {{UNKNOWN}}")
    out = tmp / "out"
    assert run("hand-out", "--tasks", str(tmp / "tasks.jsonl"), "--batch-size", "5", "--template", str(tmp / "prompt.txt"), "--out", str(out)) == 0
    assert sorted(p.name for p in out.iterdir()) == ["manifest", "prompts", "stories", "tasks"]
    assert rows(spark.read.text(str(out / "prompts")), "value") == [(f"Shard {s}: 25 tasks, {{{{UNKNOWN}}}}",) for s in "ab"]
    assert run("next") == 0
    assert run("status", "--out", str(tmp / "status"), "--alive", "a", "--iteration", "4") == 0
    text = "".join(p.read_text() for p in sorted((tmp / "status").glob("part-*")))
    doc = json.loads(text)["shards"]
    assert [(s["shard"], s["alive"], len(s["pending"]), s["iteration"]) for s in doc] == [("a", True, 5, 4), ("b", False, 5, 4)]
    logs = tmp / "logs" / "shard-b"
    logs.mkdir(parents=True)
    (logs / "run.log").write_text("all fine\nRate limit reached\n")
    assert run("alerts", "--logs", str(tmp / "logs"), "--alive", "a") == 0
    event = {"tool_name": "Write", "shard_root": ".shard-a", "tool_input": {"file_path": ".shard-a/state/x.jsonl"}}
    (tmp / "events.jsonl").write_text(json.dumps(event) + "\n")
    assert run("write-audit", "--events", str(tmp / "events.jsonl"), "--repo", "/repo") == 0
    (tmp / "events.jsonl").write_text(json.dumps({**event, "tool_input": {"file_path": ".shard-b/x"}}) + "\n")
    assert run("write-audit", "--events", str(tmp / "events.jsonl"), "--repo", "/repo") == 1


def test_a_rebalance_is_logged(spark, project):
    tmp, root, run, plan, arrive = project
    assert plan() == 0
    assert arrive("one.jsonl", [(t, "b") for t in IDS[25:37]]) == 0
    assert run("rebalance", "--from", "b", "--keep", "a", "--batch-size", "5") == 0
    header = read_table(spark, str(root / "plan"), "header")
    batches = read_table(spark, str(root / "plan"), "batches")
    assert rows(header, "n_batches", "total_tasks") == [(batches.count(), 50)]
    changes = read_table(spark, str(root / "plan"), "changes")
    assert rows(changes, "shard_id", "first_batch", "last_batch", "added_tasks", "generation", "stopped") == [("a", 11, 13, 13, 1, "b")]
    assert run("audit") == 0
    assert [c["note"] for c in history(spark, str(root / "plan"))] == ["plan", "rebalance"]
