import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import rows
from labelloom.model import PlanError
from labelloom.operators import rebalance as R
from labelloom.plans.batches import batch_table, batchify
from labelloom.plans.shards import auto_split, shard_manifest
from labelloom.sources import documents as D
from labelloom.sources import files as S
from labelloom.sources import store

TASKS = T.StructType([T.StructField("task_id", T.StringType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="module")
def project(spark):
    tasks = spark.createDataFrame([(f"t{k:03d}", f"é \"quoted\"\n{{text}} {k}" * (k % 4)) for k in range(57)], "task_id string, text string")
    members = auto_split(batchify(tasks.select("task_id"), ["task_id"], 5), 3).cache()
    return tasks, members


def test_one_batch_is_read_by_its_range(spark, project, tmp_path):
    tasks, members = project
    root = str(tmp_path / "store")
    index = store.write_batches(tasks, members, root, n_files=3)
    assert index.count() == 12 and index.select("file").distinct().count() == 3
    for b in (1, 7, 12):
        got = [(r.at, r.task_id, r.text) for r in store.read_batch(spark, root, b, TASKS).orderBy("at").collect()]
        want = [(r.task_id, r.text) for r in members.where(F.col("batch_idx") == b).join(tasks, "task_id").orderBy("pos").collect()]
        assert got == [(k, *w) for k, w in enumerate(want, 1)]
    whole = S.read_tasks(spark, store.payload_path(root), TASKS)
    assert rows(whole) == rows(tasks)
    with pytest.raises(PlanError):
        store.read_batch(spark, root, 99, TASKS)


def test_files_of_many_bytes_are_split_between_batches(spark, project, tmp_path, monkeypatch):
    tasks, members = project
    monkeypatch.setattr(store, "FILE_BYTES", 400)
    root = str(tmp_path / "store")
    index = store.write_batches(tasks, members, root, n_files=2)
    sizes = {p.name: p.stat().st_size for p in (tmp_path / "store" / "payload").glob("part-*")}
    largest = index.agg(F.max("length")).first()[0]
    assert len(sizes) > 4 and max(sizes.values()) < 400 + largest
    assert {r.file: r.n for r in index.groupBy("file").agg(F.sum("length").alias("n")).collect()} == sizes
    for b in range(1, 13):
        got = [r.task_id for r in store.read_batch(spark, root, b, TASKS).orderBy("at").collect()]
        assert got == [r.task_id for r in members.where(F.col("batch_idx") == b).orderBy("pos").collect()]


def test_moved_batches_are_stored_like_others(spark, project, tmp_path):
    tasks, members = project
    seen = members.where("batch_idx < 9").select("shard_id", "task_id")
    drained = R.drain(members, seen, ["c"])
    moves = R.next_ids(R.rebatch(R.pool(drained, ["c"]), ["a", "b"], 5), members.select("shard_id", "batch_idx"))
    grown = R.active_members(R.reassign(R.first_assignments(members), drained, moves, 1))
    root = str(tmp_path / "store")
    index = store.write_batches(tasks, grown, root)
    last = index.agg(F.max("batch_idx")).first()[0]
    assert last > 12
    got = [r.task_id for r in store.read_batch(spark, root, last, TASKS).orderBy("at").collect()]
    assert got == [r.task_id for r in grown.where(F.col("batch_idx") == last).orderBy("pos").collect()]


def one_file(path):
    found = [p for p in path.iterdir() if p.name.startswith("part-")]
    assert len(found) == 1
    return json.loads(found[0].read_text())


def test_manifest_documents(spark, project, tmp_path):
    tasks, members = project
    path = tmp_path / "manifest"
    heads, listed = shard_manifest(auto_split(batch_table(members), 3))
    D.write_manifest(heads, listed, members, str(path), 5, {"source": F.lit("demo \"x\""), "schema_version": F.lit("v1")})
    header, batches, placed = S.read_manifest(spark, str(path))
    assert rows(header, "shard_id", "n_batches", "total_tasks", "source", "batch_size") == [
        ("a", 4, 20, 'demo "x"', 5), ("b", 4, 20, 'demo "x"', 5), ("c", 4, 17, 'demo "x"', 5)]
    assert rows(batches, "batch_idx", "n_tasks") == rows(batch_table(members), "batch_idx", "n_tasks")
    assert rows(placed, "batch_idx", "task_id") == rows(members, "batch_idx", "task_id")
    doc = one_file(path / "shard_id=b")
    assert [b["story_id"] for b in doc["batches"]] == [f"BATCH-{k:03d}" for k in range(5, 9)]


def test_story_documents(spark, make, tmp_path):
    stories = make("shard_id string, pos bigint, story_id string, title string, modifies array<string>, priority bigint, passes boolean, attempts bigint, timeout_text string",
                   ("a", 1, "S1", "é \"t\"", ["x", "y"], 3, False, 0, "1200"), ("a", 5, "S2", None, None, None, True, 2, None), ("b", 9, "S9", "z", [], 1, False, 0, "x"))
    path = tmp_path / "stories"
    D.write_stories(stories, str(path), F.lit("demo"), json.dumps({"max_attempts": 2}))
    back = S.read_stories(spark, str(path), shard_pattern=r"shard_id=([^/]+)/")
    want = [(r.shard_id, r.story_id, r.title, r.modifies, r.priority, r.passes, r.attempts, r.timeout_text) for r in stories.collect()]
    assert rows(back, "shard_id", "story_id", "title", "modifies", "priority", "passes", "attempts", "timeout_text") == sorted(want)
    assert rows(back, "shard_id", "pos") == [("a", 1), ("a", 2), ("b", 1)]
    assert S.read_acceptance(spark, str(path / "shard_id=a")) == {"max_attempts": 2}


def test_status_document(spark, make, tmp_path):
    progress = make("shard_id string, done bigint, total bigint, n_pending bigint", ("a", 1, 3, 2), ("b", 2, 2, 0), ("c", 0, 1, 1))
    alive = make("shard_id string, alive boolean", ("a", True), ("c", False))
    pending = make("shard_id string, seq bigint, story_id string", ("a", 1, 'S"1'), ("a", 2, "S2"), ("c", 1, "S7"))
    path = tmp_path / "status"
    ts = F.lit("2026-01-02 03:04:05").cast("timestamp")
    D.status_document(progress, alive, pending, 7, ts, str(path), "Asia/Tokyo")
    doc = one_file(path)
    assert [s["shard"] for s in doc["shards"]] == ["a", "b", "c"]
    assert [s["pending"] for s in doc["shards"]] == [['S"1', "S2"], [], ["S7"]]
    assert [s["alive"] for s in doc["shards"]] == [True, False, False]
    assert doc["shards"][0]["ts"] == "2026-01-02 12:04:05" and doc["shards"][0]["iteration"] == 7


@pytest.mark.parametrize("indent", [1, 2])
def test_a_large_document_is_parsed_entry_by_entry(spark, tmp_path, indent):
    batches = [{"story_id": f"BATCH-{k:03d}", "input_file": 'a "[{" \\\\" }]' + str(k), "n_tasks": k % 3, "task_ids": [f"t{k}-{j}]" for j in range(k % 3)]}
               for k in range(1, 400)]
    doc = {"source": "x [ {", "batch_size": 5, "notes": ["a", {"b": ["c"]}], "batches": batches, "shard_id": "a", "after": [[1], {"batches": []}]}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=indent))
    (tmp_path / "two.json").write_text(json.dumps({**doc, "batches": batches[:1], "shard_id": "b"}, indent=indent))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits in one document
    try:
        split = [df.cache() for df in S.read_manifest_split(spark, str(tmp_path))]
        assert spark.read.text(str(tmp_path / "one.json")).rdd.getNumPartitions() > 5
        for mine, plain in zip(split, S.read_manifest(spark, str(tmp_path))):
            assert rows(mine.drop("file")) == rows(plain.drop("file")) and mine.columns[:-1] == plain.columns[:-1]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_entries_that_share_lines(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"shard_id": "a", "batches": [\n{"story_id": "BATCH-001"}, {"story_id":\n"BATCH-002"}, {"story_id": "BATCH-003"}\n, {"story_id": "BATCH-004"}\n], "n_batches": 4}')
    header, batches, _ = S.read_manifest_split(spark, str(tmp_path))
    assert rows(batches, "batch_idx") == [(1,), (2,), (3,), (4,)] and rows(header, "shard_id", "n_batches") == [("a", 4)]


@pytest.mark.parametrize("text", ['{"batches": [{"story_id": "BATCH-001"}]}', '{"other": 1}'])
def test_documents_that_cannot_be_split_stop_the_job(spark, tmp_path, text):
    (tmp_path / "m.json").write_text(text)
    with pytest.raises(Exception, match="does not begin and end at line ends"):
        S.read_manifest_split(spark, str(tmp_path))[1].collect()
