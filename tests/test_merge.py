import json
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import LONG, rows
from labelloom.model import AuditError, VerdictSchema
from labelloom.operators import merge as M
from labelloom.sources.files import read_lines

RULES = VerdictSchema(valid_qa=("yes", "no"))
ROW = "shard_id string, task_id string, qa string, reason string, schema_version string, seq bigint"
IDS = [f"t{i:02d}" for i in range(20)]


@pytest.fixture(scope="module")
def world(make):
    order = make("task_id string, batch_idx bigint, pos bigint", *[(t, i // 5 + 1, i + 1) for i, t in enumerate(IDS)])
    declared = make("shard_id string, total_tasks bigint", ("a", 10), ("b", 10))
    good = [("a" if i < 10 else "b", t, "yes", LONG, "v1", 100 - i) for i, t in enumerate(IDS)]
    return order, declared, good


def report(world, make, data, **kw):
    out = M.merge_report(make(ROW, *data), world[0], world[1], RULES, "v1", **{"total": 20, **kw})
    return {(r.layer.split(" ")[0], r.subject): (r.passed, r.n_bad, r.example) for r in out.collect()}


def test_clean_set_passes_all_layers(world, make):
    assert all(v[0] for v in report(world, make, world[2]).values())


@pytest.mark.parametrize("change,layers", [
    (lambda d: d[1:], {("2", "a"), ("3a", "rows"), ("4", "ids")}),
    (lambda d: [*d, d[0]], {("2", "a"), ("3a", "rows"), ("3b", "ids")}),
    (lambda d: [*d[1:], ("a", "zz", *d[0][2:])], {("4", "ids")}),
    (lambda d: [(*d[0][:4], "v0", 1), *d[1:]], {("5", "schema")}),
    (lambda d: [(*d[0][:3], "short", "v1", 1), *d[1:]], {("5", "schema")}),
    (lambda d: [(*d[0][:2], "maybe", *d[0][3:]), *d[1:]], {("5", "schema")}),
])
def test_each_fault_fails_its_layers(world, make, change, layers):
    got = report(world, make, change(world[2]))
    assert {k for k, v in got.items() if not v[0]} == layers


def test_missing_declared_shard_fails(world, make):
    got = report(world, make, [d for d in world[2] if d[0] == "a"])
    assert got[("2", "b")] == (False, 10, None)


def test_dup_report_examples(make):
    data = make("k string", *[(x,) for x in ["a", "a", "a", "b", "b", "c", "d", "d", "e", "e", None, ""]])
    assert rows(M.dup_report(data, ["k"])) == [(12, 6, 5, ",a,b")]
    assert rows(M.dup_report(data.where("k = 'c'"), ["k"])) == [(1, 0, 0, "")]


def test_sample_is_repeatable_and_sized(spark):
    ids = spark.range(500).select(F.col("id").cast("string").alias("task_id"))
    one, two = (rows(M.sample_rows(d, "task_id"), "task_id") for d in (ids, ids.repartition(7)))
    assert one == two and len(one) == 50
    assert rows(M.sample_rows(ids, "task_id", seed=7), "task_id") != one


def test_last_verdict_wins(world, make):
    data = [*world[2], ("b", "t00", "no", LONG, "v1", 500), ("b", "t00", "no", LONG, "v0", 400)]
    out = M.ordered_merge(make(ROW, *data), world[0], ["seq"])
    assert out.count() == 20
    assert rows(out.where("task_id = 't00'"), "qa", "schema_version", "batch_idx", "pos") == [("no", "v1", 1, 1)]
    two = M.ordered_merge(make(ROW, *data), world[0], ["schema_version", "seq"])
    assert rows(two.where("task_id = 't00'"), "qa", "seq") == [("no", 500)]


def test_publish_writes_in_baseline_order(world, make, spark, tmp_path):
    prefix = make(ROW, ("a", "old2", "yes", "r", "v0", 2), ("a", "old1", "yes", "r", "v0", 1))
    paths = M.merge_publish(make(ROW, *world[2]).repartition(5), world[0], world[1], RULES, "v1", str(tmp_path / "out"), "demo", 20,
                            prefix=prefix, day=date(2024, 3, 9))
    assert [Path(p).name for p in paths] == ["demo_merged_20240309", "demo_combined_20240309"]

    def ids(path):
        return [json.loads(r.line)["task_id"] for r in read_lines(spark, path).orderBy("src").collect()]

    assert ids(paths[0]) == IDS
    first = json.loads(read_lines(spark, paths[0]).orderBy("src").first().line)
    assert set(first) == {"shard_id", "task_id", "qa", "reason", "schema_version", "seq"}
    assert ids(paths[1]) == ["old1", "old2", *IDS]


def test_failed_audit_leaves_no_output(world, make, tmp_path):
    out = tmp_path / "out"
    with pytest.raises(AuditError):
        M.merge_publish(make(ROW, *world[2][1:]), world[0], world[1], RULES, "v1", str(out), total=20)
    assert not out.exists()
    assert M.merge_publish(make(ROW, *world[2]), world[0], world[1], RULES, "v1", str(out), total=20, dry_run=True) == []
    assert not out.exists()


def test_union_shards_allows_other_columns(make):
    both = M.union_shards([make("shard_id string, task_id string", ("a", "t1")), make("shard_id string, task_id string, note string", ("b", "t2", "n"))])
    assert rows(both, "task_id", "note") == [("t1", None), ("t2", "n")]


def test_reason_policy(world, make):
    data = make(ROW, *[(*d[:3], "short" if i == 0 else LONG, "v1", i) for i, d in enumerate(world[2])])
    assert rows(M.sample_audit(data, RULES, "v1"), "task_id", "error") == [("t00", "reason length")]
    assert M.sample_audit(data, RULES, "v1", reason_policy="ratio").count() == 0
    half = make(ROW, *[(*d[:3], "short" if i % 2 else LONG, "v1", i) for i, d in enumerate(world[2])])
    assert M.sample_audit(half, RULES, "v1", reason_policy="ratio").count() == 10
    with pytest.raises(Exception):
        M.sample_audit(data, RULES, "v1", reason_policy="x")
