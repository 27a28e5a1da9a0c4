import pytest
from pyspark.sql import functions as F

from helpers import rows
from labelloom.model import PlanError
from labelloom.operators import rebalance as R
from labelloom.operators.audit import coverage

MEMBER = "shard_id string, batch_idx bigint, task_id string, pos bigint"


@pytest.fixture(scope="module")
def members(make):
    data = [("abcd"[i // 30], i // 10 + 1, f"t{i:03d}", i + 1) for i in range(120)]
    return make(MEMBER, *data, ("d", 12, "t060", 999))


@pytest.fixture(scope="module")
def verdicts(make):
    return make("shard_id string, task_id string", *[("c", f"t{i:03d}") for i in range(60, 75)], ("a", "t089"))


@pytest.fixture(scope="module")
def plan(members, verdicts):
    pooled = R.pool(R.drain(members, verdicts, ["d", "c"]), ["d", "c"])
    return R.rebatch(pooled, ["a", "b"], 10)


def test_drain_is_per_shard(members, verdicts):
    drained = R.drain(members, verdicts, ["c", "d"])
    assert rows(R.drain_counts(drained)) == [("c", 15), ("d", 31)]
    seen_or_drained = drained.select("task_id").union(verdicts.select("task_id"))
    assert rows(coverage(seen_or_drained, members.where("shard_id IN ('c', 'd')")), "n_missing") == [(0,)]


def test_pool_takes_first_shard_in_given_order(members, make):
    none = make("shard_id string, task_id string")
    both = R.drain(members, none, ["c", "d"])
    first = {r.task_id: r.shard_id for r in R.pool(both, ["d", "c"]).collect()}
    assert first["t060"] == "d" and len(first) == 60
    assert {r.task_id: r.shard_id for r in R.pool(both, ["c", "d"]).collect()}["t060"] == "c"


def test_round_robin(plan):
    got = plan.groupBy("slice", "target", "ordinal").agg(F.count("*").alias("n"))
    assert rows(got) == [(0, "a", 0, 10), (1, "b", 0, 10), (2, "a", 1, 10), (3, "b", 1, 10), (4, "a", 2, 6)]
    order = [r.task_id for r in plan.orderBy("pool_pos").collect()]
    assert order[:30] == [f"t{i:03d}" for i in range(90, 120)] and order[30] == "t060" and order[31:] == [f"t{i:03d}" for i in range(75, 90)]


def test_new_numbers(plan, make):
    existing = make("shard_id string, batch_idx bigint", *[("abcd"[(i - 1) // 3], i) for i in range(1, 13)])
    everywhere = R.new_batches(R.next_ids(plan, existing))
    assert rows(everywhere, "batch_idx", "shard_id", "n_tasks") == [(13, "a", 10), (14, "b", 10), (15, "a", 10), (16, "b", 10), (17, "a", 6)]
    assert R.collisions(everywhere, existing).count() == 0
    mine = R.new_batches(R.next_ids(plan, existing, "target"))
    assert rows(mine, "shard_id", "batch_idx") == [("a", 4), ("a", 5), ("a", 6), ("b", 7), ("b", 8)]
    assert rows(R.collisions(mine, existing), "batch_idx") == [(4,), (5,), (6,), (7,), (8,)]
    assert R.collisions(mine, existing, "target").count() == 0
    with pytest.raises(PlanError):
        R.next_ids(plan, existing, "other")


def test_append_plan_grows_tables(plan, make):
    batches = make("shard_id string, batch_idx bigint, story_id string, n_tasks bigint", ("a", 1, "BATCH-001", 30), ("b", 2, "BATCH-002", 30))
    stories = make("shard_id string, story_id string, pos bigint, priority bigint, passes boolean, attempts bigint",
                   ("a", "BATCH-001", 1, 7, True, 1), ("b", "BATCH-002", 1, 2, False, 3))
    out = R.append_plan(batches, stories, R.next_ids(plan, batches))
    assert rows(out["totals"]) == [("a", 4, 56), ("b", 3, 50)]
    assert rows(out["stories"], "story_id", "pos", "priority", "passes", "attempts", "timeout_text") == [
        ("BATCH-001", 1, 7, True, 1, None), ("BATCH-002", 1, 2, False, 3, None), ("BATCH-003", 2, 8, False, 0, "2400"),
        ("BATCH-004", 2, 3, False, 0, "2400"), ("BATCH-005", 3, 9, False, 0, "2400"), ("BATCH-006", 3, 4, False, 0, "2400"),
        ("BATCH-007", 4, 10, False, 0, "2400")]
    log = out["log"].collect()
    assert {r.shard_id: (r.first_batch, r.last_batch, r.added_batches, r.added_tasks) for r in log} == {
        "a": (3, 7, 3, 26), "b": (4, 6, 2, 20)}
    assert log[0].ts.endswith("Z") and len(log[0].ts) == 20


def test_empty_pool_gives_empty_plan(members, verdicts, make):
    everything = members.select("shard_id", "task_id")
    empty = R.rebatch(R.pool(R.drain(members, everything, ["c"]), ["c"]), ["a"])
    assert empty.count() == 0


def test_checks():
    R.check_rebalance(["c", "d"], ["a", "b"])
    R.check_rebalance(["a", "b"], [], "baseline")
    for args in ((["a", "b"], ["b"]), (["a"], []), (["a"], ["b"], "elsewhere")):
        with pytest.raises(PlanError):
            R.check_rebalance(*args)


def test_reassigned_tasks_count_once(members, verdicts, make):
    drained = R.drain(members, verdicts, ["c", "d"])
    plan = R.next_ids(R.rebatch(R.pool(drained, ["c", "d"]), ["a", "b"], 10), members)
    moved = R.reassign(R.first_assignments(members), drained, plan, 1)
    active = R.active_members(moved)
    assert rows(active.groupBy("shard_id").count()) == [("a", 56), ("b", 50), ("c", 15)]
    everything = members.select("task_id").distinct()
    assert rows(coverage(active, everything), "n_missing", "n_extra") == [(0, 0)]
    # t060 was seen in shard c and pending in d, so it stays with c and, last in the pool (slice 4), goes to a.
    assert rows(active.where("task_id = 't060'"), "shard_id") == [("a",), ("c",)]
    assert moved.where("NOT active").count() == 46
