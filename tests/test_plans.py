import pytest
from pyspark.sql import functions as F

from helpers import rows
from labelloom.model import PlanError
from labelloom.plans.batches import batch_table, batchify, render_template, shard_prompt_columns
from labelloom.plans.shards import (assert_ranges, assign_ranges, auto_split, check_plan, check_ranges, even_ranges,
                                    named_ranges, parse_splits, range_table, shard_headers, shard_manifest)
from labelloom.plans.stories import rebase_stories, refresh_stories


def test_parse_splits_reads_text_and_json():
    assert parse_splits("1-7,8-19,20-21") == [(1, 7), (8, 19), (20, 21)]
    assert parse_splits("  5-8") == [(5, 8)]
    assert parse_splits('{"splits": [[2, 6], [7, 7]]}') == [(2, 6), (7, 7)]
    assert parse_splits("[[9, 11]]") == [(9, 11)]


@pytest.mark.parametrize("text", ["a-4", "9-2", "7", "-", '{"splits": "x"}', "[[4]]"])
def test_parse_splits_refuses(text):
    with pytest.raises(PlanError):
        parse_splits(text)


@pytest.mark.parametrize("n,total,want", [
    (3, 9, [(1, 3), (4, 6), (7, 9)]),
    (1, 6, [(1, 6)]),
])
def test_even_ranges(n, total, want):
    assert [(r.lo, r.hi) for r in even_ranges(total, n)] == want


@pytest.mark.parametrize("n,total", [(2, 17), (5, 31), (8, 8), (7, 100)])
def test_even_ranges_partition_all_batches(n, total):
    ranges = even_ranges(total, n)
    assert [k for r in ranges for k in range(r.lo, r.hi + 1)] == list(range(1, total + 1))
    assert max(r.hi - r.lo for r in ranges) - min(r.hi - r.lo for r in ranges[:-1] or ranges) <= total % n


def test_even_ranges_refuses_more_shards_than_batches():
    with pytest.raises(PlanError):
        even_ranges(3, 5)


def test_range_labels_and_letters():
    ranges = named_ranges([(1, 5), (6, 10), (11, 15)], 3)
    assert [r.shard_id for r in ranges] == ["a", "b", "c"]
    assert ranges[2].label == "BATCH-011..BATCH-015" and ranges[2].n_batches == 5
    with pytest.raises(PlanError):
        named_ranges([(1, 5)], 3)
    with pytest.raises(PlanError):
        even_ranges(100, 27)
    assert even_ranges(100, 27, wide=True)[26].shard_id == "s00026"


@pytest.mark.parametrize("splits,total,kinds", [
    ([(1, 7), (8, 19), (20, 21)], 21, []),
    ([(1, 9), (6, 14)], 14, ["overlap"]),
    ([(1, 4), (8, 11)], 11, ["gap"]),
    ([(1, 6), (7, 40)], 25, ["out_of_range"]),
    ([(0, 9)], 9, ["out_of_range", "overlap"]),
    ([(2, 4)], 6, ["gap", "gap"]),
    ([(1, 3), (6, 5), (7, 8)], 8, ["gap", "gap", "inverted"]),
])
def test_check_ranges(spark, splits, total, kinds):
    table = range_table(spark, named_ranges(splits)).withColumn("total", F.lit(total))
    assert sorted(r.kind for r in check_ranges(table, "total").collect()) == kinds
    if kinds:
        with pytest.raises(PlanError):
            assert_ranges(spark, named_ranges(splits), total)
    else:
        assert_ranges(spark, named_ranges(splits), total)


def test_assert_ranges_refuses_nothing(spark):
    with pytest.raises(PlanError):
        assert_ranges(spark, [], 3)


@pytest.fixture(scope="module")
def plan(spark):
    tasks = spark.range(1, 24).select(F.format_string("t%03d", "id").alias("task_id"))
    batch_tasks = batchify(tasks, ["task_id"], 5)
    return batch_tasks, batch_table(batch_tasks)


def test_batches_partition_tasks_in_order(plan):
    batch_tasks, batches = plan
    assert rows(batches, "batch_idx", "story_id", "n_tasks") == [
        (1, "BATCH-001", 5), (2, "BATCH-002", 5), (3, "BATCH-003", 5), (4, "BATCH-004", 5), (5, "BATCH-005", 3)]
    assert rows(batch_tasks, "pos", "task_id") == [(i, f"t{i:03d}") for i in range(1, 24)]
    with pytest.raises(PlanError):
        batchify(batch_tasks, ["task_id"], 0)


def test_split_agrees_between_closed_form_and_ranges(spark, plan):
    _, batches = plan
    closed = rows(auto_split(batches, 2), "batch_idx", "shard_id")
    joined = rows(assign_ranges(batches, range_table(spark, even_ranges(5, 2))), "batch_idx", "shard_id")
    assert closed == joined == [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "b")]


def test_wide_splits_name_shards_beyond_the_alphabet(spark):
    batches = spark.range(1, 61).select(F.col("id").alias("batch_idx"))
    with pytest.raises(PlanError):
        auto_split(batches, 30)
    got = dict(rows(auto_split(batches, 30, wide=True), "batch_idx", "shard_id"))
    assert (got[1], got[2], got[3], got[52], got[53], got[60]) == ("a", "a", "b", "z", "s00026", "s00029")
    joined = assign_ranges(batches, range_table(spark, even_ranges(60, 30, wide=True)))
    assert dict(rows(joined, "batch_idx", "shard_id")) == got


def test_ranges_pick_a_subset(spark, make):
    batches = make("batch_idx bigint", *[(i,) for i in range(1, 11)])
    got = assign_ranges(batches, range_table(spark, named_ranges([(3, 6)])))
    assert rows(got, "batch_idx") == [(3,), (4,), (5,), (6,)]


def test_manifest_totals_and_carried_header(plan, make):
    assigned = auto_split(plan[1], 2)
    header = make("source string, schema_version string, batch_size int", ("src", "v1", 5))
    heads, listed = shard_manifest(assigned, header)
    assert rows(heads, "shard_id", "batch_range", "n_batches", "total_tasks", "shard_root", "source", "batch_size") == [
        ("a", "BATCH-001..BATCH-002", 2, 10, ".shard-a", "src", 5), ("b", "BATCH-003..BATCH-005", 3, 13, ".shard-b", "src", 5)]
    assert rows(listed.where("shard_id = 'b'"), "seq", "story_id", "input_file") == [
        (1, "BATCH-003", ".shard-b/stories/batch-003.jsonl"), (2, "BATCH-004", ".shard-b/stories/batch-004.jsonl"),
        (3, "BATCH-005", ".shard-b/stories/batch-005.jsonl")]


def test_check_plan_flags_each_fault(plan, make):
    assigned = auto_split(plan[1], 2)

    def failed(n_batches, total, **kw):
        report = check_plan(make("n_batches int, total_tasks int", (n_batches, total)), plan[1], shard_headers(assigned), **kw)
        return {r.subject for r in report.where("NOT passed").collect()}

    assert failed(5, 23) == set()
    assert failed(6, 23) == {"n_batches matches batch rows"}
    assert failed(5, 22) == {"shard totals add up"}
    assert failed(0, 0) == {"n_batches positive", "total_tasks positive", "n_batches matches batch rows", "shard totals add up"}
    assert failed(None, 23) == {"n_batches positive", "n_batches matches batch rows"}
    assert failed(5, 0, allow_empty=True) == {"shard totals add up"}


STORY = "story_id string, pos bigint, priority bigint, modifies array<string>"


def test_rebase_ranks_by_priority_then_position(make):
    stories = make(STORY, ("S1", 1, 9, [".baseline/state/v", "x/.baseline/"]), ("S2", 2, 1, None), ("S3", 3, 9, []), ("S4", 4, 2, []))
    homes = make("story_id string, shard_id string", ("S1", "a"), ("S2", "b"), ("S3", "a"), ("S4", "a"))
    out = rebase_stories(stories, homes)
    assert rows(out, "shard_id", "priority", "story_id", "passes", "attempts") == [
        ("a", 1, "S4", False, 0), ("a", 2, "S1", False, 0), ("a", 3, "S3", False, 0), ("b", 1, "S2", False, 0)]
    assert rows(out.where("story_id = 'S1'"), "modifies") == [([".shard-a/state/v", "x/.baseline/"],)]


def test_refresh_keeps_known_state(make):
    new = make("shard_id string, story_id string, passes boolean, attempts bigint", ("a", "S1", False, 0), ("a", "S2", False, 0))
    old = make("shard_id string, story_id string, passes boolean, attempts bigint", ("a", "S1", True, 2), ("b", "S2", True, 9))
    assert rows(refresh_stories(new, old), "story_id", "passes", "attempts") == [("S1", True, 2), ("S2", False, 0)]


def test_templates_fill_known_names_only(make):
    df = make("a string, b int", ("{{B}}", 7), (None, 1))
    out = render_template(df, "{{A}}-{{B}}-{{C}}", {"A": "a", "B": "b"})
    assert rows(out, "prompt") == [("-1-{{C}}",), ("{{B}}-7-{{C}}",)]  # NULL is empty, a value is not filled again


def test_shard_prompt(plan):
    heads, _ = shard_manifest(auto_split(plan[1], 2))
    out = render_template(heads, "# {{SHARD_ID}} {{BATCH_RANGE}} {{N_TASKS}} tasks", shard_prompt_columns(F.col("shard_root")))
    assert rows(out, "prompt") == [("# a BATCH-001..BATCH-002 10 tasks",), ("# b BATCH-003..BATCH-005 13 tasks",)]
