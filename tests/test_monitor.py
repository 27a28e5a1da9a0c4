import json

import pytest
from pyspark.sql import functions as F

from helpers import rows
from labelloom.operators import monitor as D

STORY = "shard_id string, pos bigint, story_id string, passes boolean"
LOG = "shard_id string, source string, seq bigint, line string"


@pytest.fixture(scope="module")
def stories(make):
    return make(STORY, ("a", 1, "S1", True), ("a", 2, "S2", False), ("a", 3, "S0", None), ("b", 1, "S4", True))


def test_progress_and_pending_order(stories):
    assert rows(D.progress(stories)) == [("a", 1, 3, 2), ("b", 1, 1, 0)]
    assert rows(D.pending_stories(stories)) == [("a", 1, "S2"), ("a", 2, "S0")]


def test_errors_count_lines_not_matches(make):
    logs = make(LOG, ("a", "run", 1, "429 and 429"), ("a", "loop", 1, "overloaded_error"), ("a", "run", 2, "fine"), ("b", "run", 1, "Rate limit"))
    assert rows(D.error_counts(logs)) == [("a", 2), ("b", 0)]


def test_tail_keeps_the_last_in_order(spark):
    logs = spark.range(200).select(F.lit("a").alias("shard_id"), F.when(F.col("id") % 4 == 0, "run").otherwise("loop").alias("source"),
                                   F.col("id").alias("seq"), F.col("id").cast("string").alias("line"))
    tail = D.tail_n(logs, ["shard_id", "source"], "seq", 5)
    assert rows(tail, "source", "rn", "line") == sorted(
        [("run", k + 1, str(180 + 4 * k)) for k in range(5)] + [("loop", k + 1, s) for k, s in enumerate(["194", "195", "197", "198", "199"])])


def test_recent_mean_uses_last_texts(make):
    data = [("a", i, "x" * (10 if i < 60 else 21)) for i in range(100)] + [("b", 1, None), ("c", 1, "xx"), ("c", 2, None)]
    got = D.recent_mean_len(make("shard_id string, seq bigint, reason string", *data))
    assert rows(got) == [("a", (10 * 10 + 40 * 21) // 50), ("c", 2)]


@pytest.mark.parametrize("done,total,want", [(0, 0, "[" + "." * 20 + "]"), (1, 3, "[######..............]"), (5, 5, "[" + "#" * 20 + "]")])
def test_bar(make, done, total, want):
    assert rows(make("d bigint, t bigint", (done, total)).select(D.bar(F.col("d"), F.col("t")))) == [(want,)]


def test_dashboard_total_row(stories, make):
    logs = make(LOG, ("a", "run", 1, "429"))
    verdicts = make("shard_id string, seq bigint, reason string", ("a", 1, "abc"))
    assert rows(D.dashboard(stories, logs, verdicts), "shard", "done", "total", "n_errors", "mean_len") == [
        ("TOTAL", 2, 4, 1, None), ("a", 1, 3, 1, 3), ("b", 1, 1, 0, None)]


@pytest.mark.parametrize("lines,cause", [
    (["fine", "fatal: working tree is dirty outside"], "dirty_tree"),
    (["429", "working tree is dirty"], "dirty_tree"),
    (["You've hit your limit"], "rate_limit"), (["RATE-limit"], "rate_limit"), (["rate limit"], "rate_limit"),
    (["rate_limit_exceeded"], "rate_limit"), (["ratelimit"], "rate_limit"), (["code 429"], "rate_limit"),
    (["overloaded_error"], "other"), ([None], "other"),
])
def test_causes(make, lines, cause):
    tails = make(LOG, *[("a", "run", i, line) for i, line in enumerate(lines)])
    assert rows(D.classify(tails)) == [("a", cause)]


def test_alerts_per_shard_and_sweep(make):
    progress = make("sweep int, shard_id string, done bigint, total bigint",
                    (1, "a", 2, 2), (1, "b", 1, 2), (1, "c", 1, 2), (1, "d", 0, 2), (1, "e", 0, 2), (2, "a", 2, 2), (3, "a", 1, 2))
    alive = make("sweep int, shard_id string, alive boolean", (1, "a", False), (1, "b", True), (1, "c", False), (1, "d", None), (2, "a", False))
    causes = make("sweep int, shard_id string, cause string", (1, "c", "rate_limit"), (1, "d", "dirty_tree"), (3, "a", "other"))
    got = {(r.sweep, r.shard_id): r.alert for r in D.health_alerts(progress, alive, causes, ["sweep"]).collect()}
    assert got == {(1, "a"): "COMPLETE", (1, "b"): "RUNNING", (1, "c"): "RATE_LIMITED", (1, "d"): "DIRTY_INPUT", (1, "e"): "UNKNOWN",
                   (2, "a"): "COMPLETE", (2, None): "READY_TO_MERGE", (3, "a"): "UNKNOWN", (3, None): "ALL_DEAD"}


def test_unexpected_paths(make):
    paths = make("path string", ("src/x",), (".shard-a/y",), ("ok.txt",))
    assert rows(D.unexpected_paths(paths, make("path string", ("ok.txt",)))) == [("src/x",)]


def test_status_text_in_a_zone(stories, make):
    alive = make("shard_id string, alive boolean", ("a", True))
    out = D.status_json(D.progress(stories), alive, 3, F.lit("2024-01-01 00:00:00").cast("timestamp"), "Asia/Shanghai")
    got = {r.shard_id: json.loads(r.status) for r in out.collect()}
    assert got["a"] == {"ts": "2024-01-01 08:00:00", "iteration": 3, "shard": "a", "alive": True, "done": 1, "total": 3, "n_pending": 2}
    assert got["b"]["alive"] is False
