import pytest

from helpers import rows
from labelloom.operators import state as L

STORY = "shard_id string, pos bigint, story_id string, priority bigint, passes boolean"


@pytest.fixture(scope="module")
def stories(make):
    return make(STORY, ("a", 1, "S1", 1, True), ("a", 2, "S2", 5, False), ("a", 3, "S3", 2, None), ("a", 4, "S4", 2, False), ("b", 1, "S5", 1, True))


def test_next_story_least_priority_then_position(stories):
    assert rows(L.next_story(stories)) == [("a", "S3"), ("b", "ALL_DONE")]


def test_circuit_break_counts_and_trips(stories, make):
    counters = make("shard_id string, story_id string, counter_text string",
                    ("a", "S1", "3"), ("a", "S2", "2"), ("a", "S3", "x1"), ("a", "S4", "-7"), ("b", "S5", "99999999999999999999"))
    assert rows(L.circuit_break(stories, counters), "story_id", "attempt", "tripped", "priority") == [
        ("S1", 4, True, 99999), ("S2", 3, False, 5), ("S3", 1, False, 2), ("S4", 1, False, 2), ("S5", 1, False, 1)]
    assert rows(L.circuit_break(stories, counters.limit(0)), "attempt") == [(1,)] * 5


def test_circuit_break_of_picked_stories_only(stories, make):
    counters = make("shard_id string, story_id string, counter_text string", ("a", "S1", "9"), ("a", "S2", "3"))
    picked = make("shard_id string, story_id string", ("a", "S2"), ("b", "ALL_DONE"))
    assert rows(L.circuit_break(stories, counters, picked=picked), "story_id", "attempt", "tripped", "priority") == [
        ("S1", 9, False, 1), ("S2", 4, True, 99999), ("S3", 0, False, 2), ("S4", 0, False, 2), ("S5", 0, False, 1)]


def test_reset_touches_only_pending_of_dead_shards(stories, make):
    retries = make("shard_id string, story_id string, n bigint", ("a", "S1", 1), ("a", "S2", 2), ("b", "S5", 3))
    out, left = L.reset_pending(stories, retries, make("shard_id string, alive boolean", ("b", True)))
    assert rows(out, "story_id", "priority") == [("S1", 1), ("S2", 2), ("S3", 3), ("S4", 4), ("S5", 1)]
    assert rows(left, "story_id") == [("S1",), ("S5",)]
    out, left = L.reset_pending(stories, retries, make("shard_id string, alive boolean", ("a", True)))
    assert rows(out, "priority") == rows(stories, "priority") and left.count() == 3


SNAP = "iteration bigint, story_id string, passes boolean"
BEFORE = [(i, s, s == "done") for i in range(1, 8) for s in ("done", "lock", "free")]


def flip(iteration, **new):
    return [(iteration, s, new.get(s, s == "done")) for s in ("done", "lock", "free")]


@pytest.fixture(scope="module")
def snaps(make):
    after = (flip(1) + flip(2, lock=True) + flip(3, lock=True, free=True) + flip(4, done=False) + [*flip(5), (5, "new", False)]
             + flip(6)[1:] + [(7, "done", False), (7, "lock", False), (7, "free", False)])
    locks = make("iteration bigint, locked_id string", *[(i, "lock") for i in range(1, 7)], (7, "done"))
    return make(SNAP, *BEFORE), make(SNAP, *after), locks


def test_snapshot_diff(snaps):
    assert rows(L.snapshot_diff(*snaps), "iteration", "result") == [
        (1, "NO_CHANGE"), (2, "OK"), (3, "VIOLATION"), (4, "VIOLATION"), (5, "VIOLATION"), (6, "NO_CHANGE"), (7, "OK_NO_PASS")]
    deleted = L.snapshot_diff(*snaps, detect_deleted=True)
    assert rows(deleted.where("iteration = 6"), "result") == [("VIOLATION",)]


def test_heal_restores_and_is_idempotent(snaps, make):
    before, after, locks = snaps
    healed = L.heal(before, after, locks)
    assert rows(healed.where("healed"), "iteration", "story_id", "passes") == [(3, "free", False), (4, "done", True)]
    assert rows(healed.where("iteration = 3 AND story_id = 'lock'"), "passes") == [(True,)]
    assert L.heal(before, healed.drop("healed"), locks).where("healed").count() == 0


def test_claims_need_a_finished_shard(stories, make):
    outputs = make("iteration bigint, shard_id string, output string", (1, "a", "x <promise>COMPLETE</promise>"), (2, "b", "<promise>COMPLETE</promise>"),
                   (3, "a", "<promise>YIELD</promise>\n"), (4, "a", "VIOLATION: S1 failed"), (5, "a", "<promise>VIOLATION</promise>"), (6, "a", "COMPLETE"), (7, "a", None))
    assert rows(L.claims(outputs, stories), "iteration", "token", "believed") == [
        (1, "COMPLETE", False), (2, "COMPLETE", True), (3, "YIELD", True), (4, "VIOLATION", True), (5, "VIOLATION", True),
        (6, None, False), (7, None, False)]


@pytest.mark.parametrize("passed,total,percent", [(0, 0, 0), (1, 8, 12), (3, 8, 38), (1, 3, 33), (2, 2, 100)])
def test_summary_rounds_half_to_even(make, passed, total, percent):
    data = make(STORY, *[("a", i, f"S{i}", i, i < passed) for i in range(total)])
    assert rows(L.summary(data)) == [(passed, total, percent)]
    assert L.summary_rows(data).where("status = 'PASS'").count() == passed


@pytest.mark.parametrize("limit,seconds,code,want", [
    ("1200", 1200, 0, (1200, "OK", 0)), ("1200", 1201, 0, (1200, "TIMEOUT", 124)), ("1200", 5, 7, (1200, "ERROR", 7)),
    ("-5", 1800, 0, (1800, "OK", 0)), ("abc", 1801, 1, (1800, "TIMEOUT", 124)), (None, 1, 0, (1800, "OK", 0)), ("0", 1, 0, (1800, "OK", 0)),
])
def test_run_outcomes(make, limit, seconds, code, want):
    runs = make("run_id int, story_id string, seconds bigint, exit_code bigint", (1, "S1", seconds, code))
    got = L.run_outcomes(runs, make("story_id string, timeout_text string", ("S1", limit)))
    assert rows(got, "limit_seconds", "outcome", "code") == [want]
