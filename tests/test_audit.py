"""Mutation tests: one injected fault must fail exactly the matching layers."""

import random
import re
from datetime import date, datetime, timedelta
from decimal import Decimal
from itertools import combinations, product

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import rows
from labelloom.model import AuditError
from labelloom.operators import audit as A
from labelloom.operators import pair_tiles
from labelloom.operators.report import assert_clean

MEMBERS = [(s, b, f"task_{b:03d}_{j}") for b in range(1, 5) for s in ["a" if b < 3 else "b"] for j in range(3)]


def audit(make, members=MEMBERS, baseline=None, declared=(("a", 6), ("b", 6)), stories=None, shard_rows=None, total=12):
    batches = [("a", "B1"), ("a", "B2"), ("b", "B3"), ("b", "B4")]
    m = make("shard_id string, batch_idx bigint, task_id string", *members)
    base = make("shard_id string, batch_idx bigint, task_id string", *(baseline or MEMBERS))
    content = m if shard_rows is None else make("shard_id string, batch_idx bigint, task_id string", *shard_rows)
    return A.audit_all(m, base, make("shard_id string, total_tasks bigint", *declared),
                       make("shard_id string, story_id string", *(batches if stories is None else stories)),
                       make("shard_id string, story_id string", *batches), content, base, ["task_id"], total)


def failed(report):
    return sorted({r.layer[0] for r in report.where("NOT passed").collect()})


def test_clean_plan_passes(make):
    report = audit(make)
    assert failed(report) == []
    assert_clean(report)


def test_lost_id(make):
    report = audit(make, MEMBERS[1:])
    assert failed(report) == ["1", "3", "4"]
    with pytest.raises(AuditError) as e:
        assert_clean(report)
    assert any("task_001_0" in f for f in e.value.failures)


def test_id_in_two_shards(make):
    report = audit(make, [*MEMBERS, ("a", 1, "DUP"), ("b", 3, "DUP")], declared=(("a", 7), ("b", 7)),
                   baseline=[*MEMBERS, ("", 1, "DUP")], total=13, shard_rows=[*MEMBERS, ("", 1, "DUP")])
    assert failed(report) == ["2"]


def test_repeat_inside_a_shard(make):
    report = audit(make, [*MEMBERS, MEMBERS[0]], shard_rows=MEMBERS)
    assert [(r.layer, r.n_bad, r.example) for r in report.where("NOT passed").collect()] == [("1 repeats", 1, "task_001_0")]


def test_dropped_story(make):
    assert failed(audit(make, stories=[("a", "B1"), ("a", "B2"), ("b", "B3")])) == ["5"]


def test_changed_batch_content(make):
    swapped = [*MEMBERS[1:], ("a", 1, "other")]
    assert failed(audit(make, shard_rows=swapped)) == ["4"]


def test_wrong_declared_total(make):
    assert failed(audit(make, total=11)) == ["0"]
    assert failed(audit(make, declared=(("a", 6), ("b", 5)))) == ["1"]
    assert failed(audit(make, declared=(("a", 6), ("b", 6), ("c", 4)))) == ["1"]


def test_batch_content_states(make):
    schema = "batch_idx bigint, task_id string, text string"
    base = make(schema, (1, "a", "x"), (1, "b", "y"), (2, "c", "z"), (3, "d", "w"))
    ours = make(schema, (1, "b", "y"), (1, "a", "x"), (2, "c", "Z"), (9, "n", "new"))
    got = rows(A.audit_batch_content(ours, base, ["task_id", "text"]), "batch_idx", "status", "passed")
    assert got == [(1, "same", True), (2, "different", False), (3, "absent", False), (9, "rewritten", True)]
    strict = A.audit_batch_content(ours, base, ["task_id", "text"], allow_rewritten=False)
    assert rows(strict.where("batch_idx = 9"), "passed") == [(False,)]


def test_batch_content_sees_doubled_pairs(make):
    base = make("batch_idx bigint, task_id string", (1, "a"), (1, "b"))
    assert rows(A.audit_batch_content(make("batch_idx bigint, task_id string", (1, "a"), (1, "a")), base, ["task_id"]),
                "status") == [("different",)]


@pytest.mark.parametrize("n_shards", [5, 70])
def test_disjoint_matches_brute_force(spark, make, n_shards):
    rng = random.Random(n_shards)
    names = [f"s{i:03d}" for i in range(n_shards)]
    data = [(rng.choice(names), rng.randrange(40)) for _ in range(300)] + [(n, 7) for n in names] * 2
    sets = {n: {t for s, t in data if s == n} for n in names}
    want = []
    for x, y in combinations(names, 2):
        shared = sets[x] & sets[y]
        want.append((x, y, len(shared), str(min(shared)) if shared else None, not shared))
    members = make("shard_id string, task_id bigint", *data)
    columns = ["shard_a", "shard_b", "n_shared", "example", "passed"]
    assert rows(A.audit_disjoint(members, every=True), *columns) == sorted(want)
    assert rows(A.audit_disjoint(members), *columns) == sorted(w for w in want if w[2])


@pytest.mark.parametrize("n_shards", [2, 600])
def test_null_shard_is_a_shard_for_any_number_of_shards(make, n_shards):
    names = [f"s{i:03d}" for i in range(n_shards)]
    data = [(n, i) for i, n in enumerate(names)] + [(None, n_shards), (None, 0)]
    m = make("shard_id string, task_id bigint", *data)
    base = make("task_id bigint", *[(i,) for i in range(n_shards + 1)])
    stories = make("shard_id string, story_id string", ("s000", "B1"))
    report = A.audit_all(m, base, make("shard_id string, total_tasks bigint", *[(n, 1) for n in names]), stories, stories)
    bad = {(r.layer[0], r.subject, r.n_bad) for r in report.where("NOT passed").collect()}
    assert bad == {("1", "NULL", 2), ("2", "NULL/s000", 1)}


def test_hot_id_counts_once(spark):
    hot = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("task_id"), F.lit("a").alias("shard_id"))
    assert rows(A.audit_internal_dups(hot), "n_dups", "examples") == [(999, "0")]
    assert rows(A.coverage(hot, spark.range(3000).select(F.col("id").alias("task_id"))), "n_missing", "n_extra") == [(999, 0)]


def test_pairs_of_shards_meet_by_blocks(spark, make, monkeypatch):
    from labelloom.operators import audit as A

    monkeypatch.setattr(A, "PAIR_BLOCK", 3)
    names = [f"s{k:02d}" for k in range(11)] + [None]
    members = make("shard_id string, task_id int", *[(s, k) for k, s in enumerate(names)], ("s03", 7))
    got = A.audit_disjoint(members, every=True)
    assert got.count() == 66 and rows(got.where("NOT passed"), "shard_a", "shard_b", "n_shared") == [("s03", "s07", 1)]
    assert rows(got.where("shard_a IS NULL").select("shard_b")) == [(s,) for s in names[:-1]] and got.where("shard_b IS NULL").isEmpty()


@pytest.mark.parametrize("tile", [10, 400])
def test_pairs_of_many_shards_are_added_up_in_tiles(make, monkeypatch, tile):
    rng = random.Random(tile)
    names = [f"s{k:02d}" for k in range(40)] + [None]
    data = [(rng.choice(names), rng.randrange(60)) for _ in range(400)] + [(n, 60) for n in names]
    members = make("shard_id string, task_id int", *data)
    columns = ["shard_a", "shard_b", "n_shared", "example", "passed"]
    plain = rows(A.audit_disjoint(members), *columns)
    monkeypatch.setattr(A, "SHUFFLED_PAIRS", 0)
    monkeypatch.setattr(A, "TILE_PAIRS", tile)
    got = A.audit_disjoint(members)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(shard_a" not in plan and len(plain) == 41 * 40 // 2
    assert rows(got, *columns) == plain


KINDS = {
    "string": lambda k: f"s{k:02d}", "bigint": lambda k: 10**12 - k, "date": lambda k: date(2020, 1, 1) + timedelta(k), "decimal(20,2)": lambda k: Decimal(k) / 4,
    "boolean": lambda k: k % 2 == 0, "timestamp": lambda k: datetime(2020, 1, 1, k), "double": lambda k: k / 3, "struct<a:int,b:string>": lambda k: (k % 3, str(k)),
}


@pytest.mark.parametrize("kind", KINDS)
def test_tiles_find_the_pairs_without_a_hash_table_of_pairs(make, monkeypatch, kind):
    rng = random.Random(7)
    names = [*map(KINDS[kind], range(12)), None]
    # Ids 30 and up come in sets that are the same; a NULL id is an id, but no example beside another one.
    data = [(rng.choice(names), rng.randrange(30)) for _ in range(90)] + [(n, k) for n in names[:5] for k in range(30, 36)]
    data += [(n, None) for n in (*names[:3], None, names[7])]
    members = make(f"shard_id {kind}, task_id int", *data)
    columns = ["shard_a", "shard_b", "n_shared", "example", "passed"]
    plain = rows(A.audit_disjoint(members), *columns)
    monkeypatch.setattr(A, "SHUFFLED_PAIRS", 0)
    monkeypatch.setattr(A, "TILE_PAIRS", 60)
    got = A.audit_disjoint(members)
    assert rows(got, *columns) == plain and plain
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert bool(re.search(r"Aggregate\(keys=\[[^]]*shard_a", plan)) == (kind in ("double", "struct<a:int,b:string>"))


def test_blocks_bound_the_pairs_and_the_names_of_a_tile(monkeypatch):
    assert A._blocks(0, 0) == 1
    assert A._blocks(17_000_000_000, 9_000_000) == 33
    # Sets of two: a tile has as many names as pairs, twice.
    blocks = A._blocks(50_000_000, 100_000_000)
    assert 4 * 50_000_000 / blocks**2 <= A.TILE_NAMES


@pytest.mark.parametrize(("chunk", "cells"), [(131_072, 4_000_000), (1, 4_000_000), (50, 3), (131_072, 3)])
@pytest.mark.parametrize("weights", [(1,), (1, 2, 5)])
def test_tiles_in_pieces_of_any_size(monkeypatch, chunk, cells, weights):
    monkeypatch.setattr(pair_tiles, "CHUNK", chunk)
    monkeypatch.setattr(pair_tiles, "CELLS", cells)
    rng = random.Random(chunk)
    table, want = [], {}
    for tile in range(3):
        low, high = [None if (tile, c) == (1, "a") else f"{c}{tile}" for c in "abcdefg"], [f"{c}{tile}" for c in "ABCDEFGHIJK"]
        for k in range(25):
            n, example = rng.choice(weights), f"{k:02d}"
            x, y = rng.sample(low, rng.randint(1, len(low))), rng.sample(high, rng.randint(1, len(high)))
            parts = [(pair_tiles.BOTH, x)] if tile == 2 else [(pair_tiles.LOW, x), (pair_tiles.HIGH, y)]
            table += [{"_tile": tile, "_side": side, "_set": k, "n": n, "example": example, "names": names} for side, names in parts]
            for pair in map(frozenset, combinations(x, 2) if tile == 2 else product(x, y)):
                before = want.get(pair, (0, example))
                want[pair] = before[0] + n, before[1]
    schema = pa.schema({"_tile": pa.int32(), "_side": pa.int32(), "_set": pa.int64(), "n": pa.int64(), "example": pa.string(), "names": pa.list_(pa.string())})
    found = [(frozenset((row["shard"], other)), (row["n"], row["example"]))
             for batch in pair_tiles._count(iter(pa.Table.from_pylist(table, schema).to_batches(max_chunksize=7))) for row in batch.to_pylist() for other in row["others"]]
    assert len(found) == len(want) and dict(found) == want
