import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import LONG, rows
from labelloom.model import AuditError, PlanError, VerdictSchema
from labelloom.operators.merge import merge_commit
from labelloom.sources import versions as W
from labelloom.sources.sinks import write_placed

STATE = {"verdicts": T.StructType([T.StructField("task_id", T.StringType())])}


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "project")


def plan_of(spark, root):
    return rows(W.read_table(spark, root, "plan"))


def publish(spark, make, root, value, mode="default"):
    return W.publish_versions(spark, root, {"plan": make("v int", (value,)), "more": make("v int", (value * 10,))}, STATE, mode)


def test_modes(spark, make, root):
    assert W.current(spark, root) is None
    with pytest.raises(PlanError):
        publish(spark, make, root, 1, "refresh")
    assert publish(spark, make, root, 1) == 1 and publish(spark, make, root, 2) == 2
    W.write_version(spark, root, lambda d: (d.keep("plan"), d.keep("more"), d.write("verdicts", make("task_id string", ("t1",)))), "verdicts")
    with pytest.raises(PlanError):
        publish(spark, make, root, 3)
    assert publish(spark, make, root, 3, "refresh") == 4
    assert plan_of(spark, root) == [(3,)] and rows(W.read_table(spark, root, "verdicts")) == [("t1",)]
    assert publish(spark, make, root, 4, "force") == 5
    assert W.read_table(spark, root, "verdicts").count() == 0
    with pytest.raises(PlanError):
        publish(spark, make, root, 5, "other")
    assert [c["note"] for c in W.history(spark, root)] == ["default", "default", "verdicts", "refresh", "force"]
    old = W.history(spark, root)[0]
    assert rows(W.read_table(spark, root, "plan", commit=old)) == [(1,)]


def test_a_writer_that_dies_at_any_step_changes_nothing(spark, make, root, monkeypatch):
    """Every call of the draft and of the file system is a place to die; readers see whole versions only."""
    publish(spark, make, root, 1)
    seen, real = [], W._fs

    class Dying:
        def __init__(self, fs, calls, limit):
            self.fs, self.calls, self.limit = fs, calls, limit

        def __getattr__(self, name):
            self.calls.append(name)
            if len(self.calls) > self.limit:
                raise KeyboardInterrupt(name)
            return getattr(self.fs, name)

    for limit in range(40):
        calls = []

        def wrapped(s, p, calls=calls, limit=limit):
            fs, path = real(s, p)
            return Dying(fs, calls, limit), path

        monkeypatch.setattr(W, "_fs", wrapped)
        monkeypatch.setattr(W.Draft, "discard", lambda self: None)  # a lost process cleans nothing up
        try:
            number = publish(spark, make, root, 100 + limit)
        except KeyboardInterrupt:
            number = None
        monkeypatch.undo()
        state = (plan_of(spark, root), rows(W.read_table(spark, root, "more")))
        assert state in ([([(1,)], [(10,)])] if number is None and "rename" not in calls[:limit] else [([(100 + limit,)], [((100 + limit) * 10,)])])
        seen.append(calls[-1])
        if number:
            break
    assert number and "create" in seen and "rename" in seen
    assert len(W.prune(spark, root, 1)) >= 2 and plan_of(spark, root) == [(100 + limit,)]


def test_of_two_writers_the_later_one_is_refused(spark, make, root):
    publish(spark, make, root, 1)
    one, two = W.Draft(spark, root), W.Draft(spark, root)
    for draft, value in ((one, 2), (two, 3)):
        draft.write("plan", make("v int", (value,)))
    one.commit()
    with pytest.raises(PlanError, match="another writer"):
        two.commit()
    assert plan_of(spark, root) == [(2,)]


def test_prune_keeps_what_the_last_commits_use(spark, make, root):
    for value in range(4):
        publish(spark, make, root, value)
    W.write_version(spark, root, lambda d: d.keep("plan"))
    assert len(W.prune(spark, root, 1)) == 3
    assert plan_of(spark, root) == [(3,)]
    assert W.prune(spark, root + "-none") == []


RULES = VerdictSchema(valid_qa=("yes", "no"))
ROW = "shard_id string, task_id string, qa string, reason string, schema_version string"


def merge_inputs(make, n=23):
    data = make(ROW, *[("a" if k % 2 else "b", f"t{k:02d}", "yes", LONG, "v1") for k in range(n)])
    base = make("task_id string, batch_idx bigint, pos bigint", *[(f"t{k:02d}", k // 5 + 1, n - k) for k in range(n)])
    declared = make("shard_id string, total_tasks bigint", ("a", n // 2), ("b", n - n // 2))
    return data, base, declared


def ordered(spark, path):
    files = sorted({r.f for r in spark.read.text(path).select(F.col("_metadata.file_path").alias("f")).collect()})
    return [r.task_id for f in files for r in spark.read.json(f).collect()], len(files)


def test_merge_is_one_version(spark, make, root):
    data, base, declared = merge_inputs(make)
    prefix = make("task_id string, qa string, reason string, schema_version string, seq bigint", ("p2", "no", LONG, "v0", 2), ("p1", "no", LONG, "v0", 1))
    assert merge_commit(data, base, declared, RULES, "v1", root, 23, prefix, n_files=4) == 1
    want = [f"t{k:02d}" for k in reversed(range(23))]
    assert ordered(spark, W.table_path(spark, root, "merged")) == (want, 4)
    assert ordered(spark, W.table_path(spark, root, "combined")) == (["p1", "p2", *want], 4)
    with pytest.raises(AuditError):
        merge_commit(data.limit(20), base, declared, RULES, "v1", root)
    assert W.current(spark, root)["number"] == 1
    assert merge_commit(data, base, declared, RULES, "v1", root) == 2
    assert set(W.current(spark, root)["tables"]) == {"merged"}


def test_the_audited_rows_are_the_written_ones(spark, make, root, monkeypatch, tmp_path):
    """Rows that arrive after the audit are not merged."""
    from labelloom.operators import merge as M

    data, base, declared = merge_inputs(make)
    path = str(tmp_path / "verdicts")
    data.write.parquet(path)
    real = M.assert_clean

    def later(report):
        real(report)
        make(ROW, ("a", "t00", "no", LONG, "v1")).write.mode("append").parquet(path)

    monkeypatch.setattr(M, "assert_clean", later)
    merge_commit(spark.read.parquet(path), base, declared, RULES, "v1", root)
    assert [r.qa for r in W.read_table(spark, root, "merged", "json").where("task_id = 't00'").collect()] == ["yes"]


@pytest.mark.parametrize("total,files", [(100, 7), (100, None), (3, 8)])
def test_placed_rows_lie_in_order(spark, tmp_path, total, files):
    path = str(tmp_path / "placed")
    df = spark.range(1, total + 1).select(F.col("id").alias("place"), F.concat(F.lit("t"), "id").alias("task_id")).repartition(5)
    write_placed(df, path, "place", total, n_files=files, drop=["place"])
    got, n = ordered(spark, path)
    assert got == [f"t{k}" for k in range(1, total + 1)] and n == min(files or 1, total)
