import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import rows
from labelloom.cluster import as_lookup, materialize, scratch_root
from labelloom.plans.shards import even_ranges, named_ranges, parse_splits


def joined_plan(big, small):
    return big.join(small, "id")._jdf.queryExecution().executedPlan().toString()


def test_lookup_is_a_table(spark):
    df = spark.range(100)
    assert rows(as_lookup(df)) == rows(df)
    assert "FileScan parquet" in as_lookup(df)._jdf.queryExecution().executedPlan().toString()


def test_planner_broadcasts_by_true_size_only(spark):
    big = spark.range(1000)
    assert "BroadcastHashJoin" in joined_plan(big, as_lookup(spark.range(10)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        assert "SortMergeJoin" in joined_plan(big, as_lookup(spark.range(500)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_scratch_lies_in_the_configured_folder(spark, make):
    root = scratch_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir", root)
    table = materialize(make("a int", (1,)), "t")
    assert root.split(":")[-1] in table.inputFiles()[0]


class Session:
    """Stands in for a session with the given master and settings."""

    def __init__(self, master, **conf):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"test-{master}"})()
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: conf.get(key.replace(".", "_"), default))})()


def test_only_a_local_master_gets_a_folder_of_its_own():
    assert scratch_root(Session("yarn", spark_checkpoint_dir="hdfs:///check")) == "hdfs:///check"
    own = scratch_root(Session("local[2]"))
    assert own and scratch_root(Session("local[2]")) == own
    with pytest.raises(RuntimeError):
        scratch_root(Session("yarn"))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 26), st.integers(1, 10_000))
def test_even_ranges_cut_exactly(n, total):
    if total < n:
        with pytest.raises(ValueError):
            even_ranges(total, n)
        return
    ranges = even_ranges(total, n)
    assert [r.lo for r in ranges] == [1, *[r.hi + 1 for r in ranges[:-1]]] and ranges[-1].hi == total
    assert len({r.n_batches for r in ranges[:-1]}) <= 1 and ranges[-1].n_batches >= ranges[0].n_batches
    text = ",".join(f"{r.lo}-{r.hi}" for r in ranges)
    assert named_ranges(parse_splits(text), n) == ranges
