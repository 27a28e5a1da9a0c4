"""The physical plans keep what scale needs: no cross joins, pruned scans, pushed filters."""

import contextlib
import io
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helpers import rows
from labelloom.operators import audit as A
from labelloom.operators import gates as G
from labelloom.operators import monitor as D
from labelloom.operators.intake import pending
from labelloom.operators.merge import ordered_merge
from labelloom.sources.sinks import save_bucketed
from workload.inputs import SCHEMA, VERSION, Inputs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def no_broadcast(spark):
    """Plan as if no side were small."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_nested_loops_even_without_broadcast(spark, no_broadcast, name):
    text = plan_of(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("gate", [G.SchemaGate(SCHEMA, VERSION), G.ExprGate("avg(reason_chars) > 9")])
def test_gates_shuffle_no_text(spark, no_broadcast, gate):
    i = Inputs(spark, SF)
    text = plan_of(gate.evaluate(i.verdicts_dirty, i.members))
    for block in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", text):
        assert not re.search(r"\b(text|reason)#", block), block


def test_progress_reads_only_its_columns(spark):
    i = Inputs(spark, SF)
    text = plan_of(A.audit_counts(i.members, i.members.groupBy("shard_id").agg(F.count("*").alias("total_tasks"))))
    for schema in re.findall(r"ReadSchema: struct<(.*?)>", text):
        assert "pos" not in schema and "batch_idx" not in schema


def test_pending_reuses_the_shuffle_of_distinct_ids(spark, no_broadcast):
    i = Inputs(spark, SF)
    ids = i.table("labels").select(F.col("doc_id").alias("task_id"))
    text = plan_of(pending(i.members, ids))
    assert len(re.findall(r"^\(\d+\) Exchange$", text, re.M)) == 2


def test_tail_limits_rank_before_the_shuffle(spark):
    i = Inputs(spark, SF)
    tree = plan_of(D.tail_n(i.logs, ["shard_id", "source"], "seq")).split("\n\n")[0]
    assert tree.count("WindowGroupLimit") == 2


def test_long_tails_limit_rank_below_each_shuffle(spark):
    """Beyond the threshold Spark plans no limit itself; what a partition sends on is ranked in it."""
    i = Inputs(spark, SF)
    wide = D.tail_n(i.logs, ["shard_id", "source"], "seq", 5_000)
    assert rows(wide.groupBy("shard_id", "source").agg(F.max("rn"))) == rows(
        i.logs.groupBy("shard_id", "source").agg(F.least(F.count("*"), F.lit(5_000))))
    assert rows(D.tail_n(i.logs, ["shard_id", "source"], "seq", 1_500), "shard_id", "source", "seq", "rn") == rows(
        D.tail_n(i.logs.repartition(7), ["shard_id", "source"], "seq", 1_500), "shard_id", "source", "seq", "rn")


def test_any_number_of_configurations_scans_the_verdicts_once(spark, no_broadcast):
    from workload.gate_queries import many_configs

    i = Inputs(spark, SF)
    tasks = i.table("orders").select(F.col("o_custkey").alias("batch_idx"), F.col("o_orderkey").alias("task_id"))
    tree = plan_of(G.run_gates(many_configs(i), i.verdicts, tasks)).split("\n\n")[0]
    scanned = plan_of(i.verdicts).split("\n\n")[0].count("Scan parquet")
    # The tasks are read twice, to join and to count them, the rules and the prefixes once each.
    assert tree.count("Scan parquet") <= scanned + 2 + 2


def test_drain_pushes_the_shard_filter_to_the_scan(spark):
    from labelloom.operators.rebalance import drain

    i = Inputs(spark, SF)
    assert "PushedFilters: [In(shard_id, [a,b])" in plan_of(drain(i.members, i.verdicts.select("shard_id", "task_id"), ["a", "b"]))


def test_disjoint_is_one_shuffle_by_id(spark, no_broadcast):
    i = Inputs(spark, SF)
    text = plan_of(A.membership_sets(i.members, i.task_ids))
    assert len(re.findall(r"^\(\d+\) Exchange$", text, re.M)) == 2  # by id, then the few distinct sets


def exchanges(df):
    return re.findall(r"Arguments: hashpartitioning\((.*?), \d+\)", plan_of(df))


def test_bucketed_tables_meet_without_a_shuffle_by_id(spark, no_broadcast, tmp_path):
    i = Inputs(spark, SF)
    members = save_bucketed(i.members, "members_b", str(tmp_path / "m"), 4)
    verdicts = save_bucketed(i.verdicts, "verdicts_b", str(tmp_path / "v"), 4)
    try:
        for df in (G.gate_batches(verdicts, members, SCHEMA, VERSION), pending(members, verdicts), ordered_merge(verdicts, members)):
            assert not [x for x in exchanges(df) if x.startswith("task_id")]
        want = G.gate_batches(i.verdicts, i.members, SCHEMA, VERSION).select("batch_idx", "failures")
        assert rows(G.gate_batches(verdicts, members, SCHEMA, VERSION), "batch_idx", "failures") == rows(want)
    finally:
        spark.sql("DROP TABLE members_b")
        spark.sql("DROP TABLE verdicts_b")
