import json
import re

import pytest
from pyspark.sql import functions as F

from helpers import LONG, rows, verdict
from labelloom.model import PlanError, VerdictSchema
from labelloom.operators import gates as G

RULES = VerdictSchema()
ROW = "task_id string, qa string, reason string, schema_version string"
TASK = "batch_idx bigint, task_id string"


@pytest.fixture(scope="module")
def judged(make):
    """Judge one batch of ids against verdict rows; returns (passed, tags of failures)."""

    def run(ids, verdicts, rules=RULES, version="v1"):
        batch = make(TASK, *[(1, t) for t in ids])
        data = make(ROW, *[tuple(v.get(k) for k in ("task_id", "qa", "reason", "schema_version")) for v in verdicts])
        row = G.gate_batches(data, batch, rules, version).collect()[0]
        return row.passed, [f.split(" ")[0] for f in row.failures]

    return run


def test_schema_defaults():
    assert (RULES.id_field, RULES.qa_field, RULES.reason_field, RULES.min_reason_chars) == ("task_id", "qa", "reason", 150)
    assert [RULES.distinct_qa_threshold(n) for n in (90, 34, 33, 1)] == [2, 2, 1, 1]
    custom = VerdictSchema.from_dict({"distinct_qa_min": 5, "distinct_qa_min_small": 4, "small_batch_threshold": 7, "x": 1})
    assert (custom.distinct_qa_threshold(8), custom.distinct_qa_threshold(7)) == (5, 4)
    with pytest.raises(Exception):
        custom.min_reason_chars = 1


def test_full_batch_passes(judged):
    assert judged(["t1", "t2", "t3"], [verdict("t1"), verdict("t2", "no"), verdict("t3", "no")]) == (True, [])


def test_one_short_reason_of_two(judged):
    assert judged(["t1", "t2"], [verdict("t1"), verdict("t2", "no", "short")]) == (False, ["(c)"])


def test_missing_id(judged):
    assert judged(["t1", "t2"], [verdict("t1")]) == (False, ["(a)", "(b)"])


def test_no_verdict_at_all(judged):
    assert judged(["t1"], []) == (False, ["(a)", "(b)", "(c)", "(distinct_qa)"])


def test_wrong_version(judged):
    assert judged(["t1", "t2"], [verdict("t1", version="w"), verdict("t2", "no", version="w")]) == (False, ["(schema)"])
    assert judged(["t1"], [verdict("t1", version=None)]) == (False, ["(schema)"])


def test_small_batch_may_have_one_label(judged):
    assert judged([f"t{i}" for i in range(3)], [verdict(f"t{i}") for i in range(3)]) == (True, [])


def test_large_batch_needs_two_labels(judged):
    ids = [f"t{i}" for i in range(34)]
    assert judged(ids, [verdict(t) for t in ids]) == (False, ["(distinct_qa)"])
    assert judged(ids, [verdict(t, "no" if t == "t3" else "yes") for t in ids]) == (True, [])


def test_labels_and_missing_fields(judged):
    rules = VerdictSchema(valid_qa=("yes", "no"))
    assert judged(["t1"], [verdict("t1", "maybe")], rules) == (False, ["(valid_qa)"])
    assert judged(["t1", "t2"], [verdict("t1"), verdict("t2", None)], rules) == (False, ["(schema)", "(valid_qa)"])
    assert judged(["t1"], [verdict("t1", reason=None)], rules) == (False, ["(schema)", "(c)"])


def test_repeated_and_foreign_ids(judged):
    assert judged(["t1", "t2"], [verdict("t1"), verdict("t1", "no"), verdict("zz")]) == (False, ["(b)"])
    assert judged(["t1"], [verdict("t1"), verdict("t1")]) == (False, ["(a)"])


def test_ratio_is_inclusive_and_length_too(judged):
    ids = [f"t{i}" for i in range(10)]
    edge = [verdict(t, reason="x" * (149 if t == "t0" else 150)) for t in ids]
    assert judged(ids, edge) == (True, [])


def test_single_gates_and_diagnostics(make):
    batch, data = make(TASK, (1, "t1"), (1, "t2")), make(ROW, ("t1", "yes", "x", "v1"))
    for name, passed in [("count", False), ("ids", False), ("schema", True), ("valid_qa", True), ("reason_ratio", False),
                         ("distinct_qa", True)]:
        row = getattr(G, f"gate_{name}")(data, batch, RULES, "v1").collect()[0]
        assert (row.gate, row.passed) == (name, passed)
    assert row.diagnostics["n_tasks"] == "2" and row.diagnostics["n_rows"] == "1"


def test_stored_length_stands_for_the_text(make):
    data = make(ROW + ", reason_chars int", ("t1", "yes", None, "v1", 200))
    assert G.gate_batches(data, make(TASK, (1, "t1")), RULES, "v1").collect()[0].passed


def test_expression_and_row_gates(make):
    batch = make(TASK, (1, "t1"), (1, "t2"), (2, "t3"), (3, "t9"))
    data = make(ROW, ("t1", "yes", LONG, "v1"), ("t2", "no", LONG, "v1"), ("t3", "no", "s", "v1"))
    expr = G.ExprGate("count_if(qa = 'yes') * 2 = count(*)", "half").evaluate(data, batch)
    assert rows(expr, "batch_idx", "passed") == [(1, True), (2, False), (3, False)]
    assert expr.where("batch_idx = 2").first().failures == ["(half) count_if(qa = 'yes') * 2 = count(*)"]
    gate = G.RowGate(lambda reason: reason.str.len() > 10, ("reason",), 0.5)
    assert rows(gate.evaluate(data, batch), "batch_idx", "passed") == [(1, True), (2, False), (3, False)]


def test_composite_prefixes_failures(make):
    batch, data = make(TASK, (1, "t1")), make(ROW, ("t1", "yes", LONG, "v1"))
    ok, no = G.ExprGate("count(*) = 1"), G.ExprGate("count(*) = 2")
    assert G.CompositeGate((ok, ok)).evaluate(data, batch).collect()[0].passed
    row = G.CompositeGate((ok, no, G.SchemaGate(RULES, "other"))).evaluate(data, batch).collect()[0]
    assert not row.passed
    assert [f.split(" ")[0] for f in row.failures] == ["[expr]", "[jsonl_schema]"]


def test_registry():
    for config in ({"type": "no-such-gate"}, {}):
        with pytest.raises(PlanError):
            G.build_gate(config)
    G.register_gate("mine", lambda c: G.ExprGate(f"count(*) >= {c['threshold']}", "mine", "mine"))
    try:
        assert G.build_gate({"type": "mine", "threshold": 3}).condition == "count(*) >= 3"
    finally:
        del G.GATE_TYPES["mine"]
    nested = G.build_gate({"type": "composite", "gates": json.dumps([{"type": "expr", "condition": "true"}])})
    assert nested.gates == (G.ExprGate("true"),)


def test_default_contract():
    config = {"default_gate": {"type": "jsonl_schema", "schema_version": "v9", "verdict_schema": {"min_reason_chars": 5}}}
    version, rules = G.default_contract(config)
    assert (version, rules.min_reason_chars) == ("v9", 5)
    for bad in ({}, {"default_gate": {"type": "expr", "condition": "true"}}):
        with pytest.raises(PlanError):
            G.default_contract(bad)


STORIES = "batch_idx bigint, story_id string, acceptanceGate map<string,string>"


def test_own_gate_wins_and_default_fills(make):
    stories = make(STORIES, (1, "S1", {"type": "expr", "condition": "false"}), (2, "S2", None), (3, "S3", {"type": "x"}), (4, "S4", {"y": "z"}))
    got = rows(G.resolve_gates(stories, {"type": "expr", "condition": "true"}), "story_id", "gate_type", "error")
    assert got == [("S1", "expr", None), ("S2", "expr", None), ("S3", "x", "unknown gate type x"), ("S4", None, "gate without a type")]
    assert rows(G.resolve_gates(stories.where("batch_idx = 2")), "error") == [("no gate configured",)]


def test_run_gates_dispatches_and_refuses(make):
    stories = make(STORIES, (1, "S1", {"type": "expr", "condition": "count(*) = 9"}), (2, "S2", None))
    batch = make(TASK, (1, "t1"), (2, "t2"))
    data = make(ROW, ("t1", "yes", LONG, "v1"), ("t2", "yes", LONG, "v1"))
    default = {"type": "jsonl_schema", "schema_version": "v1", "verdict_schema": {"min_reason_chars": 5}}
    assert rows(G.run_gates(stories, data, batch, default), "batch_idx", "gate", "passed") == [
        (1, "expr", False), (2, "jsonl_schema", True)]
    with pytest.raises(PlanError):
        G.run_gates(stories, data, batch)


def test_finalize_tokens(make):
    stories = make("shard_id string, story_id string, passes boolean, attempts bigint",
                   ("a", "S1", False, 0), ("a", "S2", True, 1), ("b", "S3", False, 1), ("b", "S4", False, 2), ("b", "S5", None, 0),
                   ("c", "S6", False, 0), ("c", "S7", False, 5))
    results = make("shard_id string, story_id string, passed boolean",
                   ("a", "S1", True), ("b", "S3", False), ("b", "S4", False), ("c", "S6", True))
    out = G.finalize(stories, results)
    assert rows(out, "story_id", "passes", "attempts", "token") == [
        ("S1", True, 0, "COMPLETE"), ("S2", True, 1, None), ("S3", False, 2, "YIELD"), ("S4", False, 3, "VIOLATION"),
        ("S5", False, 0, None), ("S6", True, 0, "YIELD"), ("S7", False, 5, None)]


def test_hot_id_reaches_the_join_combined(spark, make):
    hot = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "t1").otherwise("t2").alias("task_id"), F.lit("yes").alias("qa"),
                                   F.lit(LONG).alias("reason"), F.lit("v1").alias("schema_version"))
    row = G.gate_batches(hot, make(TASK, (1, "t1"), (1, "t2")), RULES, "v1").collect()[0]
    assert (row.n_rows, row.n_tasks, row.n_missing, row.n_labels) == (5000, 2, 0, 1)


def test_same_id_in_two_shards_is_judged_per_shard(make):
    batch = make("shard_id string, batch_idx bigint, task_id string", ("a", 1, "t1"), ("b", 2, "t1"))
    data = make("shard_id string, " + ROW, ("a", "t1", "yes", LONG, "v1"))
    rules = VerdictSchema()
    assert rows(G.gate_batches(data, batch, rules, "v1"), "batch_idx", "passed") == [(1, True), (2, True)]
    assert rows(G.gate_batches(data, batch, rules, "v1", ["shard_id"]), "batch_idx", "passed") == [(1, True), (2, False)]


def test_expression_may_use_the_reason_length(make):
    gate = G.ExprGate("min(reason_chars) >= 200")
    got = gate.evaluate(make(ROW, ("t1", "yes", LONG, "v1"), ("t2", "yes", "x", "v1")), make(TASK, (1, "t1"), (2, "t2")))
    assert rows(got, "batch_idx", "passed") == [(1, True), (2, False)]


def test_other_field_names_and_absent_columns(make):
    rules = VerdictSchema(required_fields=("id", "label", "why"), id_field="id", qa_field="label", reason_field="why", min_reason_chars=2)
    data = make("id string, label string, why string, schema_version string", ("t1", "yes", "abc", "v1"))
    batch = make(TASK, (1, "t1"))
    assert G.gate_batches(data, batch, rules, "v1").collect()[0].passed
    assert G.ExprGate("min(reason_chars) = 3", schema=rules).evaluate(data, batch).collect()[0].passed
    assert G.RowGate(lambda why: why == "abc", ("why",), schema=rules).evaluate(data, batch).collect()[0].passed
    row = G.gate_batches(data.drop("schema_version", "why"), batch, rules, "v1").collect()[0]
    assert [f.split(" ")[0] for f in row.failures] == ["(schema)", "(c)"]


# ---- gates as rows ----------------------------------------------------------------


def test_one_configuration_per_batch(spark, make):
    """Each batch has rules of its own; all are judged as by gate objects of their own."""
    n = 150
    tasks = make(TASK, *[(b, f"t{b}-{k}") for b in range(n) for k in range(b % 4 + 1)])
    data = make(ROW, *[(f"t{b}-{k}", "yes" if (b + k) % 3 else "no", "x" * (b + k), "v1" if b % 7 else "v2")
                       for b in range(n) for k in range(b % 4 + 1) for _ in range(1 + (b % 5 == 0)) if (b + k) % 11])

    def config(b):
        return {"type": "jsonl_schema", "schema_version": "v1" if b % 2 else "v2", "verdict_schema": json.dumps({
            "min_reason_chars": b, "valid_qa": ["yes", "no"][:b % 3], "reason_long_ratio_min": b % 4 / 4, "distinct_qa_min_small": b % 3,
            "required_fields": ["task_id", "qa", "reason", "extra"][:3 + b % 2]})}
    stories = make(STORIES, *[(b, f"S{b}", config(b)) for b in range(n)])
    for most in (64, 1_000):  # lengths as they are, and lengths told apart by the thresholds only
        G.run_configs.__globals__["THRESHOLDS"] = most
        got = {r.batch_idx: r for r in G.run_gates(stories, data, tasks).collect()}
        G.run_configs.__globals__["THRESHOLDS"] = 64
        assert len(got) == n
        for b in range(0, n, 10):
            want = G.build_gate(config(b)).evaluate(data, tasks.where(F.col("batch_idx") == b)).collect()[0]
            assert (got[b].gate, got[b].passed, got[b].failures, got[b].diagnostics) == (want.gate, want.passed, want.failures, want.diagnostics)


def test_nested_composites(spark, make):
    tasks = make(TASK, (1, "t1"), (2, "t2"), (3, "t3"))
    data = make(ROW, ("t1", "yes", LONG, "v1"), ("t2", "no", "s", "v1"))

    def expr(text, name="expr"):
        return {"type": "expr", "condition": text, "name": name}
    schema = {"type": "jsonl_schema", "schema_version": "v1", "verdict_schema": {"valid_qa": ["yes"]}}
    tree = {"type": "composite", "gates": json.dumps([
        expr("count(*) = 1", "one"), {"type": "composite", "gates": [schema, {"type": "composite", "gates": [expr("min(qa) = 'yes'"), expr("true")]}]},
        expr("min(reason_chars) > 5")])}
    got = {r.batch_idx: r for r in G.run_gates(make(STORIES, *[(b, "S", tree) for b in (1, 2, 3)]), data, tasks).collect()}
    assert got[1].passed and got[1].failures == [] and got[1].diagnostics == {"n_gates": "3"} and got[1].gate == "composite"
    assert [f[:f.index(")") + 1] for f in got[2].failures] == [
        "[composite] [jsonl_schema] (valid_qa)", "[composite] [jsonl_schema] (c)", "[composite] [composite] [expr] (expr)", "[expr] (expr)"]
    assert got[3].failures[0] == "[expr] (one) count(*) = 1" and not got[3].passed
    nested = G.build_gate(tree)
    assert isinstance(nested.gates[1].gates[1], G.CompositeGate)
    want = {r.batch_idx: r.failures for r in nested.evaluate(data, tasks).collect()}
    assert {b: r.failures for b, r in got.items()} == want


def test_faulty_trees_are_refused(make):
    data, tasks = make(ROW, ("t1", "yes", LONG, "v1")), make(TASK, (1, "t1"))
    for gates, message in ([], "without a type"), ([{"type": "zz"}], "unknown gate type zz"), ([{"type": "expr"}], "without a condition"), (
            [{"type": "jsonl_schema"}], "without a schema version"):
        stories = make(STORIES, (1, "S", {"type": "composite", "gates": json.dumps(gates)}))
        with pytest.raises(PlanError, match=message):
            G.run_gates(stories, data, tasks)


def test_registered_types_stay_usable_inside_trees(make):
    data, tasks = make(ROW, ("t1", "yes", LONG, "v1"), ("t2", "no", LONG, "v1")), make(TASK, (1, "t1"), (2, "t2"))
    G.register_gate("share", lambda c: G.RowGate(lambda qa: qa == c["label"], ("qa",), 1.0, "share", "share"))
    try:
        tree = {"type": "composite", "gates": json.dumps([{"type": "share", "label": "yes"}, {"type": "expr", "condition": "count(*) = 1"}])}
        got = G.run_gates(make(STORIES, (1, "S1", tree), (2, "S2", {"type": "share", "label": "no"})), data, tasks)
        assert rows(got, "batch_idx", "gate", "passed") == [(1, "composite", True), (2, "share", True)]
    finally:
        del G.GATE_TYPES["share"]


def test_many_conditions_take_several_passes(make, monkeypatch):
    monkeypatch.setitem(G.run_configs.__globals__, "CONDITIONS", 2)
    tasks, data = make(TASK, *[(b, f"t{b}") for b in range(7)]), make(ROW, *[(f"t{b}", "yes", "x" * b, "v1") for b in range(7)])
    stories = make(STORIES, *[(b, "S", {"type": "expr", "condition": f"min(reason_chars) = {min(b, 5)}"}) for b in range(7)])
    assert rows(G.run_gates(stories, data, tasks), "batch_idx", "passed") == [(b, b < 6) for b in range(7)]


def test_many_rules_are_not_broadcast(spark, monkeypatch):
    from labelloom.operators import gate_table

    gate = {"type": "composite", "gates": [{"type": "expr", "name": "some", "condition": "count(*) >= 2"},
                                           {"type": "composite", "gates": [{"type": "jsonl_schema", "schema_version": "v1"}]}]}
    tasks = spark.range(60).select((F.col("id") % 20).alias("batch_idx"), F.col("id").alias("task_id"))
    verdicts = spark.range(45).selectExpr("id task_id", "'yes' qa", "repeat('x', 200) reason", "if(id < 30, 'v1', 'v0') schema_version")
    nested = F.create_map(F.lit("type"), F.lit("composite"), F.lit("gates"), F.lit(json.dumps(gate["gates"])))
    batches = tasks.select("batch_idx").distinct().withColumn("acceptanceGate", nested)

    def judged():
        return G.run_gates(batches, verdicts, tasks).select("batch_idx", "passed", F.array_join("failures", "; ").alias("f"))

    plain = rows(judged())
    monkeypatch.setattr(gate_table, "RULE_ROWS", 4)
    dealt = judged()
    held = rows(dealt)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert held == plain and len(held) == 20 and {r[1] for r in held} == {False}
    assert not re.search(r"BroadcastHashJoin \[batch_idx[^\n]*(Inner|LeftSemi)", plan)
