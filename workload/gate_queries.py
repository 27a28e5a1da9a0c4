"""Gate queries (G1-G11) and intake queries (V1-V4)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.cluster import materialize, scratch_path
from labelloom.operators import gates as G
from labelloom.operators import intake as V
from labelloom.sources.files import verdict_stream
from labelloom.streaming import ingest as N
from labelloom.streaming import retract as R
from workload.inputs import SCHEMA, VERSION, Inputs, submitted
from workload.registry import query

DEFAULT_GATE = {
    "type": "jsonl_schema",
    "schema_version": VERSION,
    "verdict_schema": {"required_fields": ["task_id", "qa", "reason"], "valid_qa": ["yes", "no"]},
}
LONG_MEAN = "avg(reason_chars) > 1500 AND count_if(qa = 'no') >= 1"


def _shown(results: DataFrame) -> DataFrame:
    return results.select("batch_idx", "passed", F.array_join("failures", "; ").alias("failures"))


def _one(check: str, column: str):
    @query(f"gate_{check}", f"""
        SELECT batch_idx, {column} IS NULL AS passed, coalesce({column}, '') AS failures FROM v_checks""")
    def run(i: Inputs) -> DataFrame:
        gate = getattr(G, f"gate_{check}")
        return _shown(gate(i.verdicts_dirty, i.members, SCHEMA, VERSION))

    return run


for _check, _column in [("count", "f_count"), ("ids", "f_ids"), ("schema", "f_schema"), ("valid_qa", "f_label"),
                        ("reason_ratio", "f_reason"), ("distinct_qa", "f_distinct")]:
    _one(_check, _column)


@query("gate_batches", """
    SELECT r.batch_idx, r.passed, r.failures, c.n_tasks, c.n_rows, c.n_missing, c.n_other_version, c.n_long, c.n_labels
    FROM v_gate_results r JOIN v_checks c ON c.batch_idx = r.batch_idx""")
def gate_batches(i: Inputs) -> DataFrame:
    rows = G.gate_batches(i.verdicts_dirty, i.members, SCHEMA, VERSION)
    return rows.select("batch_idx", "passed", F.array_join("failures", "; ").alias("failures"), "n_tasks", "n_rows",
                       "n_missing", "n_other_version", "n_long", "n_labels")


@query("gate_batches_labelled", """
    WITH r AS (
        SELECT m.batch_idx, count(*) AS n, count(*) FILTER (WHERE v.schema_version <> 'v1') AS old,
               count(*) FILTER (WHERE length(v.reason) >= 150) AS long, count(DISTINCT v.qa) AS labels
        FROM v_members m JOIN v_verdicts v ON v.task_id = m.task_id GROUP BY m.batch_idx),
    f AS (SELECT batch_idx,
          CASE WHEN old > 0 THEN printf('(schema) %d incomplete, %d of another version', 0, old) END AS a,
          CASE WHEN long / n < 0.9 THEN printf('(c) %d of %d reasons long enough', long, n) END AS b,
          CASE WHEN labels < CASE WHEN n <= 33 THEN 1 ELSE 2 END
               THEN printf('(distinct_qa) %d distinct labels, need %d', labels, CASE WHEN n <= 33 THEN 1 ELSE 2 END) END AS c FROM r)
    SELECT batch_idx, coalesce(a, b, c) IS NULL AS passed, concat_ws('; ', a, b, c) AS failures FROM f""")
def gate_batches_labelled(i: Inputs) -> DataFrame:
    """Only labelled tasks are expected, so batches can pass."""
    labelled = i.members.join(i.table("labels").select(F.col("doc_id").alias("task_id")), "task_id", "left_semi")
    return _shown(G.gate_batches(i.verdicts, labelled, SCHEMA, VERSION))


EXPR_SQL = """
    exprs AS (
        SELECT m.batch_idx, coalesce(avg(length(v.reason)) > 1500 AND count(*) FILTER (WHERE v.qa = 'no') >= 1, false) AS ok
        FROM v_members m LEFT JOIN v_verdicts_dirty v ON v.task_id = m.task_id GROUP BY m.batch_idx)"""
EXPR_TEXT = "(expr) avg(reason_chars) > 1500 AND count_if(qa = ''no'') >= 1"


@query("expr_gate", f"""
    WITH {EXPR_SQL} SELECT batch_idx, ok AS passed, CASE WHEN ok THEN '' ELSE '{EXPR_TEXT}' END AS failures FROM exprs""")
def expr_gate(i: Inputs) -> DataFrame:
    return _shown(G.ExprGate(LONG_MEAN).evaluate(i.verdicts_dirty, i.members))


@query("row_gate", """
    WITH w AS (
        SELECT m.batch_idx, avg(CASE WHEN contains(v.reason, '.') AND v.qa = 'yes' THEN 1.0 ELSE 0.0 END)
                            FILTER (WHERE v.task_id IS NOT NULL) AS share
        FROM v_members m LEFT JOIN v_verdicts_dirty v ON v.task_id = m.task_id GROUP BY m.batch_idx)
    SELECT batch_idx, coalesce(share >= 0.7, false) AS passed,
           CASE WHEN coalesce(share >= 0.7, false) THEN '' ELSE '(rows) share below 0.7' END AS failures FROM w""")
def row_gate(i: Inputs) -> DataFrame:
    """Custom pandas check of rows; the share per batch is counted by Spark."""

    def has_sentence(reason, qa):
        return reason.str.contains(".", regex=False) & (qa == "yes")

    return _shown(G.RowGate(has_sentence, ("reason", "qa"), 0.7).evaluate(i.verdicts_dirty, i.members))


COMPOSITE_SQL = f"""
    {EXPR_SQL},
    both_gates AS (
        SELECT r.batch_idx, r.passed AND e.ok AS passed,
               concat_ws('; ', '[jsonl_schema] ' || c.f_count, '[jsonl_schema] ' || c.f_ids, '[jsonl_schema] ' || c.f_schema,
                         '[jsonl_schema] ' || c.f_label, '[jsonl_schema] ' || c.f_reason, '[jsonl_schema] ' || c.f_distinct,
                         CASE WHEN NOT e.ok THEN '[expr] {EXPR_TEXT}' END) AS failures
        FROM v_gate_results r JOIN v_checks c ON c.batch_idx = r.batch_idx JOIN exprs e ON e.batch_idx = r.batch_idx)"""


@query("composite", f"WITH {COMPOSITE_SQL} SELECT batch_idx, passed, failures FROM both_gates")
def composite(i: Inputs) -> DataFrame:
    gate = G.CompositeGate((G.SchemaGate(SCHEMA, VERSION), G.ExprGate(LONG_MEAN)))
    return _shown(gate.evaluate(i.verdicts_dirty, i.members))


def _gated_stories(i: Inputs, broken: bool) -> DataFrame:
    """Stories with a gate of their own by number of attempts."""
    kind = F.when(F.col("attempts") == 0, "expr")
    if broken:
        kind = kind.when(F.col("attempts") == 1, "no-such-gate").when(F.col("attempts") == 2, "untyped")
    gate = F.when(kind == "untyped", F.create_map(F.lit("note"), F.lit("x"))).when(
        kind.isNotNull(), F.create_map(F.lit("type"), kind, F.lit("condition"), F.lit(LONG_MEAN)))
    return i.stories.withColumn("acceptanceGate", gate)


@query("resolve_gates", """
    SELECT story_id, CASE attempts WHEN 0 THEN 'expr' WHEN 1 THEN 'no-such-gate' WHEN 2 THEN NULL ELSE 'jsonl_schema' END AS gate_type,
           CASE attempts WHEN 1 THEN 'unknown gate type no-such-gate' WHEN 2 THEN 'gate without a type' END AS error
    FROM v_stories""")
def resolve_gates(i: Inputs) -> DataFrame:
    return G.resolve_gates(_gated_stories(i, True), DEFAULT_GATE).select("story_id", "gate_type", "error")


@query("run_gates", f"""
    WITH {EXPR_SQL}
    SELECT s.batch_idx, CASE WHEN s.attempts = 0 THEN e.ok ELSE r.passed END AS passed,
           CASE WHEN s.attempts <> 0 THEN r.failures WHEN e.ok THEN '' ELSE '{EXPR_TEXT}' END AS failures
    FROM v_stories s JOIN exprs e ON e.batch_idx = s.batch_idx JOIN v_gate_results r ON r.batch_idx = s.batch_idx""")
def run_gates(i: Inputs) -> DataFrame:
    return _shown(G.run_gates(_gated_stories(i, False), i.verdicts_dirty, i.members, DEFAULT_GATE))


@query("finalize", f"""
    WITH {EXPR_SQL},
    moved AS (
        SELECT s.shard_id, s.story_id, s.passes OR e.ok AS passes, s.attempts + CASE WHEN e.ok THEN 0 ELSE 1 END AS attempts, e.ok
        FROM v_stories s JOIN exprs e ON e.batch_idx = s.batch_idx),
    left_over AS (SELECT shard_id, count(*) FILTER (WHERE NOT passes) AS n FROM moved GROUP BY shard_id)
    SELECT m.shard_id, m.story_id, m.passes, m.attempts,
           CASE WHEN m.ok AND l.n = 0 THEN 'COMPLETE' WHEN m.ok THEN 'YIELD' WHEN m.attempts >= 3 THEN 'VIOLATION' ELSE 'YIELD' END AS token
    FROM moved m JOIN left_over l ON l.shard_id = m.shard_id""")
def finalize(i: Inputs) -> DataFrame:
    results = G.ExprGate(LONG_MEAN).evaluate(i.verdicts_dirty, i.members).join(
        i.batches.select("batch_idx", "shard_id", "story_id"), "batch_idx")
    # Results are a table of their own between judging and finalizing.
    results = materialize(results, "gate_results")
    return G.finalize(i.stories, results).select("shard_id", "story_id", "passes", "attempts", "token")


# Orders as tasks of their customer's batch, and as verdicts on themselves; December stays open.
MANY_SQL = """
    sheet AS (
        SELECT o_custkey AS batch_idx, o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE 'maybe' END AS qa,
               CAST(floor(o_totalprice / 1000) AS BIGINT) AS chars, CASE WHEN o_orderpriority = '1-URGENT' THEN 'v0' ELSE 'v1' END AS version,
               month(o_orderdate) < 12 AS labelled FROM orders),
    counted AS (
        SELECT batch_idx, count(*) AS n_tasks, count(*) FILTER (WHERE labelled) AS n_rows, count(*) FILTER (WHERE NOT labelled) AS n_missing,
               count(*) FILTER (WHERE labelled AND version <> 'v1') AS n_old, count(DISTINCT qa) FILTER (WHERE labelled) AS n_labels,
               count(*) FILTER (WHERE labelled AND ((batch_idx % 3 = 0 AND qa = 'maybe') OR (batch_idx % 3 = 2 AND qa <> 'yes'))) AS n_bad,
               count(*) FILTER (WHERE labelled AND chars >= 100 + batch_idx % 151) AS n_long,
               count(*) FILTER (WHERE labelled AND chars >= 150) AS n_plain_long,
               count(*) FILTER (WHERE labelled AND qa = 'maybe') AS n_maybe,
               count(*) FILTER (WHERE labelled AND qa = 'yes') AS n_yes
        FROM sheet GROUP BY batch_idx)"""


def _sheet(i: Inputs) -> tuple[DataFrame, DataFrame]:
    status, orders = F.col("o_orderstatus"), i.table("orders")
    tasks = orders.select(F.col("o_custkey").alias("batch_idx"), F.col("o_orderkey").alias("task_id"))
    chars = F.floor(F.col("o_totalprice") / 1000).cast("int")
    rows = orders.where(F.month("o_orderdate") < 12).select(
        F.col("o_orderkey").alias("task_id"), F.when(status == "F", "yes").when(status == "O", "no").otherwise("maybe").alias("qa"),
        F.repeat(F.lit("r"), chars).alias("reason"), F.when(F.col("o_orderpriority") == "1-URGENT", "v0").otherwise("v1").alias("schema_version"))
    return tasks, rows


def many_configs(i: Inputs) -> DataFrame:
    """A gate of its own for every batch."""
    batch = F.col("batch_idx")
    labels = F.when(batch % 3 == 0, F.array(F.lit("yes"), F.lit("no"))).when(batch % 3 == 2, F.array(F.lit("yes"))).otherwise(F.array())
    rules = F.to_json(F.struct(
        labels.cast("array<string>").alias("valid_qa"), (batch % 151 + 100).alias("min_reason_chars"),
        (batch % 4 / 4).alias("reason_long_ratio_min"), (batch % 2 + 1).alias("distinct_qa_min_small")))
    gate = F.create_map(F.lit("type"), F.lit("jsonl_schema"), F.lit("schema_version"), F.lit("v1"), F.lit("verdict_schema"), rules)
    return _sheet(i)[0].select("batch_idx").distinct().withColumn("acceptanceGate", gate)


@query("run_gates_many", f"""
    WITH {MANY_SQL},
    said AS (
        SELECT *, CASE WHEN n_rows <> n_tasks THEN printf('(a) %d rows for %d tasks', n_rows, n_tasks) END AS a,
               CASE WHEN n_missing > 0 THEN printf('(b) %d ids without a verdict', n_missing) END AS b,
               CASE WHEN n_old > 0 THEN printf('(schema) %d incomplete, %d of another version', 0, n_old) END AS c,
               CASE WHEN n_bad > 0 THEN printf('(valid_qa) %d labels not allowed', n_bad) END AS d,
               CASE WHEN NOT coalesce(n_long / nullif(n_rows, 0) >= batch_idx % 4 / 4, false)
                    THEN printf('(c) %d of %d reasons long enough', n_long, n_rows) END AS e,
               CASE WHEN n_labels < CASE WHEN n_tasks <= 33 THEN batch_idx % 2 + 1 ELSE 2 END
                    THEN printf('(distinct_qa) %d distinct labels, need %d', n_labels, CASE WHEN n_tasks <= 33 THEN batch_idx % 2 + 1 ELSE 2 END) END AS f
        FROM counted)
    SELECT batch_idx, coalesce(a, b, c, d, e, f) IS NULL AS passed, concat_ws('; ', a, b, c, d, e, f) AS failures FROM said""")
def run_gates_many(i: Inputs) -> DataFrame:
    tasks, rows = _sheet(i)
    return _shown(G.run_gates(many_configs(i), rows, tasks))


NESTED = {"type": "composite", "gates": json.dumps([
    {"type": "expr", "name": "many", "condition": "count(*) >= 8"},
    {"type": "composite", "gates": [
        {"type": "jsonl_schema", "schema_version": "v1", "verdict_schema": {"valid_qa": ["yes", "no"], "reason_long_ratio_min": 0.5}},
        {"type": "composite", "gates": [{"type": "expr", "name": "yes", "condition": "count_if(qa = 'yes') >= 3"}]}]}])}


@query("composite_nested", f"""
    WITH {MANY_SQL},
    said AS (
        SELECT *, CASE WHEN n_rows < 8 THEN '[expr] (many) count(*) >= 8' END AS many,
               CASE WHEN n_rows <> n_tasks THEN printf('[composite] [jsonl_schema] (a) %d rows for %d tasks', n_rows, n_tasks) END AS a,
               CASE WHEN n_missing > 0 THEN printf('[composite] [jsonl_schema] (b) %d ids without a verdict', n_missing) END AS b,
               CASE WHEN n_old > 0 THEN printf('[composite] [jsonl_schema] (schema) %d incomplete, %d of another version', 0, n_old) END AS c,
               CASE WHEN n_maybe > 0 THEN printf('[composite] [jsonl_schema] (valid_qa) %d labels not allowed', n_maybe) END AS d,
               CASE WHEN NOT coalesce(n_plain_long / nullif(n_rows, 0) >= 0.5, false)
                    THEN printf('[composite] [jsonl_schema] (c) %d of %d reasons long enough', n_plain_long, n_rows) END AS e,
               CASE WHEN n_labels < CASE WHEN n_tasks <= 33 THEN 1 ELSE 2 END THEN printf('[composite] [jsonl_schema] (distinct_qa) %d distinct labels, need %d',
                    n_labels, CASE WHEN n_tasks <= 33 THEN 1 ELSE 2 END) END AS f,
               CASE WHEN n_yes < 3 THEN '[composite] [composite] [expr] (yes) count_if(qa = ''yes'') >= 3' END AS g
        FROM counted)
    SELECT batch_idx, coalesce(many, a, b, c, d, e, f, g) IS NULL AS passed, concat_ws('; ', many, a, b, c, d, e, f, g) AS failures FROM said""")
def composite_nested(i: Inputs) -> DataFrame:
    """Three levels of gates; failures carry the whole path."""
    tasks, rows = _sheet(i)
    gate = F.create_map(*[F.lit(x) for kv in NESTED.items() for x in kv])
    return _shown(G.run_gates(tasks.select("batch_idx").distinct().withColumn("acceptanceGate", gate), rows, tasks))


@query("finalize_started", f"""
    WITH {MANY_SQL},
    due AS (
        SELECT batch_idx, n_yes >= 3 AS ok FROM counted
        WHERE n_missing = 0 AND batch_idx IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) >= 2000)),
    moved AS (
        SELECT s.batch_idx % 4 AS shard, s.batch_idx, coalesce(d.ok, false) OR s.batch_idx % 7 = 0 AS passes,
               s.batch_idx % 5 + CASE WHEN d.ok = false THEN 1 ELSE 0 END AS attempts, d.ok
        FROM counted s LEFT JOIN due d ON d.batch_idx = s.batch_idx),
    left_over AS (SELECT shard, count(*) FILTER (WHERE NOT passes) AS n FROM moved GROUP BY shard)
    SELECT m.batch_idx, m.passes, m.attempts,
           CASE WHEN m.ok AND l.n = 0 THEN 'COMPLETE' WHEN m.ok THEN 'YIELD' WHEN m.ok = false AND m.attempts >= 3 THEN 'VIOLATION'
                WHEN m.ok = false THEN 'YIELD' END AS token
    FROM moved m JOIN left_over l ON l.shard = m.shard""")
def finalize_started(i: Inputs) -> DataFrame:
    """Judged twice, before and after the verdicts of the later years: only batches that are whole and
    have news since the first time are judged the second time."""
    tasks, _ = _sheet(i)
    orders, batch = i.table("orders"), F.col("batch_idx")
    status = F.col("o_orderstatus")
    late = F.year("o_orderdate") >= 2000
    rows = orders.where(F.month("o_orderdate") < 12).select(
        F.col("o_orderkey").alias("task_id"), F.when(status == "F", "yes").when(status == "O", "no").otherwise("maybe").alias("qa"),
        F.lit("orders").alias("stream_id"), F.when(late, 1).otherwise(0).cast("bigint").alias("batch_id"))
    judged = materialize(G.due_batches(tasks, rows.where("batch_id = 0")), "judged")
    due = materialize(G.due_batches(tasks, rows, judged), "due")
    stories = tasks.select("batch_idx").distinct().select(
        (batch % 4).cast("string").alias("shard_id"), batch, batch.cast("string").alias("story_id"),
        (batch % 7 == 0).alias("passes"), (batch % 5).alias("attempts"))
    results = G.ExprGate("count_if(qa = 'yes') >= 3").evaluate(rows, tasks).join(due, "batch_idx", "left_semi").join(
        stories.select("batch_idx", "shard_id", "story_id"), "batch_idx")
    return G.finalize(stories, materialize(results, "results")).select("batch_idx", "passes", "attempts", "token")


# ---- Intake ------------------------------------------------------------------

BAD_SQL = """
    marked AS (
        SELECT *, CASE WHEN qa IS NULL THEN 'missing qa' ELSE concat_ws('; ', CASE WHEN schema_version <> 'v1' THEN 'schema_version' END,
                  CASE WHEN qa NOT IN ('yes', 'no') THEN 'qa' END, CASE WHEN length(reason) < 150 THEN 'reason length' END) END AS errors
        FROM v_submissions)"""


@query("validate_rows", f"WITH {BAD_SQL} SELECT seq, task_id, qa, errors FROM marked WHERE errors = ''")
def validate_rows(i: Inputs) -> DataFrame:
    ok, _ = V.validate_rows(i.submissions, SCHEMA, VERSION)
    return ok.select("seq", "task_id", "qa", F.lit("").alias("errors"))


@query("quarantine_rows", f"WITH {BAD_SQL} SELECT seq, task_id, qa, errors FROM marked WHERE errors <> ''")
def quarantine_rows(i: Inputs) -> DataFrame:
    _, bad = V.validate_rows(i.submissions, SCHEMA, VERSION)
    return bad.select("seq", "task_id", "qa", F.array_join("errors", "; ").alias("errors"))


FIRST_SQL = f"""
    {BAD_SQL},
    firsts AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS rn FROM marked WHERE errors = '')"""


def _ingested(i: Inputs) -> str:
    """Stream the document files through the ingest, twice: the second run must change nothing."""
    sink, checkpoint = scratch_path(i.spark, "sink"), scratch_path(i.spark, "stream")
    for _ in range(2):
        rows = submitted(i.stream("documents").select("doc_id", "text", "lang", "source"), i.table("labels"))
        N.ingest_stream(rows, sink, checkpoint, "documents", SCHEMA, VERSION, ["seq"]).awaitTermination()
    return sink


@query("ingest_stream", f"""
    WITH {FIRST_SQL} SELECT task_id, shard_id, qa, seq, md5(reason) AS reason_md5 FROM firsts WHERE rn = 1""")
def ingest_stream(i: Inputs) -> DataFrame:
    return N.read_accepted(i.spark, _ingested(i)).select("task_id", "shard_id", "qa", "seq", F.md5("reason").alias("reason_md5"))


@query("pending", """
    SELECT shard_id, batch_idx, task_id, pos FROM v_members m
    WHERE NOT EXISTS (SELECT 1 FROM v_verdicts_dirty v WHERE v.task_id = m.task_id AND v.shard_id = m.shard_id)""")
def pending(i: Inputs) -> DataFrame:
    return V.pending(i.members, i.verdicts_dirty, ["shard_id", "task_id"]).select("shard_id", "batch_idx", "task_id", "pos")


RECOVER_SQL = """
    labelled AS (SELECT m.* FROM v_members m WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.task_id)),
    current AS (SELECT task_id FROM v_verdicts WHERE schema_version = 'v1'),
    reset AS (
        SELECT b.batch_idx FROM labelled b JOIN v_stories s ON s.batch_idx = b.batch_idx
        WHERE s.attempts > 0 AND NOT s.passes
        GROUP BY b.batch_idx HAVING bool_and(b.task_id IN (SELECT task_id FROM current)))"""


def _recovered(i: Inputs) -> tuple[DataFrame, DataFrame]:
    labelled = i.members.join(i.table("labels").select(F.col("doc_id").alias("task_id")), "task_id", "left_semi")
    return V.auto_recover(i.stories, labelled, i.verdicts.where("schema_version = 'v1'"))


@query("auto_recover", f"""
    WITH {RECOVER_SQL}
    SELECT v.task_id, v.qa FROM v_verdicts v WHERE schema_version = 'v1' AND NOT EXISTS (
        SELECT 1 FROM labelled l JOIN reset r ON r.batch_idx = l.batch_idx WHERE l.task_id = v.task_id)""")
def auto_recover(i: Inputs) -> DataFrame:
    return _recovered(i)[0].select("task_id", "qa")


@query("auto_recover_batches", f"WITH {RECOVER_SQL} SELECT batch_idx FROM reset")
def auto_recover_batches(i: Inputs) -> DataFrame:
    return _recovered(i)[1]


# Orders as verdicts on customers, taken in by years: most ids come again.
ORDERS_SQL = """
    arrivals AS (
        SELECT CAST(o_custkey AS VARCHAR) AS task_id, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE 'maybe' END AS qa,
               o_orderkey AS seq, CAST((year(o_orderdate) - 1992) // 3 AS BIGINT) AS batch_id FROM orders),
    valid AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY batch_id, seq) AS rn FROM arrivals WHERE qa <> 'maybe')"""


def _orders_sink(i: Inputs) -> str:
    """Micro-batches of some years each, all of them absorbed twice: a replay must change nothing."""
    orders = i.table("orders")
    status = F.col("o_orderstatus")
    rows = orders.select(
        F.col("o_custkey").cast("string").alias("task_id"), F.when(status == "F", "yes").when(status == "O", "no").otherwise("maybe").alias("qa"),
        F.rpad("o_orderpriority", 160, ".").alias("reason"), F.lit(VERSION).alias("schema_version"), F.col("o_orderkey").alias("seq"),
        F.call_function("div", F.year("o_orderdate") - 1992, F.lit(3)).alias("part"))
    sink = scratch_path(i.spark, "orders-sink")
    numbers = sorted(r.part for r in rows.select("part").distinct().collect())  # one per three years
    for n in (*numbers, numbers[0]):
        N.absorb_batch(rows.where(F.col("part") == n).drop("part"), n, sink, "1992", SCHEMA, VERSION, ["seq"])
    return sink


@query("ingest_indexed", f"WITH {ORDERS_SQL} SELECT task_id, qa, seq, batch_id, '1992' AS stream_id FROM valid WHERE rn = 1")
def ingest_indexed(i: Inputs) -> DataFrame:
    sink = i.place("orders-sink", _orders_sink)
    return N.read_accepted(i.spark, sink).select("task_id", "qa", "seq", "batch_id", "stream_id")


@query("ingest_repeats", f"WITH {ORDERS_SQL} SELECT task_id, seq, batch_id, 'repeated' AS error FROM valid WHERE rn > 1")
def ingest_repeats(i: Inputs) -> DataFrame:
    sink = i.place("orders-sink", _orders_sink)
    return N.read_repeated(i.spark, sink).select("task_id", "seq", "batch_id", F.array_join("errors", ",").alias("error"))


@query("ingest_types", """
    SELECT CAST(doc_id AS VARCHAR) AS task_id, CASE WHEN n_chars % 4 = 0 AND length(text) >= 150 THEN '' WHEN n_chars % 4 = 0 THEN 'reason length'
           ELSE 'missing reason' END AS errors FROM documents""")
def ingest_types(i: Inputs) -> DataFrame:
    """Reasons that are JSON text, numbers, objects and arrays: only text is taken in."""
    source, sink = scratch_path(i.spark, "lines"), scratch_path(i.spark, "sink")
    text = F.col("text")
    kinds = F.col("n_chars") % 4
    reason = (F.when(kinds == 0, F.get_json_object(F.to_json(F.struct(F.array(text).alias("a"))), "$.a"))
              .when(kinds == 1, F.concat(F.lit("["), F.repeat(F.lit("7"), 200), F.lit("]")))
              .when(kinds == 2, F.to_json(F.struct(text))).otherwise(F.concat(F.lit("[1, "), F.repeat(F.lit("2"), 150), F.lit("]"))))
    # A text of one array is the JSON text without its brackets, a number of 200 digits the array without its own.
    bare = F.when(kinds < 2, F.substring(reason, F.lit(2), F.length(reason) - 2)).otherwise(reason)
    line = F.concat(F.lit('{"task_id": "'), F.col("doc_id").cast("string"), F.lit('", "qa": "yes", "schema_version": "v1", "reason": '), bare, F.lit("}"))
    i.table("documents").select(line.alias("value")).write.text(source)
    N.ingest_stream(verdict_stream(i.spark, source, SCHEMA), sink, scratch_path(i.spark, "stream"), "types", SCHEMA, VERSION).awaitTermination()
    taken = N.read_accepted(i.spark, sink).select("task_id", F.lit("").alias("errors"))
    return taken.unionByName(N.read_quarantine(i.spark, sink).select("task_id", F.array_join("errors", "; ").alias("errors")))


REDO_SQL = f"""
    {FIRST_SQL},
    placed AS (SELECT task_id, CAST(min(seq) // 6 AS BIGINT) AS batch_idx FROM v_submissions GROUP BY task_id),
    taken AS (SELECT task_id, qa, seq FROM firsts WHERE rn = 1),
    redo AS (
        SELECT p.batch_idx FROM placed p LEFT JOIN taken t ON t.task_id = p.task_id
        WHERE p.batch_idx % 3 > 0 AND p.batch_idx % 5 > 0
        GROUP BY p.batch_idx HAVING bool_and(t.task_id IS NOT NULL))"""


@query("recover_redo", f"""
    WITH {REDO_SQL}
    SELECT t.task_id, p.batch_idx, t.qa, t.seq, CASE WHEN r.batch_idx IS NULL THEN 'first' ELSE 'second' END AS stream_id
    FROM taken t JOIN placed p ON p.task_id = t.task_id LEFT JOIN redo r ON r.batch_idx = p.batch_idx""")
def recover_redo(i: Inputs) -> DataFrame:
    """Ingest, take back what is stuck, ingest again: only what was taken back is accepted a second time."""
    sink = scratch_path(i.spark, "sink")
    placed = i.submissions.groupBy("task_id").agg(F.call_function("div", F.min("seq"), F.lit(6)).alias("batch_idx"))
    batch = F.col("batch_idx")
    stories = placed.select("batch_idx").distinct().select(batch, (batch % 3).alias("attempts"), (batch % 5 == 0).alias("passes"))
    N.absorb_batch(i.submissions, 0, sink, "first", SCHEMA, VERSION, ["seq"])
    R.recover(N.read_accepted(i.spark, sink), sink, stories, placed)
    N.absorb_batch(i.submissions, 0, sink, "second", SCHEMA, VERSION, ["seq"])
    return N.read_accepted(i.spark, sink).join(placed, "task_id").select("task_id", "batch_idx", "qa", "seq", "stream_id")
