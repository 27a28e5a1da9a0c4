"""Acceptance gates over batches of verdicts.

A gate turns ``(verdicts, batch_tasks)`` into one result row per batch:
``batch_idx, gate, passed, failures ARRAY<STRING>, diagnostics MAP<STRING, STRING>``.
Verdicts belong to the batch that lists their id.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.cluster import as_lookup
from labelloom.functions.columns import has_fields, in_labels, long_enough, true, with_chars
from labelloom.model import MAX_ATTEMPTS, PlanError, VerdictSchema
from labelloom.operators.gate_table import run_configs


# ---- G1-G6: one pass of measures, one check each -------------------------


def batch_measures(verdicts: DataFrame, batch_tasks: DataFrame, schema: VerdictSchema, version: str,
                   within: Sequence[str] = ()) -> DataFrame:
    """All facts the schema gates need, one row per batch.

    ``within`` names further columns that must agree, such as ``shard_id`` when
    one id has verdicts in several shards.

    Verdicts first collapse to one row per (id, label), so an id repeated
    millions of times reaches the join as a few rows. Reasons travel as their
    length only.
    """
    qa = F.col(schema.qa_field)
    per_label = with_chars(verdicts, schema).groupBy(
        F.col(schema.id_field).alias("task_id"), *within, qa.alias("_qa"),
    ).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(~has_fields(schema.checked_fields, schema)).alias("_incomplete"),
        F.count_if(~F.col("schema_version").eqNullSafe(version)).alias("_other_version"),
        F.count_if(~in_labels(qa, schema.valid_qa)).alias("_bad_label"),
        F.count_if(long_enough(schema)).alias("_long"),
    )
    joined = batch_tasks.select("batch_idx", "task_id", *within).join(per_label, ["task_id", *within], "left")
    # Every task once more, to count them without another join.
    joined = joined.withColumn("_task", F.lit(0)).unionByName(
        batch_tasks.select("batch_idx", F.lit(1).alias("_task")), allowMissingColumns=True)

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")

    return joined.groupBy("batch_idx").agg(
        F.count_if(F.col("_rows").isNull() & (F.col("_task") == 0)).alias("n_missing"),
        total("_rows").alias("n_rows"),
        total("_incomplete").alias("n_incomplete"),
        total("_other_version").alias("n_other_version"),
        total("_bad_label").alias("n_bad_label"),
        total("_long").alias("n_long"),
        F.count_distinct("_qa").alias("n_labels"),
        F.sum("_task").cast("bigint").alias("n_tasks"),
    )


def _count_check(schema: VerdictSchema) -> tuple[Column, Column]:
    return (F.col("n_rows") == F.col("n_tasks"),
            F.format_string("(a) %d rows for %d tasks", F.col("n_rows"), F.col("n_tasks")))


def _ids_check(schema: VerdictSchema) -> tuple[Column, Column]:
    return F.col("n_missing") == 0, F.format_string("(b) %d ids without a verdict", F.col("n_missing"))


def _schema_check(schema: VerdictSchema) -> tuple[Column, Column]:
    ok = (F.col("n_incomplete") == 0) & (F.col("n_other_version") == 0)
    return ok, F.format_string("(schema) %d incomplete, %d of another version",
                               F.col("n_incomplete"), F.col("n_other_version"))


def _label_check(schema: VerdictSchema) -> tuple[Column, Column]:
    return F.col("n_bad_label") == 0, F.format_string("(valid_qa) %d labels not allowed", F.col("n_bad_label"))


def _reason_check(schema: VerdictSchema) -> tuple[Column, Column]:
    ratio = F.try_divide(F.col("n_long").cast("double"), F.col("n_rows"))
    return (true(ratio >= schema.reason_long_ratio_min),
            F.format_string("(c) %d of %d reasons long enough", F.col("n_long"), F.col("n_rows")))


def _distinct_check(schema: VerdictSchema) -> tuple[Column, Column]:
    need = F.when(F.col("n_tasks") <= schema.small_batch_threshold, schema.distinct_qa_min_small).otherwise(
        schema.distinct_qa_min)
    return (F.col("n_labels") >= need,
            F.format_string("(distinct_qa) %d distinct labels, need %d", F.col("n_labels"), need))


# Failures are always listed in this order.
SCHEMA_CHECKS: dict[str, Callable[[VerdictSchema], tuple[Column, Column]]] = {
    "count": _count_check,
    "ids": _ids_check,
    "schema": _schema_check,
    "valid_qa": _label_check,
    "reason_ratio": _reason_check,
    "distinct_qa": _distinct_check,
}

MEASURES = ["n_tasks", "n_rows", "n_missing", "n_incomplete", "n_other_version", "n_bad_label", "n_long", "n_labels"]


def judge(measures: DataFrame, schema: VerdictSchema, checks: Sequence[str] = tuple(SCHEMA_CHECKS),
          gate: str = "jsonl_schema", keep: Sequence[str] = ()) -> DataFrame:
    """Apply the named checks to measured batches; the limits of ``schema`` may be columns of them."""
    parts = []
    for name in checks:
        ok, message = SCHEMA_CHECKS[name](schema)
        parts.append(F.when(~ok, message))
    failures = F.filter(F.array(*parts), lambda x: x.isNotNull())
    diagnostics = F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.col(m).cast("string"))])
    return measures.select("batch_idx", F.lit(gate).alias("gate"), failures.alias("failures"),
                           diagnostics.alias("diagnostics"), *MEASURES, *keep).withColumn(
        "passed", F.size("failures") == 0)


def _single(check: str):
    def gate(verdicts: DataFrame, batch_tasks: DataFrame, schema: VerdictSchema, version: str,
             within: Sequence[str] = ()) -> DataFrame:
        return judge(batch_measures(verdicts, batch_tasks, schema, version, within), schema, [check], check)

    gate.__name__ = f"gate_{check}"
    gate.__doc__ = f"Only the ``{check}`` check; unused measures are pruned from the plan."
    return gate


gate_count = _single("count")
gate_ids = _single("ids")
gate_schema = _single("schema")
gate_valid_qa = _single("valid_qa")
gate_reason_ratio = _single("reason_ratio")
gate_distinct_qa = _single("distinct_qa")


def gate_batches(verdicts: DataFrame, batch_tasks: DataFrame, schema: VerdictSchema, version: str,
                 within: Sequence[str] = ()) -> DataFrame:
    """All six schema checks in one join and one aggregate."""
    return judge(batch_measures(verdicts, batch_tasks, schema, version, within), schema)


# ---- Gate objects ---------------------------------------------------------

RESULT = ["batch_idx", "gate", "passed", "failures", "diagnostics"]


@dataclass(frozen=True)
class SchemaGate:
    schema: VerdictSchema
    version: str
    type: str = "jsonl_schema"

    def evaluate(self, verdicts: DataFrame, batch_tasks: DataFrame) -> DataFrame:
        return gate_batches(verdicts, batch_tasks, self.schema, self.version).select(*RESULT)


@dataclass(frozen=True)
class ExprGate:
    """Passes where a boolean SQL aggregate over the batch's verdict rows is true.

    The condition may use ``reason_chars``, the length of the reason; then no
    text is shuffled.
    """

    condition: str
    name: str = "expr"
    type: str = "expr"
    schema: VerdictSchema = VerdictSchema()

    def evaluate(self, verdicts: DataFrame, batch_tasks: DataFrame) -> DataFrame:
        # An inner join lets adaptive execution split the rows of a hot id.
        ready = with_chars(verdicts, self.schema).withColumnRenamed(self.schema.id_field, "task_id")
        rows = ready.drop("batch_idx").join(batch_tasks.select("batch_idx", "task_id"), "task_id")
        held = rows.groupBy("batch_idx").agg(F.expr(self.condition).alias("_ok"))
        return _all_batches(batch_tasks, held, self.name, self.condition)


@dataclass(frozen=True)
class RowGate:
    """Passes where at least ``min_share`` of the batch's rows satisfy a vectorised function.

    ``check`` maps one pandas Series per input column to a boolean Series; the
    share itself is counted by Spark, so no batch is gathered in one place.
    """

    check: Callable
    columns: tuple[str, ...]
    min_share: float = 1.0
    name: str = "rows"
    type: str = "rows"
    schema: VerdictSchema = VerdictSchema()

    def evaluate(self, verdicts: DataFrame, batch_tasks: DataFrame) -> DataFrame:
        fits = F.pandas_udf(self.check, "boolean")
        marked = verdicts.select(F.col(self.schema.id_field).alias("task_id"), fits(*[F.col(c) for c in self.columns]).alias("_fits"))
        rows = marked.join(batch_tasks.select("batch_idx", "task_id"), "task_id")
        share = F.avg(true(F.col("_fits")).cast("int")) >= self.min_share
        held = rows.groupBy("batch_idx").agg(share.alias("_ok"))
        return _all_batches(batch_tasks, held, self.name, f"share below {self.min_share}")


@dataclass(frozen=True)
class CompositeGate:
    """AND of sub-gates; failures carry the sub-gate's type as prefix."""

    gates: tuple
    type: str = "composite"

    def evaluate(self, verdicts: DataFrame, batch_tasks: DataFrame) -> DataFrame:
        return composite([(g.type, g.evaluate(verdicts, batch_tasks)) for g in self.gates])


def _all_batches(batch_tasks: DataFrame, held: DataFrame, name: str, message: str) -> DataFrame:
    """Result rows for every batch; a batch without verdicts fails."""
    every = batch_tasks.select("batch_idx").distinct().join(held, "batch_idx", "left")
    ok = true(F.col("_ok"))
    nothing = F.array().cast("array<string>")
    return every.select(
        "batch_idx", F.lit(name).alias("gate"), ok.alias("passed"),
        F.when(ok, nothing).otherwise(F.array(F.lit(f"({name}) {message}"))).alias("failures"),
        F.create_map(F.lit("result"), F.col("_ok").cast("string")).alias("diagnostics"))


def _prefixed(kind: str) -> Column:
    return F.transform("failures", lambda f: F.concat(F.lit(f"[{kind}] "), f))


def composite(results: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Combine result tables given as ``(type, rows)`` in order."""
    tagged = [
        rows.select("batch_idx", "passed", F.struct(
            F.lit(i).alias("i"),
            _prefixed(kind).alias("f")).alias("part"))
        for i, (kind, rows) in enumerate(results)
    ]
    merged = reduce(DataFrame.unionByName, tagged).groupBy("batch_idx").agg(
        F.bool_and("passed").alias("passed"), F.sort_array(F.collect_list("part")).alias("parts"))
    return merged.select(
        "batch_idx", F.lit("composite").alias("gate"), "passed",
        F.flatten(F.transform("parts", lambda p: p["f"])).alias("failures"),
        F.create_map(F.lit("n_gates"), F.size("parts").cast("string")).alias("diagnostics"))


# ---- Registry and resolution ----------------------------------------------


def _nested(value):
    return json.loads(value) if isinstance(value, str) else value


GATE_TYPES: dict[str, Callable[[Mapping], object]] = {
    "jsonl_schema": lambda c: SchemaGate(VerdictSchema.from_dict(_nested(c.get("verdict_schema", {}))),
                                         c["schema_version"]),
    "expr": lambda c: ExprGate(c["condition"], c.get("name", "expr"),
                               schema=VerdictSchema.from_dict(_nested(c.get("verdict_schema", {})))),
    "composite": lambda c: CompositeGate(tuple(build_gate(g) for g in _nested(c["gates"]))),
}


def register_gate(kind: str, factory: Callable[[Mapping], object]) -> None:
    """Add a gate type: ``factory(config)`` returns an object with ``type`` and ``evaluate``."""
    GATE_TYPES[kind] = factory


def build_gate(config: Mapping):
    kind = config.get("type")
    if kind not in GATE_TYPES:
        raise PlanError(f"unknown gate type {kind!r}" if kind else "gate without a type")
    return GATE_TYPES[kind](config)


def default_contract(acceptance: Mapping) -> tuple[str, VerdictSchema]:
    """Schema version and verdict schema of the project's default gate."""
    gate = acceptance.get("default_gate") or {}
    if gate.get("type") != "jsonl_schema":
        raise PlanError("the default gate does not describe verdicts")
    return gate["schema_version"], VerdictSchema.from_dict(gate.get("verdict_schema", {}))


def resolve_gates(stories: DataFrame, default: Mapping | None = None) -> DataFrame:
    """Effective gate per story with ``gate, gate_type, error``.

    A story's own gate (a string map) wins over the default; no gate, no type
    or an unknown type is an error row.
    """
    fallback = F.lit(None).cast("map<string,string>")
    if default:
        flat = {k: v if isinstance(v, str) else json.dumps(v) for k, v in default.items()}
        fallback = F.create_map(*[F.lit(x) for kv in flat.items() for x in kv])
    kind = F.try_element_at("gate", F.lit("type"))
    error = (
        F.when(F.col("gate").isNull(), "no gate configured")
        .when(kind.isNull(), "gate without a type")
        .when(~kind.isin(sorted(GATE_TYPES)), F.concat(F.lit("unknown gate type "), kind))
    )
    return (stories.withColumn("gate", F.coalesce("acceptanceGate", fallback))
            .withColumn("gate_type", kind).withColumn("error", error))


def run_gates(stories: DataFrame, verdicts: DataFrame, batch_tasks: DataFrame,
              default: Mapping | None = None) -> DataFrame:
    """Judge each batch by its story's gate; ``stories`` carries ``batch_idx``.

    Configurations are data (see ``gate_table``): any number of them, nested or not, costs one pass
    over the verdicts for the schema gates and one for each group of expressions.
    """
    resolved = resolve_gates(stories, default).select("batch_idx", "error", F.to_json("gate").alias("config"))
    errors = [r.error for r in resolved.where("error IS NOT NULL").select("error").distinct().orderBy("error").limit(20).collect()]
    if errors:
        raise PlanError("; ".join(errors))
    own = {k: f for k, f in GATE_TYPES.items() if k not in ("jsonl_schema", "expr", "composite")}
    rules = _nested((default or {}).get("verdict_schema") or {})  # the project's field names
    found = run_configs(resolved, verdicts, batch_tasks, judge, own, rules)
    if found is None:
        return build_gate({"type": "jsonl_schema", "schema_version": "v1"}).evaluate(verdicts.limit(0), batch_tasks.limit(0))
    return found


def due_batches(batch_tasks: DataFrame, verdicts: DataFrame, judged: DataFrame | None = None,
                arrival: Sequence[str] = ("stream_id", "batch_id")) -> DataFrame:
    """Batches that are to be judged now (``batch_idx, mark``): every task has a verdict, and the
    verdicts are not those of the last judgement.

    ``mark`` stands for the verdicts and their ``arrival``; ``judged`` holds the marks of earlier
    judgements. So a batch under work gets no attempt, and neither does one that nobody has touched since.
    """
    own = F.sum(F.shiftright(F.xxhash64("task_id", *arrival), 32)).alias("_mark")
    seen = verdicts.groupBy("task_id").agg(own)
    full = batch_tasks.select("batch_idx", "task_id").join(seen, "task_id", "left").groupBy("batch_idx").agg(
        F.bool_and(F.col("_mark").isNotNull()).alias("_full"), F.sum("_mark").alias("mark")).where("_full").drop("_full")
    return full if judged is None else full.join(judged.select("batch_idx", "mark"), ["batch_idx", "mark"], "left_anti")


def finalize(stories: DataFrame, gate_results: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """New story state and promise token after the gates ran.

    ``gate_results`` holds ``shard_id, story_id, passed``; stories without a
    result stay as they are and get no token.
    """
    judged = stories.join(
        gate_results.select("shard_id", "story_id", F.col("passed").alias("_gate")), ["shard_id", "story_id"], "left")
    passed, failed = true(F.col("_gate")), true(~F.col("_gate"))
    moved = judged.withColumn("passes", true(F.col("passes")) | passed).withColumn(
        "attempts", F.coalesce("attempts", F.lit(0)) + F.when(failed, 1).otherwise(0))
    left = as_lookup(moved.groupBy("shard_id").agg(F.count_if(~F.col("passes")).alias("_pending")))
    token = (
        F.when(passed & (F.col("_pending") == 0), "COMPLETE")
        .when(passed, "YIELD")
        .when(failed & (F.col("attempts") >= max_attempts), "VIOLATION")
        .when(failed, "YIELD")
    )
    return moved.join(left, "shard_id").withColumn("token", token).drop("_gate", "_pending")
