"""Gates as rows: any number of configurations judged in one pass over the verdicts.

A configuration is a tree of composites over single gates. Its single gates are rows with their
path in the tree and their rules as columns. Verdicts are counted per batch by what any rule could
ask of them; the rules meet these few counts, never the verdicts, and each is applied as a column. The
conditions of expression gates become aggregates of one further pass.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.cluster import as_lookup, materialize
from labelloom.functions.columns import present, true, with_chars
from labelloom.model import PlanError, VerdictSchema

# Expression gates share a pass in groups of so many conditions, and reason lengths are
# told apart by the configured minimum they reach where there are no more than so many.
CONDITIONS = 50
THRESHOLDS = 64

# Rows of rules that may go to every executor, or that one task meets where there are more.
RULE_ROWS = 50_000

_RULES = ("required_fields array<string>, id_field string, qa_field string, reason_field string, valid_qa array<string>, "
          "min_reason_chars bigint, reason_long_ratio_min double, distinct_qa_min bigint, distinct_qa_min_small bigint, "
          "small_batch_threshold bigint, chars_field string")
_NUMBERS = ["min_reason_chars", "reason_long_ratio_min", "distinct_qa_min", "distinct_qa_min_small", "small_batch_threshold"]
_LAYOUT = ["id_field", "qa_field", "reason_field", "chars_field"]
PART = ["batch_idx", "path", "prefix", "gate", "passed", "failures", "diagnostics"]


def gate_leaves(configs: DataFrame) -> DataFrame:
    """``configs`` (config_id, config) -> (config_id, path, prefix, type, node), one row per single gate.

    ``path`` holds the places in the lists of the composites around it, ``prefix`` what its failures carry.
    Each level of nesting is one more round.
    """
    kind = F.get_json_object("node", "$.type").alias("type")
    level = configs.select("config_id", F.array().cast("array<int>").alias("path"), F.lit("").alias("prefix"), F.col("config").alias("node"))
    level = materialize(level.select("*", kind), "gate-level")
    found = level.where("type IS DISTINCT FROM 'composite'")
    while not (inner := level.where("type = 'composite'")).isEmpty():
        nested = inner.select("config_id", "path", "prefix", F.posexplode_outer(F.from_json(
            F.get_json_object("node", "$.gates"), "array<string>")).alias("at", "node"))
        named = nested.select("config_id", F.concat("path", F.array(F.coalesce("at", F.lit(0)))).alias("path"), "prefix", "node", kind)
        level = materialize(named.withColumn("prefix", F.concat("prefix", F.lit("["), F.coalesce("type", F.lit("")), F.lit("] "))), "gate-level")
        found = found.unionByName(level.where("type IS DISTINCT FROM 'composite'"))
    return found


def schema_rules(leaves: DataFrame, default_rules: Mapping | None) -> DataFrame:
    """The rules of ``jsonl_schema`` gates as columns; what a gate leaves open is the default."""
    plain = VerdictSchema()
    text = F.get_json_object("node", "$.verdict_schema")
    own = F.from_json(F.coalesce(text, F.lit(json.dumps(dict(default_rules or {})))), _RULES)
    parsed = leaves.withColumn("r", own)

    def value(name: str) -> Column:
        fallback = getattr(plain, name)
        lit = F.array(*[F.lit(x) for x in fallback]).cast("array<string>") if isinstance(fallback, tuple) else F.lit(fallback)
        return F.coalesce(F.col(f"r.{name}"), lit).alias(name)

    return parsed.select(*leaves.columns, F.get_json_object("node", "$.schema_version").alias("version"),
                         value("required_fields"), value("valid_qa"), *map(value, _NUMBERS), *map(value, _LAYOUT))


def _reached(chars: Column, thresholds: Sequence[int]) -> Column:
    """The largest threshold that the length reaches, or the length itself where they are many."""
    if len(thresholds) > THRESHOLDS:
        return chars.cast("bigint")
    steps = [F.when(chars >= t, F.lit(t).cast("bigint")) for t in thresholds]
    return F.greatest(*steps, F.lit(None).cast("bigint")) if steps else F.lit(None).cast("bigint")


def kinds_of_rows(verdicts: DataFrame, batch_tasks: DataFrame, layout: VerdictSchema, fields: Sequence[str],
                  thresholds: Sequence[int]) -> DataFrame:
    """Counts per batch and kind of row: (batch_idx, qa, version, absent, reached, n_rows, n_missing, n_tasks).

    A kind is all that a rule can ask: the label, the version, the absent ones of ``fields``, and
    which thresholds the reason reaches. An id of any number of verdicts is a few rows before the join.
    """
    ready = with_chars(verdicts, layout)
    ready = ready.withColumns({f: F.lit(None).cast("string") for f in fields if f not in ready.columns})
    absent = F.filter(F.array(*[F.when(~present(f, layout), F.lit(f)) for f in sorted(fields)]), lambda x: x.isNotNull())
    kind = [F.col(layout.qa_field).alias("qa"), F.col("schema_version").alias("version"), absent.alias("absent"),
            _reached(F.col(layout.chars_field), thresholds).alias("reached")]
    names = ["qa", "version", "absent", "reached"]
    per_id = ready.groupBy(F.col(layout.id_field).alias("task_id"), *kind).agg(F.count(F.lit(1)).alias("_rows"))
    joined = batch_tasks.select("batch_idx", "task_id").join(per_id, "task_id", "left")
    found = joined.select("batch_idx", *names, F.coalesce("_rows", F.lit(0)).alias("n_rows"),
                          F.when(F.col("_rows").isNull(), 1).otherwise(0).alias("n_missing"), F.lit(0).alias("n_tasks"))
    # Every task once more, to count them without another join.
    tasks = batch_tasks.select("batch_idx", F.lit(1).alias("n_tasks"))
    return found.unionByName(tasks, allowMissingColumns=True).groupBy("batch_idx", *names).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in ("n_rows", "n_missing", "n_tasks")])


def measures_by_rules(kinds: DataFrame, rules: DataFrame) -> DataFrame:
    """The gate measures of every (batch, path) under its own rules; ``rules`` has batch_idx."""
    rows = F.col("n_rows")

    def total(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, rows)), F.lit(0)).cast("bigint").alias(name)

    needed = F.concat(F.col("required_fields"), F.array(F.lit("schema_version")))
    label_ok = F.col("qa").isNotNull() & ((F.size("valid_qa") == 0) | F.array_contains("valid_qa", F.coalesce("qa", F.lit(""))))
    met = kinds.join(rules.withColumnRenamed("version", "wanted"), "batch_idx")
    return met.groupBy("batch_idx", "path", "prefix").agg(
        *[F.sum(n).alias(n) for n in ("n_missing", "n_rows", "n_tasks")],
        total(true(F.arrays_overlap("absent", needed)), "n_incomplete"),
        total(~F.col("version").eqNullSafe(F.col("wanted")), "n_other_version"),
        total(~true(label_ok), "n_bad_label"),
        total(true(F.col("reached") >= F.col("min_reason_chars")), "n_long"),
        F.count_distinct("qa").alias("n_labels"),
        *[F.first(n).alias(n) for n in _NUMBERS])


def judge_schema_gates(verdicts: DataFrame, batch_tasks: DataFrame, rules: DataFrame, judge: Callable) -> list[DataFrame]:
    """Results of all ``jsonl_schema`` gates; one scan of the verdicts for each layout of field names."""
    out = []
    for row in rules.select(*_LAYOUT).distinct().collect():  # names of columns of one table
        mine = reduce(lambda df, c: df.where(F.col(c) == row[c]), _LAYOUT, rules)
        fields = {r.f for r in mine.select(F.explode("required_fields").alias("f")).distinct().collect()} | {"schema_version"}
        steps = [r.t for r in mine.select(F.col("min_reason_chars").alias("t")).distinct().orderBy("t").limit(THRESHOLDS + 1).collect()]
        kinds = kinds_of_rows(verdicts, batch_tasks, VerdictSchema(**row.asDict()), sorted(fields), steps)
        measured = measures_by_rules(kinds, mine)
        own = SimpleNamespace(**{n: F.col(n) for n in _NUMBERS})
        out.append(judge(measured, own, keep=["path", "prefix"]).select(*PART))
    return out


def judge_expressions(verdicts: DataFrame, batch_tasks: DataFrame, leaves: DataFrame) -> list[DataFrame]:
    """Results of all expression gates (batch_idx, path, prefix, condition, name, id_field ...), ``CONDITIONS`` to a pass."""
    out = []
    asked = leaves.select("condition", *_LAYOUT).distinct().orderBy("condition").collect()  # texts that somebody wrote
    layouts = {tuple(r[c] for c in _LAYOUT) for r in asked}
    for names in sorted(layouts):
        layout = VerdictSchema(**dict(zip(_LAYOUT, names)))
        own = [r.condition for r in asked if tuple(r[c] for c in _LAYOUT) == names]
        for group in (own[k:k + CONDITIONS] for k in range(0, len(own), CONDITIONS)):
            mine = reduce(lambda df, c: df.where(F.col(c) == getattr(layout, c)), _LAYOUT, leaves).where(F.col("condition").isin(group))
            tasks = batch_tasks.join(mine.select("batch_idx").distinct(), "batch_idx", "left_semi")
            # An inner join lets adaptive execution split the rows of a hot id.
            ready = with_chars(verdicts, layout).withColumnRenamed(layout.id_field, "task_id").drop("batch_idx")
            held = ready.join(tasks.select("batch_idx", "task_id"), "task_id").groupBy("batch_idx").agg(
                *[F.expr(c).alias(f"_c{k}") for k, c in enumerate(group)])
            told = reduce(lambda col, k: col.when(F.col("condition") == group[k], F.col(f"_c{k}")), range(1, len(group)),
                          F.when(F.col("condition") == group[0], F.col("_c0")))
            every = mine.join(tasks.select("batch_idx").distinct(), "batch_idx").join(held, "batch_idx", "left").withColumn("_ok", told)
            ok, nothing = true(F.col("_ok")), F.array().cast("array<string>")
            message = F.concat(F.lit("("), F.col("name"), F.lit(") "), F.col("condition"))
            out.append(every.select("batch_idx", "path", "prefix", F.col("name").alias("gate"), ok.alias("passed"),
                                    F.when(ok, nothing).otherwise(F.array(message)).alias("failures"),
                                    F.create_map(F.lit("result"), F.col("_ok").cast("string")).alias("diagnostics")))
    return out


def fold(parts: Sequence[DataFrame]) -> DataFrame:
    """One result per batch from those of its single gates: all must pass, failures come in the order of the tree."""
    rows = reduce(DataFrame.unionByName, parts)
    told = F.transform("failures", lambda f: F.concat("prefix", f))
    merged = rows.groupBy("batch_idx").agg(
        F.bool_and("passed").alias("passed"), F.sort_array(F.collect_list(F.struct("path", told.alias("f")))).alias("parts"),
        F.any_value("gate").alias("gate"), F.any_value("diagnostics").alias("own"))
    single = F.size(F.get("parts.path", F.lit(0))) == 0
    top = F.array_distinct(F.transform("parts", lambda p: F.get(p["path"], F.lit(0))))
    return merged.select(
        "batch_idx", F.when(single, F.col("gate")).otherwise("composite").alias("gate"), "passed",
        F.flatten("parts.f").alias("failures"),
        F.when(single, F.col("own")).otherwise(F.create_map(F.lit("n_gates"), F.size(top).cast("string"))).alias("diagnostics"))


def _dealt(rules: DataFrame, n_rows: int) -> DataFrame:
    """Rules that are many meet their batches by shuffle, in tasks of equal size.

    The size of their files would let them be broadcast, or read by few tasks: equal rules take little
    room there and much in memory.
    """
    return rules if n_rows <= RULE_ROWS else rules.repartition(-(-n_rows // RULE_ROWS), "batch_idx").hint("merge")


def run_configs(resolved: DataFrame, verdicts: DataFrame, batch_tasks: DataFrame, judge: Callable,
                factories: Mapping[str, Callable[[Mapping], object]], default_rules: Mapping | None = None) -> DataFrame | None:
    """Judge each batch by its configuration (batch_idx, config as JSON); None if there is none.

    Gates of other types come from their factories, one object for each different configuration.
    """
    named = resolved.select("batch_idx", "config", F.md5("config").alias("config_id"))
    configs = named.groupBy("config_id").agg(F.any_value("config").alias("config"))
    leaves = as_lookup(gate_leaves(configs))
    if leaves.isEmpty():
        return None
    known = {"jsonl_schema", "expr"}
    odd = leaves.select(F.when(F.col("type").isNull(), "gate without a type")
                        .when(~F.col("type").isin(sorted(known | set(factories))), F.concat(F.lit("unknown gate type "), F.col("type")))
                        .when((F.col("type") == "jsonl_schema") & F.get_json_object("node", "$.schema_version").isNull(), "gate without a schema version")
                        .when((F.col("type") == "expr") & F.get_json_object("node", "$.condition").isNull(), "gate without a condition").alias("e"))
    errors = [r.e for r in odd.where("e IS NOT NULL").distinct().orderBy("e").limit(20).collect()]
    if errors:
        raise PlanError("; ".join(errors))
    ruled = schema_rules(leaves, default_rules)
    every = as_lookup(named.select("batch_idx", "config_id").join(
        ruled if leaves.count() <= RULE_ROWS else ruled.hint("merge"), "config_id"))
    placed = _dealt(every, every.count())
    kinds = [r.type for r in leaves.select("type").distinct().collect()]
    parts = []
    if "jsonl_schema" in kinds:
        parts += judge_schema_gates(verdicts, batch_tasks, placed.where("type = 'jsonl_schema'"), judge)
    if "expr" in kinds:
        exprs = placed.where("type = 'expr'").withColumns({
            "condition": F.get_json_object("node", "$.condition"), "name": F.coalesce(F.get_json_object("node", "$.name"), F.lit("expr"))})
        parts += judge_expressions(verdicts, batch_tasks, exprs)
    for kind in sorted(set(kinds) - known):
        for row in leaves.where(F.col("type") == kind).select("node").distinct().collect():  # objects of the caller's own code
            mine = placed.where((F.col("type") == kind) & (F.col("node") == row.node)).select("batch_idx", "path", "prefix")
            tasks = batch_tasks.join(mine.select("batch_idx").distinct(), "batch_idx", "left_semi")
            parts.append(factories[kind](json.loads(row.node)).evaluate(verdicts, tasks).join(mine, "batch_idx").select(*PART))
    return fold(parts)
