"""Audit and merge the verdicts of all shards into one ordered set (M1-M7)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.cluster import as_lookup, materialize
from labelloom.functions.columns import long_enough, row_errors, with_chars
from labelloom.model import EXAMPLES, SAMPLE_SEED, SAMPLE_SIZE, PlanError, VerdictSchema
from labelloom.operators.audit import against_declared, coverage
from labelloom.operators.report import assert_clean, check_rows, union_reports
from labelloom.sources.sinks import has_rows, remove, swap_in, write_ordered, write_placed
from labelloom.sources.versions import Draft, write_version


def union_shards(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack shard tables whose optional columns may differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_counts(verdicts: DataFrame, declared: DataFrame) -> DataFrame:
    """Raw verdict rows per shard against the shard's ``total_tasks`` (M1)."""
    return against_declared(verdicts.groupBy("shard_id").agg(F.count(F.lit(1)).alias("actual")), declared)


def dup_report(df: DataFrame, key_cols: Sequence[str], n_examples: int = EXAMPLES) -> DataFrame:
    """One row: total rows, surplus rows, repeated keys and the smallest of them (M2).

    A missing text key counts as the empty text.
    """
    keyed = df.select(*[
        F.coalesce(c, F.lit("")).alias(c) if df.schema[c].dataType.typeName() == "string" else F.col(c)
        for c in key_cols
    ])
    per_key = keyed.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_n"))
    facts = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_surplus"),
        F.count_if(F.col("_n") > 1).alias("n_keys"))
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in key_cols])
    shown = per_key.where("_n > 1").orderBy(*key_cols).limit(n_examples).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*key_cols, text.alias("_t")))), lambda x: x["_t"]), ",")
        .alias("examples"))
    both = facts.unionByName(shown, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("n_rows", "n_surplus", "n_keys", "examples")])


def alignment(verdicts: DataFrame, baseline: DataFrame, key: str = "task_id") -> DataFrame:
    """Verdict ids against input ids: missing and extra (M3)."""
    return coverage(verdicts, baseline, key)


def sample_rows(verdicts: DataFrame, id_field: str, n: int = SAMPLE_SIZE, seed: int = SAMPLE_SEED,
                tie_cols: Sequence[str] = ()) -> DataFrame:
    """Repeatable pseudo-random rows: the ``n`` smallest seeded hashes of the id."""
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_field).cast("string")))
    return verdicts.orderBy(hashed, *tie_cols).limit(n)


def sample_audit(verdicts: DataFrame, schema: VerdictSchema, version: str, n: int | None = SAMPLE_SIZE,
                 seed: int = SAMPLE_SEED, tie_cols: Sequence[str] = (), reason_policy: str = "all") -> DataFrame:
    """Schema violations of a repeatable sample, one row each; ``n=None`` scans everything (M4).

    ``reason_policy="all"`` reports every short reason; ``"ratio"`` allows them
    as the batch gate does, while the share of long ones reaches the minimum.
    """
    if reason_policy not in ("all", "ratio"):
        raise PlanError(f"reason_policy is 'all' or 'ratio', got {reason_policy!r}")
    rows = verdicts if n is None else sample_rows(verdicts, schema.id_field, n, seed, tie_cols)
    rows = with_chars(rows, schema)
    found = rows.select(F.col(schema.id_field).alias("task_id"), F.explode(row_errors(schema, version)).alias("error"))
    if reason_policy == "ratio":
        share = rows.agg(F.avg(long_enough(schema).cast("int"))).first()[0]
        if share is not None and share >= schema.reason_long_ratio_min:
            found = found.where(F.col("error") != f"{schema.reason_field} length")
    return found


def ordered_merge(verdicts: DataFrame, baseline_order: DataFrame, seq_cols: Sequence[str] | None = None) -> DataFrame:
    """One verdict per baseline id with its ``batch_idx, pos`` (M5).

    With ``seq_cols`` (unique per id) the last verdict by those columns wins;
    without, ids must already be unique, as the merge audit has shown. The
    winners are found on ids and order columns alone; the wide rows are
    shuffled once, by id and order, which also spreads an id repeated very
    often. Write with ``write_ordered``.
    """
    order = baseline_order.select("task_id", "batch_idx", "pos")
    rows = verdicts.drop("batch_idx", "pos")
    if not seq_cols:
        return order.join(rows, "task_id")
    if len(seq_cols) == 1:
        last = verdicts.groupBy("task_id").agg(F.max(seq_cols[0]).alias(seq_cols[0]))
    else:
        last = verdicts.groupBy("task_id").agg(F.max(F.struct(*seq_cols)).alias("_last")).select("task_id", "_last.*")
    return order.join(last, "task_id").join(rows, ["task_id", *seq_cols]).select(
        "task_id", "batch_idx", "pos", *[c for c in rows.columns if c != "task_id"])


ORDER = ["src_rank", "batch_idx", "pos"]


def combine(prefix: DataFrame, merged: DataFrame, prefix_order: str) -> DataFrame:
    """An earlier partial set in front of the merged rows; versions may differ (M6).

    ``prefix_order`` is the prefix's own row order. The result sorts by
    ``src_rank, batch_idx, pos``.
    """
    first = (prefix.withColumn("src_rank", F.lit(0)).withColumn("batch_idx", F.lit(0).cast("bigint"))
             .withColumn("pos", F.col(prefix_order).cast("bigint")))
    second = merged.withColumn("src_rank", F.lit(1))
    return first.unionByName(second, allowMissingColumns=True)


def id_facts(verdicts: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: verdict rows, surplus rows, ids missing and extra, with examples."""
    tagged = verdicts.select("task_id", F.lit(False).alias("_base")).unionByName(
        baseline.select("task_id", F.lit(True).alias("_base")))
    per_id = tagged.groupBy("task_id").agg(F.count_if(~F.col("_base")).alias("_n"), F.bool_or("_base").alias("_in_base"))
    missing, extra = F.col("_n") == 0, ~F.col("_in_base")
    return per_id.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.greatest(F.col("_n") - 1, F.lit(0))), F.lit(0)).alias("n_surplus"),
        F.count_if(missing).alias("n_missing"),
        F.count_if(extra).alias("n_extra"),
        F.min(F.when(missing, F.col("task_id"))).cast("string").alias("missing_example"),
        F.min(F.when(extra, F.col("task_id"))).cast("string").alias("extra_example"),
    )


def merge_report(verdicts: DataFrame, baseline_order: DataFrame, declared: DataFrame, schema: VerdictSchema,
                 version: str, total: int | None = None, n: int | None = SAMPLE_SIZE,
                 reason_policy: str = "all") -> DataFrame:
    """The five merge layers as audit rows; totals, repeats and alignment share one shuffle by id."""
    text = F.format_string
    facts = as_lookup(id_facts(verdicts, baseline_order))
    examples = F.lit("")
    if facts.first().n_surplus:
        examples = F.lit(dup_report(verdicts, ["task_id"]).first().examples)
    counts = check_rows(merge_counts(verdicts, declared), "2 shard count", F.col("shard_id"),
                        n_bad=F.abs(F.col("actual") - F.coalesce("declared", F.lit(0))),
                        detail=text("%d rows, declared %d", F.col("actual"), F.col("declared")))
    want = F.lit(total).cast("bigint")
    totals = check_rows(facts, "3a total", F.lit("rows"), F.coalesce(F.col("n_rows") == want, F.lit(True)),
                        F.abs(F.col("n_rows") - want), detail=text("%d rows, declared %d", F.col("n_rows"), want))
    unique = check_rows(facts, "3b unique", F.lit("ids"), F.col("n_surplus") == 0, F.col("n_surplus"), examples)
    align = check_rows(facts, "4 alignment", F.lit("ids"), (F.col("n_missing") == 0) & (F.col("n_extra") == 0),
                       n_bad=F.col("n_missing") + F.col("n_extra"),
                       example=F.coalesce("missing_example", "extra_example"),
                       detail=text("missing %d, extra %d", F.col("n_missing"), F.col("n_extra")))
    sample = sample_audit(verdicts, schema, version, n, reason_policy=reason_policy).agg(
        F.count(F.lit(1)).alias("n_bad"), F.min(F.concat_ws(": ", "task_id", "error")).alias("example"))
    sampled = check_rows(sample, "5 sample", F.lit("schema"), F.col("n_bad") == 0)
    return union_reports([counts, totals, unique, align, sampled])


def output_name(stem: str, kind: str = "merged", day: date | None = None) -> str:
    return f"{stem}_{kind}_{(day or date.today()).strftime('%Y%m%d')}"


def merge_publish(verdicts: DataFrame, baseline_order: DataFrame, declared: DataFrame, schema: VerdictSchema,
                  version: str, out_dir: str, stem: str = "merged", total: int | None = None,
                  prefix: DataFrame | None = None, prefix_order: str = "seq", dry_run: bool = False,
                  day: date | None = None, fmt: str = "json", reason_policy: str = "all",
                  line_field: str | None = None, keep_order: bool = False, mode: str = "default",
                  n: int | None = SAMPLE_SIZE) -> list[str]:
    """Audit, then write; any failed layer raises and leaves no output (M7).

    All outputs are written aside first and take their places only when each is complete.
    An output that has rows is replaced with ``mode="force"`` only. ``n`` is the size of
    the schema sample, None checks every row.

    Returns the written paths: the merged set, and the combined one if a
    ``prefix`` was given. ``line_field`` names a column with the raw lines, which
    are then written as they came. ``keep_order`` leaves the order columns in.
    """
    assert_clean(merge_report(verdicts, baseline_order, declared, schema, version, total, n, reason_policy=reason_policy))
    if dry_run:
        return []
    fields = [line_field] if line_field else [c for c in verdicts.columns if c not in (schema.chars_field, "task_id", "src")]
    merged = ordered_merge(verdicts.select("task_id", *fields), baseline_order)
    outputs = [(output_name(stem, "merged", day), merged, ["batch_idx", "pos"])]
    if prefix is not None:
        outputs.append((output_name(stem, "combined", day), combine(prefix, merged, prefix_order), ORDER))
    spark, staged = merged.sparkSession, {}
    kind = "text" if line_field else fmt
    places = {name: f"{out_dir.rstrip('/')}/{name}" for name, _, _ in outputs}
    taken = [path for path in places.values() if mode != "force" and has_rows(spark, path, kind)]
    if taken:
        raise PlanError(f"rows found in {', '.join(taken)}: only mode='force' replaces them")
    try:
        for name, df, order in outputs:
            staged[name] = f"{out_dir.rstrip('/')}/.staging-{uuid.uuid4().hex}"
            rows = df.select(*order, F.col(line_field).alias("value")) if line_field else df
            write_ordered(rows, staged[name], order, kind, drop=[] if keep_order and not line_field else order)
    except BaseException:
        for folder in staged.values():
            remove(spark, folder)
        raise
    for name, folder in staged.items():
        swap_in(spark, folder, places[name])
    return list(places.values())


def merge_commit(verdicts: DataFrame, baseline_order: DataFrame, declared: DataFrame, schema: VerdictSchema, version: str,
                 root: str, total: int | None = None, prefix: DataFrame | None = None, prefix_order: str = "seq",
                 fmt: str = "json", reason_policy: str = "all", line_field: str | None = None, n: int | None = SAMPLE_SIZE,
                 n_files: int | None = None) -> int:
    """Audit and write the merged set, and the combined one, as one version of ``root`` (M7).

    What is audited is what is written: the verdicts are read once, into a table that both the audit and the
    merge use, so rows that arrive meanwhile take no part. The outputs ``merged`` and ``combined`` change
    together when the commit is named; a failed layer or a lost writer leaves the version before.

    The baseline's ``pos`` and the prefix's ``prefix_order`` are dense from 1, so files follow from places.
    Returns the number of the commit.
    """
    spark = verdicts.sparkSession
    fields = [line_field] if line_field else [c for c in verdicts.columns if c not in (schema.chars_field, "task_id", "src")]
    frozen = materialize(with_chars(verdicts, schema), "merge-input")
    assert_clean(merge_report(frozen, baseline_order, declared, schema, version, total, n, reason_policy=reason_policy))
    merged = ordered_merge(frozen.select("task_id", *fields), baseline_order)
    rows = baseline_order.agg(F.max("pos")).first()[0] or 0
    kind = "text" if line_field else fmt

    def shaped(df: DataFrame, place: Column) -> DataFrame:
        placed = df.withColumn("_place", place)
        return placed.select("_place", F.col(line_field).alias("value")) if line_field else placed.drop("batch_idx", "pos", "src_rank")

    def write(draft: Draft) -> None:
        write_placed(shaped(merged, F.col("pos")), draft.place("merged"), "_place", rows, kind, n_files, ["_place"])
        if prefix is not None:
            first = prefix.agg(F.max(prefix_order)).first()[0] or 0
            both = combine(prefix, merged, prefix_order)
            place = F.col("pos") + F.when(F.col("src_rank") == 0, 0).otherwise(first)
            write_placed(shaped(both, place).drop(prefix_order), draft.place("combined"), "_place", first + rows, kind, n_files, ["_place"])

    return write_version(spark, root, write, "merge")
