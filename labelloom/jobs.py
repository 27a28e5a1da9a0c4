"""Command line over one project folder, for ``spark-submit`` or ``python -m labelloom.jobs``.

    plan       cut tasks into batches and shards
    audit      check the plan, exit 1 on any failed layer
    ingest     take in verdict files
    gate       judge batches and update stories
    recover    take back the verdicts of batches that were tried in vain, to do them again
    rebalance  move unfinished tasks of stopped shards
    merge      audit all verdicts and publish the ordered set
    dashboard  show progress per shard
    next       show the story that each shard takes up next
    status     write one status document with all pending stories
    alerts     show the alert of each shard and of the whole
    write-audit  check write events, exit 1 on any that is not allowed
    hand-out   write payloads, manifests, stories and prompts for the workers

Folder layout: ``plan`` holds versions of ``assignments, batches, stories, header, gate_results, changes``
(see :mod:`labelloom.sources.versions`), which change all at once, and ``state`` the tables of the ingest, all Parquet. Verdict lines name their
``shard_id``. A later refresh plans anew from the tasks and keeps story state.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.cluster import drop_scratch, materialize
from labelloom.functions.columns import batch_label
from labelloom.model import BATCH_SIZE, AuditError, PlanError, VerdictSchema
from labelloom.operators import audit, gates, merge, monitor, policy, rebalance, state
from labelloom.operators.report import assert_clean
from labelloom.plans import batches as B
from labelloom.plans import shards as S
from labelloom.plans.stories import rebase_stories, refresh_stories
from labelloom.sources import documents, files, sinks, store, versions
from labelloom.streaming import ingest, retract


# Rows of a table that a job prints; the tables themselves are whole.
ROWS_SHOWN = 2_000_000_000


class Project:
    """Tables of one project folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def plan(self, name: str) -> DataFrame:
        return versions.read_table(self.spark, f"{self.root}/plan", name)

    def planned(self, name: str) -> bool:
        now = versions.current(self.spark, f"{self.root}/plan")
        return now is not None and name in now["tables"]

    @property
    def sink(self) -> str:
        return f"{self.root}/state"

    @property
    def arrived(self) -> DataFrame:
        """Verdicts that count, with the micro-batch that brought them."""
        if sinks.exists(self.spark, ingest.accepted_path(self.sink)):
            return ingest.read_accepted(self.spark, self.sink)
        empty = T.StructType([T.StructField(n, T.StringType()) for n in ("task_id", "qa", "reason", "schema_version", "shard_id", "line", "stream_id")])
        return self.spark.createDataFrame([], empty.add("batch_id", "long"))

    @property
    def accepted(self) -> DataFrame:
        return self.arrived.drop("stream_id", "batch_id")

    @property
    def members(self) -> DataFrame:
        return rebalance.active_members(self.plan("assignments"))

    @property
    def baseline(self) -> DataFrame:
        return self.plan("assignments").where("generation = 0").select("task_id", "batch_idx", "pos")

    def save_plan(self, note: str, fresh: bool = False, **tables: DataFrame) -> None:
        """Change the given tables all at once; the others stay, or go if the plan is a ``fresh`` one."""
        def write(draft: versions.Draft) -> None:
            for name, df in tables.items():
                draft.write(name, df)
            for name in set(draft.base["tables"] if draft.base and not fresh else ()) - set(tables):
                draft.keep(name)

        versions.write_version(self.spark, f"{self.root}/plan", write, note)


def batches_of(members: DataFrame) -> DataFrame:
    label = batch_label(F.col("batch_idx"))
    return members.groupBy("shard_id", "batch_idx").agg(F.count(F.lit(1)).alias("n_tasks")).withColumn("story_id", label)


def header_of(batches: DataFrame) -> DataFrame:
    return batches.agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n_tasks").alias("total_tasks"))


def load_contract(path: str | None, spark: SparkSession) -> tuple[str, VerdictSchema, dict]:
    """Version, schema and default gate of a configuration document (a story document's form)."""
    acceptance = files.read_acceptance(spark, path) if path else {}
    gate = acceptance.get("default_gate") or {"type": "jsonl_schema", "schema_version": "v1"}
    version, schema = gates.default_contract({"default_gate": gate})
    return version, schema, {**acceptance, "default_gate": gate}


def plan(p: Project, args) -> None:
    if args.mode == "default" and sinks.has_rows(p.spark, ingest.accepted_path(p.sink)):
        raise PlanError(f"verdicts found in {p.sink}: only --mode force replaces them")
    if args.mode == "refresh" and not p.planned("stories"):
        raise PlanError("nothing planned yet, nothing to refresh")
    schema = T.StructType([T.StructField(args.id_field, T.StringType())])
    tasks = files.read_tasks(p.spark, args.tasks, schema, args.id_field, args.format).select(F.col(args.id_field).alias("task_id"))
    placed = B.batchify(tasks, ["task_id"], args.batch_size)
    total = placed.agg(F.max("batch_idx")).first()[0] or 0
    if args.splits or args.splits_file:
        text = args.splits or "\n".join(r.value for r in p.spark.read.text(args.splits_file, wholetext=True).collect())
        ranges = S.named_ranges(S.parse_splits(text), args.shards, args.wide)
        S.assert_ranges(p.spark, ranges, total)
        members = S.assign_ranges(placed, S.range_table(p.spark, ranges))
    else:
        members = S.auto_split(placed, args.shards, args.wide, total)
    batches = batches_of(members)
    stories = rebase_stories(batches.select(
        "story_id", F.col("batch_idx").alias("pos"), F.col("batch_idx").alias("priority"), "batch_idx",
        F.array(F.lit(".baseline/state/verdicts.jsonl")).alias("modifies")), batches)
    if args.mode == "refresh":
        stories = refresh_stories(stories, p.plan("stories"))
    header = header_of(batches)
    assert_clean(S.check_plan(header, batches, S.shard_headers(batches)))
    if args.mode == "force":
        sinks.remove(p.spark, p.sink)
    p.save_plan("plan", args.mode == "force", assignments=rebalance.first_assignments(members), batches=batches, stories=stories, header=header)
    S.shard_headers(p.plan("batches")).orderBy("shard_id").show(truncate=False)


def run_audit(p: Project, args) -> None:
    batches, baseline = p.plan("batches"), p.plan("assignments").where("generation = 0")
    total = p.plan("header").first().total_tasks
    report = audit.audit_all(p.members, baseline, S.shard_headers(batches), p.plan("stories"), batches, total=total)
    report.orderBy("layer", "subject").show(ROWS_SHOWN, truncate=False)
    assert_clean(report)


def run_ingest(p: Project, args) -> None:
    version, schema, _ = load_contract(args.config, p.spark)
    stream = files.verdict_stream(p.spark, args.source, schema, [T.StructField("shard_id", T.StringType())], keep_line=True)
    ingest.ingest_stream(stream, p.sink, f"{p.sink}/checkpoint", args.stream_id, schema, version, once=not args.follow).awaitTermination()


def gate(p: Project, args) -> None:
    _, _, acceptance = load_contract(args.config, p.spark)
    stories = p.plan("stories")
    own = "acceptanceGate" in stories.columns
    judged = gates.run_gates(stories if own else stories.withColumn("acceptanceGate", F.lit(None).cast("map<string,string>")),
                             p.accepted, p.members, acceptance["default_gate"])
    # An attempt counts for stories whose batch is fully labelled, has news, and has not passed yet.
    earlier = p.plan("gate_results") if p.planned("gate_results") else None
    due = materialize(gates.due_batches(p.members, p.arrived, earlier), "due")
    waiting = stories.where(~F.coalesce("passes", F.lit(False))).select("shard_id", "story_id")
    results = judged.join(p.plan("batches").select("shard_id", "batch_idx", "story_id"), "batch_idx")
    results = results.join(due, "batch_idx").join(waiting, ["shard_id", "story_id"], "left_semi")
    moved = gates.finalize(stories, results, acceptance.get("max_attempts", 3))
    tokens = moved.where("token IS NOT NULL").select("shard_id", "story_id", "token")
    rows = results.join(tokens, ["shard_id", "story_id"], "left").select(
        "shard_id", "story_id", "batch_idx", "mark", "passed", "failures", "diagnostics", "token")
    if earlier is not None:  # the last judgement of every batch
        rows = rows.unionByName(earlier.join(due.select("batch_idx"), "batch_idx", "left_anti"))
    p.save_plan("gate", stories=moved.drop("token"), gate_results=rows)
    monitor.progress(p.plan("stories")).orderBy("shard_id").show(ROWS_SHOWN, truncate=False)


def run_recover(p: Project, args) -> None:
    _, schema, _ = load_contract(args.config, p.spark)
    reset = materialize(retract.recover(p.arrived, p.sink, p.plan("stories"), p.members, schema.id_field), "reset")
    reset.orderBy("batch_idx").show(ROWS_SHOWN, truncate=False)


def run_rebalance(p: Project, args) -> None:
    stopped, keep = args.stopped.split(","), [s for s in args.keep.split(",") if s]
    rebalance.check_rebalance(stopped, keep, args.target)
    assignments, stories = p.plan("assignments"), p.plan("stories")
    drained = rebalance.drain(p.members, p.accepted, stopped)
    rebalance.drain_counts(drained).orderBy("shard_id").show(truncate=False)
    if args.dry_run or drained.isEmpty():
        return
    targets = keep if args.target == "keep" else ["baseline"]
    dealt = rebalance.rebatch(rebalance.pool(drained, stopped), targets, args.batch_size)
    moves = rebalance.next_ids(dealt, assignments)
    generation = assignments.agg(F.max("generation")).first()[0] + 1
    added = rebalance.new_batches(moves)
    clash = rebalance.collisions(added, assignments)
    if not clash.isEmpty():
        raise PlanError(f"batch {clash.first().batch_idx} exists already")
    grown = rebalance.reassign(assignments, drained, moves, generation)
    batches = batches_of(rebalance.active_members(grown))
    rows = rebalance.new_stories(added, stories).select(*[c for c in stories.columns])
    kept = stories.unionByName(rows).join(batches.select("shard_id", "story_id"), ["shard_id", "story_id"], "left_semi")
    log = rebalance.append_plan(p.plan("batches"), stories, moves)["log"].withColumns({
        "generation": F.lit(generation).cast("bigint"), "stopped": F.lit(",".join(stopped))})
    if p.planned("changes"):
        log = p.plan("changes").unionByName(log)
    p.save_plan("rebalance", assignments=grown, batches=batches, stories=kept, header=header_of(batches), changes=log)


def run_merge(p: Project, args) -> None:
    version, schema, _ = load_contract(args.config, p.spark)
    declared = p.members.groupBy("shard_id").agg(F.count(F.lit(1)).alias("total_tasks"))
    prefix = None
    if args.partial:
        first, _ = files.read_verdicts(p.spark, args.partial, schema, keep_line=True)
        prefix = files.number_all(first, "seq").drop("src")
    paths = merge.merge_publish(p.accepted, p.baseline, declared, schema, version, args.out, args.name,
                                p.plan("header").first().total_tasks, prefix, "seq", args.dry_run, line_field="line")
    print(json.dumps({"written": paths}))


def dashboard(p: Project, args) -> None:
    logs = (files.read_logs(p.spark, args.logs) if args.logs
            else p.spark.createDataFrame([], "shard_id string, source string, seq bigint, line string"))
    if sinks.exists(p.spark, ingest.accepted_path(p.sink)):
        seen = ingest.read_accepted(p.spark, p.sink).withColumn("seq", F.struct("batch_id", "src"))
    else:
        seen = p.accepted.withColumn("seq", F.lit(0))
    monitor.dashboard(p.plan("stories"), logs, seen).orderBy("shard").show(ROWS_SHOWN, truncate=False)


def living(p: Project, names: str) -> DataFrame:
    """(shard_id, alive) of every shard; ``names`` are those whose worker runs."""
    running = [n for n in names.split(",") if n]
    return p.plan("batches").select("shard_id").distinct().withColumn("alive", F.col("shard_id").isin(running) if running else F.lit(False))


def show_next(p: Project, args) -> None:
    state.next_story(p.plan("stories")).orderBy("shard_id").show(ROWS_SHOWN, truncate=False)


def status(p: Project, args) -> None:
    stories = p.plan("stories")
    documents.status_document(monitor.progress(stories), living(p, args.alive), monitor.pending_stories(stories), args.iteration,
                              F.current_timestamp(), args.out, args.zone)


def alerts(p: Project, args) -> None:
    tails = monitor.tail_n(files.read_logs(p.spark, args.logs), ["shard_id", "source"], "seq")
    found = monitor.health_alerts(monitor.progress(p.plan("stories")), living(p, args.alive), monitor.classify(tails))
    found.orderBy(F.col("shard_id").asc_nulls_last(), "alert").show(ROWS_SHOWN, truncate=False)


def write_audit(p: Project, args) -> None:
    judged = policy.write_audit(files.read_write_events(p.spark, args.events), args.repo, normalize=True)
    denied = materialize(judged.where("NOT allowed"), "denied")
    denied.groupBy("shard_root", "reason").count().orderBy("shard_root", "reason").show(ROWS_SHOWN, truncate=False)
    if not denied.isEmpty():
        raise AuditError([f"{r.reason}: {r['count']}" for r in denied.groupBy("reason").count().orderBy("reason").collect()])  # few reasons


def hand_out(p: Project, args) -> None:
    """Everything a worker needs: payloads by batch, manifest and story documents, and prompts."""
    _, _, acceptance = load_contract(args.config, p.spark)
    batches, out = p.plan("batches"), args.out.rstrip("/")
    schema = p.spark.read.json(args.tasks).schema if args.format == "json" else p.spark.read.format(args.format).load(args.tasks).schema
    tasks = files.read_tasks(p.spark, args.tasks, schema, args.id_field, args.format)
    store.write_batches(tasks, p.members, f"{out}/tasks", key=args.id_field)
    heads, listed = S.shard_manifest(batches)
    documents.write_manifest(heads, listed, p.members, f"{out}/manifest", args.batch_size)
    documents.write_stories(p.plan("stories"), f"{out}/stories", F.lit("labelloom"), json.dumps(acceptance))
    if args.template:
        template = "\n".join(r.value for r in p.spark.read.text(args.template, wholetext=True).collect())  # one template
        prompts = B.render_template(heads, template, B.shard_prompt_columns(F.col("shard_root")))
        prompts.select("shard_id", F.col("prompt").alias("value")).repartition("shard_id").write.partitionBy("shard_id").text(f"{out}/prompts")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="labelloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--root", required=True, help="project folder")
    top.add_argument("--config", help="document with the acceptance configuration")
    jobs = top.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("plan")
    one.add_argument("--tasks", required=True)
    one.add_argument("--format", default="json")
    one.add_argument("--id-field", default="task_id")
    one.add_argument("--batch-size", type=int, default=BATCH_SIZE)
    one.add_argument("--shards", type=int, required=True)
    one.add_argument("--wide", action="store_true", help="allow more than 26 shards")
    one.add_argument("--splits")
    one.add_argument("--splits-file")
    one.add_argument("--mode", choices=sinks.MODES, default="default")
    one.set_defaults(run=plan)
    jobs.add_parser("audit").set_defaults(run=run_audit)
    one = jobs.add_parser("ingest")
    one.add_argument("--source", required=True)
    one.add_argument("--stream-id", default="verdicts")
    one.add_argument("--follow", action="store_true", help="keep running")
    one.set_defaults(run=run_ingest)
    jobs.add_parser("gate").set_defaults(run=gate)
    jobs.add_parser("recover").set_defaults(run=run_recover)
    one = jobs.add_parser("rebalance")
    one.add_argument("--from", dest="stopped", required=True)
    one.add_argument("--keep", default="")
    one.add_argument("--target", choices=["keep", "baseline"], default="keep")
    one.add_argument("--batch-size", type=int, default=BATCH_SIZE)
    one.add_argument("--dry-run", action="store_true")
    one.set_defaults(run=run_rebalance)
    one = jobs.add_parser("merge")
    one.add_argument("--out", required=True)
    one.add_argument("--name", default="merged")
    one.add_argument("--partial")
    one.add_argument("--dry-run", action="store_true")
    one.set_defaults(run=run_merge)
    one = jobs.add_parser("dashboard")
    one.add_argument("--logs")
    one.set_defaults(run=dashboard)
    jobs.add_parser("next").set_defaults(run=show_next)
    one = jobs.add_parser("status")
    one.add_argument("--out", required=True)
    one.add_argument("--alive", default="", help="shards whose worker runs")
    one.add_argument("--iteration", type=int, default=0)
    one.add_argument("--zone", default="UTC")
    one.set_defaults(run=status)
    one = jobs.add_parser("alerts")
    one.add_argument("--logs", required=True)
    one.add_argument("--alive", default="")
    one.set_defaults(run=alerts)
    one = jobs.add_parser("write-audit")
    one.add_argument("--events", required=True)
    one.add_argument("--repo", required=True, help="folder that the paths are in")
    one.set_defaults(run=write_audit)
    one = jobs.add_parser("hand-out")
    one.add_argument("--tasks", required=True)
    one.add_argument("--format", default="json")
    one.add_argument("--id-field", default="task_id")
    one.add_argument("--batch-size", type=int, default=BATCH_SIZE)
    one.add_argument("--template")
    one.add_argument("--out", required=True)
    one.set_defaults(run=hand_out)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    session = spark or SparkSession.builder.appName(f"labelloom {args.job}").getOrCreate()
    try:
        args.run(Project(session, args.root), args)
    except (AuditError, PlanError) as e:
        print(f"FAILED: {e}", file=sys.stderr)
        return 1
    finally:
        if spark is None:
            drop_scratch(session)
    return 0


if __name__ == "__main__":
    sys.exit(main())
