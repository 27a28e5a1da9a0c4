"""The same input views as DataFrames, built with the library's own operators.

Plan tables (batches, members and text-keyed members) are computed once per session and folder and
kept as tables, as a real run plans once and then reads its plan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.cluster import materialize
from labelloom.model import VerdictSchema
from labelloom.plans.batches import batch_table, batchify
from labelloom.plans.shards import auto_split
from labelloom.sources.sinks import is_folder

SCHEMA = VerdictSchema(valid_qa=("yes", "no"))
VERSION = "v1"
N_SHARDS = 4

_PLANS: dict[tuple[str, str, str], tuple[DataFrame, ...]] = {}
_PLACES: dict[tuple[str, str, str], str] = {}


def letter(ordinal: Column) -> Column:
    return F.chr(ordinal + 97)


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """A table as a stream of its files; a table is one file or a folder of them."""
        reader = self.spark.readStream.schema(self.table(name).schema)
        path = f"{self.sf_dir}/{name}.parquet"
        # A stream lists a folder, so a single file is picked from the one around it.
        return reader.parquet(path) if is_folder(self.spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)

    @property
    def tasks(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("task_id"), "text", "lang", "source")

    @property
    def task_ids(self) -> DataFrame:
        return self.tasks.select("task_id")

    def _once(self, name: str, build: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _PLANS:
            _PLANS[key] = build()
        return _PLANS[key]

    def place(self, name: str, build: Callable[[Inputs], str]) -> str:
        """A folder that is filled once per session."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _PLACES:
            _PLACES[key] = build(self)
        return _PLACES[key]

    def _plan(self) -> tuple[DataFrame, ...]:
        def build():
            tasks = auto_split(batchify(self.task_ids, ["task_id"]), N_SHARDS)
            members = materialize(tasks.select("shard_id", "batch_idx", "task_id", "pos"), "members")
            return materialize(auto_split(batch_table(members), N_SHARDS), "batches"), members

        return self._once("plan", build)

    @property
    def batches(self) -> DataFrame:
        return self._plan()[0]

    @property
    def members(self) -> DataFrame:
        return self._plan()[1]

    @property
    def members_dirty(self) -> DataFrame:
        """Ids from text, so that copies share an id; the shard is the source."""
        def build():
            docs = self.table("documents").select(
                F.col("doc_id").alias("d"), F.col("source").alias("shard_id"), F.md5("text").alias("task_id"))
            place = self.members.select(F.col("task_id").alias("d"), "batch_idx", "pos")
            return (materialize(docs.join(place, "d").drop("d"), "members_dirty"),)

        return self._once("members_dirty", build)[0]

    @cached_property
    def verdicts(self) -> DataFrame:
        labels = self.table("labels").select(F.col("doc_id").alias("task_id"), "quality", "toxic")
        # The length is taken at the scan, so that checks need no text behind the join.
        texts = self.tasks.select("task_id", F.col("text").alias("reason"), F.length("text").alias("reason_chars"))
        place = self.members.select("task_id", "shard_id", F.col("pos").alias("seq"))
        return labels.join(place, "task_id").join(texts, "task_id").select(
            "shard_id", "task_id", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("qa"), "reason",
            F.when(F.col("toxic") == 1, "v0").otherwise("v1").alias("schema_version"), "seq", "reason_chars")

    @property
    def relabels(self) -> DataFrame:
        """Second verdicts for every row of the old version."""
        return self.verdicts.where("schema_version = 'v0'").select(
            "shard_id", "task_id", F.lit("no").alias("qa"), "reason", F.lit("v1").alias("schema_version"),
            (F.col("seq") + 1_000_000_000).alias("seq"), "reason_chars")

    @property
    def verdicts_dirty(self) -> DataFrame:
        return self.verdicts.unionByName(self.relabels)

    @property
    def submissions(self) -> DataFrame:
        """Labelled texts as incoming verdicts with natural repeats and faults."""
        docs = self.table("documents").select("doc_id", "text", "lang", "source")
        return submitted(docs, self.table("labels"))

    @property
    def stories(self) -> DataFrame:
        i = F.col("batch_idx")
        timeout = F.when(i % 4 == 1, "1200").when(i % 4 == 2, "-5").when(i % 4 == 3, "abc")
        return self.batches.select(
            "shard_id", i.alias("pos"), "batch_idx", "story_id", "n_tasks", ((i * 7) % 11).alias("priority"),
            (i % 3 == 0).alias("passes"), (i % 5).alias("attempts"), timeout.alias("timeout_text"))

    @property
    def logs(self) -> DataFrame:
        n, kind = F.col("event_id"), F.col("event_type")
        error = kind == "error"
        line = (
            F.when(error & (n % 97 == 0), "FATAL: working tree is dirty")
            .when(error & (n % 7 == 0), "overloaded_error, retry")
            .when(error & (n % 5 == 0), "Rate-Limit reached")
            .when(error, F.concat(F.lit("status="), (n % 100 + 400).cast("string")))
            .otherwise(F.concat(F.lit("ok "), kind)))
        return self.table("events").select(
            letter(F.col("user_id") % 4).alias("shard_id"),
            F.when(kind.isin("error", "view"), "run").otherwise("loop").alias("source"), n.alias("seq"), line.alias("line"))

    @property
    def sweeps(self) -> DataFrame:
        """Progress, heartbeat and cause of many sweeps, from orders."""
        price = F.col("o_totalprice")
        return self.table("orders").groupBy(F.col("o_custkey").alias("sweep"), F.col("o_orderpriority").alias("shard_id")).agg(
            F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") != "P").alias("done"),
            F.bool_or(price > 200000).alias("alive"),
            F.when(F.max(price) > 250000, "rate_limit").when(F.min(price) < 50000, "dirty_tree").otherwise("other").alias("cause"))

    @property
    def _orders_by_iteration(self) -> DataFrame:
        return self.table("orders").select(
            (F.col("o_custkey") * 10000 + F.year("o_orderdate")).alias("iteration"), F.col("o_orderkey").alias("story_id"),
            "o_orderstatus", "o_orderpriority")

    @property
    def before(self) -> DataFrame:
        return self._orders_by_iteration.select("iteration", "story_id", (F.col("o_orderstatus") == "P").alias("passes"))

    @property
    def after(self) -> DataFrame:
        status, urgency = F.col("o_orderstatus"), F.col("o_orderpriority")
        passes = (F.when((status == "O") & (urgency == "1-URGENT"), True)
                  .when(status == "P", urgency != "5-LOW").otherwise(False))
        return self._orders_by_iteration.select("iteration", "story_id", passes.alias("passes"))

    @property
    def locks(self) -> DataFrame:
        return self._orders_by_iteration.groupBy("iteration").agg(F.min("story_id").alias("locked_id"))

    @property
    def outputs(self) -> DataFrame:
        kind = F.col("event_type")
        text = (F.when(kind == "purchase", "done <promise>COMPLETE</promise>").when(kind == "view", "<promise>YIELD</promise>")
                .when(kind == "error", F.concat(F.lit("VIOLATION: item "), F.col("event_id").cast("string")))
                .otherwise("no token"))
        return self.table("events").select(
            F.col("event_id").alias("iteration"), letter(F.col("user_id") % 4).alias("shard_id"), text.alias("output"))

    @property
    def runs(self) -> DataFrame:
        stories = self.stories.select("story_id", "pos")
        events = self.table("events").select(
            F.col("event_id").alias("run_id"), (F.col("user_id") % 4 + 1).alias("pos"),
            (F.col("event_id") % 3000).alias("seconds"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).cast("bigint").alias("exit_code"))
        return events.join(stories, "pos").drop("pos")

    @property
    def write_events(self) -> DataFrame:
        n, kind = F.col("event_id"), F.col("event_type")
        path = (
            F.when(n % 13 == 0, F.lit(None).cast("string"))
            .when(n % 10 == 0, F.concat(F.lit("/tmp/"), kind))
            .when(n % 10 == 1, F.concat(F.lit(".baseline/state/"), kind))
            .when(n % 10 == 2, F.concat(F.lit("docs/"), kind))
            .when(n % 10 == 3, F.concat(F.lit("src/"), kind, F.lit(".py")))
            .otherwise(F.concat(F.lit(".shard-"), letter(n % 4), F.lit("/state/"), kind,
                                F.when(n % 7 == 0, ".py").otherwise(".jsonl"))))
        return self.table("events").select(
            "event_id", F.concat(F.lit(".shard-"), letter(F.col("user_id") % 4)).alias("shard_root"),
            F.when(n % 11 == 0, "Read").otherwise("Write").alias("tool_name"), path.alias("path"))

    @property
    def ranges(self) -> DataFrame:
        lo = F.floor(F.col("o_totalprice") / 10000).cast("bigint")
        return self.table("orders").select(
            F.col("o_custkey").alias("split_set"), F.col("o_orderkey").alias("ordinal"), lo.alias("lo"),
            (lo + F.month("o_orderdate") - 2).cast("bigint").alias("hi"), F.lit(45).cast("bigint").alias("total"))


def submitted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Join texts with labels into submission rows (also for a stream of texts)."""
    qa = F.when(F.col("quality") == 1, "yes").when(F.col("lang") == "en", "no").when(F.col("lang") == "fr", "maybe")
    facts = docs.withColumns({"task_id": F.md5("text"), "reason_chars": F.length("text")})
    return facts.join(labels, "doc_id").select(
        F.col("source").alias("shard_id"), "task_id", qa.alias("qa"), F.col("text").alias("reason"),
        F.when(F.col("toxic") == 1, "v0").otherwise("v1").alias("schema_version"), F.col("doc_id").alias("seq"), "reason_chars")
