"""Source and sink queries (S1-S7): write the given tables as files, read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.cluster import scratch_path
from labelloom.operators import monitor as M
from labelloom.operators.index import dense_index
from labelloom.operators.monitor import tail_n
from labelloom.plans.shards import shard_manifest
from labelloom.sources import documents as D
from labelloom.sources import files as S
from labelloom.sources import sinks as K
from labelloom.sources import store
from labelloom.sources import versions as W
from workload.inputs import SCHEMA, Inputs
from workload.registry import query

TASK_SCHEMA = T.StructType([
    T.StructField("task_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
])


@query("read_tasks", "SELECT task_id, lang, source, length(text) AS n, md5(text) AS text_md5 FROM v_tasks")
def read_tasks(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "tasks")
    i.tasks.write.json(path)
    rows = S.read_tasks(i.spark, path, TASK_SCHEMA)
    return rows.select("task_id", "lang", "source", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("text_md5"))


def _verdict_lines(i: Inputs) -> str:
    """Verdicts as JSON text; toxic low-quality rows end as cut lines, toxic good ones as meta rows."""
    path = scratch_path(i.spark, "verdicts")
    whole = F.to_json(F.struct(F.col("task_id").cast("string").alias("task_id"), "qa", "reason", "schema_version"))
    line = (F.when((F.col("schema_version") == "v0") & (F.col("qa") == "no"),
                   F.concat(F.lit('{"task_id": "'), F.col("task_id").cast("string")))
            .when(F.col("schema_version") == "v0", F.lit('{"__meta__": true, "note": "x"}')).otherwise(whole))
    i.verdicts.select(line.alias("value")).write.text(path)
    return path


@query("read_verdicts", """
    SELECT CAST(task_id AS VARCHAR) AS task_id, qa, schema_version, length(reason) AS n FROM v_verdicts WHERE schema_version = 'v1'""")
def read_verdicts(i: Inputs) -> DataFrame:
    good, _ = S.read_verdicts(i.spark, _verdict_lines(i), SCHEMA, on_bad="quarantine")
    return good.select("task_id", "qa", "schema_version", F.length("reason").cast("bigint").alias("n"))


@query("read_verdicts_bad", """
    SELECT concat('{"task_id": "', CAST(task_id AS VARCHAR)) AS line FROM v_verdicts WHERE schema_version = 'v0' AND qa = 'no'""")
def read_verdicts_bad(i: Inputs) -> DataFrame:
    _, bad = S.read_verdicts(i.spark, _verdict_lines(i), SCHEMA, on_bad="quarantine")
    return bad.select("line")


def _manifest_docs(i: Inputs) -> str:
    """One manifest document per batch; a document holds the ids of one batch of 50."""
    path = scratch_path(i.spark, "manifest")
    ids = i.members.groupBy("batch_idx").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "task_id"))), lambda x: x["task_id"].cast("string")).alias("task_ids"))
    docs = i.batches.join(ids, "batch_idx").select(
        F.lit("documents").alias("source"), F.lit(50).alias("batch_size"), F.lit(1).alias("n_batches"),
        F.col("n_tasks").alias("total_tasks"), "shard_id",
        F.array(F.struct("story_id", F.concat(F.lit("stories/"), "story_id").alias("input_file"), "n_tasks", "task_ids")).alias("batches"))
    docs.write.json(path)
    return path


@query("read_manifest", "SELECT batch_idx, story_id, concat('stories/', story_id) AS input_file, n_tasks FROM v_batches")
def read_manifest(i: Inputs) -> DataFrame:
    _, batches, _ = S.read_manifest(i.spark, _manifest_docs(i), multi_line=False)
    return batches.drop("file")


@query("read_manifest_tasks", """
    SELECT batch_idx, CAST(task_id AS VARCHAR) AS task_id, (pos - 1) % 50 + 1 AS pos FROM v_batch_tasks""")
def read_manifest_tasks(i: Inputs) -> DataFrame:
    _, _, tasks = S.read_manifest(i.spark, _manifest_docs(i), multi_line=False)
    return tasks.drop("file")


@query("read_stories", "SELECT shard_id, story_id, CAST(1 AS BIGINT) AS pos, priority, passes, attempts, timeout_text FROM v_stories")
def read_stories(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "stories")
    story = F.struct(F.col("story_id").alias("id"), "priority", "passes", "attempts", F.col("timeout_text").alias("timeoutSeconds"))
    docs = i.stories.select("shard_id", F.lit("demo").alias("project"), F.array(story).alias("userStories"))
    docs.write.partitionBy("shard_id").json(path)
    rows = S.read_stories(i.spark, path, multi_line=False, shard_pattern=r"shard_id=([^/]+)/")
    return rows.select("shard_id", "story_id", "pos", "priority", "passes", "attempts", "timeout_text")


def _log_files(i: Inputs) -> str:
    path = scratch_path(i.spark, "logs")
    lines = i.logs.select("shard_id", "source", "seq", F.concat_ws(" ", F.format_string("%012d", "seq"), "line").alias("value"))
    ordered = lines.repartitionByRange("shard_id", "source", "seq").sortWithinPartitions("shard_id", "source", "seq")
    ordered.drop("seq").write.partitionBy("shard_id", "source").text(path)
    return path


def _logs_back(i: Inputs) -> DataFrame:
    return S.read_logs(i.spark, _log_files(i), "*.txt", r"shard_id=([^/]+)/", r"source=([^/]+)/")


@query("read_logs", "SELECT shard_id, source, concat(printf('%012d', seq), ' ', line) AS line FROM v_log")
def read_logs(i: Inputs) -> DataFrame:
    return _logs_back(i).drop("seq")


@query("read_logs_tail", """
    SELECT shard_id, source, concat(printf('%012d', seq), ' ', line) AS line,
           row_number() OVER (PARTITION BY shard_id, source ORDER BY seq) AS rn
    FROM (SELECT *, row_number() OVER (PARTITION BY shard_id, source ORDER BY seq DESC) AS back FROM v_log) WHERE back <= 50""")
def read_logs_tail(i: Inputs) -> DataFrame:
    """The order of lines in files decides which are last."""
    return tail_n(_logs_back(i), ["shard_id", "source"], "seq").drop("seq")


@query("write_ordered", """
    SELECT row_number() OVER (ORDER BY pos) AS line_no, v.task_id, v.qa
    FROM v_verdicts v JOIN v_members m ON m.task_id = v.task_id""")
def write_ordered(i: Inputs) -> DataFrame:
    """The n-th line over all files, by file name and line, is the n-th row in order."""
    path = scratch_path(i.spark, "ordered")
    placed = i.verdicts.join(i.members.select("task_id", "batch_idx", "pos"), "task_id")
    K.write_ordered(placed, path, ["batch_idx", "pos"], n_files=8, drop=["batch_idx", "pos", "reason"])
    numbered = S.number_all(S.read_lines(i.spark, path))
    return numbered.select("line_no", F.from_json("line", "task_id bigint, qa string").alias("r")).select("line_no", "r.*")


@query("publish", "SELECT shard_id, count(*) AS n FROM v_verdicts_dirty GROUP BY shard_id")
def publish(i: Inputs) -> DataFrame:
    """A first publish, then a forced one that replaces it."""
    path = scratch_path(i.spark, "published")
    K.publish(i.spark, path, lambda p: i.verdicts.write.parquet(p))
    K.publish(i.spark, path, lambda p: i.verdicts_dirty.write.parquet(p), mode="force")
    return i.spark.read.parquet(path).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))


@query("publish_plan", "SELECT shard_id, count(*) AS n, CAST(0 AS BIGINT) AS n_verdicts FROM v_members GROUP BY shard_id")
def publish_plan(i: Inputs) -> DataFrame:
    """Plan tables with an empty verdict state, refreshed once with the state kept."""
    root = scratch_path(i.spark, "plan")
    state = {"verdicts": T.StructType([T.StructField("shard_id", T.StringType()), T.StructField("task_id", T.LongType())])}
    for mode in ("default", "refresh"):
        K.publish_plan(i.spark, root, {"members": i.members, "batches": i.batches}, state, mode)
    verdicts = i.spark.read.parquet(f"{root}/state/verdicts").groupBy("shard_id").agg(F.count(F.lit(1)).alias("v"))
    members = i.spark.read.parquet(f"{root}/plan/members").groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
    return members.join(verdicts, "shard_id", "left").select("shard_id", "n", F.coalesce("v", F.lit(0)).cast("bigint").alias("n_verdicts"))


@query("publish_versions", """
    SELECT shard_id, count(*) AS n, CAST(2 AS BIGINT) AS version, (SELECT count(*) FROM v_verdicts) AS n_verdicts
    FROM v_members_dirty GROUP BY shard_id""")
def publish_versions(i: Inputs) -> DataFrame:
    """A plan, then another one over its kept verdicts; readers follow the commit, old folders go."""
    root = scratch_path(i.spark, "versions")
    schema = i.verdicts.select("shard_id", "task_id").schema

    def first(draft: W.Draft) -> None:
        draft.write("members", i.members)
        draft.write("verdicts", i.verdicts.select("shard_id", "task_id"))

    W.write_version(i.spark, root, first)
    W.publish_versions(i.spark, root, {"members": i.members_dirty}, {"verdicts": schema}, "refresh")
    W.prune(i.spark, root, 1)
    commit = W.current(i.spark, root)
    n = W.read_table(i.spark, root, "verdicts").count()
    return W.read_table(i.spark, root, "members").groupBy("shard_id").agg(F.count(F.lit(1)).alias("n")).select(
        "shard_id", "n", F.lit(commit["number"]).cast("bigint").alias("version"), F.lit(n).cast("bigint").alias("n_verdicts"))


@query("write_ordered_exact", """
    SELECT row_number() OVER (ORDER BY o_orderkey) AS line_no, o_orderkey, o_custkey FROM orders""")
def write_ordered_exact(i: Inputs) -> DataFrame:
    """Rows that know their place: the n-th line over all files is the n-th order."""
    path = scratch_path(i.spark, "placed")
    orders = dense_index(i.table("orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], name="place")
    K.write_placed(orders, path, "place", orders.count(), n_files=8, drop=["place"])
    numbered = S.number_all(S.read_lines(i.spark, path))
    return numbered.select("line_no", F.from_json("line", "o_orderkey bigint, o_custkey bigint").alias("r")).select("line_no", "r.*")


@query("write_batches", """
    SELECT b.batch_idx, t.task_id, t.pos, length(t.text) AS n, md5(t.text) AS text_md5,
           row_number() OVER (PARTITION BY b.batch_idx ORDER BY t.pos) AS at
    FROM v_tasks t JOIN v_batch_tasks b ON b.task_id = t.task_id""")
def write_batches(i: Inputs) -> DataFrame:
    """The payload of every batch, found again through the index by the order of lines in its file."""
    root = scratch_path(i.spark, "store")
    index = store.write_batches(i.tasks, i.members, root, n_files=4)
    lines = S.number_lines(S.read_lines(i.spark, store.payload_path(root)))
    parsed = lines.select(F.regexp_extract("src.file", "[^/]+$", 0).alias("file"), "line_no", F.from_json("line", TASK_SCHEMA).alias("t"))
    earlier = Window.partitionBy("file").orderBy("offset")  # a file has few batches
    spans = index.withColumn("last", F.sum("n_tasks").over(earlier)).withColumn("first", F.col("last") - F.col("n_tasks"))
    each = spans.select("file", "batch_idx", F.posexplode(F.sequence(F.col("first") + 1, F.col("last"))).alias("k", "line_no"))
    return parsed.join(each, ["file", "line_no"]).join(i.members.select("task_id", "pos"), F.col("t.task_id") == F.col("task_id")).select(
        "batch_idx", "t.task_id", "pos", F.length("t.text").cast("bigint").alias("n"), F.md5("t.text").alias("text_md5"),
        (F.col("k") + 1).cast("bigint").alias("at"))


@query("write_manifest", """
    SELECT b.shard_id, b.batch_idx, b.n_tasks, CAST(t.task_id AS VARCHAR) AS task_id, (t.pos - 1) % 50 + 1 AS pos
    FROM v_batches b JOIN v_batch_tasks t ON t.batch_idx = b.batch_idx""")
def write_manifest(i: Inputs) -> DataFrame:
    """One manifest document per shard, written from pieces and read as documents."""
    path = scratch_path(i.spark, "manifests")
    heads, listed = shard_manifest(i.batches)
    D.write_manifest(heads, listed, i.members, path, 50, {"source": F.lit("documents")})
    _, batches, tasks = S.read_manifest(i.spark, path)
    shard = F.regexp_extract("file", "shard_id=([^/]+)/", 1).alias("shard_id")
    return batches.select(shard, "batch_idx", "n_tasks").join(tasks.drop("file"), "batch_idx").select("shard_id", "batch_idx", "n_tasks", "task_id", "pos")


@query("read_manifest_split", """
    SELECT b.shard_id, b.batch_idx, b.n_tasks, CAST(t.task_id AS VARCHAR) AS task_id, (t.pos - 1) % 50 + 1 AS pos
    FROM v_batches b JOIN v_batch_tasks t ON t.batch_idx = b.batch_idx""")
def read_manifest_split(i: Inputs) -> DataFrame:
    """The same documents, each parsed entry by entry in many tasks."""
    path = scratch_path(i.spark, "manifests")
    heads, listed = shard_manifest(i.batches)
    D.write_manifest(heads, listed, i.members, path, 50, {"source": F.lit("documents")})
    header, batches, tasks = S.read_manifest_split(i.spark, path)
    rows = batches.join(header.select("file", "shard_id"), "file").select("shard_id", "batch_idx", "n_tasks")
    return rows.join(tasks.drop("file"), "batch_idx").select("shard_id", "batch_idx", "n_tasks", "task_id", "pos")


@query("write_stories", """
    SELECT shard_id, story_id, row_number() OVER (PARTITION BY shard_id ORDER BY pos) AS pos, priority, passes, attempts, timeout_text FROM v_stories""")
def write_stories(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "story-documents")
    D.write_stories(i.stories, path, F.lit("demo"))
    rows = S.read_stories(i.spark, path, shard_pattern=r"shard_id=([^/]+)/")
    return rows.select("shard_id", "story_id", "pos", "priority", "passes", "attempts", "timeout_text")


@query("status_document", """
    SELECT shard_id AS shard, count(*) FILTER (WHERE passes) AS done, count(*) AS total, shard_id IN ('a', 'c') AS alive,
           coalesce(string_agg(story_id, ',' ORDER BY pos) FILTER (WHERE NOT passes), '') AS pending
    FROM v_stories GROUP BY shard_id""")
def status_document(i: Inputs) -> DataFrame:
    """One document over all shards with every pending story, read back as one JSON value."""
    path = scratch_path(i.spark, "status")
    alive = i.batches.select("shard_id").distinct().withColumn("alive", F.col("shard_id").isin("a", "c"))
    stamp = F.lit("2026-01-02 03:04:05").cast("timestamp")
    D.status_document(M.progress(i.stories), alive, M.pending_stories(i.stories), 3, stamp, path)
    shard = "struct<shard:string,done:bigint,total:bigint,alive:boolean,pending:array<string>>"
    doc = i.spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(f"shards array<{shard}>").json(path)
    return doc.select(F.explode("shards").alias("s")).select("s.shard", "s.done", "s.total", "s.alive", F.array_join("s.pending", ",").alias("pending"))
