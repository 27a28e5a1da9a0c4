"""One nested document per shard from ordered rows.

A document is cut where JSON allows white space: its head, one piece per entry, its tail. The pieces are
rows, computed in many tasks; they are put in order by one shuffle by shard and written one after the
other, so no cell, and no memory of a task, holds a whole document. A document is one file, so one task
writes it out; where a shard is too large for that, write one document per batch instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.model import STORY_SCHEMA

_ENTRY = ["shard_id", "a", "b", "value"]


def _piece(rows: DataFrame, a: Column, b: Column, value: Column) -> DataFrame:
    return rows.select("shard_id", a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), value.alias("value"))


def _open(fields: Sequence[tuple[str, Column]], name: str) -> Column:
    """Text of an object up to the opening of its last field, a list."""
    body = F.to_json(F.struct(*[c.alias(n) for n, c in fields]))
    inner = F.substring(body, F.lit(2), F.length(body) - 2)
    return F.concat(F.lit("{"), inner, F.when(F.length(inner) > 0, ", ").otherwise(""), F.lit(f'"{name}": ['))


def write_pieces(pieces: DataFrame, path: str) -> None:
    """Write ``pieces`` (shard_id, a, b, value) as one document per shard, ordered by a and b."""
    ordered = pieces.repartition("shard_id").sortWithinPartitions("shard_id", "a", "b")
    ordered.select("shard_id", "value").write.partitionBy("shard_id").text(path)


def _comma(seq: Column) -> Column:
    return F.when(seq > 1, ", ").otherwise("")


def write_manifest(heads: DataFrame, batches: DataFrame, members: DataFrame, path: str, batch_size: int,
                   carried: Mapping[str, Column] | None = None) -> None:
    """Manifest documents from shard headers, batch rows (``seq`` 1..k) and members; S3 reads them.

    ``carried`` are header fields of the baseline such as ``source``. The ids of one batch are one cell, as
    a batch has ``batch_size`` tasks.
    """
    fields = [*(carried or {}).items(), ("batch_size", F.lit(batch_size)), ("n_batches", F.col("n_batches")), ("total_tasks", F.col("total_tasks")),
              ("shard_id", F.col("shard_id")), ("shard_root", F.col("shard_root")), ("batch_range", F.col("batch_range"))]
    ids = members.groupBy("batch_idx").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "task_id"))), lambda x: x["task_id"].cast("string")).alias("task_ids"))
    entry = F.to_json(F.struct("story_id", "input_file", "n_tasks", "task_ids"))
    listed = batches.join(ids, "batch_idx")
    pieces = [_piece(heads, F.lit(0), F.lit(0), _open(fields, "batches")),
              _piece(listed, F.col("seq"), F.lit(0), F.concat(_comma(F.col("seq")), entry)),
              _piece(heads, F.col("n_batches") + 1, F.lit(0), F.lit("]}"))]
    write_pieces(pieces[0].unionByName(pieces[1]).unionByName(pieces[2]), path)


# Columns of story rows and the fields of a story document that hold them.
STORY_FIELDS = {"id": "story_id", "title": "title", "description": "description", "storyType": "story_type", "entryCount": "entry_count",
                "modifies": "modifies", "creates": "creates", "acceptanceCriteria": "acceptance_criteria", "acceptanceGate": "acceptanceGate",
                "priority": "priority", "passes": "passes", "attempts": "attempts", "timeoutSeconds": "timeout_text", "notes": "notes"}


def write_stories(stories: DataFrame, path: str, project: Column, acceptance: str = "{}") -> None:
    """Story documents from story rows with ``pos`` 1..k per shard; S4 reads them.

    ``acceptance`` is the JSON text of the project's acceptance settings. Fields without a column are left out.
    """
    kinds = {f.name: f.dataType for f in STORY_SCHEMA}
    held = [F.col(c).cast(kinds[n]).alias(n) for n, c in STORY_FIELDS.items() if c in stories.columns]
    heads = stories.groupBy("shard_id").agg(F.max("pos").alias("last"))
    pieces = _piece(heads, F.lit(0), F.lit(0), F.concat(
        F.lit('{"acceptance": ' + acceptance + ', "project": '), F.concat(F.lit('"'), project, F.lit('"')), F.lit(', "userStories": [')))
    # Places need not be dense, so the comma goes by the shard's first one.
    first = stories.groupBy("shard_id").agg(F.min("pos").alias("_first"))
    entries = stories.join(first, "shard_id")
    comma = F.when(F.col("pos") > F.col("_first"), ", ").otherwise("")
    pieces = pieces.unionByName(_piece(entries, F.col("pos"), F.lit(0), F.concat(comma, F.to_json(F.struct(*held)))))
    write_pieces(pieces.unionByName(_piece(heads, F.col("last") + 1, F.lit(0), F.lit("]}"))), path)


def status_pieces(progress_rows: DataFrame, alive: DataFrame, pending: DataFrame, iteration: int, shown_at: Column) -> DataFrame:
    """Pieces of the status document: every shard with its pending story ids (``pending`` has seq 1..k)."""
    rows = progress_rows.join(alive, "shard_id", "left").withColumns({"_alive": F.coalesce("alive", F.lit(False)), "_shown": shown_at})
    fields = [("ts", F.col("_shown")), ("iteration", F.lit(iteration)), ("shard", F.col("shard_id")), ("alive", F.col("_alive")),
              ("done", F.col("done")), ("total", F.col("total")), ("n_pending", F.col("n_pending"))]
    heads = _piece(rows, F.lit(0), F.lit(0), _open(fields, "pending"))
    ids = _piece(pending, F.lit(1), F.col("seq"), F.concat(_comma(F.col("seq")), F.to_json(F.struct(F.col("story_id").alias("s")))))
    # The text of one id without the object around it.
    ids = ids.withColumn("value", F.regexp_replace("value", r'\{"s":(.*)\}$', "$1"))
    return heads.unionByName(ids).unionByName(_piece(rows, F.lit(2), F.lit(0), F.lit("]}")))


def status_document(progress_rows: DataFrame, alive: DataFrame, pending: DataFrame, iteration: int, ts: Column, path: str,
                    tz: str = "UTC") -> None:
    """One status document ``{"shards": [...]}`` with all pending ids, time shown in ``tz``.

    It is one file, so one task writes its pieces out in order.
    """
    shown = F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM-dd HH:mm:ss")
    pieces = status_pieces(progress_rows, alive, pending, iteration, shown)
    spark = progress_rows.sparkSession
    least = progress_rows.agg(F.min("shard_id")).first()[0]
    pieces = status_pieces(progress_rows, alive, pending, iteration, shown)
    first = progress_rows.agg(F.min("shard_id").alias("first"))
    lead = F.when((F.col("a") == 0) & (F.col("shard_id") > F.col("first")), ", ").otherwise("")
    # The least shard is one row, so it travels with every piece instead of through the driver.
    spark = progress_rows.sparkSession
    least = first.first()[0]
    body = pieces.withColumn("value", F.concat(F.when((F.col("a") == 0) & (F.col("shard_id") > F.lit(least)), ", ").otherwise(""), "value"))
    ends = spark.createDataFrame([(None, 0, 0, '{"shards": ['), (None, 9, 0, "]}")], "shard_id string, a bigint, b bigint, value string")
    every = body.select(F.lit(1).alias("part"), *_ENTRY).unionByName(ends.select(
        F.when(F.col("a") == 0, 0).otherwise(2).alias("part"), *_ENTRY))
    every.repartition(1).sortWithinPartitions("part", "shard_id", "a", "b").select("value").write.text(path)
