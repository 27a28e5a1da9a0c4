"""Read tasks, verdicts, manifests, stories and logs.

Schemas are always given. Line formats are read as splittable text, so one
huge file spreads over many tasks and still has an order (see ``line_order``).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.cluster import as_lookup, materialize
from labelloom.functions.columns import batch_number, strip
from labelloom.model import MANIFEST_SCHEMA, STORIES_DOC_SCHEMA, VerdictSchema
from labelloom.operators.index import dense_index

SHARD_IN_PATH = r"shard[-_=]([A-Za-z0-9]+)/"
CORRUPT = "_corrupt_record"


def line_order() -> Column:
    """Position of a line as ``(file, block, row)``; sorts like file name, then line.

    A block is a split of a file; rows of one split keep their order in the
    row number, whatever tasks the splits went to.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_lines(spark: SparkSession, path: str | Sequence[str], glob: str | None = None,
               blank: bool = False) -> DataFrame:
    """Lines with their ``src`` order; blank ones only on request."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    paths = [path] if isinstance(path, str) else list(path)
    lines = reader.text(paths).select(F.col("value").alias("line"), line_order().alias("src"))
    return lines if blank else lines.where(strip(F.col("line")) != "")


def _flat(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"_file": F.col("src.file"), "_block": F.col("src.block"), "_at": F.col("src.row")})


def number_lines(lines: DataFrame, name: str = "line_no") -> DataFrame:
    """Dense line numbers per file for rows with ``src``; lines left out before are not counted."""
    return dense_index(_flat(lines), ["_block", "_at"], ["_file"], name).drop("_file", "_block", "_at")


def number_all(lines: DataFrame, name: str = "line_no") -> DataFrame:
    """Dense numbers over all files, by file name and then line."""
    return dense_index(_flat(lines), ["_file", "_block", "_at"], name=name).drop("_file", "_block", "_at")


def _must(value: Column, text: str | Column) -> Column:
    message = F.lit(text) if isinstance(text, str) else text
    return F.when(value.isNull(), F.raise_error(message)).otherwise(value)


def read_tasks(spark: SparkSession, path: str, schema: T.StructType, id_field: str = "task_id",
               fmt: str = "json", with_src: bool = False) -> DataFrame:
    """Tasks, one object per line or columnar; a bad line or a task without id stops the job."""
    reader = spark.read.schema(schema)
    df = reader.option("mode", "FAILFAST").json(path) if fmt == "json" else reader.format(fmt).load(path)
    if with_src:
        df = df.select("*", line_order().alias("src"))
    return df.withColumn(id_field, _must(F.col(id_field), f"task without {id_field}"))


def _truthy(text: Column) -> Column:
    return F.coalesce(~F.lower(text).isin("", "false", "0", "0.0", "null", "{}", "[]"), F.lit(False))


def parse_lines(lines: DataFrame, schema: VerdictSchema, extra: Sequence[T.StructField] = (),
                keep_all: bool = False) -> DataFrame:
    """Parse ``line`` into ``rec``; ``malformed`` keeps the text of unreadable lines, meta rows are dropped.

    ``keep_all`` keeps meta rows and blank lines, which are not malformed.
    """
    parsed_type = T.StructType([*schema.read_schema(extra), T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.withColumn("rec", F.from_json("line", parsed_type, options))
    is_bad = F.col(f"rec.{CORRUPT}").isNotNull() | F.col("rec").isNull()
    marked = parsed.withColumn("malformed", F.when(is_bad & (strip(F.col("line")) != ""), F.col("line")))
    return marked if keep_all else marked.where(is_bad | ~_truthy(F.col("rec.__meta__")))


def _only_text(value: Column, name: str) -> Column:
    """``value`` where the line's field is JSON text; only what looks like another kind is parsed again."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("line"), f"$.{name}", "variant"))
    looks_other = value.rlike(r"(?s)^(?:true|false|-?[0-9].*|[{\[].*)$")
    return F.when(~F.coalesce(looks_other, F.lit(False)) | (kind == "STRING"), value)


def verdict_stream(spark: SparkSession, path: str, schema: VerdictSchema, extra: Sequence[T.StructField] = (),
                   max_files: int = 1_000, keep_line: bool = False) -> DataFrame:
    """JSON-lines verdict files as a stream with ``malformed`` and the line's ``_file, _block``.

    A reason that is no JSON text counts as missing. ``keep_line`` adds the raw ``line``,
    which holds fields no schema names.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block")).where(strip(F.col("line")) != "")
    names = [f.name for f in schema.read_schema(extra) if f.name != "__meta__"]
    columns = {n: F.col(f"rec.{n}") for n in names}
    columns[schema.reason_field] = _only_text(columns[schema.reason_field], schema.reason_field)
    return parse_lines(lines, schema, extra).select(
        *[c.alias(n) for n, c in columns.items()], *(["line"] if keep_line else []), "malformed", "_file", "_block")


def read_verdicts(spark: SparkSession, path: str, schema: VerdictSchema, extra: Sequence[T.StructField] = (),
                  on_bad: str = "fail", strict: bool = False, keep_line: bool = False,
                  extras: bool = False) -> tuple[DataFrame, DataFrame]:
    """Verdict rows and malformed lines ``(line, src)``.

    ``fail`` raises on a malformed line with its file and text, ``quarantine``
    returns it in the second table. Meta rows are dropped. ``strict`` adds
    ``present_keys`` and takes only JSON text as a reason. Fields no schema
    names are found in the raw ``line`` (``keep_line``) or as text values of the
    map ``extras``.
    """
    parsed = parse_lines(read_lines(spark, path), schema, extra)
    is_bad = F.col("malformed").isNotNull()
    bad = parsed.where(is_bad).select("line", "src")
    names = [f.name for f in schema.read_schema(extra) if f.name != "__meta__"]
    if on_bad == "fail":
        note = F.concat(F.lit("malformed verdict in "), F.col("src.file"), F.lit(": "), F.col("line"))
        good = parsed.where(F.when(is_bad, F.raise_error(note).cast("boolean")).otherwise(F.lit(True)))
    else:
        good = parsed.where(~is_bad)
    columns = [F.col(f"rec.{n}").alias(n) for n in names]
    if strict:
        reason = schema.reason_field
        columns = [_only_text(F.col(f"rec.{n}"), n).alias(n) if n == reason else c for n, c in zip(names, columns)]
        columns.append(F.map_keys(F.from_json("line", "map<string,string>")).alias("present_keys"))
    if keep_line:
        columns.append(F.col("line"))
    if extras:
        unnamed = F.map_filter(F.from_json("line", "map<string,string>"), lambda k, _: ~k.isin([*names, "__meta__"]))
        columns.append(unnamed.alias("extras"))
    return good.select(*columns, "src"), bad


def bad_line_numbers(spark: SparkSession, path: str, schema: VerdictSchema,
                     extra: Sequence[T.StructField] = ()) -> DataFrame:
    """Malformed verdict lines as ``file, line_no, line``, numbered over all lines of the file.

    Only the text of malformed lines travels with the numbering.
    """
    lines = read_lines(spark, path, blank=True)
    kept = parse_lines(lines, schema, extra, keep_all=True).select("src", F.col("malformed").alias("line"))
    return number_lines(kept).where(F.col("line").isNotNull()).select(F.col("src.file").alias("file"), "line_no", "line")


def _documents(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", str(multi_line).lower())
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("file"))


def read_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Header, batch and (batch, task) rows of manifest documents (S3).

    ``multi_line`` reads one document per file; otherwise one per line, which
    is splittable. Rows carry their ``file``.
    """
    docs = _documents(spark, path, MANIFEST_SCHEMA, multi_line)
    header = docs.drop("batches")
    listed = docs.select("file", F.explode("batches").alias("b"))
    batches = listed.select("file", batch_number(F.col("b.story_id")).alias("batch_idx"),
                            "b.story_id", "b.input_file", "b.n_tasks")
    tasks = listed.select("file", batch_number(F.col("b.story_id")).alias("batch_idx"),
                          F.posexplode("b.task_ids").alias("at", "task_id")).select(
        "file", "batch_idx", "task_id", (F.col("at") + 1).cast("bigint").alias("pos"))
    return header, batches, tasks


def read_stories(spark: SparkSession, path: str, multi_line: bool = True,
                 shard_pattern: str = SHARD_IN_PATH) -> DataFrame:
    """Story rows of story documents with ``shard_id`` from the path and list position ``pos``."""
    docs = _documents(spark, path, STORIES_DOC_SCHEMA, multi_line)
    rows = docs.select("file", F.posexplode("userStories").alias("at", "s"))
    return rows.select(
        F.nullif(F.regexp_extract("file", shard_pattern, 1), F.lit("")).alias("shard_id"),
        F.col("s.id").alias("story_id"), (F.col("at") + 1).cast("bigint").alias("pos"),
        "s.title", "s.description", F.col("s.storyType").alias("story_type"),
        F.col("s.entryCount").alias("entry_count"), "s.modifies", "s.creates",
        F.col("s.acceptanceCriteria").alias("acceptance_criteria"), "s.acceptanceGate",
        "s.priority", "s.passes", "s.attempts", F.col("s.timeoutSeconds").alias("timeout_text"), "s.notes")


# ---- one large document, parsed by many tasks --------------------------------------


def _level(lines: DataFrame) -> DataFrame:
    """``lines`` with ``before``, how deep in lists and objects each line begins.

    Valid JSON has no raw line break inside a text, so every line begins outside of one, and what it opens
    and closes can be counted by itself. The counts are summed up inside a split of the file, and over
    splits by one summary row each.
    """
    bare = F.regexp_replace("line", r'"(?:[^"\\]|\\.)*"', "")
    opened = F.length(F.regexp_replace(bare, r"[^\[{]+", "")) - F.length(F.regexp_replace(bare, r"[^\]}]+", ""))
    flat = lines.select(F.col("src.file").alias("file"), F.col("src.block").alias("block"), F.col("src.row").alias("row"),
                        "line", opened.cast("bigint").alias("opened"))
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = flat.groupBy("file", "block").agg(F.sum("opened").alias("_sum")).select(
        "file", "block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    local = flat.withColumn("_local", F.coalesce(F.sum("opened").over(inside), F.lit(0)))
    return local.join(sums, ["file", "block"]).select(
        "file", "block", "row", "line", "opened", (F.col("_offset") + F.col("_local")).alias("before"))


def split_entries(spark: SparkSession, path: str, field: str, entry: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The list ``field`` of large documents as rows (file, at, e), and the documents without it (file, text).

    Files are read as splittable text and parsed entry by entry, so a document of any size spreads over
    many tasks, as long as its list begins and ends at line ends, which holds for indented JSON and for
    :mod:`labelloom.sources.documents`. A document without such a line stops the job.
    """
    lines = materialize(_level(read_lines(spark, path)), "document-lines")
    place = F.struct("block", "row")
    opening = F.col("line").rlike(rf'"{field}"\s*:\s*\[\s*$') & (F.col("before") + F.col("opened") == 2)
    heads = lines.groupBy("file").agg(F.min(F.when(opening, place)).alias("head"))
    after = lines.join(heads, "file").where((place > F.col("head")) & (F.col("before") + F.col("opened") < 2))
    ends = after.groupBy("file").agg(F.min(F.struct("block", "row", "before")).alias("end"))
    found = heads.join(ends, "file", "left")
    fits = F.col("head").isNotNull() & F.coalesce(F.col("end.before") == 2, F.lit(False))
    fault = F.raise_error(F.concat(F.lit(f"the list {field} does not begin and end at line ends in "), F.col("file")))
    spans = as_lookup(found.select("file", F.when(fits, F.col("head")).otherwise(fault.cast("struct<block:bigint,row:bigint>")).alias("head"), "end"))
    marked = lines.join(spans, "file").withColumn("inner", (place > F.col("head")) & (place < F.struct("end.block", "end.row")))
    listed = marked.where("inner").select("file", "block", "row", "line", (F.col("before") == 2).cast("int").alias("new"))
    # An entry begins on a line of the list's own level; entries that share lines stay together.
    upto = Window.partitionBy("file", "block").orderBy("row")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = listed.groupBy("file", "block").agg(F.sum("new").alias("_n")).select(
        "file", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    numbered = listed.withColumn("_k", F.sum("new").over(upto)).join(sums, ["file", "block"]).withColumn("_no", F.col("_offset") + F.col("_k"))
    groups = numbered.groupBy("file", "_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("block", "row", "line"))), lambda x: x["line"]), "\n").alias("text"))
    body = F.regexp_replace("text", r"^[\s,]+|[\s,]+$", "")
    parsed = F.from_json(F.concat(F.lit("["), body, F.lit("]")), T.ArrayType(entry), {"mode": "FAILFAST"})
    entries = groups.where(body != "").select("file", F.col("_no").alias("at"), F.posexplode(parsed).alias("k", "e")).select(
        "file", "at", "k", "e")
    rest = marked.where(~F.col("inner")).groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("block", "row", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return entries, rest


def read_manifest_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`read_manifest` for documents too large for one task (see :func:`split_entries`)."""
    kind = MANIFEST_SCHEMA["batches"].dataType.elementType
    entries, rest = split_entries(spark, path, "batches", kind)
    fields = T.StructType([f for f in MANIFEST_SCHEMA if f.name != "batches"])
    header = rest.select(F.from_json("text", fields, {"mode": "FAILFAST"}).alias("h"), "file").select("h.*", "file")
    listed = entries.select("file", F.col("e").alias("b"))
    batches = listed.select("file", batch_number(F.col("b.story_id")).alias("batch_idx"), "b.story_id", "b.input_file", "b.n_tasks")
    tasks = listed.select("file", batch_number(F.col("b.story_id")).alias("batch_idx"), F.posexplode("b.task_ids").alias("at", "task_id")).select(
        "file", "batch_idx", "task_id", (F.col("at") + 1).cast("bigint").alias("pos"))
    return header, batches, tasks


def read_acceptance(spark: SparkSession, path: str) -> dict:
    """Acceptance configuration of one story document: ``max_attempts``, ``default_gate``."""
    row = _documents(spark, path, STORIES_DOC_SCHEMA, True).select("acceptance").first()
    return json.loads(row.acceptance) if row and row.acceptance else {}


# Raw write events: the tool and its input appear under either of two names.
_TARGET = T.StructType([T.StructField(n, T.StringType()) for n in ("file_path", "path", "notebook_path")])
EVENT_SCHEMA = T.StructType([
    T.StructField("tool_name", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("tool_input", _TARGET), T.StructField("input", _TARGET), T.StructField("shard_root", T.StringType()),
])


def read_write_events(spark: SparkSession, path: str, extra: Sequence[T.StructField] = ()) -> DataFrame:
    """Tool-call lines as rows for the write audit, with ``extra`` fields such as an event id."""
    schema = T.StructType([*EVENT_SCHEMA, *extra])
    events = read_lines(spark, path).select(F.from_json("line", schema).alias("e"), "src")
    target = F.coalesce("e.tool_input", "e.input")
    return events.select(
        *[f"e.{f.name}" for f in extra], "e.shard_root", F.coalesce("e.tool_name", "e.name").alias("tool_name"), target["file_path"].alias("file_path"),
        target["path"].alias("path"), target["notebook_path"].alias("notebook_path"), "src")


def read_logs(spark: SparkSession, path: str, glob: str = "*.log", shard_pattern: str = SHARD_IN_PATH,
              source_pattern: str = r"/(?:source=)?([A-Za-z]+)(?:\.log|/[^/]*)$") -> DataFrame:
    """Log lines as ``shard_id, source, seq, line``.

    ``seq`` is the line order; a missing log simply has no rows. Folders with a
    leading dot are only read when ``path`` names them, for instance by ``/data/.shard-*``.
    """
    lines = read_lines(spark, path, glob)
    return lines.select(
        F.regexp_extract("src.file", shard_pattern, 1).alias("shard_id"),
        F.regexp_extract("src.file", source_pattern, 1).alias("source"),
        F.col("src").alias("seq"), "line")
