"""Payloads of all batches in few files, from which one batch is read by its range.

One line per task, in batch order. The index has a row per batch with file, offset and length in
bytes, so a labeller's batch is one seek, and the files are plain task files for everybody else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.cluster import materialize
from labelloom.model import PlanError
from labelloom.sources.sinks import _fs

BATCHES_PER_FILE = 20_000

# One task writes a file, so no file is planned for more bytes, whatever number is asked for.
FILE_BYTES = 128 * 1024 * 1024


def payload_path(root: str) -> str:
    return f"{root.rstrip('/')}/payload"


def index_path(root: str) -> str:
    return f"{root.rstrip('/')}/index"


def write_batches(tasks: DataFrame, members: DataFrame, root: str, n_files: int | None = None, key: str = "task_id",
                  drop: Sequence[str] = ()) -> DataFrame:
    """Write the payload of every member (``batch_idx, task_id, pos``) and return the index.

    ``tasks`` has the ids under ``key`` and any payload columns. Line lengths, taken where the tasks are
    scanned, tell the bytes of every batch. A file ends where its share of all batches or ``FILE_BYTES`` is
    full, so ``n_files`` is the least number of files: one join of the payload and one shuffle by file.
    """
    spark = tasks.sparkSession
    last = members.agg(F.max("batch_idx")).first()[0] or 0
    files = n_files or max(1, -(-last // BATCHES_PER_FILE))
    share = F.least(F.call_function("div", (F.col("batch_idx") - 1) * files, F.lit(max(last, 1))), F.lit(files - 1)).cast("int")
    named = members.select("batch_idx", "pos", F.col("task_id").alias(key))
    line = F.to_json(F.struct(*[c for c in tasks.columns if c not in (*drop, "batch_idx", "pos")]))
    lengths = tasks.select(key, (F.octet_length(line) + 1).alias("_bytes"))
    batches = materialize(named.join(lengths, key).groupBy(share.alias("_share"), "batch_idx").agg(
        F.sum("_bytes").cast("bigint").alias("length"), F.count(F.lit(1)).alias("n_tasks")), "batch-sizes")
    earlier = Window.partitionBy("_share").orderBy("batch_idx").rowsBetween(Window.unboundedPreceding, -1)
    piece = F.call_function("div", F.coalesce(F.sum("length").over(earlier), F.lit(0)), F.lit(FILE_BYTES))
    placed = batches.withColumn("_piece", piece)
    number = Window.orderBy("_share", "_piece")  # one row a file
    numbers = placed.select("_share", "_piece").distinct().withColumn("file_no", (F.row_number().over(number) - 1).cast("int"))
    sizes = materialize(placed.join(numbers, ["_share", "_piece"]).select("file_no", "batch_idx", "length", "n_tasks"), "batch-files")
    written = (sizes.agg(F.max("file_no")).first()[0] or 0) + 1
    # A table of its own tells the planner how small the members are beside the payload.
    filed = materialize(named.join(sizes.select("batch_idx", "file_no"), "batch_idx"), "batch-members")
    lines = filed.join(tasks, key).select("batch_idx", "pos", "file_no", line.alias("value"))
    lines.repartitionById(written, F.col("file_no")).sortWithinPartitions("batch_idx", "pos").select("value").write.text(payload_path(root))
    before = Window.partitionBy("file_no").orderBy("batch_idx").rowsBetween(Window.unboundedPreceding, -1)
    fs, folder = _fs(spark, payload_path(root))
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
    parts = [(int(n[5:10]), n) for n in names if n.startswith("part-")]  # one name a file
    named = spark.createDataFrame(parts, "file_no int, file string")
    rows = sizes.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).join(F.broadcast(named), "file_no")
    rows.select("batch_idx", "file", "offset", "length", "n_tasks").repartitionByRange("batch_idx").sortWithinPartitions(
        "batch_idx").write.parquet(index_path(root))
    return read_index(spark, root)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(index_path(root))


def read_range(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    """``length`` bytes of a file from ``offset`` on."""
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        stream.seek(offset)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


def read_batch(spark: SparkSession, root: str, batch_idx: int, schema: T.StructType) -> DataFrame:
    """The tasks of one batch with their order ``at`` (1, 2 ...); no other byte of the payload is read."""
    found = read_index(spark, root).where(F.col("batch_idx") == batch_idx).collect()  # one row
    if not found:
        raise PlanError(f"no batch {batch_idx} in {root}")
    row = found[0]
    text = read_range(spark, f"{payload_path(root)}/{row.file}", row.offset, row.length).decode()
    lines = spark.createDataFrame([(k, x) for k, x in enumerate(text.split("\n")[:-1], 1)], "at bigint, line string")
    return lines.select("at", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("t")).select("at", "t.*")
