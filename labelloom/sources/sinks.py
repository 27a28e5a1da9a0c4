"""Write ordered files and publish all-or-nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.model import PlanError

MODES = ("default", "refresh", "force")


def write_ordered(df: DataFrame, path: str, order_cols: Sequence[str], fmt: str = "json",
                  n_files: int | None = None, drop: Sequence[str] = ()) -> None:
    """Files whose name order is the row order.

    One range shuffle; each file is sorted and holds a contiguous range.
    ``drop`` removes order columns from the output.
    """
    ranged = df.repartitionByRange(n_files, *order_cols) if n_files else df.repartitionByRange(*order_cols)
    ranged.sortWithinPartitions(*order_cols).drop(*drop).write.format(fmt).mode("errorifexists").save(path)


# Rows of one file, where nobody asks for a number of files.
ROWS_PER_FILE = 1_000_000


def write_placed(df: DataFrame, path: str, place: str, total: int, fmt: str = "json", n_files: int | None = None,
                 drop: Sequence[str] = ()) -> None:
    """Files in row order for rows that know their place, 1 to ``total``.

    The file follows from the place, so the rows are read once and shuffled once, without a look at their
    distribution; files hold equally many rows. Gaps in the places only make files smaller.
    """
    files = n_files or max(1, -(-total // ROWS_PER_FILE))
    number = F.call_function("div", (F.col(place) - 1) * files, F.lit(max(total, 1)))
    file = F.greatest(F.least(number, F.lit(files - 1)), F.lit(0)).cast("int")
    df.repartitionById(files, file).sortWithinPartitions(place).drop(*drop).write.format(fmt).mode("errorifexists").save(path)


def save_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "task_id") -> DataFrame:
    """Save as a table bucketed and sorted by ``key``.

    Members and verdicts saved with the same number of buckets meet in gates,
    pending sets and merges without a shuffle by id. Also a way to pack the
    many small parts of an ingest. Meant for tables with unique ids, such as
    accepted verdicts: rows of one id share a bucket, which is read by one task.
    """
    (df.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").mode("overwrite").saveAsTable(table))
    return df.sparkSession.table(table)


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.getFileStatus(target).isDirectory()


def has_rows(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    """Whether a table or line file holds at least one row; reads no more than that."""
    if not exists(spark, path):
        return False
    if fmt == "json":
        return not spark.read.text(path).where(F.trim("value") != "").limit(1).isEmpty()
    return not spark.read.format(fmt).load(path).limit(1).isEmpty()


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def swap_in(spark: SparkSession, staging: str, path: str) -> None:
    """Put a finished folder in place of ``path``.

    What was there is moved aside first and deleted last, so a writer that dies loses neither; see
    ``versions`` for readers that must never find the place empty.
    """
    fs, source = _fs(spark, staging)
    _, target = _fs(spark, path)
    _, aside = _fs(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    parent = target.getParent()
    if parent is not None and not fs.exists(parent):
        fs.mkdirs(parent)
    there = fs.exists(target)
    if there and not fs.rename(target, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(source, target):
        if there:
            fs.rename(aside, target)
        raise OSError(f"could not move {staging} to {path}")
    if there:
        fs.delete(aside, True)


def publish(spark: SparkSession, path: str, write: Callable[[str], None], mode: str = "default",
            fmt: str = "parquet") -> None:
    """Run ``write`` into a staging folder and move it to ``path`` once complete.

    ``default`` refuses a target that has rows, ``refresh`` needs an existing
    target, ``force`` replaces whatever is there.
    """
    if mode not in MODES:
        raise PlanError(f"mode is one of {MODES}, got {mode!r}")
    if mode == "default" and has_rows(spark, path, fmt):
        raise PlanError(f"rows found in {path}: only mode='force' replaces them")
    if mode == "refresh" and not exists(spark, path):
        raise PlanError(f"{path} does not exist, nothing to refresh")
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    write(staging)
    swap_in(spark, staging, path)


def publish_plan(spark: SparkSession, root: str, tables: Mapping[str, DataFrame],
                 state: Mapping[str, T.StructType], mode: str = "default") -> None:
    """Write plan tables to ``root/plan`` and treat ``root/state`` by ``mode``.

    ``default`` refuses when any state table has rows; ``refresh`` rewrites the
    plan and keeps the state, which must exist; ``force`` also empties the state.
    """
    if mode not in MODES:
        raise PlanError(f"mode is one of {MODES}, got {mode!r}")
    base = root.rstrip("/")
    places = {name: f"{base}/state/{name}" for name in state}
    if mode == "default":
        for place in places.values():
            if has_rows(spark, place):
                raise PlanError(f"rows found in {place}: only mode='force' replaces them")
    if mode == "refresh" and not all(exists(spark, p) for p in places.values()):
        raise PlanError(f"{base}/state does not exist, nothing to refresh")
    # Stage everything first, so that a failed table leaves the old plan untouched.
    staged = {}
    for name, df in tables.items():
        staged[name] = f"{base}/.staging-{uuid.uuid4().hex}/{name}"
        df.write.parquet(staged[name])
    for name, folder in staged.items():
        swap_in(spark, folder, f"{base}/plan/{name}")
    if mode != "refresh":
        for name, place in places.items():
            empty = spark.createDataFrame([], state[name])
            publish(spark, place, lambda staging, d=empty: d.write.parquet(staging), "force")
