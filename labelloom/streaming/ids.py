"""Which ids a sink has accepted, so that a micro-batch reads only the parts that may hold its own (V2).

Each micro-batch leaves a part of the index beside its rows: its ids alone, in hash buckets,
and for each bucket a Bloom filter whose bits all lie in one 64-bit word per id. A filter is stored as
its words, so ids are looked up in all filters by one equality join; the folders of ids that no filter
points to are never listed or read. What the filters point to is compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.sources.sinks import exists

BUCKETS = 16
IDS_PER_WORD = 4
PROBES = 4

_PLACE = [T.StructField("stream_id", T.StringType()), T.StructField("batch_id", T.LongType())]


def ids_path(sink: str) -> str:
    return f"{sink.rstrip('/')}/index/ids"


def words_path(sink: str) -> str:
    return f"{sink.rstrip('/')}/index/words"


def sizes_path(sink: str) -> str:
    return f"{sink.rstrip('/')}/index/sizes"


def part_of(stream_id: str, batch_id: int) -> str:
    return f"stream_id={stream_id}/batch_id={batch_id}"


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))


def _hashed(ids: DataFrame, key: str) -> DataFrame:
    """Bucket of each id, the bits it sets, and a number that picks its word."""
    spread = F.xxhash64(F.lit("word"), F.col(key))
    mask = F.lit(0).cast("bigint")
    for k in range(PROBES):
        mask = mask.bitwiseOR(_bit(F.shiftrightunsigned(spread, 6 * k).bitwiseAND(F.lit(63))))
    return ids.select(F.col(key), F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket"), mask.alias("mask"),
                      F.shiftrightunsigned(spread, 6 * PROBES).alias("pick"))


def _word(size: str = "n_words") -> Column:
    return F.col("pick").bitwiseAND(F.col(size) - 1)


def add_part(ids: DataFrame, sink: str, stream_id: str, batch_id: int, key: str) -> None:
    """Index the ids (unique) of one micro-batch; written again, the part is replaced."""
    part = part_of(stream_id, batch_id)
    hashed = _hashed(ids, key).persist()
    try:
        hashed.select(key, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{ids_path(sink)}/{part}")
        doubled = F.ceil(F.log2(F.greatest(F.count(F.lit(1)) / IDS_PER_WORD, F.lit(1.0)))).cast("int")
        sizes = hashed.groupBy("bucket").agg(_bit(doubled).alias("n_words"))
        words = hashed.join(F.broadcast(sizes), "bucket").groupBy("bucket", "n_words", _word().alias("word")).agg(F.bit_or("mask").alias("bits"))
        words.write.mode("overwrite").parquet(f"{words_path(sink)}/{part}")
        # The part counts from here on.
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{sizes_path(sink)}/{part}")
    finally:
        hashed.unpersist()


def _read(spark: SparkSession, path: str, *columns: T.StructField) -> DataFrame:
    return spark.read.schema(T.StructType([*columns, *_PLACE])).parquet(path)


def parts_that_may_hold(ids: DataFrame, sink: str, key: str) -> DataFrame:
    """(stream_id, batch_id, bucket) of the indexed parts whose filters hold one of ``ids``."""
    spark = ids.sparkSession
    sizes = _read(spark, sizes_path(sink), T.StructField("bucket", T.IntegerType()), T.StructField("n_words", T.LongType()))
    words = _read(spark, words_path(sink), T.StructField("bucket", T.IntegerType()), T.StructField("n_words", T.LongType()),
                  T.StructField("word", T.LongType()), T.StructField("bits", T.LongType()))
    # Sizes are powers of two, so an id has few different words however many parts there are.
    asked = _hashed(ids, key).join(sizes.select("bucket", "n_words").distinct(), "bucket").select(
        "bucket", "n_words", _word().alias("word"), "mask")
    hit = words.join(asked, ["bucket", "n_words", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return hit.select(*[f.name for f in _PLACE], "bucket").distinct()


def ids_of_parts(spark: SparkSession, sink: str, parts: list, key: T.StructField) -> DataFrame | None:
    """(key, stream_id, batch_id) of the given parts (stream_id, batch_id, bucket), from their folders alone."""
    folders = [f"{ids_path(sink)}/{part_of(p.stream_id, p.batch_id)}/bucket={p.bucket}" for p in parts]
    if not folders:
        return None
    schema = T.StructType([key, *_PLACE, T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(schema).option("basePath", ids_path(sink)).parquet(*folders).drop("bucket")


def known_ids(ids: DataFrame, sink: str, key: str, accepted: str, stream_id: str, batch_id: int) -> DataFrame | None:
    """(key, stream_id, batch_id): which of ``ids`` were accepted in other parts than the given one.

    Parts of the index without accepted rows are of a run that was cut short, and do not count.
    """
    spark = ids.sparkSession
    if not exists(spark, sizes_path(sink)):
        return None
    own = (F.col("stream_id") == stream_id) & (F.col("batch_id") == batch_id)
    parts = parts_that_may_hold(ids, sink, key).where(~own).collect()  # at most the folders of the index
    whole = {(p.stream_id, p.batch_id) for p in parts}
    whole = {p for p in whole if exists(spark, f"{accepted}/{part_of(*p)}/_SUCCESS")}
    found = ids_of_parts(spark, sink, [p for p in parts if (p.stream_id, p.batch_id) in whole], ids.schema[key])
    return None if found is None else found.join(ids.select(key), key, "left_semi")


def rebuild(spark: SparkSession, sink: str, accepted: DataFrame, key: str) -> None:
    """Index the accepted rows (with stream_id, batch_id) of a sink that has no index."""
    for p in accepted.select("stream_id", "batch_id").distinct().collect():  # one row a micro-batch
        mine = accepted.where((F.col("stream_id") == p.stream_id) & (F.col("batch_id") == p.batch_id))
        add_part(mine.select(key), sink, p.stream_id, p.batch_id, key)
