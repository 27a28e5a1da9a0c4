"""What the operators share: reading documents, words, shared scratch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.cluster import materialize

__all__ = ["GAP", "held_out", "lower_ascii", "materialize", "rows_of", "table", "words"]

# A set of keys is sent to every executor only up to this many rows of one long each.
BROADCAST_KEYS = 1_000_000

# Fixed by the query contracts: what separates words, as a Java and Python pattern.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def plain_names(docs: DataFrame) -> DataFrame:
    """``docs`` with other columns than the id and the text under names that clash with nothing."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)))


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, so that every engine agrees."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """Documents that no model may learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def rows_of(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` (a long) is in ``keys``.

    The wide rows need no shuffle where the keys, counted first, are few enough to be sent
    to every executor; beyond that the same join runs as a shuffle.
    """
    keys = materialize(keys.select(key).distinct(), "keys")
    few = keys.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(keys) if few else keys, key, "left_semi")
