"""Near duplicates by bottom-k sketches of one hash function.

A document's set is its distinct 5-word shingles, each a 64-bit hash. Documents of one set
are one class, found by an aggregate, and only its least id takes part in what follows. Its
sketch is the ``SKETCH`` smallest hashes of the set. Two similar sets
share at least ``sure_overlap`` retained values but for one pair in 10^7, so they meet in the
inverted list of one of the ``SKETCH - overlap + 1`` values that are rarest among all
sketches; common passages are common values and hardly ever get there.

A list that is long holds a common passage or many near copies. Its members are listed anew
by the rarest of *all* their shingles, as many as a set must have outside the common part of a
similar pair, which finds every such pair and leaves common passages out.

Lists are not expanded into pairs. Each member is first compared with the least id of its
lists; the confirmed links make components, and only members of different components of a
list are then compared with each other. The union sketch filters candidates, the whole sets
confirm them.

Defined cases: a null or empty text has an empty set and links with nothing; with fewer than
five words the whole sequence is the one shingle. Rows that repeat an id are one document. A
null id links with nothing, its ``component_id`` is null and it is kept. Only the id and the
text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import BROADCAST_KEYS, lower_ascii, materialize, plain_names, rows_of, words
from labelloom.llm.components import components

SIZE = 5
SIMILAR = 80
SKETCH = 64
MISSED = 1e-7
LONG_LIST = 64


def shingles(text: Column) -> Column:
    """Sorted distinct 64-bit hashes of the 5-word shingles."""
    def hashes(ws: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(ws) - SIZE),
                           lambda i: F.xxhash64(*(ws[i + k] for k in range(SIZE))))
        one = F.array(F.xxhash64(F.array_join(ws, " ")))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(ws) >= SIZE, F.sort_array(F.array_distinct(many))).when(F.size(ws) > 0, one).otherwise(none)
    return F.get(F.transform(F.array(words(lower_ascii(text))), hashes), F.lit(0))


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, sketch): set size, fingerprint of the whole set, smallest hashes."""
    sets = docs.select("doc_id", shingles(F.col("text")).alias("s"))
    return sets.select(
        "doc_id", F.size("s").cast("bigint").alias("n"),
        F.struct(F.xxhash64("s").alias("x"), F.xxhash64(F.lit(1), "s").alias("y")).alias("key"),
        F.slice("s", 1, SKETCH).alias("sketch"))


@cache
def sure_overlap(similar: int) -> int:
    """How many retained values two full sketches share but for a share of ``MISSED`` of the pairs.

    Each of the ``SKETCH`` least hashes of the union is in both sets with the probability of
    the Jaccard index, and then it is in both sketches.
    """
    p, missed, m = similar / 100, 0.0, 0
    while True:
        missed += comb(SKETCH, m) * p ** m * (1 - p) ** (SKETCH - m)
        if missed > MISSED:
            return m
        m += 1


def _least_shared(n: Column, similar: int) -> Column:
    """How many retained values a set has in common with any similar one."""
    return F.least(F.ceil(n * similar / 100), F.lit(sure_overlap(similar)))


def ranked_values(sets: DataFrame) -> DataFrame:
    """``sets`` (doc, values) -> (doc, alone, shared): values that other sets hold too, rarest first.

    ``alone`` is the number of values that are in no other one; they come before all others
    in the global order and link with nothing.
    """
    each = sets.select("doc", F.explode("values").alias("value"))
    shared = each.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = each.join(shared, "value").groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))  # at most all of one set
    return sets.join(lists, "doc").select("doc", (F.size("values") - F.size("shared")).alias("alone"), F.transform(
        "shared", lambda x: x["value"]).alias("shared"))  # all others are in ``shared``


def _listed(ranked: DataFrame, prefix: Column) -> DataFrame:
    """(doc, value, left, members): each set under the rarest ``prefix`` of its values, if another one is there too.

    ``left`` is how many values of the set come at or after this one in the global order.
    """
    reach = F.greatest(prefix - F.col("alone"), F.lit(0)).cast("int")
    single = ranked.where(reach > 0).select("doc", F.size("shared").alias("size"), F.posexplode(F.slice("shared", 1, reach)).alias("at", "value"))
    single = single.select("doc", "value", (F.col("size") - F.col("at")).alias("left"))
    sizes = single.groupBy("value").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return materialize(single.join(sizes, "value"), "lists")


def whole_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, s): the whole sets of the classes ``wanted`` (doc)."""
    sets = rows_of(docs.select(F.col("doc_id").alias("doc"), "text"), wanted, "doc").select("doc", shingles(F.col("text")).alias("s"))
    # Rows that repeat an id may hold other texts; the set that the class stands for is the one with its key.
    key = F.struct(F.xxhash64("s").alias("x"), F.xxhash64(F.lit(1), "s").alias("y"))
    return materialize(sets.withColumn("key", key).join(
        reps.select("doc", "key"), ["doc", "key"], "left_semi").select("doc", "s").distinct(), "sets")


def inverted_lists(reps: DataFrame, docs: DataFrame, similar: int) -> DataFrame:
    """(key, doc, n, left): lists such that two similar sets meet in one of them at least."""
    sizes = reps.select("doc", "n")
    held = F.size("values")
    ranked = ranked_values(reps.select("doc", F.col("sketch").alias("values"))).join(sizes, "doc")
    single = _listed(ranked, F.least(F.col("n"), F.lit(SKETCH)) - _least_shared(F.col("n"), similar) + 1)
    short = single.where(F.col("members") <= LONG_LIST).select(F.struct(F.lit(0).alias("stage"), "value").alias("key"), "doc", "left")
    again = whole_sets(docs, reps, single.where(F.col("members") > LONG_LIST).select("doc")).select("doc", F.col("s").alias("values"))
    ranked = ranked_values(again).join(again.select("doc", held.alias("m")), "doc")
    whole = _listed(ranked, F.col("m") - F.ceil(F.col("m") * similar / 100) + 1)
    long = whole.select(F.struct(F.lit(1).alias("stage"), "value").alias("key"), "doc", "left")
    return short.unionByName(long).join(sizes, "doc")


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough, as rows (a, b)."""
    def size_fits(n: Column, m: Column) -> Column:
        return 100 * F.least(n, m) >= similar * F.greatest(n, m)

    def shared(x: Column, y: Column) -> Column:
        return F.size(F.array_intersect(x, y))

    sides = [reps.select(F.col("doc").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}")) for s in "ab"]
    likely = pairs.join(sides[0], "a").join(sides[1], "b").where(size_fits(F.col("n_a"), F.col("n_b")))
    union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, SKETCH)
    both = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
    enough = _least_shared(F.least("n_a", "n_b"), similar)
    likely = materialize(likely.where(both >= enough).select("a", "b"), "likely")
    sets = whole_sets(docs, reps, likely.select(F.col("a").alias("doc")).unionByName(likely.select(F.col("b").alias("doc"))))
    sides = [sets.select(F.col("doc").alias(s), F.col("s").alias(f"s_{s}")) for s in "ab"]
    full = likely.join(sides[0], "a").join(sides[1], "b")
    inter = shared(F.col("s_a"), F.col("s_b"))
    return full.where(100 * inter >= similar * (F.size("s_a") + F.size("s_b") - inter)).select("a", "b")


def near_duplicates(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """One row per document: ``n_shingles``, ``component_id`` and ``kept``."""
    slim = docs.select("doc_id", "text")
    rows = materialize(describe(slim), "described")
    reps = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = materialize(reps, "classes")
    # One id may stand for several classes only if its rows repeat with other texts.
    least = reps.groupBy("doc").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("k"))
    twice = least.where("k > 1").select("doc")
    lists = materialize(inverted_lists(reps, slim, similar), "inverted")
    centers = lists.groupBy("key").agg(F.min("doc").alias("b"))
    stars = lists.join(centers, "key").where("doc > b").select(F.col("doc").alias("a"), "b").distinct()
    edges = materialize(confirm(stars, reps, slim, similar), "links")
    member = components(edges)
    placed = lists.join(member, F.col("doc") == F.col("node"), "left").select(
        "key", "doc", "n", "left", F.coalesce("component", "doc").alias("c"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("doc").alias("center")).where("lo < hi")
    rest = placed.join(mixed.select("key", "center"), "key")
    x, y = (rest.select("key", "center", F.col("doc").alias(d), *(F.col(v).alias(f"{v}_{d}") for v in ("n", "left", "c"))) for d in "ab")
    # A similar pair is met at its first common value, where enough values are left in both sets.
    left, total = F.least("left_a", "left_b"), F.col("n_a") + F.col("n_b")
    reaches = F.when(F.col("key.stage") == 0, left >= _least_shared(F.least("n_a", "n_b"), similar)).otherwise(
        left * (100 + similar) >= similar * total)
    across = x.join(y.drop("center"), "key").where(
        (F.col("a") > F.col("b")) & (F.col("c_a") != F.col("c_b")) & (F.col("b") != F.col("center")) & reaches
        & (100 * F.least("n_a", "n_b") >= similar * F.greatest("n_a", "n_b"))).select("a", "b").distinct()
    more = confirm(across, reps, slim, similar)
    joined = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("a"), "key").join(
        reps.select("key", F.col("doc").alias("b")), "key").join(
        twice.withColumnRenamed("doc", "b"), "b", "left_semi").select("a", "b")
    member = components(edges.unionByName(more).unionByName(joined))
    by_class = reps.select("key", "doc").join(member, F.col("doc") == F.col("node"), "left").select(
        "key", F.coalesce("component", "doc").alias("class_component"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return rows.select("doc_id", "n", "key").join(by_class, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """``docs`` with the document of the least id of each group; rows that repeat that id stay together.

    Other columns pass through whatever their names.
    """
    inner = plain_names(docs)
    drop = near_duplicates(inner, similar).where("NOT kept").select(F.col("doc_id").alias("_later")).distinct()
    drop = materialize(drop, "later-copies")
    few = drop.count() <= BROADCAST_KEYS
    kept = inner.join(F.broadcast(drop) if few else drop, F.col("doc_id") == F.col("_later"), "left_anti")
    return kept.toDF(*docs.columns)
