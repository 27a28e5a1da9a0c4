"""Line dedup by prefix doubling over sequences of line ids.

Every place of every text begins a run of lines. Round ``k`` looks at the runs of ``2**k``
lines: a run's name is made of the names of its halves, places whose name occurs once drop
out, and the least place of a name is its first copy. So the names of a round are the
intervals of the suffix array whose common prefix is at least that long, and the rounds end
when no run is repeated any more. Each round is one aggregate, which combines before its
shuffle, and equi-joins; a line that a third of all texts share is one row of the aggregate.

Every later copy of a maximal repeated run of at least ``MIN_CHARS`` characters, line ends included, is
deleted, whatever its number of lines. A line is in such a copy if and only if it is in a later
copy of a shortest run: one that reaches ``MIN_CHARS`` from its first line on, or from its last
line back, and not without the line at its other end. A shortest run has ``MIN_CHARS`` lines at
most; its name is made of the two blocks of the greatest power of two that cover it.

All of it is DataFrame operations.

Defined cases: a null text stays null; an empty one is one empty line. Equal texts under one id
are one document and treated alike; other texts under that id are documents of their own. A
null id takes no part and keeps its text. Blank lines are lines. An empty table gives an empty
result. Other columns pass through ``dedup_lines`` unchanged whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import BROADCAST_KEYS, materialize, plain_names

MIN_CHARS = 40
_PLACE = ("doc", "hash", "at")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, hash, at, a, b, size): every line, with a 128-bit id and its length."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").alias("doc"), F.xxhash64("text").alias("hash"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.select(*_PLACE, F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"),
                       (F.length("line") + 1).cast("bigint").alias("size"))


def _repeated(runs: DataFrame) -> DataFrame:
    """Places whose run occurs twice or more, and whether they are later copies of it."""
    first = runs.groupBy("a", "b").agg(
        F.min(F.struct(*_PLACE)).alias("first"), F.max(F.struct(*_PLACE)).alias("last")).where("first <> last")
    return runs.join(first, ["a", "b"]).withColumn("late", F.col("first") != F.struct(*_PLACE)).drop("first", "last")


def _doubled(now: DataFrame, length: int) -> DataFrame:
    """The runs of twice ``length`` lines whose halves are in ``now``."""
    left = now.select(*_PLACE, F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("size").alias("xs"))
    right = now.select("doc", "hash", (F.col("at") - length).alias("at"), F.col("a").alias("ya"), F.col("b").alias("yb"),
                       F.col("size").alias("ys"))
    return left.join(right, list(_PLACE)).select(
        *_PLACE, F.xxhash64("xa", "xb", "ya", "yb").alias("a"), F.xxhash64(F.lit(1), "xa", "xb", "ya", "yb").alias("b"),
        (F.col("xs") + F.col("ys")).alias("size"))


def _shortest(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, hash, at, n): the shortest runs of two lines or more that reach ``min_chars``, from each line on and back."""
    def reach(sizes: Column) -> Column:
        grown = F.aggregate(sizes, F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n")), lambda s, x: F.when(
            s["chars"] >= min_chars, s).otherwise(F.struct((s["chars"] + x).alias("chars"), (s["n"] + 1).alias("n"))))
        return F.get(F.transform(F.array(grown), lambda s: F.when(s["chars"] >= min_chars, s["n"]).otherwise(0)), F.lit(0))

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").alias("doc"), F.xxhash64("text").alias("hash"),
        F.transform(F.split("text", "\n"), lambda line: F.length(line) + 1).alias("sizes"))
    line = rows.select("doc", "hash", "sizes", F.posexplode("sizes").alias("at", "size")).where(F.col("size") < min_chars)
    on = reach(F.slice("sizes", F.col("at") + 1, F.lit(min_chars)))
    first = F.greatest(F.col("at") + 2 - min_chars, F.lit(1))
    back = reach(F.reverse(F.slice("sizes", first, F.col("at") + 2 - first)))
    both = line.select("doc", "hash", "at", on.alias("on"), back.alias("back"))
    each = both.select("doc", "hash", F.explode(F.array(
        F.struct(F.col("at"), F.col("on").alias("n")),
        F.struct((F.col("at") + 1 - F.col("back")).alias("at"), F.col("back").alias("n")))).alias("w"))
    return each.where("w.n > 1").select("doc", "hash", "w.at", "w.n").distinct()


def _late_wholes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, hash, at, end): all later copies of shortest runs."""
    windows = materialize(_shortest(docs, min_chars), "shortest")
    now = materialize(_repeated(materialize(_lines(docs), "lines")), "runs")
    found = now.where(F.col("late") & (F.col("size") >= min_chars)).select(*_PLACE, (F.col("at") + 1).alias("end"))
    length, named = 1, []
    while 2 * length <= min_chars and not now.isEmpty():
        now = materialize(_repeated(materialize(_doubled(now, length), "grown")), "runs")
        length *= 2
        named.append(_named_windows(windows, now, length))
    if not named:
        return found
    # The number of lines is part of a name, so the windows of all rounds are compared at once.
    late = _repeated(materialize(reduce(DataFrame.unionByName, named), "windows")).where("late")
    return found.unionByName(late.select(*_PLACE, (F.col("at") + F.col("n")).alias("end")))


def _named_windows(windows: DataFrame, now: DataFrame, length: int) -> DataFrame:
    """The windows of ``length`` to ``2 * length - 1`` lines whose halves are repeated, named by them."""
    some = windows.where(F.col("n").between(length, 2 * length - 1)).withColumn("tail", F.col("at") + F.col("n") - length)
    head = now.select(*_PLACE, F.col("a").alias("xa"), F.col("b").alias("xb"))
    tail = now.select("doc", "hash", F.col("at").alias("tail"), F.col("a").alias("ya"), F.col("b").alias("yb"))
    return some.join(head, list(_PLACE)).join(tail, ["doc", "hash", "tail"]).select(
        *_PLACE, "n", F.xxhash64("n", "xa", "xb", "ya", "yb").alias("a"), F.xxhash64(F.lit(1), "n", "xa", "xb", "ya", "yb").alias("b"))


def later_copies(docs: DataFrame, min_chars: int = MIN_CHARS, whole: bool = True) -> DataFrame:
    """(doc, hash, at, end): maximal runs of lines that are copies of earlier ones."""
    found = _late_wholes(docs, min_chars)
    text = Window.partitionBy("doc", "hash").orderBy("at", "end")
    reached = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    island = found.withColumn("new", F.coalesce(F.col("at") > reached, F.lit(True)).cast("int"))
    island = island.withColumn("run", F.sum("new").over(text))
    return island.groupBy("doc", "hash", "run").agg(F.min("at").alias("at"), F.max("end").alias("end")).drop("run")


def _without(lines: Column, runs: Column) -> Column:
    """``lines`` without the sorted, disjoint ``runs``: the pieces between them."""
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"]))
    ends = F.concat(F.transform(runs, lambda r: r["at"]), F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))


def mark_copies(docs: DataFrame, min_chars: int = MIN_CHARS, whole: bool = True) -> DataFrame:
    """``docs`` with a column ``_runs``, the later copies in each text (null: none)."""
    runs = later_copies(docs, min_chars, whole).groupBy("doc", "hash").agg(F.sort_array(F.collect_list(F.struct("at", "end"))).alias("_runs"))
    runs = materialize(runs, "copies")
    total = runs.agg(F.sum(F.size("_runs") + 2)).first()[0] or 0
    sized = F.broadcast(runs) if total <= BROADCAST_KEYS else runs
    own = docs.withColumn("_hash", F.xxhash64("text"))
    return own.join(sized, (own["doc_id"] == sized["doc"]) & (own["_hash"] == sized["hash"]), "left").drop("doc", "hash", "_hash")


def _kept(runs: str = "_runs") -> Column:
    cut = F.get(F.transform(F.array(F.split("text", "\n")), lambda ls: F.array_join(_without(ls, F.col(runs)), "\n")), F.lit(0))
    return F.when(F.col(runs).isNull(), F.col("text")).otherwise(cut)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, whole: bool = True) -> DataFrame:
    """``docs`` without later copies of line runs; a document of which nothing but blanks is left goes."""
    columns = docs.columns
    cut = mark_copies(plain_names(docs), min_chars, whole)
    rest = cut.withColumn("text", _kept())
    rest = rest.where(F.col("_runs").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return rest.drop("_runs").toDF(*columns)


def count_copies(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: ``n_lines``, ``n_removed``, ``n_runs`` and ``kept_sha256`` of the text that stays."""
    cut = mark_copies(docs.select("doc_id", "text"), min_chars)
    removed = F.aggregate("_runs", F.lit(0), lambda n, r: n + r["end"] - r["at"])
    return cut.select(
        "doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("bigint").alias("n_removed"),
        F.when(F.col("_runs").isNull(), 0).otherwise(F.size("_runs")).cast("bigint").alias("n_runs"),
        F.sha2(F.coalesce(_kept(), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def oracle(min_chars: int = MIN_CHARS) -> str:
    """The same as SQL over all runs of up to ``min_chars`` lines, which cover every longer one."""
    return rf"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, ls, unnest(range(0, len(ls))) AS s FROM d),
c AS (SELECT doc_id, ls, s, unnest(range(s + 1, least(s + {min_chars}, len(ls)) + 1)) AS e FROM p),
b AS (SELECT doc_id, s, e, array_to_string(ls[s + 1:e], chr(10)) AS block FROM c),
m AS (SELECT doc_id, s, e, min(struct_pack(d := doc_id, s := s)) OVER (PARTITION BY e - s, md5(block)) AS f
      FROM b WHERE length(block) + 1 >= {min_chars}),
g AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS i FROM m WHERE f.d <> doc_id OR f.s <> s),
r AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (p IS NULL OR p < i - 1) AS n_runs, list(i) AS gone
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM g) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs,
       sha256(CASE WHEN gone IS NULL THEN coalesce(text, '') ELSE array_to_string(
         [string_split(text, chr(10))[i + 1] FOR i IN range(0, len(string_split(text, chr(10)))) IF NOT list_contains(gone, i)],
         chr(10)) END) AS kept_sha256
FROM documents LEFT JOIN r USING (doc_id)
"""
