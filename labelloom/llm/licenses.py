"""License scan: phrase places, and an exact set-similarity join of text blocks with templates.

A template is a set of words; a block (a line, or a paragraph for long templates) matches
where it holds at least ``threshold`` of that set. Words are ordered by their number of
documents in the whole corpus, rarest first. A block that matches must hold one of the
first ``m - ceil(threshold * m) + 1`` words of the template (prefix filter), have enough
words (length filter), and have enough of them left at and after that word (positional
filter); what remains is counted exactly. The templates are a constant of this module, so
the prefix table that is broadcast has a proven bound; blocks are never grouped by a word.

All of it is DataFrame expressions.

Defined cases: a null or empty text has no words, no labels and score 0. Repeated rows of
one id each give a row and share the labels that the method finds in any of them. An empty
table gives an empty result. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import lower_ascii

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PARAGRAPH = r"\n[\x20\x09-\x0D]*\n"
THRESHOLD = 0.8

# Fixed by the query contract: phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Short forms and opening passages of public licenses.
TEMPLATES = (
    ("mit-text", "paragraph",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files to deal in the software without restriction including without limitation the rights to use "
     "copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("bsd-text", "paragraph",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met"),
    ("apache-2.0-text", "paragraph",
     "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you "
     "may obtain a copy of the license at"),
    ("gpl-text", "paragraph",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation either version of the license or any later version"),
    ("cc-by-4.0", "line", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "line", "licensed under cc by nc 4 0"),
    ("apache-2.0", "line", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "line", "this work is licensed under the gnu general public license version 3"),
    ("mit-line", "line", "released under the mit license"),
    ("all-rights-reserved", "line", "all rights reserved"),
)


@dataclass(frozen=True)
class Template:
    label: str
    unit: str
    words: frozenset[str]


def templates() -> list[Template]:
    return [Template(label, unit, frozenset(text.split())) for label, unit, text in TEMPLATES]


def license_words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def phrase_places(words: Column) -> Column:
    """Array of (place, label), one entry for each phrase and place."""
    def places(phrase: list[str], label: str) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _all(
            F.get(words, i + k) == F.lit(p) for k, p in enumerate(phrase)))
        return F.transform(starts, lambda i: F.struct(i.cast("bigint").alias("place"), F.lit(label).alias("label")))
    found = F.concat(*(places(p.split(), label) for p, label in PHRASES))
    none = F.array().cast("array<struct<place:bigint,label:string>>")
    return F.when(F.size(words) > 0, found).otherwise(none)


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        c = F.coalesce(c, F.lit(False))
        out = c if out is None else out & c
    return out


def document_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents of the whole table each template word stands."""
    hits = docs.select(F.explode(F.array_intersect(license_words(F.col("text")), _strings(vocabulary))).alias("word"))
    return {r["word"]: r["count"] for r in hits.groupBy("word").count().collect()}  # at most one row per template word


def matches(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, unit, block, label, containment): every block of every text that meets the threshold."""
    known = templates()
    vocabulary = sorted(set().union(*(t.words for t in known)))
    counts = document_counts(docs, vocabulary)
    ordered = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(ordered)}
    spark = docs.sparkSession
    rows = []
    for t in known:
        mine, need = sorted(t.words, key=rank.get), math.ceil(threshold * len(t.words) - 1e-9)
        prefix = mine[:len(mine) - need + 1]
        rows += [(w, t.unit, t.label, k, need, mine, prefix) for k, w in enumerate(prefix)]
    schema = ("word string, t_unit string, label string, place int, need int, template array<string>, prefix array<string>")
    table = spark.createDataFrame(rows, schema)
    starters = sorted({r[0] for r in rows}, key=rank.get)

    in_order = _strings(ordered)
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), license_words(F.col("text")).alias("ws"))
    # A text without any starter has no block with one.
    slim = slim.where(F.arrays_overlap("ws", _strings(starters))).drop("ws")
    blocks = [slim.select("doc_id", F.lit(unit).alias("unit"), F.posexplode(F.split("text", pattern)).alias("block", "part"))
              for unit, pattern in (("line", "\n"), ("paragraph", PARAGRAPH))]
    # Template words of the block in the global order; other words only count for the length.
    sets = blocks[0].unionByName(blocks[1]).select(
        "doc_id", "unit", "block", license_words(F.col("part")).alias("all")).select(
        "doc_id", "unit", "block", F.array_intersect(in_order, F.col("all")).alias("ws"))
    probes = sets.select("*", F.explode(F.array_intersect("ws", _strings(starters))).alias("word"))
    pairs = probes.join(F.broadcast(table), "word").where(F.col("unit") == F.col("t_unit"))
    first = F.get(F.array_intersect("ws", "prefix"), F.lit(0)) == F.col("word")  # each pair once
    long_enough = F.size("ws") >= F.col("need")
    left = F.least(F.size("template") - F.col("place"),
                   F.size("ws") - F.array_position("ws", F.col("word")).cast("int") + 1)
    overlap = F.size(F.array_intersect("ws", "template"))
    return pairs.where(long_enough & first & (left >= F.col("need"))).where(overlap >= F.col("need")).select(
        "doc_id", "unit", "block", "label", (overlap / F.size("template")).alias("containment"))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: phrase places, base labels, all labels and the best score."""
    ws = license_words(F.col("text"))
    # A phrase needs one of these strings somewhere, which is cheaper to look for than places.
    lowered = lower_ascii(F.coalesce("text", F.lit("")))
    maybe = lowered.contains("license") | lowered.contains("cc")
    none = F.array().cast("array<struct<place:bigint,label:string>>")
    base = docs.select("doc_id", ws.alias("_ws"), maybe.alias("_maybe")).select(
        "doc_id", F.size("_ws").cast("bigint").alias("n_words"),
        F.when(F.col("_maybe"), phrase_places(F.col("_ws"))).otherwise(none).alias("_places"))
    base = base.select(
        "doc_id", "n_words", F.size("_places").cast("bigint").alias("n_base"),
        F.array_min(F.transform("_places", lambda x: x["place"])).alias("first_word"),
        F.array_max(F.transform("_places", lambda x: x["place"])).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("_places", lambda x: x["label"]))).alias("_base"))
    found = matches(docs, threshold).groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_set("label").alias("_own"), F.max("containment").alias("_best"))
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    own = F.coalesce(F.col("_own"), F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", own)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same result as SQL, block by template without any filter."""
    known = ", ".join(
        f"('{t.label}', '{t.unit}', [{', '.join(repr(w) for w in sorted(t.words))}], "
        f"{math.ceil(threshold * len(t.words) - 1e-9)})" for t in templates())
    places = " UNION ALL ".join(
        "SELECT doc_id, i, '{}' AS label FROM p WHERE {}".format(label, " AND ".join(
            f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))) for phrase, label in PHRASES)
    low = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cut = r"list_filter(regexp_split_to_array(" + low + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
WITH d AS (SELECT doc_id, text, {cut.format('text')} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM d WHERE list_has_any(ws, ['license', 'by'])),
h AS ({places}),
b AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_base, CAST(min(i) AS BIGINT) AS first_word,
             CAST(max(i) AS BIGINT) AS last_word, list_sort(list_distinct(list(label))) AS base FROM h GROUP BY doc_id),
t(label, unit, words, need) AS (VALUES {known}),
x AS (SELECT doc_id, 'line' AS unit, unnest(string_split(coalesce(text, ''), chr(10))) AS part FROM documents
      UNION ALL SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(coalesce(text, ''), '\n[\x20\x09-\x0D]*\n')) FROM documents),
y AS (SELECT doc_id, unit, {cut.format('part')} AS ws FROM x),
m AS (SELECT doc_id, label, len(list_intersect(ws, words)) / len(words) AS c FROM y JOIN t USING (unit)
      WHERE list_has_any(ws, words) AND len(list_intersect(ws, words)) >= need),
o AS (SELECT doc_id, list(DISTINCT label) AS own, max(c) AS best FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(coalesce(base, []), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id)
"""
