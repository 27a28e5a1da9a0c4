"""Column helpers shared by the operators; all of them stay inside codegen."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.model import LETTERS, PlanError, VerdictSchema


def batch_label(idx: Column) -> Column:
    return F.format_string("BATCH-%03d", idx)


def batch_number(story_id: Column) -> Column:
    return F.split_part(story_id, F.lit("-"), F.lit(2)).try_cast("bigint")


def range_label(lo: Column, hi: Column) -> Column:
    return F.concat(batch_label(lo), F.lit(".."), batch_label(hi))


def shard_name(ordinal: int, wide: bool = False) -> str:
    """0 -> a, 1 -> b ...; beyond 26 shards only with ``wide`` names."""
    if ordinal < len(LETTERS):
        return LETTERS[ordinal]
    if not wide:
        raise PlanError(f"more than {len(LETTERS)} shards need wide names")
    return f"s{ordinal:05d}"


def shard_name_of(ordinal: Column) -> Column:
    """Column form of :func:`shard_name` with wide names allowed."""
    return F.when(ordinal < len(LETTERS), F.chr(ordinal + 97)).otherwise(F.format_string("s%05d", ordinal))


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def true(flag: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(flag, F.lit(False))


def swap_prefix(value: Column, old: str | Column, new: str | Column) -> Column:
    old_c = F.lit(old) if isinstance(old, str) else old
    new_c = F.lit(new) if isinstance(new, str) else new
    rest = F.substring(value, F.length(old_c) + 1, F.length(value))
    return F.when(F.startswith(value, old_c), F.concat(new_c, rest)).otherwise(value)


def fill_placeholders(template: str | Column, mapping: Mapping[str, Column]) -> Column:
    """Replace every ``{{NAME}}`` in ``template`` by its column; NULL is empty text.

    The template is cut once, so a value that holds a placeholder stays as it is.
    """
    marks = {"{{" + name + "}}": F.coalesce(value.cast("string"), F.lit("")) for name, value in mapping.items()}
    if not marks:
        return F.lit(template) if isinstance(template, str) else template
    cut = "|".join(re.escape(m) for m in marks)
    if isinstance(template, str):
        parts = re.split(f"({cut})", template)
        return F.concat(*(marks.get(part, F.lit(part)) for part in parts))
    # Template parts and the placeholders between them, in turn.
    plain, found = F.split(template, cut), F.regexp_extract_all(template, F.lit(f"({cut})"), F.lit(1))
    filled = F.transform(found, lambda m: F.coalesce(*(F.when(m == F.lit(mark), value) for mark, value in marks.items())))
    return F.array_join(F.flatten(F.zip_with(plain, filled, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def in_labels(qa: Column, valid: Sequence[str]) -> Column:
    """Label check; NULL is not a label, and no list accepts every label."""
    if not valid:
        return qa.isNotNull()
    return true(qa.isin(list(valid)))


def with_chars(verdicts: DataFrame, schema: VerdictSchema) -> DataFrame:
    """Make sure the reason's length is a column.

    A table that carries it already is checked without reading any text;
    otherwise it is computed where the text is scanned, before any shuffle.
    Fields the table does not have at all become NULL, that is, missing.
    """
    wanted = [*schema.checked_fields, schema.id_field, schema.qa_field, schema.reason_field]
    absent = {n: F.lit(None).cast("string") for n in wanted if n not in verdicts.columns}
    full = verdicts.withColumns(absent) if absent else verdicts
    if schema.chars_field in verdicts.columns:
        return full
    return full.withColumn(schema.chars_field, F.length(schema.reason_field))


def long_enough(schema: VerdictSchema) -> Column:
    return true(F.col(schema.chars_field) >= schema.min_reason_chars)


def present(name: str, schema: VerdictSchema) -> Column:
    """Presence of a field; that of the reason shows in its length."""
    return F.col(schema.chars_field if name == schema.reason_field else name).isNotNull()


def has_fields(names: Iterable[str], schema: VerdictSchema) -> Column:
    found = F.lit(True)
    for name in names:
        found = found & present(name, schema)
    return found


def row_errors(schema: VerdictSchema, version: str) -> Column:
    """Problems of one verdict row as an ordered list of texts.

    A row with missing fields reports only those, as nothing else can be
    trusted. A missing key and a NULL value are the same thing here. The rows
    need the length column of :func:`with_chars`.
    """
    absent = F.filter(
        F.array(*[F.when(~present(n, schema), F.lit(n)) for n in schema.checked_fields]),
        lambda x: x.isNotNull(),
    )
    qa = F.col(schema.qa_field)
    rules = F.filter(
        F.array(
            F.when(F.col("schema_version") != version, F.lit("schema_version")),
            F.when(~in_labels(qa, schema.valid_qa), F.lit(schema.qa_field)),
            F.when(~long_enough(schema), F.lit(f"{schema.reason_field} length")),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(
        F.size(absent) > 0, F.array(F.concat(F.lit("missing "), F.array_join(absent, ",")))
    ).otherwise(rules)


def fingerprint_aggs(columns: Sequence[str], prefix: str = "") -> list[Column]:
    """Order-free fingerprint of a group: row count and three hash sums.

    The 64-bit hash is summed as two 32-bit halves, which cannot overflow below
    2^31 rows per group, and a second seeded hash guards against collisions.
    """
    values = [F.col(c) for c in columns]
    first, second = F.xxhash64(*values), F.xxhash64(F.lit("second"), *values)
    return [
        F.count(F.lit(1)).alias(f"{prefix}rows"),
        F.sum(F.shiftright(first, 32)).alias(f"{prefix}high"),
        F.sum(first.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{prefix}low"),
        F.sum(F.shiftright(second, 32)).alias(f"{prefix}check"),
    ]
