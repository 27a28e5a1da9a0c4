"""Audit rows ``(layer, subject, passed, n_bad, example, detail)`` and the fail-stop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.model import AuditError


def check_rows(df: DataFrame, layer: str, subject: Column | None = None, passed: Column | None = None,
               n_bad: Column | None = None, example: Column | None = None,
               detail: Column | None = None) -> DataFrame:
    """Shape check results; columns not given are taken from ``df`` by name or left NULL."""

    def pick(given: Column | None, name: str, kind: str) -> Column:
        if given is None:
            given = F.col(name) if name in df.columns else F.lit(None)
        return given.cast(kind).alias(name)

    return df.select(
        F.lit(layer).alias("layer"),
        pick(subject, "subject", "string"),
        pick(passed, "passed", "boolean"),
        pick(n_bad, "n_bad", "bigint"),
        pick(example, "example", "string"),
        pick(detail, "detail", "string"),
    )


def union_reports(reports: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def assert_clean(report: DataFrame, shown: int = 20) -> None:
    """Raise :class:`AuditError` when any row failed; it names the first ``shown`` and tells how many there are."""
    failed = report.where(~F.col("passed")).orderBy("layer", "subject").limit(shown).collect()
    if failed:
        total = report.where(~F.col("passed")).count()
        more = [f"{total} failed rows in all"] if total > len(failed) else []
        raise AuditError([
            f"({r.layer}) {r.subject}: {r.detail or ''} n_bad={r.n_bad} example={r.example}" for r in failed
        ] + more)
