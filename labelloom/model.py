"""Shared vocabulary: schemas, defaults and the verdict contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import types as T

# Defaults that decide results.
BATCH_SIZE = 50
MAX_ATTEMPTS = 3
MAX_RETRIES = 3
TRIPPED_PRIORITY = 99999
DEFAULT_TIMEOUT_SECONDS = 1800
REBALANCED_TIMEOUT_SECONDS = 2400
SAMPLE_SIZE = 50
SAMPLE_SEED = 42
TAIL_LINES = 50
EXAMPLES = 3
LETTERS = "abcdefghijklmnopqrstuvwxyz"


class PlanError(ValueError):
    """A plan, configuration or argument is not usable."""


class AuditError(RuntimeError):
    """At least one audit layer failed; carries the failed report rows."""

    def __init__(self, failures: Sequence[str]):
        super().__init__("; ".join(failures))
        self.failures = list(failures)


@dataclass(frozen=True)
class VerdictSchema:
    """Field names and rules a verdict row must follow.

    An empty ``valid_qa`` means that any label is accepted.
    """

    required_fields: tuple[str, ...] = ("task_id", "qa", "reason")
    id_field: str = "task_id"
    qa_field: str = "qa"
    reason_field: str = "reason"
    valid_qa: tuple[str, ...] = ()
    min_reason_chars: int = 150
    reason_long_ratio_min: float = 0.9
    distinct_qa_min: int = 2
    distinct_qa_min_small: int = 1
    small_batch_threshold: int = 33
    # Length of the reason, kept beside it so that checks need not move the text.
    chars_field: str = "reason_chars"

    @classmethod
    def from_dict(cls, config: Mapping) -> "VerdictSchema":
        known = {f.name for f in fields(cls)}
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in config.items() if k in known}
        return cls(**values)

    @property
    def checked_fields(self) -> list[str]:
        """Required columns in a stable order, the schema version included."""
        return sorted({*self.required_fields, "schema_version"})

    def distinct_qa_threshold(self, n: int) -> int:
        return self.distinct_qa_min_small if n <= self.small_batch_threshold else self.distinct_qa_min

    def read_schema(self, extra: Sequence[T.StructField] = ()) -> T.StructType:
        """Explicit reader schema: text columns, the meta flag and any extra fields."""
        names = list(dict.fromkeys([self.id_field, *self.required_fields, self.qa_field,
                                    self.reason_field, "schema_version"]))
        taken = {f.name for f in extra}
        columns = [T.StructField(n, T.StringType()) for n in names if n not in taken]
        return T.StructType([*columns, *extra, T.StructField("__meta__", T.StringType())])


@dataclass(frozen=True)
class ShardRange:
    """One shard's inclusive, 1-based range of batch numbers."""

    shard_id: str
    lo: int
    hi: int

    @property
    def n_batches(self) -> int:
        return self.hi - self.lo + 1

    @property
    def label(self) -> str:
        return f"BATCH-{self.lo:03d}..BATCH-{self.hi:03d}"


STORY_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("storyType", T.StringType()),
    T.StructField("entryCount", T.LongType()),
    T.StructField("modifies", T.ArrayType(T.StringType())),
    T.StructField("creates", T.ArrayType(T.StringType())),
    T.StructField("acceptanceCriteria", T.ArrayType(T.StringType())),
    T.StructField("acceptanceGate", T.MapType(T.StringType(), T.StringType())),
    T.StructField("priority", T.LongType()),
    T.StructField("passes", T.BooleanType()),
    T.StructField("attempts", T.LongType()),
    T.StructField("timeoutSeconds", T.StringType()),
    T.StructField("notes", T.StringType()),
])

STORIES_DOC_SCHEMA = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("branchName", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("designDocs", T.ArrayType(T.StringType())),
    T.StructField("userStories", T.ArrayType(STORY_SCHEMA)),
    T.StructField("acceptance", T.StringType()),
])

MANIFEST_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("batch_size", T.LongType()),
    T.StructField("n_batches", T.LongType()),
    T.StructField("total_tasks", T.LongType()),
    T.StructField("shard_id", T.StringType()),
    T.StructField("shard_root", T.StringType()),
    T.StructField("batch_range", T.StringType()),
    T.StructField("batches", T.ArrayType(T.StructType([
        T.StructField("story_id", T.StringType()),
        T.StructField("input_file", T.StringType()),
        T.StructField("n_tasks", T.LongType()),
        T.StructField("task_ids", T.ArrayType(T.StringType())),
    ]))),
])
