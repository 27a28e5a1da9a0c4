"""Sets of tables that change all at once: versioned folders and a log of commits.

A version is written aside, whole, under a name of its own. It becomes the current one when a small
file of the commit log takes its place, which is a single rename; until then, and if a writer dies at any
step, readers see the version before. Tables that a new version leaves as they are stay where they lie.

Layout: ``<root>/_versions/<version>/<table>`` and ``<root>/_commits/<number>.json``. One writer at a time;
of two, the later one is refused.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from labelloom.model import PlanError
from labelloom.sources.sinks import MODES, _fs, exists, has_rows, remove

_NUMBER = re.compile(r"(\d{12})\.json")


def _commits(root: str) -> str:
    return f"{root.rstrip('/')}/_commits"


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _fs(spark, _commits(root))
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]  # one small file a commit
    return sorted(int(m.group(1)) for m in map(_NUMBER.fullmatch, names) if m)


def _read(spark: SparkSession, root: str, number: int) -> dict:
    fs, path = _fs(spark, f"{_commits(root)}/{number:012d}.json")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def history(spark: SparkSession, root: str) -> list[dict]:
    """All commits, the first one first: ``number, version, tables, at, note``."""
    return [_read(spark, root, n) for n in _numbers(spark, root)]


def current(spark: SparkSession, root: str) -> dict | None:
    """The last commit, or None."""
    numbers = _numbers(spark, root)
    return _read(spark, root, numbers[-1]) if numbers else None


def table_path(spark: SparkSession, root: str, name: str, commit: dict | None = None) -> str:
    """Folder of a table in the given or the current version."""
    commit = commit or current(spark, root)
    if commit is None or name not in commit["tables"]:
        raise PlanError(f"{root} has no table {name}")
    return f"{root.rstrip('/')}/{commit['tables'][name]}"


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet", commit: dict | None = None) -> DataFrame:
    return spark.read.format(fmt).load(table_path(spark, root, name, commit))


@dataclass
class Draft:
    """A version under work; nothing of it shows before ``commit``."""

    spark: SparkSession
    root: str
    version: str = field(default_factory=lambda: uuid.uuid4().hex)
    tables: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.base = current(self.spark, self.root)

    def place(self, name: str) -> str:
        """Folder for a writer of the table ``name``."""
        self.tables[name] = f"_versions/{self.version}/{name}"
        return f"{self.root.rstrip('/')}/{self.tables[name]}"

    def write(self, name: str, df: DataFrame, fmt: str = "parquet") -> None:
        df.write.format(fmt).save(self.place(name))

    def keep(self, name: str) -> None:
        """Take a table over from the current version; no row is copied."""
        if self.base is None or name not in self.base["tables"]:
            raise PlanError(f"{self.root} has no table {name} to keep")
        self.tables[name] = self.base["tables"][name]

    def commit(self, note: str = "") -> int:
        """Make this the current version."""
        number = (self.base["number"] if self.base else 0) + 1
        record = {"number": number, "version": self.version, "tables": self.tables, "note": note,
                  "at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")}
        final = f"{_commits(self.root)}/{number:012d}.json"
        aside = f"{_commits(self.root)}/.{self.version}"
        fs, target = _fs(self.spark, final)
        _, source = _fs(self.spark, aside)
        out = fs.create(source, True)
        out.write(json.dumps(record).encode())
        out.close()
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, False)
            raise PlanError(f"{self.root} was changed by another writer")
        return number

    def discard(self) -> None:
        remove(self.spark, f"{self.root.rstrip('/')}/_versions/{self.version}")


def write_version(spark: SparkSession, root: str, write: Callable[[Draft], None], note: str = "") -> int:
    """Let ``write`` fill a draft and commit it; a draft that fails leaves nothing behind."""
    draft = Draft(spark, root)
    try:
        write(draft)
        return draft.commit(note)
    except BaseException:
        draft.discard()
        raise


def publish_versions(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], state: Mapping[str, T.StructType],
                     mode: str = "default") -> int:
    """Plan tables and an empty or kept state as one version.

    ``default`` refuses when any state table has rows; ``refresh`` rewrites the plan and keeps the
    state, which must exist; ``force`` also empties the state.
    """
    if mode not in MODES:
        raise PlanError(f"mode is one of {MODES}, got {mode!r}")
    now = current(spark, root)
    there = [n for n in state if now and n in now["tables"]]
    if mode == "default":
        for name in there:
            if has_rows(spark, table_path(spark, root, name, now)):
                raise PlanError(f"rows found in {name}: only mode='force' replaces them")
    if mode == "refresh" and len(there) < len(state):
        raise PlanError(f"{root} has no state, nothing to refresh")

    def write(draft: Draft) -> None:
        for name, df in tables.items():
            draft.write(name, df)
        for name, schema in state.items():
            if mode == "refresh":
                draft.keep(name)
            else:
                draft.write(name, spark.createDataFrame([], schema))

    return write_version(spark, root, write, mode)


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the folders that none of the last ``keep`` commits uses; returns their versions.

    Commits stay in the log. Drafts of writers that died go as well, so no writer may be at work.
    """
    commits = history(spark, root)[-max(keep, 1):]
    used = {path.split("/")[1] for c in commits for path in c["tables"].values()}
    folder = f"{root.rstrip('/')}/_versions"
    if not exists(spark, folder):
        return []
    fs, target = _fs(spark, folder)
    gone = sorted(s.getPath().getName() for s in fs.listStatus(target) if s.getPath().getName() not in used)
    for name in gone:
        remove(spark, f"{folder}/{name}")
    return gone
