"""Write-boundary rules as a query over a log of write events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which tools write and where anybody may.
WRITE_TOOLS = ["Write", "Edit", "MultiEdit", "NotebookEdit"]
TEMP_PREFIXES = ("/tmp/", "/var/folders/")


def plain_path(path: Column) -> Column:
    """Drop repeated slashes, ``.`` steps and a closing slash; most paths have none and stay untouched."""
    untidy = F.contains(path, F.lit("//")) | F.contains(path, F.lit("./")) | F.endswith(path, F.lit("/")) | F.endswith(path, F.lit("/."))
    text = F.regexp_replace(path, "/(\\./)+", "/")
    text = F.regexp_replace(F.regexp_replace(text, "/{2,}", "/"), "/(\\./)+", "/")
    text = F.regexp_replace(text, "^(\\./)+", "")
    return F.when(untidy, F.regexp_replace(text, "(?<=.)/\\.?$", "")).otherwise(path)


def resolved_path(path: Column) -> Column:
    """Also resolve ``..`` steps."""
    absolute = F.startswith(path, F.lit("/"))
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda done, s: F.when(s != "..", F.concat(done, F.array(s)))
        .when((F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != ".."),
              F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(absolute, done).otherwise(F.concat(done, F.array(s))))
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(kept, "/"))


def starts_with_any(path: Column, prefixes: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith(path, F.lit(p))
    return hit


def write_audit(events: DataFrame, repo_root: str, deny_prefixes: Sequence[str] = (),
                baseline_prefix: str = ".baseline/", shard_prefix: str = ".shard-",
                normalize: bool = False) -> DataFrame:
    """Add ``allowed`` and ``reason``; the first rule that applies decides.

    ``events`` holds ``shard_root, tool_name`` and one or more of
    ``file_path, path, notebook_path``. An event without ``shard_root`` is outside
    sharded mode and allowed. ``normalize`` resolves ``..`` before the rules.
    """
    given = [F.nullif(F.col(c), F.lit("")) for c in ("file_path", "path", "notebook_path") if c in events.columns]
    raw = F.coalesce(*given, F.lit(None).cast("string"))
    clean = resolved_path if normalize else plain_path
    root = repo_root.rstrip("/")

    def inside(path: Column) -> Column:
        return F.when(F.startswith(path, F.lit(root + "/")), F.substring(path, F.lit(len(root) + 2), F.length(path))).otherwise(path)

    df = events.withColumn("_raw", raw).withColumn("_p", clean(F.col("_raw"))).withColumn(
        "_rel", inside(F.col("_p"))).withColumn("_own", inside(plain_path(F.col("shard_root"))))
    path, rel, own = F.col("_p"), F.col("_rel"), F.col("_own")
    own_name = F.regexp_extract(own, "([^/]*)$", 1)
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root + "/"), path))

    def under(folder: Column) -> Column:
        return (rel == folder) | F.startswith(rel, F.concat(folder, F.lit("/")))

    # The texts of decisions.
    rules = [
        (F.nullif(F.col("shard_root"), F.lit("")).isNull(), True, "no shard"),
        (~F.coalesce(F.col("tool_name").isin(WRITE_TOOLS), F.lit(False)), True, "not a write tool"),
        (F.col("_raw").isNull(), True, "no path"),
        (starts_with_any(full, TEMP_PREFIXES), True, "tmp path"),
        (F.startswith(rel, F.lit(baseline_prefix)), False, "baseline deny"),
        (starts_with_any(rel, deny_prefixes), False, "project red-line deny"),
        (F.startswith(rel, F.lit(shard_prefix)) & ~under(own_name), False, "cross-shard deny"),
        (F.endswith(rel, F.lit(".py")) & ~F.contains(rel, F.lit("__pycache__")), False, "code deny"),
        (under(own), True, "inside current shard"),
    ]
    rule = F.lit(len(rules))
    for number, (condition, _, _) in reversed(list(enumerate(rules))):
        rule = F.when(condition, number).otherwise(rule)
    reasons = F.array(*[F.lit(text) for _, _, text in rules], F.lit("default deny"))
    letting = [number for number, (_, ok, _) in enumerate(rules) if ok]
    return (df.withColumn("_rule", rule)
            .withColumn("allowed", F.col("_rule").isin(letting))
            .withColumn("reason", F.element_at(reasons, F.col("_rule") + 1))
            .drop("_raw", "_p", "_rel", "_own", "_rule"))
