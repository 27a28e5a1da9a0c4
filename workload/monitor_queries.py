"""Progress and log queries (D1-D9), state queries (L1-L8), write audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.cluster import scratch_path
from labelloom.operators import monitor as D
from labelloom.operators import policy as W
from labelloom.operators import state as L
from labelloom.sources.files import read_write_events
from workload.inputs import Inputs
from workload.registry import query

PROGRESS_SQL = """
    p AS (SELECT shard_id, count(*) FILTER (WHERE passes) AS done, count(*) AS total, count(*) FILTER (WHERE NOT passes) AS n_pending
          FROM v_stories GROUP BY shard_id)"""
ERROR_SQL = """
    e AS (SELECT shard_id, count(*) FILTER (WHERE regexp_matches(line, '429|rate_limit_exceeded|overloaded_error')) AS n_errors
          FROM v_log GROUP BY shard_id)"""
MEAN_SQL = """
    r AS (SELECT shard_id, CAST(floor(avg(n)) AS BIGINT) AS mean_len FROM (
              SELECT shard_id, length(reason) AS n, row_number() OVER (PARTITION BY shard_id ORDER BY seq DESC) AS back
              FROM v_verdicts_dirty) WHERE back <= 50 GROUP BY shard_id)"""
TAIL_SQL = """
    tails AS (SELECT shard_id, source, seq, line FROM (
        SELECT *, row_number() OVER (PARTITION BY shard_id, source ORDER BY seq DESC) AS back FROM v_log) WHERE back <= 50)"""
CAUSE_SQL = TAIL_SQL + """,
    c AS (SELECT shard_id, CASE WHEN bool_or(contains(line, 'working tree is dirty')) THEN 'dirty_tree'
              WHEN bool_or(regexp_matches(line, '(?i)(You''ve hit your limit|rate[ _-]?limit|429)')) THEN 'rate_limit'
              ELSE 'other' END AS cause FROM tails GROUP BY shard_id)"""


@query("progress", f"WITH {PROGRESS_SQL} SELECT * FROM p")
def progress(i: Inputs) -> DataFrame:
    return D.progress(i.stories)


@query("pending_stories", """
    SELECT shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY pos) AS seq, story_id FROM v_stories WHERE NOT passes""")
def pending_stories(i: Inputs) -> DataFrame:
    return D.pending_stories(i.stories)


@query("error_counts", f"WITH {ERROR_SQL} SELECT * FROM e")
def error_counts(i: Inputs) -> DataFrame:
    return D.error_counts(i.logs)


@query("recent_mean_len", f"WITH {MEAN_SQL} SELECT * FROM r")
def recent_mean_len(i: Inputs) -> DataFrame:
    return D.recent_mean_len(i.verdicts_dirty)


@query("dashboard", f"""
    WITH {PROGRESS_SQL}, {ERROR_SQL}, {MEAN_SQL},
    b AS (SELECT p.shard_id AS shard, done, total, coalesce(n_errors, 0) AS n_errors, mean_len
          FROM p LEFT JOIN e ON e.shard_id = p.shard_id LEFT JOIN r ON r.shard_id = p.shard_id
          UNION ALL
          SELECT 'TOTAL', CAST(sum(done) AS BIGINT), CAST(sum(total) AS BIGINT), CAST(sum(coalesce(n_errors, 0)) AS BIGINT), NULL
          FROM p LEFT JOIN e ON e.shard_id = p.shard_id)
    SELECT shard, done, total, n_errors, mean_len,
           concat('[', repeat('#', CAST(done * 20 // greatest(total, 1) AS INT)),
                  repeat('.', CAST(20 - done * 20 // greatest(total, 1) AS INT)), ']') AS bar FROM b""")
def dashboard(i: Inputs) -> DataFrame:
    return D.dashboard(i.stories, i.logs, i.verdicts_dirty)


@query("tail_n", f"""
    WITH {TAIL_SQL}
    SELECT shard_id, source, seq, line, row_number() OVER (PARTITION BY shard_id, source ORDER BY seq) AS rn FROM tails""")
def tail_n(i: Inputs) -> DataFrame:
    return D.tail_n(i.logs, ["shard_id", "source"], "seq")


@query("classify", f"WITH {CAUSE_SQL} SELECT shard_id, cause FROM c")
def classify(i: Inputs) -> DataFrame:
    return D.classify(D.tail_n(i.logs, ["shard_id", "source"], "seq"))


@query("health_alerts", """
    WITH s AS (SELECT sweep, shard_id, done = total AS complete, alive, cause FROM v_sweeps)
    SELECT sweep, shard_id, CASE WHEN complete THEN 'COMPLETE' WHEN alive THEN 'RUNNING' WHEN cause = 'rate_limit' THEN 'RATE_LIMITED'
           WHEN cause = 'dirty_tree' THEN 'DIRTY_INPUT' ELSE 'UNKNOWN' END AS alert FROM s
    UNION ALL
    SELECT sweep, NULL, CASE WHEN bool_and(complete) THEN 'READY_TO_MERGE' ELSE 'ALL_DEAD' END
    FROM s GROUP BY sweep HAVING bool_and(complete) OR NOT bool_or(alive)""")
def health_alerts(i: Inputs) -> DataFrame:
    rows = i.sweeps
    keys = ["sweep", "shard_id"]
    return D.health_alerts(rows.select(*keys, "done", "total"), rows.select(*keys, "alive"), rows.select(*keys, "cause"), ["sweep"])


@query("status_json", f"""
    WITH {PROGRESS_SQL}
    SELECT shard_id, concat('{{"ts":"2024-03-01 21:30:00","iteration":7,"shard":"', shard_id, '","alive":',
           CASE WHEN done > 1 THEN 'true' ELSE 'false' END, ',"done":', done, ',"total":', total, ',"n_pending":', n_pending, '}}') AS status
    FROM p""")
def status_json(i: Inputs) -> DataFrame:
    rows = D.progress(i.stories)
    alive = rows.select("shard_id", (F.col("done") > 1).alias("alive"))
    return D.status_json(rows, alive, 7, F.lit("2024-03-01 12:30:00").cast("timestamp"), "Asia/Tokyo")


PATHS_SQL = "SELECT DISTINCT path FROM v_write_events WHERE path IS NOT NULL"


@query("unexpected_paths", f"""
    WITH w AS ({PATHS_SQL})
    SELECT path FROM w WHERE NOT starts_with(path, '.shard-') AND path NOT IN ('docs/click', 'docs/view')""")
def unexpected_paths(i: Inputs) -> DataFrame:
    paths = i.write_events.where("path IS NOT NULL").select("path").distinct()
    allow = i.spark.createDataFrame([("docs/click",), ("docs/view",)], "path string")
    return D.unexpected_paths(paths, allow)


# ---- Control state -------------------------------------------------------------


@query("next_story", """
    SELECT n.shard_id, coalesce(s.story_id, 'ALL_DONE') AS next_story FROM (SELECT DISTINCT shard_id FROM v_stories) n
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY priority, pos) AS rn FROM v_stories WHERE NOT passes) s
      ON s.shard_id = n.shard_id AND s.rn = 1""")
def next_story(i: Inputs) -> DataFrame:
    return L.next_story(i.stories)


@query("circuit_break", """
    WITH c AS (SELECT *, CASE WHEN timeout_text = '1200' THEN 1201 WHEN attempts > 1 AND timeout_text IS NULL THEN attempts + 1 ELSE 1 END AS attempt
               FROM v_stories)
    SELECT shard_id, story_id, CAST(attempt AS BIGINT) AS attempt, attempt > 3 AS tripped,
           CAST(CASE WHEN attempt > 3 THEN 99999 ELSE priority END AS BIGINT) AS priority FROM c""")
def circuit_break(i: Inputs) -> DataFrame:
    """Counter texts: good numbers, negative ones, words and absent files."""
    text = F.coalesce(F.col("timeout_text"), F.col("attempts").cast("string"))
    counters = i.stories.where("timeout_text IS NOT NULL OR attempts > 1").select("shard_id", "story_id", text.alias("counter_text"))
    return L.circuit_break(i.stories, counters).select("shard_id", "story_id", "attempt", "tripped", "priority")


@query("circuit_break_picked", """
    WITH n AS (SELECT shard_id, story_id FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY priority, pos) AS rn
               FROM v_stories WHERE NOT passes) WHERE rn = 1),
    c AS (SELECT s.*, n.story_id IS NOT NULL AS picked, s.attempts + CASE WHEN n.story_id IS NOT NULL THEN 1 ELSE 0 END AS attempt
          FROM v_stories s LEFT JOIN n ON n.shard_id = s.shard_id AND n.story_id = s.story_id)
    SELECT shard_id, story_id, attempt, picked AND attempt > 3 AS tripped,
           CASE WHEN picked AND attempt > 3 THEN 99999 ELSE priority END AS priority FROM c""")
def circuit_break_picked(i: Inputs) -> DataFrame:
    """Only the next story of each shard is attempted."""
    counters = i.stories.select("shard_id", "story_id", F.col("attempts").cast("string").alias("counter_text"))
    picked = L.next_story(i.stories).withColumnRenamed("next_story", "story_id")
    return L.circuit_break(i.stories, counters, picked=picked).select("shard_id", "story_id", "attempt", "tripped", "priority")


ALIVE_SQL = "al AS (SELECT DISTINCT shard_id, shard_id IN ('b', 'd') AS alive FROM v_stories)"


def _reset(i: Inputs) -> tuple[DataFrame, DataFrame]:
    alive = i.stories.select("shard_id").distinct().withColumn("alive", F.col("shard_id").isin("b", "d"))
    retries = i.stories.select("shard_id", "story_id", F.col("attempts").alias("n"))
    return L.reset_pending(i.stories, retries, alive)


@query("reset_pending", f"""
    WITH {ALIVE_SQL}
    SELECT s.shard_id, s.story_id, CASE WHEN NOT s.passes AND NOT a.alive THEN s.pos ELSE s.priority END AS priority
    FROM v_stories s JOIN al a ON a.shard_id = s.shard_id""")
def reset_pending(i: Inputs) -> DataFrame:
    return _reset(i)[0].select("shard_id", "story_id", "priority")


@query("reset_retries", f"""
    WITH {ALIVE_SQL}
    SELECT s.shard_id, s.story_id, s.attempts AS n FROM v_stories s JOIN al a ON a.shard_id = s.shard_id WHERE s.passes OR a.alive""")
def reset_retries(i: Inputs) -> DataFrame:
    return _reset(i)[1]


CHANGES_SQL = """
    x AS (SELECT *, before_passes IS DISTINCT FROM after_passes AS changed, story_id = locked_id AS is_locked FROM v_snapshots)"""


@query("snapshot_changes", f"""
    WITH {CHANGES_SQL}
    SELECT iteration, story_id, before_passes AS before, after_passes AS after, locked_id, changed, is_locked FROM x""")
def snapshot_changes(i: Inputs) -> DataFrame:
    return L.changes(i.before, i.after, i.locks)


@query("snapshot_diff", f"""
    WITH {CHANGES_SQL},
    g AS (SELECT iteration, count(*) FILTER (WHERE changed) AS n_changed, count(*) FILTER (WHERE changed AND is_locked) AS n_locked,
                 bool_or(after_passes) FILTER (WHERE changed AND is_locked) AS now FROM x GROUP BY iteration)
    SELECT iteration, n_changed, CASE WHEN n_changed = 0 THEN 'NO_CHANGE' WHEN n_changed = 1 AND n_locked = 1 AND now THEN 'OK'
           WHEN n_changed = 1 AND n_locked = 1 THEN 'OK_NO_PASS' ELSE 'VIOLATION' END AS result FROM g""")
def snapshot_diff(i: Inputs) -> DataFrame:
    return L.snapshot_diff(i.before, i.after, i.locks)


@query("heal", f"""
    WITH {CHANGES_SQL}
    SELECT iteration, story_id, CASE WHEN is_locked THEN after_passes ELSE before_passes END AS passes,
           NOT is_locked AND changed AS healed FROM x""")
def heal(i: Inputs) -> DataFrame:
    return L.heal(i.before, i.after, i.locks)


@query("claims", f"""
    WITH {PROGRESS_SQL},
    t AS (SELECT *, CASE WHEN contains(output, '<promise>COMPLETE</promise>') THEN 'COMPLETE'
                         WHEN contains(output, '<promise>YIELD</promise>') THEN 'YIELD'
                         WHEN contains(output, 'VIOLATION: ') THEN 'VIOLATION' END AS token FROM v_outputs)
    SELECT t.iteration, t.shard_id, t.token,
           CASE WHEN t.token = 'COMPLETE' THEN coalesce(p.n_pending, 0) = 0 ELSE t.token IS NOT NULL END AS believed
    FROM t LEFT JOIN p ON p.shard_id = t.shard_id""")
def claims(i: Inputs) -> DataFrame:
    return L.claims(i.outputs, i.stories).select("iteration", "shard_id", "token", "believed")


@query("summary", """
    SELECT count(*) FILTER (WHERE passes) AS passed, count(*) AS total,
           CAST(round_even(count(*) FILTER (WHERE passes) * 100.0 / count(*), 0) AS BIGINT) AS percent FROM v_stories""")
def summary(i: Inputs) -> DataFrame:
    return L.summary(i.stories)


@query("summary_rows", "SELECT shard_id, story_id, CASE WHEN passes THEN 'PASS' ELSE 'TODO' END AS status FROM v_stories")
def summary_rows(i: Inputs) -> DataFrame:
    return L.summary_rows(i.stories)


@query("run_outcomes", """
    WITH x AS (SELECT r.*, CASE WHEN s.timeout_text = '1200' THEN 1200 ELSE 1800 END AS lim FROM v_runs r JOIN v_stories s ON s.story_id = r.story_id)
    SELECT run_id, story_id, CAST(lim AS BIGINT) AS limit_seconds,
           CASE WHEN seconds > lim THEN 'TIMEOUT' WHEN exit_code <> 0 THEN 'ERROR' ELSE 'OK' END AS outcome,
           CAST(CASE WHEN seconds > lim THEN 124 ELSE exit_code END AS BIGINT) AS code FROM x""")
def run_outcomes(i: Inputs) -> DataFrame:
    return L.run_outcomes(i.runs, i.stories).select("run_id", "story_id", "limit_seconds", "outcome", "code")


WRITE_SQL = """
    WITH r AS (
        SELECT event_id, CASE WHEN tool_name <> 'Write' THEN 'not a write tool' WHEN path IS NULL THEN 'no path'
               WHEN starts_with(path, '/tmp/') THEN 'tmp path' WHEN starts_with(path, '.baseline/') THEN 'baseline deny'
               WHEN starts_with(path, 'docs/') THEN 'project red-line deny'
               WHEN starts_with(path, '.shard-') AND NOT starts_with(path, concat(shard_root, '/')) THEN 'cross-shard deny'
               WHEN path LIKE '%.py' THEN 'code deny' WHEN starts_with(path, concat(shard_root, '/')) THEN 'inside current shard'
               ELSE 'default deny' END AS reason FROM v_write_events)
    SELECT event_id, reason IN ('not a write tool', 'no path', 'tmp path', 'inside current shard') AS allowed, reason FROM r"""


@query("write_audit", WRITE_SQL)
def write_audit(i: Inputs) -> DataFrame:
    return W.write_audit(i.write_events, "/data/project", ["docs/"]).select("event_id", "allowed", "reason")


@query("write_audit_lines", WRITE_SQL)
def write_audit_lines(i: Inputs) -> DataFrame:
    """The same events as raw tool-call lines, half of them under the older field names."""
    path = scratch_path(i.spark, "events")
    target, older = F.struct(F.col("path").alias("file_path")), F.struct("path")
    new, old = F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1
    line = F.to_json(F.struct(
        F.when(new, F.col("tool_name")).alias("tool_name"), F.when(old, F.col("tool_name")).alias("name"),
        F.when(new, target).alias("tool_input"), F.when(old, older).alias("input"), "shard_root", "event_id"))
    i.write_events.select(line.alias("value")).write.text(path)
    events = read_write_events(i.spark, path, [T.StructField("event_id", T.LongType())])
    return W.write_audit(events, "/data/project", ["docs/"]).select("event_id", "allowed", "reason")
