"""Planning queries (P1-P10) and rebalancing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators import rebalance as R
from labelloom.plans import batches as B
from labelloom.plans import shards as S
from labelloom.plans import stories as T
from workload.inputs import Inputs
from workload.registry import query

STOPPED = ["src0", "src1", "src2", "src3", "src4"]
TARGETS = ["src7", "src8", "src9"]


@query("batchify", "SELECT task_id, pos, batch_idx FROM v_batch_tasks")
def batchify(i: Inputs) -> DataFrame:
    return B.batchify(i.task_ids, ["task_id"])


@query("batch_table", """
    SELECT batch_idx, story_id, concat('stories/batch-', printf('%03d', batch_idx), '.jsonl') AS input_file, n_tasks
    FROM v_batches""")
def batch_table(i: Inputs) -> DataFrame:
    return B.batch_table(i.members)


@query("auto_split", """
    SELECT b.batch_idx, b.story_id, b.n_tasks,
           chr(CAST(97 + least((b.batch_idx - 1) // (t.n // 3), 2) AS INT)) AS shard_id
    FROM v_batches b CROSS JOIN (SELECT count(*) AS n FROM v_batches) t""")
def auto_split(i: Inputs) -> DataFrame:
    return S.auto_split(i.batches.select("batch_idx", "story_id", "n_tasks"), 3)


@query("assign_ranges", """
    SELECT b.batch_idx, b.story_id,
           CASE WHEN b.batch_idx <= t.n // 4 THEN 'a' WHEN b.batch_idx <= t.n // 2 THEN 'b' ELSE 'c' END AS shard_id
    FROM v_batches b CROSS JOIN (SELECT count(*) AS n FROM v_batches) t""")
def assign_ranges(i: Inputs) -> DataFrame:
    n = i.batches.count()
    text = f"1-{n // 4},{n // 4 + 1}-{n // 2},{n // 2 + 1}-{n}"
    ranges = S.named_ranges(S.parse_splits(text), 3)
    return S.assign_ranges(i.batches.select("batch_idx", "story_id"), S.range_table(i.spark, ranges))


@query("check_assignment", """
    WITH t AS (SELECT count(*) AS n FROM v_batches)
    SELECT 'a' AS shard_id, n // 4 AS expected, n // 4 AS actual, true AS passed FROM t
    UNION ALL SELECT 'b', n - n // 4 + 2, n - n // 4, false FROM t""")
def check_assignment(i: Inputs) -> DataFrame:
    """The second range asks for two batches more than there are."""
    n = i.batches.count()
    ranges = S.range_table(i.spark, S.named_ranges([(1, n // 4), (n // 4 + 1, n + 2)]))
    return S.check_assignment(S.assign_ranges(i.batches.select("batch_idx"), ranges), ranges)


@query("check_ranges", """
    WITH c AS (
        SELECT *, coalesce(max(hi) OVER (PARTITION BY split_set ORDER BY ordinal
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor
        FROM v_ranges)
    SELECT split_set, ordinal, lo, hi, 'out_of_range' AS kind, CAST(NULL AS BIGINT) AS missing_lo,
           CAST(NULL AS BIGINT) AS missing_hi FROM c WHERE lo < 1 OR hi > total
    UNION ALL SELECT split_set, ordinal, lo, hi, 'inverted', NULL, NULL FROM c WHERE lo > hi
    UNION ALL SELECT split_set, ordinal, lo, hi, 'overlap', NULL, NULL FROM c WHERE lo <= cursor
    UNION ALL SELECT split_set, ordinal, lo, hi, 'gap', cursor + 1, lo - 1 FROM c WHERE lo > cursor + 1
    UNION ALL SELECT split_set, NULL, NULL, NULL, 'gap', max(hi) + 1, max(total) FROM v_ranges
              GROUP BY split_set HAVING max(hi) < max(total)""")
def check_ranges(i: Inputs) -> DataFrame:
    return S.check_ranges(i.ranges, "total", ["split_set"])


@query("shard_manifest", """
    SELECT shard_id, concat(printf('BATCH-%03d', min(batch_idx)), '..', printf('BATCH-%03d', max(batch_idx))) AS batch_range,
           count(*) AS n_batches, CAST(sum(n_tasks) AS BIGINT) AS total_tasks, concat('.shard-', shard_id) AS shard_root
    FROM v_batches GROUP BY shard_id""")
def shard_manifest(i: Inputs) -> DataFrame:
    return S.shard_manifest(i.batches)[0]


@query("shard_batches", """
    SELECT shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY batch_idx) AS seq, batch_idx, story_id,
           concat('.shard-', shard_id, '/stories/batch-', printf('%03d', batch_idx), '.jsonl') AS input_file, n_tasks
    FROM v_batches""")
def shard_batches(i: Inputs) -> DataFrame:
    return S.shard_batches(i.batches)


REBASED_SQL = """
    rebased AS (
        SELECT shard_id, story_id, pos,
               row_number() OVER (PARTITION BY shard_id ORDER BY priority, pos) AS priority,
               concat('.shard-', shard_id, '/state/', story_id, ' | docs/', story_id) AS modifies
        FROM v_stories)"""


def _rebased(i: Inputs) -> DataFrame:
    paths = F.array(F.concat(F.lit(".baseline/state/"), F.col("story_id")), F.concat(F.lit("docs/"), F.col("story_id")))
    stories = i.stories.select("story_id", "pos", "priority", paths.alias("modifies"))
    return T.rebase_stories(stories, i.batches.select("story_id", "shard_id"))


@query("rebase_stories", f"""
    WITH {REBASED_SQL}
    SELECT shard_id, story_id, priority, false AS passes, CAST(0 AS BIGINT) AS attempts, modifies FROM rebased""")
def rebase_stories(i: Inputs) -> DataFrame:
    return _rebased(i).select("shard_id", "story_id", "priority", "passes", "attempts",
                              F.array_join("modifies", " | ").alias("modifies"))


@query("story_headers", """
    SELECT shard_id, concat('demo-shard-', shard_id) AS project, 'main' AS branch,
           concat('docs · shard ', shard_id, ' (', printf('BATCH-%03d', min(batch_idx)), '..', printf('BATCH-%03d', max(batch_idx)), ')') AS description
    FROM v_batches GROUP BY shard_id""")
def story_headers(i: Inputs) -> DataFrame:
    return T.story_headers(S.shard_headers(i.batches), "demo", "main", "docs")


@query("refresh_stories", f"""
    WITH {REBASED_SQL}
    SELECT r.shard_id, r.story_id, r.priority, coalesce(s.passes, false) AS passes, coalesce(s.attempts, 0) AS attempts
    FROM rebased r LEFT JOIN (SELECT * FROM v_stories WHERE passes OR attempts > 2) s
      ON s.shard_id = r.shard_id AND s.story_id = r.story_id""")
def refresh_stories(i: Inputs) -> DataFrame:
    known = i.stories.where("passes OR attempts > 2")
    return T.refresh_stories(_rebased(i), known).select("shard_id", "story_id", "priority", "passes", "attempts")


@query("check_plan", """
    WITH h AS (SELECT count(*) AS n_batches, CAST(sum(n_tasks) AS BIGINT) AS total_tasks FROM v_batches),
         d AS (SELECT count(DISTINCT md5(text)) AS total_tasks FROM documents)
    SELECT 'plan' AS layer, 'n_batches positive' AS subject, h.n_batches > 0 AS passed,
           CAST(h.n_batches <= 0 AS BIGINT) AS n_bad, printf('n_batches=%d', h.n_batches) AS detail FROM h
    UNION ALL SELECT 'plan', 'total_tasks positive', d.total_tasks > 0, CAST(d.total_tasks <= 0 AS BIGINT),
                     printf('total_tasks=%d', d.total_tasks) FROM d
    UNION ALL SELECT 'plan', 'n_batches matches batch rows', true, 0,
                     printf('declared %d, rows %d', h.n_batches, h.n_batches) FROM h
    UNION ALL SELECT 'plan', 'shard totals add up', d.total_tasks = h.total_tasks, CAST(d.total_tasks <> h.total_tasks AS BIGINT),
                     printf('baseline %d, shards %d', d.total_tasks, h.total_tasks) FROM h, d""")
def check_plan(i: Inputs) -> DataFrame:
    """The baseline header counts distinct texts, so copies break conservation."""
    n_texts = i.tasks.agg(F.count_distinct(F.md5("text"))).first()[0]
    header = i.batches.agg(F.count(F.lit(1)).alias("n_batches")).withColumn("total_tasks", F.lit(n_texts))
    return S.check_plan(header, i.batches, S.shard_headers(i.batches)).drop("example")


@query("render_template", """
    SELECT t.task_id, length(p) AS n, md5(p) AS prompt_md5 FROM (
        SELECT b.task_id, replace(replace(replace(replace('Task {{ID}} of {{BATCH}} ({{LANG}}): {{TEXT}} {{OTHER}}',
               '{{ID}}', CAST(b.task_id AS VARCHAR)), '{{BATCH}}', printf('BATCH-%03d', b.batch_idx)), '{{LANG}}', t.lang),
               '{{TEXT}}', t.text) AS p
        FROM v_batch_tasks b JOIN v_tasks t ON t.task_id = b.task_id) t""")
def render_template(i: Inputs) -> DataFrame:
    rows = i.members.select("task_id", "batch_idx").join(i.tasks, "task_id")
    filled = B.render_template(
        rows, "Task {{ID}} of {{BATCH}} ({{LANG}}): {{TEXT}} {{OTHER}}",
        {"ID": "task_id", "BATCH": B.batch_label(F.col("batch_idx")), "LANG": "lang", "TEXT": "text"})
    return filled.select("task_id", F.length("prompt").cast("bigint").alias("n"), F.md5("prompt").alias("prompt_md5"))


@query("shard_prompts", """
    SELECT shard_id, concat('# ', shard_id, ' .shard-', shard_id, ' ', printf('BATCH-%03d', min(batch_idx)), '..',
           printf('BATCH-%03d', max(batch_idx)), ' ', CAST(count(*) AS VARCHAR), ' batches ',
           CAST(CAST(sum(n_tasks) AS BIGINT) AS VARCHAR), ' tasks until ', CAST(count(*) AS VARCHAR)) AS prompt
    FROM v_batches GROUP BY shard_id""")
def shard_prompts(i: Inputs) -> DataFrame:
    heads = S.shard_manifest(i.batches)[0]
    text = "# {{SHARD_ID}} {{SHARD_ROOT}} {{BATCH_RANGE}} {{N_BATCHES}} batches {{N_TASKS}} tasks until {{COMPLETE_THRESHOLD}}"
    return B.render_template(heads, text, B.shard_prompt_columns(F.col("shard_root"))).select("shard_id", "prompt")


# ---- Rebalance: five stopped sources drain into three others ----------------

DRAIN_SQL = """
    drained AS (
        SELECT m.shard_id, m.task_id, m.batch_idx, m.pos FROM v_members_dirty m
        WHERE m.shard_id IN ('src0', 'src1', 'src2', 'src3', 'src4')
          AND NOT EXISTS (SELECT 1 FROM labels l JOIN documents d ON d.doc_id = l.doc_id
                          WHERE d.source = m.shard_id AND md5(d.text) = m.task_id))"""
POOL_SQL = DRAIN_SQL + """,
    pooled AS (
        SELECT * FROM (
            SELECT task_id, CAST(substr(shard_id, 4) AS BIGINT) + 1 AS shard_rank, batch_idx, pos, shard_id,
                   row_number() OVER (PARTITION BY task_id ORDER BY CAST(substr(shard_id, 4) AS BIGINT), batch_idx, pos) AS rn
            FROM drained) WHERE rn = 1)"""
PLAN_SQL = POOL_SQL + """,
    numbered AS (
        SELECT task_id, shard_id, row_number() OVER (ORDER BY shard_rank, batch_idx, pos) AS pool_pos FROM pooled),
    plan AS (
        SELECT *, (pool_pos - 1) // 50 AS slice,
               CASE ((pool_pos - 1) // 50) % 3 WHEN 0 THEN 'src7' WHEN 1 THEN 'src8' ELSE 'src9' END AS target,
               ((pool_pos - 1) // 50) // 3 AS ordinal
        FROM numbered),
    existing AS (SELECT DISTINCT shard_id, batch_idx FROM v_members_dirty),
    added AS (
        SELECT p.target AS shard_id, p.slice + 1 + (SELECT max(batch_idx) FROM existing) AS batch_idx, count(*) AS n_tasks
        FROM plan p GROUP BY p.target, p.slice)"""


def _drained(i: Inputs) -> DataFrame:
    seen = i.submissions.select("shard_id", "task_id")
    return R.drain(i.members_dirty, seen, STOPPED)


def _plan(i: Inputs) -> DataFrame:
    return R.rebatch(R.pool(_drained(i), STOPPED), TARGETS)


def _existing(i: Inputs) -> DataFrame:
    return i.members_dirty.select("shard_id", "batch_idx").distinct()


@query("drain", f"WITH {DRAIN_SQL} SELECT shard_id, task_id, batch_idx, pos FROM drained")
def drain(i: Inputs) -> DataFrame:
    return _drained(i)


@query("drain_counts", f"WITH {DRAIN_SQL} SELECT shard_id, count(*) AS n_drained FROM drained GROUP BY shard_id")
def drain_counts(i: Inputs) -> DataFrame:
    return R.drain_counts(_drained(i))


@query("pool", f"WITH {POOL_SQL} SELECT task_id, shard_rank, batch_idx, pos, shard_id FROM pooled")
def pool(i: Inputs) -> DataFrame:
    return R.pool(_drained(i), STOPPED).withColumn("shard_rank", F.col("shard_rank").cast("bigint"))


@query("rebatch", f"WITH {PLAN_SQL} SELECT task_id, pool_pos, slice, target, ordinal FROM plan")
def rebatch(i: Inputs) -> DataFrame:
    return _plan(i).select("task_id", "pool_pos", "slice", "target", "ordinal")


@query("next_ids", f"""
    WITH {PLAN_SQL}
    SELECT p.task_id, p.target, CAST(p.slice + 1 + (SELECT max(batch_idx) FROM existing) AS BIGINT) AS new_batch_idx FROM plan p""")
def next_ids(i: Inputs) -> DataFrame:
    return R.next_ids(_plan(i), _existing(i)).select("task_id", "target", "new_batch_idx")


@query("next_ids_per_target", f"""
    WITH {PLAN_SQL}
    SELECT p.task_id, p.target, e.top + 1 + p.ordinal AS new_batch_idx
    FROM plan p JOIN (SELECT shard_id, max(batch_idx) AS top FROM existing GROUP BY shard_id) e ON e.shard_id = p.target""")
def next_ids_per_target(i: Inputs) -> DataFrame:
    return R.next_ids(_plan(i), _existing(i), "target").select("task_id", "target", "new_batch_idx")


def _appended(i: Inputs) -> dict[str, DataFrame]:
    plan = R.next_ids(_plan(i), _existing(i))
    batches = i.members_dirty.groupBy("shard_id", "batch_idx").agg(F.count(F.lit(1)).alias("n_tasks")).withColumn(
        "story_id", B.batch_label(F.col("batch_idx")))
    stories = batches.select("shard_id", "story_id", "batch_idx", F.col("batch_idx").alias("pos"),
                             (F.col("batch_idx") % 7).alias("priority"), F.lit(True).alias("passes"),
                             F.lit(1).cast("bigint").alias("attempts"))
    return R.append_plan(batches, stories, plan)


@query("append_plan_totals", f"""
    WITH {PLAN_SQL},
    grown AS (SELECT shard_id, batch_idx, count(*) AS n_tasks FROM v_members_dirty GROUP BY shard_id, batch_idx
              UNION ALL SELECT * FROM added)
    SELECT shard_id, count(*) AS n_batches, CAST(sum(n_tasks) AS BIGINT) AS total_tasks FROM grown GROUP BY shard_id""")
def append_plan_totals(i: Inputs) -> DataFrame:
    return _appended(i)["totals"]


@query("append_plan_stories", f"""
    WITH {PLAN_SQL},
    tops AS (SELECT shard_id, max(batch_idx % 7) AS top, max(batch_idx) AS last FROM existing GROUP BY shard_id)
    SELECT shard_id, printf('BATCH-%03d', batch_idx) AS story_id, batch_idx AS pos, batch_idx % 7 AS priority,
           true AS passes, CAST(1 AS BIGINT) AS attempts, NULL AS title, NULL AS timeout_text FROM existing
    UNION ALL
    SELECT a.shard_id, printf('BATCH-%03d', a.batch_idx), t.last + row_number() OVER w, t.top + row_number() OVER w,
           false, 0, concat(printf('BATCH-%03d', a.batch_idx), ': ', CAST(a.n_tasks AS VARCHAR), ' moved tasks'), '2400'
    FROM added a JOIN tops t ON t.shard_id = a.shard_id WINDOW w AS (PARTITION BY a.shard_id ORDER BY a.batch_idx)""")
def append_plan_stories(i: Inputs) -> DataFrame:
    return _appended(i)["stories"].select(
        "shard_id", "story_id", "pos", "priority", "passes", "attempts", "title", "timeout_text")


@query("append_plan_log", f"""
    WITH {PLAN_SQL}
    SELECT shard_id, min(batch_idx) AS first_batch, max(batch_idx) AS last_batch, count(*) AS added_batches,
           CAST(sum(n_tasks) AS BIGINT) AS added_tasks FROM added GROUP BY shard_id""")
def append_plan_log(i: Inputs) -> DataFrame:
    """Without the time stamp, which no oracle can know."""
    return _appended(i)["log"].drop("ts")


@query("reassign", f"""
    WITH {PLAN_SQL}
    SELECT m.task_id, m.shard_id, m.batch_idx, m.pos, CAST(0 AS BIGINT) AS generation, NOT EXISTS (
        SELECT 1 FROM drained d WHERE d.shard_id = m.shard_id AND d.task_id = m.task_id) AS active FROM v_members_dirty m
    UNION ALL
    SELECT task_id, target, CAST(slice + 1 + (SELECT max(batch_idx) FROM existing) AS BIGINT), pool_pos, 1, true FROM plan""")
def reassign(i: Inputs) -> DataFrame:
    """Drained memberships close, planned ones open as generation 1."""
    plan = R.next_ids(_plan(i), _existing(i))
    return R.reassign(R.first_assignments(i.members_dirty), _drained(i), plan, 1)


@query("check_rebalance", """
    WITH left_over AS (
        SELECT m.task_id, row_number() OVER (ORDER BY m.batch_idx, m.pos) AS n FROM v_members m
        WHERE m.shard_id IN ('c', 'd') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.task_id)),
    slices AS (SELECT DISTINCT (n - 1) // 50 AS slice FROM left_over),
    mine AS (SELECT CASE slice % 2 WHEN 0 THEN 'a' ELSE 'b' END AS shard_id, slice // 2 AS ordinal FROM slices),
    numbered AS (SELECT m.shard_id, (SELECT max(batch_idx) FROM v_batches b WHERE b.shard_id = m.shard_id) + 1 + ordinal AS batch_idx
                 FROM mine m)
    SELECT batch_idx, shard_id FROM numbered n WHERE EXISTS (SELECT 1 FROM v_batches b WHERE b.batch_idx = n.batch_idx)""")
def check_rebalance(i: Inputs) -> DataFrame:
    """Shards c and d drain into a and b: numbers given per target that another shard already owns."""
    R.check_rebalance(["c", "d"], ["a", "b"])
    drained = R.drain(i.members, i.verdicts, ["c", "d"])
    plan = R.next_ids(R.rebatch(R.pool(drained, ["c", "d"]), ["a", "b"]), i.batches, "target")
    return R.collisions(R.new_batches(plan), i.batches).select("batch_idx", "shard_id")
