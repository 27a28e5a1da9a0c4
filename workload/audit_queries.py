"""Set audits (A1-A8) and merge queries (M1-M7)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.cluster import scratch_path
from labelloom.model import AuditError, VerdictSchema
from labelloom.operators import audit as A
from labelloom.operators import merge as M
from labelloom.plans.shards import auto_split
from labelloom.sources import files as S
from labelloom.sources import versions as W
from workload.inputs import SCHEMA, VERSION, Inputs
from workload.registry import query


def _declared(i: Inputs) -> DataFrame:
    return i.table("documents").groupBy(F.col("source").alias("shard_id")).agg(F.count(F.lit(1)).alias("total_tasks"))


COUNTS_SQL = """
    SELECT source AS shard_id, count(DISTINCT md5(text)) AS actual, count(*) AS declared,
           count(DISTINCT md5(text)) = count(*) AS passed
    FROM documents GROUP BY source"""

DUPS_SQL = """
    WITH per AS (SELECT shard_id, task_id, count(*) AS n FROM v_members_dirty GROUP BY shard_id, task_id HAVING count(*) > 1),
         ranked AS (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY task_id) AS rn FROM per)
    SELECT shard_id, CAST(sum(n - 1) AS BIGINT) AS n_dups,
           string_agg(task_id, ',' ORDER BY task_id) FILTER (WHERE rn <= 3) AS examples
    FROM ranked GROUP BY shard_id"""

PAIRS_SQL = """
    WITH m AS (SELECT DISTINCT shard_id, task_id FROM v_members_dirty),
         shared AS (SELECT a.shard_id AS shard_a, b.shard_id AS shard_b, count(*) AS n, min(a.task_id) AS example
                    FROM m a JOIN m b ON a.task_id = b.task_id AND a.shard_id < b.shard_id GROUP BY a.shard_id, b.shard_id),
         names AS (SELECT DISTINCT shard_id FROM m)
    SELECT x.shard_id AS shard_a, y.shard_id AS shard_b, coalesce(s.n, 0) AS n_shared, s.example, s.n IS NULL AS passed
    FROM names x JOIN names y ON x.shard_id < y.shard_id
    LEFT JOIN shared s ON s.shard_a = x.shard_id AND s.shard_b = y.shard_id"""


@query("audit_counts", COUNTS_SQL)
def audit_counts(i: Inputs) -> DataFrame:
    return A.audit_counts(i.members_dirty, _declared(i))


@query("audit_internal_dups", DUPS_SQL)
def audit_internal_dups(i: Inputs) -> DataFrame:
    return A.audit_internal_dups(i.members_dirty)


@query("audit_disjoint", PAIRS_SQL)
def audit_disjoint(i: Inputs) -> DataFrame:
    return A.audit_disjoint(i.members_dirty, every=True)


@query("audit_disjoint_many_shards", """
    WITH m AS (SELECT DISTINCT o_custkey AS shard_id, o_orderdate AS task_id FROM orders)
    SELECT x.shard_id AS shard_a, y.shard_id AS shard_b, count(*) AS n_shared, CAST(CAST(min(x.task_id) AS DATE) AS VARCHAR) AS example,
           false AS passed
    FROM m x JOIN m y ON x.task_id = y.task_id AND x.shard_id < y.shard_id GROUP BY ALL""")
def audit_disjoint_many_shards(i: Inputs) -> DataFrame:
    """One shard per customer: any number of shards takes the same way."""
    days = i.table("orders").select(F.col("o_custkey").alias("shard_id"), F.to_date("o_orderdate").alias("task_id"))
    return A.audit_disjoint(days)


COVER_SQL = """
    WITH l AS (SELECT DISTINCT task_id AS k FROM v_submissions),
         r AS (SELECT DISTINCT md5(text) AS k FROM documents WHERE lang = 'en'),
         s AS (SELECT coalesce(l.k, r.k) AS k, l.k IS NOT NULL AS in_l, r.k IS NOT NULL AS in_r FROM l FULL JOIN r ON l.k = r.k)"""


def _english(i: Inputs) -> DataFrame:
    return i.tasks.where("lang = 'en'").select(F.md5("text").alias("task_id"))


@query("audit_coverage", f"""
    {COVER_SQL}
    SELECT count(*) FILTER (WHERE NOT in_l) AS n_missing, count(*) FILTER (WHERE NOT in_r) AS n_extra,
           min(k) FILTER (WHERE NOT in_l) AS missing_example, min(k) FILTER (WHERE NOT in_r) AS extra_example,
           bool_and(in_l AND in_r) AS passed FROM s""")
def audit_coverage(i: Inputs) -> DataFrame:
    """Labelled texts against the English texts: ids missing on both sides."""
    return A.audit_coverage(i.submissions, _english(i))


@query("uncovered", f"""
    {COVER_SQL}
    SELECT k AS task_id, CASE WHEN in_r THEN 'missing' ELSE 'extra' END AS problem FROM s WHERE NOT (in_l AND in_r)""")
def uncovered(i: Inputs) -> DataFrame:
    return A.uncovered(i.submissions, _english(i))


@query("audit_batch_content", """
    WITH p AS (
        SELECT b.batch_idx, d.doc_id, d.text,
               CASE WHEN l.quality = 0 AND l.toxic = 1 THEN concat(d.text, '!') ELSE d.text END AS changed
        FROM documents d JOIN v_batch_tasks b ON b.task_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)
    SELECT batch_idx, count(*) AS shard_rows, count(*) AS baseline_rows,
           CASE WHEN bool_and(text = changed) THEN 'same' ELSE 'different' END AS status, bool_and(text = changed) AS passed
    FROM p GROUP BY batch_idx""")
def audit_batch_content(i: Inputs) -> DataFrame:
    """A copy of the batches in which the texts of toxic low-quality rows were changed."""
    base = i.members.select("batch_idx", "task_id").join(i.tasks.select("task_id", "text"), "task_id")
    labels = i.table("labels").select(F.col("doc_id").alias("task_id"), "quality", "toxic")
    hit = (F.col("quality") == 0) & (F.col("toxic") == 1)
    copy = base.join(labels, "task_id", "left").select(
        "batch_idx", "task_id", F.when(hit, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return A.audit_batch_content(copy, base, ["task_id", "text"])


STORY_SIDES_SQL = """
    three AS (SELECT story_id, chr(CAST(97 + least((batch_idx - 1) // ((SELECT count(*) FROM v_batches) // 3), 2) AS INT)) AS shard_id
              FROM v_batches),
    sides AS (SELECT coalesce(s.shard_id, t.shard_id) AS shard_id, coalesce(s.story_id, t.story_id) AS story_id,
                     s.story_id IS NOT NULL AS in_stories, t.story_id IS NOT NULL AS in_manifest
              FROM v_stories s FULL JOIN three t ON t.shard_id = s.shard_id AND t.story_id = s.story_id),
    moved AS (SELECT shard_id, story_id, CASE WHEN in_stories THEN 'not in manifest' ELSE 'not in stories' END AS problem
              FROM sides WHERE NOT (in_stories AND in_manifest))"""


def _three_way(i: Inputs) -> DataFrame:
    return auto_split(i.batches.select("batch_idx", "story_id", "n_tasks"), 3)


@query("audit_story_manifest", f"WITH {STORY_SIDES_SQL} SELECT shard_id, story_id, problem FROM moved")
def audit_story_manifest(i: Inputs) -> DataFrame:
    """Stories of a four-way plan against the batch lists of a three-way plan."""
    return A.audit_story_manifest(i.stories, _three_way(i))


@query("audit_baseline", """
    SELECT count(DISTINCT md5(text)) AS actual, count(*) AS declared, count(DISTINCT md5(text)) = count(*) AS passed
    FROM documents""")
def audit_baseline(i: Inputs) -> DataFrame:
    total = i.tasks.count()
    return A.audit_baseline(i.tasks.select(F.md5("text").alias("task_id")), total)


@query("audit_all", f"""
    WITH counts AS ({COUNTS_SQL}),
    per AS (SELECT shard_id, task_id, count(*) AS n FROM v_members_dirty GROUP BY shard_id, task_id HAVING count(*) > 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY task_id) AS rn FROM per),
    m AS (SELECT DISTINCT shard_id, task_id FROM v_members_dirty),
    shared AS (SELECT a.shard_id AS shard_a, b.shard_id AS shard_b, count(*) AS n, min(a.task_id) AS example
               FROM m a JOIN m b ON a.task_id = b.task_id AND a.shard_id < b.shard_id GROUP BY a.shard_id, b.shard_id),
    names AS (SELECT DISTINCT shard_id FROM m),
    tops AS (SELECT count(DISTINCT md5(text)) AS ids, count(*) AS rows FROM documents),
    {STORY_SIDES_SQL}
    SELECT '0 baseline' AS layer, 'baseline' AS subject, ids = rows AS passed, CAST(ids <> rows AS BIGINT) AS n_bad,
           CAST(NULL AS VARCHAR) AS example FROM tops
    UNION ALL SELECT '1 count', shard_id, passed, abs(actual - declared), NULL FROM counts
    UNION ALL SELECT '1 repeats', shard_id, false, CAST(sum(n - 1) AS BIGINT),
                     string_agg(task_id, ',' ORDER BY task_id) FILTER (WHERE rn <= 3) FROM ranked GROUP BY shard_id
    UNION ALL SELECT '2 disjoint', concat(x.shard_id, '/', y.shard_id), s.n IS NULL, coalesce(s.n, 0), s.example
              FROM names x JOIN names y ON x.shard_id < y.shard_id
              LEFT JOIN shared s ON s.shard_a = x.shard_id AND s.shard_b = y.shard_id
    UNION ALL SELECT '3 coverage', 'union', true, 0, NULL
    UNION ALL SELECT '4 content', 'batches', true, 0, NULL
    UNION ALL SELECT '5 stories', 'stories and batches', count(*) = 0, count(*), min(concat(shard_id, '/', story_id)) FROM moved""")
def audit_all(i: Inputs) -> DataFrame:
    dirty = i.members_dirty
    report = A.audit_all(
        dirty, dirty, _declared(i), i.stories, _three_way(i), shard_rows=dirty, baseline_rows=dirty,
        total=i.tasks.count(), every_pair=True)
    return report.drop("detail")


# ---- Merge -----------------------------------------------------------------


def _declared_members(i: Inputs) -> DataFrame:
    return i.members.groupBy("shard_id").agg(F.count(F.lit(1)).alias("total_tasks"))


@query("merge_counts", """
    SELECT m.shard_id, coalesce(v.n, 0) AS actual, m.n AS declared, coalesce(v.n, 0) = m.n AS passed
    FROM (SELECT shard_id, count(*) AS n FROM v_members GROUP BY shard_id) m
    LEFT JOIN (SELECT shard_id, count(*) AS n FROM v_verdicts_dirty GROUP BY shard_id) v ON v.shard_id = m.shard_id""")
def merge_counts(i: Inputs) -> DataFrame:
    return M.merge_counts(M.union_shards([i.verdicts, i.relabels]), _declared_members(i))


@query("dup_report", """
    WITH per AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_surplus, count(*) FILTER (WHERE n > 1) AS n_keys,
           (SELECT string_agg(k, ',' ORDER BY l_orderkey, l_linenumber) FROM (
                SELECT l_orderkey, l_linenumber, concat(l_orderkey, '/', l_linenumber) AS k FROM per WHERE n > 1
                ORDER BY l_orderkey, l_linenumber LIMIT 3)) AS examples
    FROM per""")
def dup_report(i: Inputs) -> DataFrame:
    return M.dup_report(i.table("lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("alignment", """
    WITH s AS (SELECT t.task_id, v.task_id IS NOT NULL AS seen FROM v_tasks t
               LEFT JOIN (SELECT DISTINCT task_id FROM v_verdicts_dirty) v ON v.task_id = t.task_id)
    SELECT count(*) FILTER (WHERE NOT seen) AS n_missing, CAST(0 AS BIGINT) AS n_extra,
           CAST(min(task_id) FILTER (WHERE NOT seen) AS VARCHAR) AS missing_example, CAST(NULL AS VARCHAR) AS extra_example,
           bool_and(seen) AS passed FROM s""")
def alignment(i: Inputs) -> DataFrame:
    return M.alignment(i.verdicts_dirty, i.task_ids)


ERRORS_SQL = """
    errors AS (
        SELECT task_id, seq, e FROM (
            SELECT task_id, seq, CASE WHEN qa IS NULL OR reason IS NULL OR schema_version IS NULL OR task_id IS NULL
                THEN [concat('missing ', concat_ws(',', CASE WHEN qa IS NULL THEN 'qa' END, CASE WHEN reason IS NULL THEN 'reason' END,
                      CASE WHEN schema_version IS NULL THEN 'schema_version' END, CASE WHEN task_id IS NULL THEN 'task_id' END))]
                ELSE list_filter([CASE WHEN schema_version <> 'v1' THEN 'schema_version' END,
                                  CASE WHEN qa NOT IN ('yes', 'no') THEN 'qa' END,
                                  CASE WHEN length(reason) < 150 THEN 'reason length' END], lambda x: x IS NOT NULL) END AS e
            FROM picked))"""


@query("sample_audit", f"""
    WITH picked AS (SELECT * FROM v_submissions ORDER BY md5(concat('42|', task_id)), seq LIMIT 50), {ERRORS_SQL}
    SELECT task_id, unnest(e) AS error FROM errors""")
def sample_audit(i: Inputs) -> DataFrame:
    """The sample of 50 is the operator; ties between equal ids go by ``seq``."""
    return M.sample_audit(i.submissions, SCHEMA, VERSION, tie_cols=["seq"])


@query("sample_audit_full", f"""
    WITH picked AS (SELECT * FROM v_submissions), {ERRORS_SQL}
    SELECT task_id, unnest(e) AS error FROM errors""")
def sample_audit_full(i: Inputs) -> DataFrame:
    return M.sample_audit(i.submissions, SCHEMA, VERSION, n=None)


MERGED_SQL = """
    merged AS (
        SELECT m.batch_idx, m.pos, v.* FROM v_members m JOIN (
            SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS rn FROM v_verdicts_dirty) v
        ON v.task_id = m.task_id AND v.rn = 1)"""


@query("ordered_merge", f"""
    WITH {MERGED_SQL}
    SELECT task_id, batch_idx, pos, shard_id, qa, schema_version, md5(reason) AS reason_md5, seq FROM merged""")
def ordered_merge(i: Inputs) -> DataFrame:
    merged = M.ordered_merge(i.verdicts_dirty, i.members, ["seq"])
    return merged.select("task_id", "batch_idx", "pos", "shard_id", "qa", "schema_version", F.md5("reason").alias("reason_md5"), "seq")


@query("combine", """
    SELECT 0 AS src_rank, CAST(0 AS BIGINT) AS batch_idx, seq AS pos, task_id, schema_version FROM v_verdicts WHERE schema_version = 'v0'
    UNION ALL
    SELECT 1, m.batch_idx, m.pos, v.task_id, v.schema_version FROM v_members m
    JOIN v_verdicts_dirty v ON v.task_id = m.task_id WHERE v.schema_version = 'v1'""")
def combine(i: Inputs) -> DataFrame:
    """Old-version verdicts as the earlier partial set in front of the new ones."""
    prefix = i.verdicts.where("schema_version = 'v0'")
    merged = M.ordered_merge(i.verdicts_dirty.where("schema_version = 'v1'"), i.members)
    return M.combine(prefix, merged, "seq").select("src_rank", "batch_idx", "pos", "task_id", "schema_version")


@query("merge_report", """
    WITH declared AS (SELECT shard_id, count(*) AS n FROM v_members GROUP BY shard_id),
    got AS (SELECT shard_id, count(*) AS n FROM v_verdicts_dirty GROUP BY shard_id),
    per AS (SELECT task_id, count(*) AS n FROM v_verdicts_dirty GROUP BY task_id),
    picked AS (SELECT * FROM v_verdicts_dirty),""" + ERRORS_SQL + """
    SELECT '2 shard count' AS layer, d.shard_id AS subject, coalesce(g.n, 0) = d.n AS passed, abs(coalesce(g.n, 0) - d.n) AS n_bad,
           CAST(NULL AS VARCHAR) AS example FROM declared d LEFT JOIN got g ON g.shard_id = d.shard_id
    UNION ALL SELECT '3a total', 'rows', sum(n) = (SELECT count(*) FROM documents),
                     CAST(abs(sum(n) - (SELECT count(*) FROM documents)) AS BIGINT), NULL FROM per
    UNION ALL SELECT '3b unique', 'ids', sum(n - 1) = 0, CAST(sum(n - 1) AS BIGINT),
                     coalesce((SELECT string_agg(CAST(task_id AS VARCHAR), ',' ORDER BY task_id) FROM (
                         SELECT task_id FROM per WHERE n > 1 ORDER BY task_id LIMIT 3)), '') FROM per
    UNION ALL SELECT '4 alignment', 'ids', count(*) = 0, count(*), CAST(min(task_id) AS VARCHAR)
              FROM v_tasks t WHERE NOT EXISTS (SELECT 1 FROM per WHERE per.task_id = t.task_id)
    UNION ALL SELECT '5 sample', 'schema', count(*) = 0, count(*), min(concat(task_id, ': ', x)) FROM (
                     SELECT task_id, unnest(e) AS x FROM errors)""")
def merge_report(i: Inputs) -> DataFrame:
    """The full scan stands in for the sample, so that the report is complete."""
    return M.merge_report(i.verdicts_dirty, i.task_ids, _declared_members(i), SCHEMA, VERSION,
                          total=i.tasks.count(), n=None).drop("detail")


@query("merge_publish", """
    SELECT m.pos, v.task_id, v.qa, v.schema_version, length(v.reason) AS n FROM v_members m
    JOIN v_verdicts_dirty v ON v.task_id = m.task_id WHERE v.schema_version = 'v1'""")
def merge_publish(i: Inputs) -> DataFrame:
    """A clean set (every labelled task once, one version) passes all layers and is written."""
    clean = i.verdicts_dirty.where("schema_version = 'v1'")
    labelled = i.members.join(i.table("labels").select(F.col("doc_id").alias("task_id")), "task_id", "left_semi")
    declared = labelled.groupBy("shard_id").agg(F.count(F.lit(1)).alias("total_tasks"))
    rules = VerdictSchema(valid_qa=("yes", "no"), min_reason_chars=1)
    out = scratch_path(i.spark, "published")
    path = M.merge_publish(clean, labelled, declared, rules, VERSION, out, total=i.table("labels").count(),
                           day=date(2024, 1, 2), fmt="parquet", keep_order=True)[0]
    rows = i.spark.read.parquet(path)
    return rows.select("pos", "task_id", "qa", "schema_version", F.length("reason").cast("bigint").alias("n"))


@query("merge_publish_lines", """
    SELECT row_number() OVER (ORDER BY m.pos) AS line_no, CAST(v.task_id AS VARCHAR) AS task_id, concat('n', v.task_id) AS note,
           length(v.reason) AS n
    FROM v_verdicts_dirty v JOIN v_members m ON m.task_id = v.task_id WHERE v.schema_version = 'v1'""")
def merge_publish_lines(i: Inputs) -> DataFrame:
    """Verdict files with a field no schema names: the published lines still have it."""
    source, out = scratch_path(i.spark, "lines"), scratch_path(i.spark, "published")
    clean = i.verdicts_dirty.where("schema_version = 'v1'").select(
        F.col("task_id").cast("string").alias("task_id"), "qa", "reason", "schema_version", "shard_id",
        F.concat(F.lit("n"), F.col("task_id").cast("string")).alias("note"))
    clean.write.json(source)
    rules = VerdictSchema(valid_qa=("yes", "no"), min_reason_chars=1)
    verdicts, _ = S.read_verdicts(i.spark, source, rules, [T.StructField("shard_id", T.StringType())], keep_line=True)
    labelled = i.members.join(i.table("labels").select(F.col("doc_id").alias("task_id")), "task_id", "left_semi")
    named = labelled.withColumn("task_id", F.col("task_id").cast("string"))
    declared = labelled.groupBy("shard_id").agg(F.count(F.lit(1)).alias("total_tasks"))
    path = M.merge_publish(verdicts, named, declared, rules, VERSION, out, line_field="line", day=date(2024, 1, 2))[0]
    numbered = S.number_all(S.read_lines(i.spark, path))
    return numbered.select("line_no", F.from_json("line", "task_id string, note string, reason string").alias("r")).select(
        "line_no", "r.task_id", "r.note", F.length("r.reason").cast("bigint").alias("n"))


@query("merge_commit", """
    SELECT row_number() OVER (ORDER BY m.pos) AS line_no, v.task_id, v.qa, length(v.reason) AS n, CAST(1 AS BIGINT) AS version
    FROM v_members m JOIN v_verdicts_dirty v ON v.task_id = m.task_id WHERE v.schema_version = 'v1'""")
def merge_commit(i: Inputs) -> DataFrame:
    """A clean set becomes the first version, one with repeats is refused and changes nothing."""
    clean, root = i.verdicts_dirty.where("schema_version = 'v1'"), scratch_path(i.spark, "merged")
    labelled = i.members.join(i.table("labels").select(F.col("doc_id").alias("task_id")), "task_id", "left_semi")
    declared = labelled.groupBy("shard_id").agg(F.count(F.lit(1)).alias("total_tasks"))
    rules = VerdictSchema(valid_qa=("yes", "no"), min_reason_chars=1)
    M.merge_commit(clean, labelled, declared, rules, VERSION, root, n_files=4)
    try:
        M.merge_commit(i.verdicts_dirty, labelled, declared, rules, VERSION, root)
    except AuditError:
        pass
    numbered = S.number_all(S.read_lines(i.spark, W.table_path(i.spark, root, "merged")))
    row = F.from_json("line", "task_id bigint, qa string, reason string")
    version = F.lit(W.current(i.spark, root)["number"]).cast("bigint")
    return numbered.select("line_no", row.alias("r")).select(
        "line_no", "r.task_id", "r.qa", F.length("r.reason").cast("bigint").alias("n"), version.alias("version"))
