"""The input views in SQL, as one ``WITH`` chain for the oracle engine.

The single-task windows here serve the oracle only.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "v_tasks": """
        SELECT doc_id AS task_id, text, lang, source,
               CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS pos
        FROM documents""",
    "v_batch_tasks": """
        SELECT task_id, pos, CAST((pos - 1) // 50 + 1 AS BIGINT) AS batch_idx FROM v_tasks""",
    "v_batches": """
        SELECT b.batch_idx, printf('BATCH-%03d', b.batch_idx) AS story_id, b.n_tasks,
               chr(CAST(97 + least((b.batch_idx - 1) // (t.n // 4), 3) AS INT)) AS shard_id
        FROM (SELECT batch_idx, count(*) AS n_tasks FROM v_batch_tasks GROUP BY batch_idx) b
        CROSS JOIN (SELECT count(DISTINCT batch_idx) AS n FROM v_batch_tasks) t""",
    "v_members": """
        SELECT b.shard_id, bt.batch_idx, bt.task_id, bt.pos
        FROM v_batch_tasks bt JOIN v_batches b ON bt.batch_idx = b.batch_idx""",
    "v_members_dirty": """
        SELECT d.source AS shard_id, md5(d.text) AS task_id, b.batch_idx, b.pos
        FROM documents d JOIN v_batch_tasks b ON b.task_id = d.doc_id""",
    "v_verdicts": """
        SELECT m.shard_id, m.task_id, CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS qa,
               d.text AS reason, CASE WHEN l.toxic = 1 THEN 'v0' ELSE 'v1' END AS schema_version, m.pos AS seq
        FROM labels l JOIN v_members m ON l.doc_id = m.task_id JOIN documents d ON d.doc_id = l.doc_id""",
    "v_relabels": """
        SELECT shard_id, task_id, 'no' AS qa, reason, 'v1' AS schema_version, seq + 1000000000 AS seq
        FROM v_verdicts WHERE schema_version = 'v0'""",
    "v_verdicts_dirty": "SELECT * FROM v_verdicts UNION ALL SELECT * FROM v_relabels",
    "v_submissions": """
        SELECT d.source AS shard_id, md5(d.text) AS task_id,
               CASE WHEN l.quality = 1 THEN 'yes' WHEN d.lang = 'en' THEN 'no' WHEN d.lang = 'fr' THEN 'maybe' END AS qa,
               d.text AS reason, CASE WHEN l.toxic = 1 THEN 'v0' ELSE 'v1' END AS schema_version, l.doc_id AS seq
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "v_seen": "SELECT DISTINCT shard_id, task_id FROM v_verdicts",
    "v_stories": """
        SELECT shard_id, batch_idx AS pos, batch_idx, story_id, n_tasks, (batch_idx * 7) % 11 AS priority,
               (batch_idx % 3 = 0) AS passes, batch_idx % 5 AS attempts,
               CASE batch_idx % 4 WHEN 1 THEN '1200' WHEN 2 THEN '-5' WHEN 3 THEN 'abc' END AS timeout_text
        FROM v_batches""",
    "v_log": """
        SELECT chr(CAST(97 + user_id % 4 AS INT)) AS shard_id,
               CASE WHEN event_type IN ('error', 'view') THEN 'run' ELSE 'loop' END AS source, event_id AS seq,
               CASE WHEN event_type = 'error' AND event_id % 97 = 0 THEN 'FATAL: working tree is dirty'
                    WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'overloaded_error, retry'
                    WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'Rate-Limit reached'
                    WHEN event_type = 'error' THEN concat('status=', CAST(400 + event_id % 100 AS STRING))
                    ELSE concat('ok ', event_type) END AS line
        FROM events""",
    "v_sweeps": """
        SELECT o_custkey AS sweep, o_orderpriority AS shard_id, count(*) AS total,
               count(*) FILTER (WHERE o_orderstatus <> 'P') AS done, bool_or(o_totalprice > 200000) AS alive,
               CASE WHEN max(o_totalprice) > 250000 THEN 'rate_limit' WHEN min(o_totalprice) < 50000 THEN 'dirty_tree'
                    ELSE 'other' END AS cause
        FROM orders GROUP BY o_custkey, o_orderpriority""",
    "v_snapshots": """
        SELECT o_custkey * 10000 + year(o_orderdate) AS iteration, o_orderkey AS story_id,
               (o_orderstatus = 'P') AS before_passes,
               CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN true
                    WHEN o_orderstatus = 'P' THEN o_orderpriority <> '5-LOW'
                    ELSE false END AS after_passes,
               min(o_orderkey) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS locked_id
        FROM orders""",
    "v_outputs": """
        SELECT event_id AS iteration, chr(CAST(97 + user_id % 4 AS INT)) AS shard_id,
               CASE event_type WHEN 'purchase' THEN 'done <promise>COMPLETE</promise>'
                               WHEN 'view' THEN '<promise>YIELD</promise>'
                               WHEN 'error' THEN concat('VIOLATION: item ', CAST(event_id AS STRING))
                               ELSE 'no token' END AS output
        FROM events""",
    "v_runs": """
        SELECT e.event_id AS run_id, s.story_id, CAST(e.event_id % 3000 AS BIGINT) AS seconds,
               CAST(CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS exit_code
        FROM events e JOIN v_stories s ON s.pos = 1 + e.user_id % 4""",
    "v_write_events": """
        SELECT event_id, concat('.shard-', chr(CAST(97 + user_id % 4 AS INT))) AS shard_root,
               CASE WHEN event_id % 11 = 0 THEN 'Read' ELSE 'Write' END AS tool_name,
               CASE WHEN event_id % 13 = 0 THEN CAST(NULL AS STRING)
                    WHEN event_id % 10 = 0 THEN concat('/tmp/', event_type)
                    WHEN event_id % 10 = 1 THEN concat('.baseline/state/', event_type)
                    WHEN event_id % 10 = 2 THEN concat('docs/', event_type)
                    WHEN event_id % 10 = 3 THEN concat('src/', event_type, '.py')
                    ELSE concat('.shard-', chr(CAST(97 + event_id % 4 AS INT)), '/state/', event_type,
                                CASE WHEN event_id % 7 = 0 THEN '.py' ELSE '.jsonl' END) END AS path
        FROM events""",
    "v_ranges": """
        SELECT o_custkey AS split_set, o_orderkey AS ordinal, CAST(floor(o_totalprice / 10000) AS BIGINT) AS lo,
               CAST(floor(o_totalprice / 10000) AS BIGINT) + month(o_orderdate) - 2 AS hi, CAST(45 AS BIGINT) AS total
        FROM orders""",
    # Gate measures of every batch over the given verdict view.
    "v_measures": """
        SELECT m.batch_idx, count(DISTINCT m.task_id) AS n_tasks, count(v.task_id) AS n_rows,
               count(*) FILTER (WHERE v.task_id IS NULL) AS n_missing,
               count(*) FILTER (WHERE v.task_id IS NOT NULL AND (v.qa IS NULL OR v.reason IS NULL OR v.schema_version IS NULL)) AS n_incomplete,
               count(*) FILTER (WHERE v.task_id IS NOT NULL AND v.schema_version IS DISTINCT FROM 'v1') AS n_other_version,
               count(*) FILTER (WHERE v.task_id IS NOT NULL AND coalesce(v.qa NOT IN ('yes', 'no'), true)) AS n_bad_label,
               count(*) FILTER (WHERE length(v.reason) >= 150) AS n_long,
               count(DISTINCT v.qa) AS n_labels
        FROM v_members m LEFT JOIN v_verdicts_dirty v ON v.task_id = m.task_id
        GROUP BY m.batch_idx""",
    "v_checks": """
        SELECT *,
               CASE WHEN n_rows <> n_tasks THEN printf('(a) %d rows for %d tasks', n_rows, n_tasks) END AS f_count,
               CASE WHEN n_missing <> 0 THEN printf('(b) %d ids without a verdict', n_missing) END AS f_ids,
               CASE WHEN n_incomplete + n_other_version <> 0
                    THEN printf('(schema) %d incomplete, %d of another version', n_incomplete, n_other_version) END AS f_schema,
               CASE WHEN n_bad_label <> 0 THEN printf('(valid_qa) %d labels not allowed', n_bad_label) END AS f_label,
               CASE WHEN NOT coalesce(n_long / nullif(n_rows, 0) >= 0.9, false)
                    THEN printf('(c) %d of %d reasons long enough', n_long, n_rows) END AS f_reason,
               CASE WHEN n_labels < CASE WHEN n_tasks <= 33 THEN 1 ELSE 2 END
                    THEN printf('(distinct_qa) %d distinct labels, need %d', n_labels, CASE WHEN n_tasks <= 33 THEN 1 ELSE 2 END)
               END AS f_distinct
        FROM v_measures""",
    "v_gate_results": """
        SELECT c.batch_idx, b.shard_id, b.story_id,
               coalesce(f_count, f_ids, f_schema, f_label, f_reason, f_distinct) IS NULL AS passed,
               concat_ws('; ', f_count, f_ids, f_schema, f_label, f_reason, f_distinct) AS failures
        FROM v_checks c JOIN v_batches b ON b.batch_idx = c.batch_idx""",
}


def needed_views(sql: str) -> list[str]:
    """Views a text uses, in definition order, their own views included."""
    used: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                todo.append(VIEWS[name])
    return [name for name in VIEWS if name in used]


def with_views(sql: str) -> str:
    """Put the needed views in front; a leading ``WITH`` of ``sql`` is continued."""
    chain = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed_views(sql))
    body = sql.strip()
    if not chain:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {chain},\n{body[5:]}"
    return f"WITH {chain}\n{body}"
