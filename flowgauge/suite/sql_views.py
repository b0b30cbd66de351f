"""The derived state tables again, as DuckDB text: the independent side of every check."""

from __future__ import annotations

import re

from flowgauge.suite.views import FACTS_NOW, RUNS_NOW, SCHEDULES, TYPE_TEXTS

FINAL = "('success','succeeded','failed','skipped','aborted','upstream_failed','stopped')"
FAILURES = "('failed','upstream_failed','aborted','stopped')"
NOW_RUNS = f"TIMESTAMP '{RUNS_NOW}'"
NOW_FACTS = f"TIMESTAMP '{FACTS_NOW}'"


def texts(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


VIEWS: dict[str, str] = {
    "v_tasks_all": """
        SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ln) AS task_no, pk, sk, q FROM (
          SELECT l_orderkey AS run_id, l_linenumber AS ln, min(l_partkey) AS pk, min(l_suppkey) AS sk,
                 CAST(min(l_quantity) AS INTEGER) AS q FROM lineitem GROUP BY 1, 2)""",
    "v_heads": """
        SELECT o_orderkey AS run_id, 'pl_' || o_custkey AS pipeline, o_custkey AS pipeline_no,
               CAST(o_orderdate AS DATE) AS run_date, o_orderdate + to_seconds(o_orderkey % 86400) AS started_at,
               o_orderdate AS started_day, o_orderkey % 97 = 0 AS step_failed,
               lower(substring(o_orderpriority, 3)) AS triggered_by FROM orders""",
    "v_runs": """
        SELECT h.*, coalesce(c.task_count, 0) AS task_count FROM v_heads h
        LEFT JOIN (SELECT run_id, max(task_no) AS task_count FROM v_tasks_all GROUP BY 1) c USING (run_id)""",
    "v_tasks": f"""
        SELECT *, CASE WHEN status IN {FINAL} THEN running_at + to_minutes(q) END AS finished_at FROM (
          SELECT t.run_id, task_no, 'task_' || task_no AS task_name, pipeline, run_date, pk, sk,
            CASE WHEN k = 0 THEN 'failed' WHEN k = 1 THEN 'upstream_failed' WHEN k = 2 THEN 'stopped'
                 WHEN k = 3 THEN 'aborted' WHEN k BETWEEN 4 AND 7 THEN 'skipped' WHEN k = 8 THEN 'waiting'
                 WHEN k = 9 THEN 'running' WHEN k = 10 THEN 'waiting_decision' WHEN k = 11 THEN 'succeeded'
                 ELSE 'success' END AS status,
            CASE k WHEN 4 THEN 'manual' WHEN 5 THEN 'run' WHEN 6 THEN 'rule' END AS skip_origin,
            CASE WHEN pk % 50 = 0 THEN 'always' ELSE ['all_success','one_success','all_done','all_skipped',
                 'none_skipped','one_failed','all_failed','none_failed','none_failed_min_one_success'][pk % 9 + 1] END
                 AS trigger_rule,
            started_at, started_at + to_minutes(task_no) AS running_at, q,
            CASE WHEN t.run_id % 23 = 0 THEN 2 ELSE 1 END AS generation
          FROM (SELECT *, (pk + 3 * sk + task_no) % 20 AS k FROM v_tasks_all WHERE (run_id + task_no) % 41 <> 0) t
          JOIN v_heads USING (run_id))""",
    "v_edges": """
        SELECT run_id, task_no, task_no - 1 AS upstream_no FROM v_tasks_all WHERE task_no > 1
        UNION ALL SELECT run_id, task_no, task_no - 2 FROM v_tasks_all WHERE task_no > 2 AND task_no % 2 = 1""",
    "v_pipelines": f"""
        SELECT 'pl_' || c_custkey AS name, c_custkey AS pipeline_no,
          CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN ' Team' || (c_custkey % 4)
               ELSE 'team' || (c_custkey % 4) || ' ' END AS group_name,
          {texts(SCHEDULES)}[c_custkey % 12 + 1] AS schedule,
          strftime(DATE '2023-01-01' + CAST(c_custkey % 300 AS INTEGER), '%Y-%m-%d') AS partition_start FROM customer""",
    "v_facts": """
        SELECT event_id, asset_name, event_time, granularity,
          CASE granularity WHEN 'hourly' THEN strftime(event_time, '%Y-%m-%dT%H')
            WHEN 'daily' THEN strftime(event_time, '%Y-%m-%d') WHEN 'weekly' THEN strftime(event_time, '%G-W%V')
            ELSE strftime(event_time, '%Y-%m') END AS partition_key,
          CAST(CASE granularity WHEN 'weekly' THEN date_trunc('week', event_time)
            WHEN 'monthly' THEN date_trunc('month', event_time) ELSE date_trunc('day', event_time) END AS DATE)
            AS partition_date, cascade, source_dag
        FROM (SELECT event_id, event_type AS asset_name, ts AS event_time,
            CASE event_type WHEN 'click' THEN 'hourly' WHEN 'signup' THEN 'weekly' WHEN 'error' THEN 'monthly'
                 ELSE 'daily' END AS granularity,
            CASE event_id % 10 WHEN 0 THEN 'none' WHEN 1 THEN 'all' ELSE 'auto' END AS cascade,
            'p' || (user_id % 7) AS source_dag FROM events)""",
    "v_gappy": """
        SELECT * FROM v_facts WHERE CASE granularity WHEN 'monthly' THEN true WHEN 'weekly' THEN week(event_time) % 3 <> 0
              ELSE (day(event_time) * 7 + length(asset_name)) % 5 <> 0 END""",
    "v_raw_facts": """
        SELECT event_id, asset_name, event_time, cascade, source_dag,
          CASE WHEN event_id % 53 = 0 THEN '2024-02-31' WHEN event_id % 59 = 0 THEN 'latest'
               WHEN event_id % 7 = 0 THEN NULL ELSE partition_key END AS partition_key,
          partition_key AS execution_date,
          CASE WHEN event_id % 61 = 0 THEN NULL ELSE granularity END AS granularity,
          CASE WHEN event_id % 3 = 0 THEN strftime(partition_date, '%Y-%m-%d')
               WHEN event_id % 67 = 0 THEN '20240131' END AS partition_date FROM v_facts""",
    "v_targets": """
        SELECT asset_name, CAST(d AS DATE) AS target_date FROM (SELECT DISTINCT asset_name FROM v_facts),
          unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-10', INTERVAL 1 DAY)) AS s(d)""",
    "v_subs": """
        SELECT 'p' || n AS pipeline, n, CASE WHEN n % 2 = 0 THEN 'AND' ELSE 'OR' END AS operator,
          TIMESTAMP '2024-01-01' + to_days(n % 5) AS subscribed_at, names[n % 5 + 1] AS a,
          names[(n + 1 + n % 3) % 5 + 1] AS b, names[(n + 2) % 5 + 1] AS c
        FROM (SELECT n_nationkey AS n, ['click','error','purchase','signup','view'] AS names FROM nation)""",
    "v_lineage_nodes": """
        SELECT p_partkey AS asset, p_brand AS pipeline,
          CASE p_partkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END AS granularity FROM part""",
    "v_lineage_edges": """
        SELECT DISTINCT p_partkey AS asset, u AS upstream FROM part,
          unnest([p_partkey // 2, p_partkey // 3]) AS s(u) WHERE u > 0 AND u <> p_partkey""",
    "v_task_io": """
        SELECT p_brand AS pipeline, p_partkey AS task, p_partkey AS ordinal,
          CASE WHEN p_partkey % 40 = 0 THEN p_partkey // 2 ELSE p_partkey END AS outlet,
          CASE p_partkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' END AS granularity,
          list_filter(list_distinct([p_partkey // 2, p_partkey // 3, p_partkey + 1000000]), lambda x: x > 0) AS inlets
        FROM part""",
    "v_triggers": """
        SELECT n AS src, CASE WHEN n % 5 <> 4 THEN n + 1 ELSE n - 4 END AS dst, 'asset_' || n AS label
          FROM (SELECT s_suppkey AS n FROM supplier)
        UNION ALL SELECT s_suppkey, s_suppkey + 2, 'asset_' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 1
        UNION ALL SELECT s_suppkey, s_suppkey, 'asset_' || s_suppkey FROM supplier WHERE s_suppkey % 25 = 7
        UNION ALL SELECT s_suppkey, s_suppkey + 5, 'asset_' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 0""",
    "v_declarations": f"""
        SELECT asset, pipeline, ordinal, 'c' || ordinal AS column_name, pk,
          {texts(TYPE_TEXTS)}[pk % {len(TYPE_TEXTS)} + 1] AS type_text, pk % 2 = 0 AS nullable,
          pk % 11 = 0 AS primary_key, pk % 13 = 0 AS partition_key,
          CASE WHEN pk % 3 = 0 THEN 'described' ELSE '' END AS description
        FROM (SELECT p_name AS asset, p_brand AS pipeline, p_size % 5 AS ordinal, min(p_partkey) AS pk
              FROM part GROUP BY 1, 2, 3)""",
    "v_outcomes": """
        SELECT o_custkey AS backfill_id, o_orderkey AS item, strftime(o_orderdate, '%Y-%m-%d') AS partition_key,
          CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'pending' END AS outcome,
          o_custkey % 29 = 0 AS canceled, CAST(o_orderkey % 4 AS INTEGER) AS tier, o_orderkey % 6 = 0 AS reused,
          o_orderdate + to_seconds(o_orderkey % 86400) AS "at" FROM orders""",
    "v_backfills": """
        SELECT backfill_id, 'pl_' || (backfill_id % 20) AS target_pipeline,
          CASE WHEN backfill_id % 29 = 0 THEN 'canceled' WHEN backfill_id % 3 = 0 THEN 'running'
               WHEN failed = 0 THEN 'completed' WHEN completed = 0 THEN 'failed' ELSE 'partial' END AS status,
          CASE WHEN backfill_id % 31 = 0 THEN NULL ELSE started_at END AS started_at,
          CASE WHEN backfill_id % 3 = 0 THEN NULL ELSE finished_at END AS finished_at,
          total, completed, failed,
          CASE WHEN backfill_id % 17 = 0 THEN '[broken' WHEN backfill_id % 19 = 0 THEN '[]'
               ELSE '["' || last_key || '","' || first_key || '"]' END AS partition_keys,
          CASE WHEN backfill_id % 4 = 1 THEN backfill_id - 1 END AS parent_id,
          CASE WHEN backfill_id % 5 = 0 THEN 'all' ELSE 'auto' END AS cascade
        FROM (SELECT backfill_id, min(partition_key) AS first_key, max(partition_key) AS last_key,
                min("at") AS started_at, max("at") AS finished_at, count(*) AS total,
                count(*) FILTER (outcome = 'completed') AS completed, count(*) FILTER (outcome = 'failed') AS failed
              FROM v_outcomes GROUP BY 1)""",
    "v_task_events": """
        SELECT user_id AS task_run_id, event_id, date_trunc('hour', ts) AS event_time,
          CASE event_type WHEN 'signup' THEN '05' WHEN 'error' THEN '20' WHEN 'view' THEN '30' ELSE '10' END AS ord,
          CASE event_type WHEN 'signup' THEN 'DEPS_READY' WHEN 'click' THEN 'TASK_STARTED'
            WHEN 'purchase' THEN 'TASK_RETRY_STARTED' WHEN 'error' THEN 'TASK_FINISHED' ELSE 'MANUAL_DECISION' END
            AS event_type FROM events""",
    "v_run_events": """
        SELECT user_id AS run_id, event_id, ts AS "at", CASE WHEN event_type IN ('click', 'purchase') THEN 'pause'
          ELSE 'resume' END AS action FROM events""",
    "v_row_log": """
        SELECT run_id, task_no, seq, old_status, new_status, writer, kind, generation_before,
          generation_before + raise AS generation_after, run_id % 103 <> 0 AS conditional,
          run_id % 103 <> 0 AS checks_run_version,
          CASE WHEN (run_id + task_no) % 107 = 0 THEN 9 ELSE generation_before END AS writer_generation,
          started_at + to_minutes(seq) AS "at" FROM (
        SELECT *, CASE WHEN seq = 5 AND status IN ('skipped', 'stopped') AND run_id % 10 <> 0 THEN 2 ELSE 1 END
            AS generation_before FROM (
          SELECT run_id, task_no, status, started_at, 1 AS seq, NULL AS old_status, 'waiting' AS new_status,
            'start_run' AS writer, 'start_run' AS kind, 0 AS raise FROM v_tasks
          UNION ALL SELECT run_id, task_no, status, started_at, 2, 'waiting',
            CASE WHEN run_id % 101 = 0 THEN 'running' ELSE 'deps_ready' END,
            CASE WHEN run_id % 101 = 0 THEN 'run_task' ELSE 'dispatcher' END,
            CASE WHEN run_id % 101 = 0 THEN 'run_task' ELSE 'decision' END, 0 FROM v_tasks WHERE status <> 'waiting'
          UNION ALL SELECT run_id, task_no, status, started_at, 3, 'deps_ready', 'running', 'run_task', 'run_task', 0
            FROM v_tasks WHERE status <> 'waiting' AND run_id % 101 <> 0
          UNION ALL SELECT run_id, task_no, status, started_at, 4, 'running', status,
            CASE WHEN status IN ('success','waiting_decision','succeeded') THEN 'run_task'
                 WHEN status IN ('failed','upstream_failed') THEN 'dispatcher' ELSE 'console' END,
            CASE WHEN status IN ('success','waiting_decision','succeeded') THEN 'run_task'
                 WHEN status IN ('failed','upstream_failed') THEN 'decision' ELSE 'action' END,
            CASE WHEN status IN ('skipped','stopped') AND run_id % 10 <> 0 THEN 1 ELSE 0 END
            FROM v_tasks WHERE status NOT IN ('waiting','running')
          UNION ALL SELECT run_id, task_no, status, started_at, 5, status, 'waiting', 'console', 'action', 1
            FROM v_tasks WHERE run_id % 23 = 0 AND status NOT IN ('waiting','running')))""",
    "v_pauses": """
        SELECT run_id, 1 AS pos, started_at + to_minutes(10) AS p_start,
               started_at + to_minutes(10 + (pipeline_no % 4) * 5) AS p_end FROM v_heads
        UNION ALL SELECT run_id, 2, started_at + to_minutes(60), NULL FROM v_heads WHERE run_id % 31 = 0""",
    # The pauses in columns: one closed interval, and whether a later one is open and from when.
    "v_row_times": """
        SELECT t.run_id, task_no,
          CASE WHEN status = 'success' AND pk % 4 = 0 THEN 'deps_ready' ELSE status END AS status,
          t.started_at AS waiting_since,
          CASE WHEN sk % 4 <> 0 THEN t.started_at + to_minutes(pk % 50) END AS enabled_at, pk % 3 = 0 AS has_wait_for,
          CASE WHEN pk % 7 = 0 THEN to_minutes(30 + sk % 600) END AS orchestration_timeout,
          CASE WHEN pk % 11 = 0 THEN running_at + to_minutes(20) END AS countdown_end,
          CASE WHEN sk % 9 = 0 THEN t.started_at + to_minutes(3) END AS start_failed_first,
          CASE WHEN sk % 9 = 0 THEN t.started_at + to_minutes(9) END AS start_failed_last,
          CASE WHEN sk % 9 = 0 THEN pk % 6 ELSE 0 END AS start_failures, running_at AS status_since,
          CASE WHEN pk % 5 = 0 THEN running_at + to_minutes(12) END AS last_check, pk % 5 AS checks,
          CASE WHEN status = 'waiting_decision' THEN running_at END AS decision_since,
          CASE WHEN status = 'waiting_decision' THEN to_minutes(60 * (1 + sk % 48)) END AS decision_timeout,
          t.run_id % 31 = 0 AS paused, p1.p_start AS s1, p1.p_end AS e1, p2.p_start AS s2
        FROM v_tasks t JOIN v_pauses p1 ON p1.run_id = t.run_id AND p1.pos = 1
        LEFT JOIN v_pauses p2 ON p2.run_id = t.run_id AND p2.pos = 2""",
    "v_run_counts": f"""
        SELECT run_id, count(*) AS n, bool_and(status IN {FINAL}) AS all_final, bool_or(status = 'failed') AS any_failed,
          bool_or(status IN ('stopped','aborted','upstream_failed')) AS any_stopped,
          count(*) FILTER (status = 'failed') AS n_failed, bool_or(status = 'waiting_decision') AS asks,
          max(finished_at) AS finish FROM v_tasks GROUP BY 1""",
    "v_entries": """
        SELECT *, CASE WHEN status <> 'running' THEN finish END AS finished_at FROM (
          SELECT h.*, c.finish, c.asks, coalesce(c.n_failed, 0) AS failed_tasks,
            CASE WHEN c.n IS NULL OR NOT all_final THEN 'running' WHEN step_failed OR any_failed THEN 'failed'
                 WHEN any_stopped THEN 'aborted' ELSE 'success' END AS status
          FROM v_heads h LEFT JOIN v_run_counts c USING (run_id) WHERE h.run_id % 7 <> 0)""",
    "v_counts": f"""
        SELECT t.run_id, t.task_no, count(u.run_id) AS total, count(*) FILTER (u.status IN ('success','succeeded')) AS success,
          count(*) FILTER (u.status IN {FAILURES}) AS failed, count(*) FILTER (u.status = 'skipped') AS skipped,
          count(*) FILTER (u.status = 'skipped' AND u.skip_origin = 'rule') AS cascading,
          count(*) FILTER (u.run_id IS NOT NULL AND u.status NOT IN {FINAL}) AS pending,
          min(CASE WHEN e.upstream_no IS NOT NULL AND u.run_id IS NULL THEN e.upstream_no END) AS missing_upstream,
          min(u.finished_at) FILTER (u.status IN ('success','succeeded')) AS s_at,
          min(u.finished_at) FILTER (u.status IN {FAILURES}) AS f_at, max(u.finished_at) AS l_at
        FROM v_tasks t LEFT JOIN v_edges e ON e.run_id = t.run_id AND e.task_no = t.task_no
        LEFT JOIN v_tasks u ON u.run_id = e.run_id AND u.task_no = e.upstream_no GROUP BY 1, 2""",
    "v_verdicts": """
        SELECT t.run_id, t.task_no, t.trigger_rule, t.status, t.skip_origin, c.*  EXCLUDE (run_id, task_no),
          CASE WHEN trigger_rule = 'always' THEN 'fail' WHEN total = 0 THEN 'ready'
            WHEN trigger_rule = 'one_success' THEN CASE WHEN success > 0 THEN 'ready' WHEN pending > 0 THEN 'wait'
              WHEN failed > 0 THEN 'upstream_failed' ELSE 'skip' END
            WHEN trigger_rule = 'one_failed' THEN CASE WHEN failed > 0 THEN 'ready' WHEN pending > 0 THEN 'wait'
              ELSE 'skip' END
            WHEN pending > 0 THEN 'wait'
            WHEN trigger_rule = 'all_success' THEN CASE WHEN success + skipped - cascading = total THEN 'ready'
              WHEN failed > 0 THEN 'upstream_failed' ELSE 'skip' END
            WHEN trigger_rule = 'all_done' THEN 'ready'
            WHEN trigger_rule = 'all_skipped' THEN CASE WHEN skipped = total THEN 'ready' ELSE 'skip' END
            WHEN trigger_rule = 'none_skipped' THEN CASE WHEN skipped = 0 THEN 'ready' ELSE 'skip' END
            WHEN trigger_rule = 'all_failed' THEN CASE WHEN failed = total THEN 'ready' ELSE 'skip' END
            WHEN failed > 0 THEN 'upstream_failed'
            WHEN trigger_rule = 'none_failed' OR success > 0 THEN 'ready' ELSE 'skip' END AS verdict
        FROM v_tasks t JOIN v_counts c USING (run_id, task_no)""",
    "v_executions": """
        SELECT run_id, task_no, CASE pk % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'FAILED' END AS execution_status
        FROM v_tasks WHERE status = 'running' OR (status = 'success' AND pk % 4 = 0)""",
    "v_outputs": """
        SELECT run_id, pipeline, task_no, run_date,
          CASE WHEN pk % 11 = 0 THEN '{"_manually_resolved":true,"_resolution":"skip","_operator":"op' || sk
                 || '","_reason":"r","_pipeline_execution":"' || run_id || '"}'
            WHEN pk % 13 = 0 THEN '{"_s3_ref":"store://bucket/' || pk || '.json"}'
            WHEN pk % 17 = 0 THEN '{"_truncated":true}' WHEN pk % 19 = 0 THEN 'plain text'
            WHEN pk % 23 = 0 THEN '{"_manually_resolved":"yes"}' ELSE '{"rows":' || pk || '}' END AS result, pk, sk
        FROM v_tasks WHERE (run_id + task_no) % 5 <> 0""",
    "v_a_tasks": """
        SELECT run_id, task_no, status, generation,
          CASE WHEN (run_id * 7 + task_no) % 211 = 0 THEN 'wait_token' END AS token_fields,
          started_at + to_days(455) AS expires_at, (run_id + task_no) % 37 <> 0 AS output_recorded,
          started_at + to_minutes(CASE WHEN pk % 10 = 0 THEN 900 ELSE 0 END) AS waiting_since FROM v_tasks""",
    "v_a_runs": f"""
        SELECT run_id, CASE WHEN run_id % 89 = 0 THEN 'creating' ELSE 'active' END AS status, 'tk' || run_id AS token,
          CASE WHEN run_id % 13 <> 0 THEN 'tk' || run_id END AS answered, run_id % 17 = 0 AS stop_mark,
          run_id % 34 = 0 AS stop_done, run_id % 19 = 0 AS request_pending, run_id % 31 = 0 AS paused,
          CASE WHEN run_id % 11 <> 0 THEN {NOW_RUNS} + to_minutes(run_id % 50) END AS due_at,
          started_at + to_days(455) AS expires_at, run_id % 5 = 0 AS execution_ended,
          CASE WHEN run_id % 5 = 0 THEN started_at + to_minutes(600) END AS execution_ended_at FROM v_heads""",
    "v_a_executions": """
        SELECT run_id, task_no, generation, status = 'running' OR (run_id + task_no) % 83 = 0 AS running, copy
        FROM v_tasks, unnest([1, 2]) AS s(copy) WHERE copy = 1 OR (run_id + task_no) % 97 = 0""",
    "v_a_starts": """
        SELECT run_id, task_no, generation,
          CASE WHEN (run_id + task_no) % 79 = 0 THEN 'waiting' ELSE 'deps_ready' END AS row_status,
          CASE WHEN (run_id + task_no) % 71 = 0 THEN generation + 1 ELSE generation END AS row_generation
        FROM v_tasks""",
}

_NAME = re.compile(r"\bv_[a-z_]+\b")


def recursive(walk: str, sql: str, **extra: str) -> str:
    """An oracle whose query reads ``walk``, a recursive table over the derived views."""
    mark = "--walk--"
    head, tail = oracle(f"{mark}{walk}{mark}{sql}", **extra).split(mark)[0], sql.strip()
    return f"{head.rstrip()},\nwalk AS ({walk.strip()})\n{tail}"


def oracle(sql: str, **extra: str) -> str:
    """``sql`` below the views it names, each written out as a named subquery."""
    known = {**VIEWS, **extra}
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in known and name not in ordered:
                need(known[name])
                if name not in ordered:
                    ordered.append(name)

    need(sql)
    head = ",\n".join(f"{name} AS ({known[name].strip()})" for name in ordered)
    return f"WITH RECURSIVE {head}\n{sql.strip()}" if head else sql.strip()
