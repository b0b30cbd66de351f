"""Registered checks of state tables and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgauge.operators import audit
from flowgauge.sources import state
from flowgauge.suite.registry import query
from flowgauge.suite.sql_views import FINAL, NOW_RUNS
from flowgauge.suite.views import runs_now


@query("s07_task_rows", "SELECT run_id, task_no FROM v_tasks WHERE (run_id + task_no) % 10 > 5")
def _(v):
    mixed = v.tasks.selectExpr(
        "run_id", "task_no",
        "concat(element_at(array('_run_', 'output#', 'input#', 'dag_snapshot::', 'x', 'y', 'my_', 'a#', 'b', 'c'),"
        " cast((run_id + task_no) % 10 AS int) + 1), run_id) AS execution_name",
        "CASE WHEN (run_id + task_no) % 10 = 4 THEN 'backfill' END AS record_type",
        "CASE WHEN (run_id + task_no) % 10 = 5 THEN '_bulk_backfill' ELSE pipeline END AS pipeline_name")
    return state.task_rows_only(mixed).select("run_id", "task_no")


@query("s08_readiness", """
    SELECT run_id, task_no, CASE pk % 5 WHEN 1 THEN 'unknown keys' WHEN 2 THEN 'missing keys' WHEN 3 THEN 'not JSON'
      WHEN 4 THEN 'not an object' END AS problem, CASE WHEN pk % 5 = 0 THEN trigger_rule END AS rule,
      CASE WHEN pk % 5 = 0 THEN 'a,t' || task_no ELSE '' END AS dependencies FROM v_tasks""")
def _(v):
    texts = v.tasks.selectExpr("run_id", "task_no", """CASE pk % 5
        WHEN 0 THEN concat('{"dependencies":["a","t', task_no, '"],"trigger_rule":"', trigger_rule, '"}')
        WHEN 1 THEN '{"dependencies":[],"trigger_rule":"all_done","color":1}' WHEN 2 THEN '{"dependencies":[]}'
        WHEN 3 THEN '{broken' ELSE '[1]' END AS readiness""")
    return state.parse_readiness(texts).select(
        "run_id", "task_no", "problem", "rule", F.array_join("dependencies", ",").alias("dependencies"))


_MARK = "'{\"_manually_resolved\":true,\"_resolution\":\"mark\"}'"


@query("s10_markers", f"""
    SELECT coalesce(o.run_id, t.run_id) AS run_id, coalesce(o.task_no, t.task_no) AS task_no,
      CASE WHEN t.run_id IS NOT NULL AND (o.run_id IS NULL OR o.pk % 11 = 0) THEN {_MARK} ELSE o.result END AS result,
      t.run_id IS NOT NULL AND (o.run_id IS NULL OR o.pk % 11 = 0) AS marked
    FROM v_outputs o FULL JOIN (SELECT run_id, task_no FROM v_tasks WHERE status = 'skipped') t
      ON t.run_id = o.run_id AND t.task_no = o.task_no""")
def _(v):
    markers = v.tasks.where("status = 'skipped'").select("run_id", "task_no", F.expr(_MARK).alias("result"))
    return state.apply_markers(v.outputs, markers, ["run_id", "task_no"])


@query("s11_push_size", """
    SELECT doc_id, strlen(text) * 40 AS bytes, strlen(text) * 40 <= 350000 AS accepted,
      CASE WHEN strlen(text) * 40 > 350000 THEN 'store the payload and push a pointer to it' END AS hint FROM documents""")
def _(v):
    rows = v.table("documents").select("doc_id", F.repeat("text", F.lit(40)).alias("value"))
    return state.validate_pushes(rows, "value").drop("value")


@query("s12_live_rows", f"""
    SELECT 'history' AS kind, run_id FROM v_heads WHERE started_at + INTERVAL 455 DAY > {NOW_RUNS}
    UNION ALL SELECT 'timeline', run_id FROM v_heads WHERE started_at + INTERVAL 90 DAY > {NOW_RUNS}
    UNION ALL SELECT 'backfill', backfill_id FROM v_backfills WHERE started_at + CASE WHEN status IN ('pending', 'running')
      THEN INTERVAL 455 DAY ELSE INTERVAL 90 DAY END > {NOW_RUNS}""")
def _(v):
    now = runs_now()
    out = [state.live_rows(v.run_heads, kind, "started_at", now).select(F.lit(kind).alias("kind"), "run_id")
           for kind in ("history", "timeline")]
    backfills = state.live_backfills(v.backfills, "started_at", now).select(
        F.lit("backfill").alias("kind"), F.col("backfill_id").alias("run_id"))
    return out[0].unionByName(out[1]).unionByName(backfills)


_CURRENT = {"v_current": """
    SELECT run_id, task_no, new_status AS status, generation_after AS generation, "at" AS status_since FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id, task_no ORDER BY generation_after DESC, "at" DESC, seq DESC) AS n
      FROM v_row_log) WHERE n = 1"""}


@query("s13_current_rows", """
    SELECT run_id, task_no, status, generation, status_since::VARCHAR AS status_since FROM v_current""", **_CURRENT)
def _(v):
    return state.current_rows(v.row_log)


@query("s14_unregistered", """
    SELECT DISTINCT pipeline FROM v_heads WHERE pipeline NOT IN (SELECT name FROM v_pipelines WHERE pipeline_no % 3 <> 0)""")
def _(v):
    return state.unregistered(v.run_heads, v.pipelines.where("pipeline_no % 3 <> 0"))


@query("s15_alert_routes", """
    SELECT t.run_id, t.task_no, c AS channel FROM v_tasks t JOIN (
      SELECT 'pl_' || c_custkey AS pipeline, unnest(CASE c_custkey % 4 WHEN 1 THEN ['chat'] WHEN 2 THEN ['chat', 'mail']
        ELSE [] END) AS c FROM customer) USING (pipeline) WHERE status = 'failed'""")
def _(v):
    config = v.table("customer").selectExpr(
        "concat('pl_', c_custkey) AS pipeline",
        "CASE c_custkey % 4 WHEN 0 THEN array() WHEN 1 THEN array('chat') WHEN 2 THEN array('chat', 'mail') END AS enabled_channels")
    return state.route_alerts(v.tasks.where("status = 'failed'"), config).select("run_id", "task_no", "channel")


# Written out by hand, so that a wrong entry in the library's table shows.
_OPEN = "('waiting', 'deps_ready', 'waiting_paused', 'waiting_decision', 'running', 'pending', 'waiting_delay')"
_UNSUCCESSFUL = """('waiting', 'deps_ready', 'waiting_paused', 'waiting_decision', 'running', 'pending', 'failed', 'upstream_failed',
    'aborted', 'skipped', 'stopped')"""
_RESTARTED = "('success', 'succeeded', 'failed', 'skipped', 'aborted', 'upstream_failed', 'stopped', 'waiting_decision')"
_LEGAL = f"""coalesce(CASE writer
    WHEN 'start_run' THEN old_status IS NULL AND new_status IN ('waiting', 'skipped')
    WHEN 'run_task' THEN old_status = 'deps_ready' AND new_status = 'running'
      OR old_status = 'running' AND new_status IN ('success', 'waiting_decision')
    WHEN 'console' THEN old_status IN {_UNSUCCESSFUL} AND new_status IN ('skipped', 'success')
      OR old_status IN {_OPEN} AND new_status IN ('failed', 'stopped') OR old_status IN {_RESTARTED} AND new_status = 'waiting'
    WHEN 'dispatcher' THEN CASE old_status
      WHEN 'waiting' THEN new_status IN ('waiting_paused', 'deps_ready', 'skipped', 'upstream_failed', 'failed', 'stopped')
      WHEN 'waiting_paused' THEN new_status IN ('waiting', 'deps_ready', 'skipped', 'upstream_failed', 'failed', 'stopped')
      WHEN 'deps_ready' THEN new_status IN ('failed', 'stopped') WHEN 'running' THEN new_status IN ('failed', 'stopped')
      WHEN 'waiting_decision' THEN new_status IN ('failed', 'stopped') WHEN 'pending' THEN new_status = 'stopped'
      WHEN 'waiting_delay' THEN new_status = 'stopped'
      WHEN 'upstream_failed' THEN new_status = 'waiting' WHEN 'skipped' THEN new_status = 'waiting' END END, false)"""
WAKING = f"""CASE new_status WHEN 'skipped' THEN old_status IN {_UNSUCCESSFUL} WHEN 'success' THEN old_status IN {_UNSUCCESSFUL}
    WHEN 'upstream_failed' THEN old_status IN ('waiting', 'waiting_paused') WHEN 'failed' THEN old_status IN {_OPEN}
    WHEN 'stopped' THEN old_status IN {_OPEN} WHEN 'waiting_decision' THEN old_status = 'running'
    WHEN 'waiting' THEN old_status IN {_RESTARTED} END"""


@query("w13_illegal_moves", f"""
    SELECT run_id, task_no, seq FROM v_row_log WHERE old_status IS DISTINCT FROM new_status AND NOT {_LEGAL}""")
def _(v):
    return audit.illegal_moves(v.row_log).select("run_id", "task_no", "seq")


@query("p12_waking_changes", f"""
    SELECT run_id, task_no, seq FROM v_row_log WHERE old_status IS NOT NULL AND {WAKING}""")
def _(v):
    return audit.waking_changes(v.row_log).select("run_id", "task_no", "seq")


@query("q01_right_to_run", """
    SELECT run_id, task_no, 'token' AS violation FROM v_a_tasks WHERE token_fields IS NOT NULL
    UNION ALL SELECT run_id, task_no, 'execution' FROM v_a_tasks t WHERE status NOT IN ('deps_ready', 'running')
      AND EXISTS (SELECT 1 FROM v_a_executions e WHERE e.run_id = t.run_id AND e.task_no = t.task_no
        AND e.generation = t.generation AND running)""")
def _(v):
    return audit.run_without_right(v.audit_tasks, v.audit_executions)


@query("q02_lawful_leave", """
    SELECT run_id, task_no, seq, CASE WHEN kind NOT IN ('decision', 'action', 'request', 'stop') THEN 'writer'
      ELSE 'conditions' END AS violation FROM v_row_log WHERE old_status IN ('waiting', 'waiting_paused')
      AND (kind NOT IN ('decision', 'action', 'request', 'stop') OR (kind = 'decision' AND run_id % 103 = 0))""")
def _(v):
    return audit.unlawful_leave(v.row_log)


@query("q03_ready_starts", """
    SELECT run_id, task_no, generation FROM v_a_starts WHERE row_status <> 'deps_ready' OR row_generation <> generation""")
def _(v):
    return audit.early_starts(v.audit_starts)


@query("q04_single_execution", """
    SELECT run_id, task_no, generation, count(*) AS executions FROM v_a_executions GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def _(v):
    return audit.repeated_executions(v.audit_executions)


@query("q05_own_generation", """
    SELECT run_id, task_no, seq FROM v_row_log WHERE kind = 'run_task'
      AND (writer_generation <> generation_before OR generation_after <> generation_before)""")
def _(v):
    return audit.foreign_writes(v.row_log)


@query("q06_raised_generation", """
    SELECT run_id, task_no, seq FROM v_row_log WHERE kind = 'action' AND new_status <> old_status
      AND generation_after <> generation_before + 1""")
def _(v):
    return audit.kept_generations(v.row_log)


_OPEN = {"v_open": f"""SELECT run_id, count(*) FILTER (status NOT IN {FINAL}) AS n,
    count(*) FILTER (status = 'waiting_decision') AS d FROM v_a_tasks GROUP BY 1"""}


@query("q08_founded_ends", f"""
    SELECT r.run_id, 'not answered' AS violation FROM v_a_runs r LEFT JOIN v_open o USING (run_id)
      WHERE status <> 'creating' AND coalesce(n, 0) = 0 AND answered IS NULL AND NOT execution_ended AND due_at IS NULL
    UNION ALL SELECT DISTINCT r.run_id, 'ended early' FROM v_a_runs r JOIN v_a_tasks t USING (run_id)
      WHERE r.status <> 'creating' AND execution_ended AND NOT stop_mark AND t.status NOT IN {FINAL}
        AND NOT (r.run_id % 4 = 0 AND t.task_no = r.run_id % 3) AND t.waiting_since <= r.execution_ended_at
    UNION ALL SELECT run_id, 'answered early' FROM v_open WHERE run_id % 4 = 0 AND run_id % 17 <> 0 AND n > 0""", **_OPEN)
def _(v):
    return audit.unfounded_ends(v.audit_runs, v.audit_tasks, v.audit_answers)


@query("q09_covered_work", f"""
    SELECT r.run_id, CASE WHEN due_at IS NULL THEN 'no due time' ELSE 'due too late' END AS violation
    FROM v_a_runs r LEFT JOIN v_open o USING (run_id) WHERE status <> 'creating'
      AND (coalesce(n, 0) > 0 OR (stop_mark AND NOT stop_done) OR request_pending OR (answered IS NULL AND NOT execution_ended))
      AND (due_at IS NULL OR due_at > {NOW_RUNS} + INTERVAL 30 MINUTE)""", **_OPEN)
def _(v):
    return audit.uncovered_work(v.audit_runs, v.audit_tasks, runs_now())


@query("q10_blind_passes", """
    SELECT run_id AS pass_id FROM v_heads WHERE run_id % 7 = 0 AND (run_id % 3 > 0 OR run_id % 2 > 0 OR run_id % 5 = 0)""")
def _(v):
    return audit.blind_passes(v.audit_passes)


@query("q11_live_rows_expire", f"""
    SELECT run_id, NULL::BIGINT AS task_no FROM v_a_runs WHERE NOT execution_ended AND expires_at <= {NOW_RUNS}
    UNION ALL SELECT t.run_id, t.task_no FROM v_a_tasks t JOIN v_a_runs r USING (run_id)
      WHERE NOT execution_ended AND t.expires_at <= {NOW_RUNS}""")
def _(v):
    return audit.expired_live_rows(v.audit_runs, v.audit_tasks, runs_now())


@query("q12_recorded_success", """
    SELECT run_id, task_no FROM v_a_tasks WHERE status = 'success' AND NOT output_recorded""")
def _(v):
    return audit.unrecorded_successes(v.audit_tasks)


@query("q13_liveness", """
    SELECT r.run_id FROM v_a_runs r LEFT JOIN v_open o USING (run_id) WHERE NOT execution_ended AND NOT paused
      AND NOT (coalesce(d, 0) > 0 AND due_at IS NOT NULL)""", **_OPEN)
def _(v):
    return audit.stuck_runs(v.audit_runs, v.audit_tasks)
