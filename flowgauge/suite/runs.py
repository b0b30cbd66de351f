"""Registered checks of run roll-ups, entries and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgauge.operators import runs
from flowgauge.suite.registry import query
from flowgauge.suite.sql_views import FAILURES, FINAL

_TODAY = "2000-06-30"
_DAYS = 400


def entries(v):
    return runs.run_entries(v.run_rows)


def cards(v):
    return runs.pipeline_cards(entries(v), v.pipelines, F.lit(_TODAY).cast("date"), _DAYS)


@query("j06_expected_rows", """
    SELECT a.run_id, a.task_no, coalesce(t.status, 'failed') AS status, t.status IS NULL AS row_missing
    FROM v_tasks_all a LEFT JOIN v_tasks t USING (run_id, task_no)""")
def _(v):
    return runs.expected_rows(v.tasks_all, v.tasks)


@query("g05_run_status", """
    SELECT run_id, CASE WHEN NOT all_final THEN 'running' WHEN any_failed THEN 'failed' WHEN any_stopped THEN 'aborted'
      ELSE 'success' END AS status FROM v_run_counts""")
def _(v):
    return runs.run_status(v.tasks)


@query("g06_run_summary", """
    SELECT run_id, string_agg(status || '=' || n, ',' ORDER BY status) AS summary
    FROM (SELECT run_id, status, count(*) AS n FROM v_tasks GROUP BY 1, 2) GROUP BY 1""")
def _(v):
    entry = F.array_sort(F.transform(
        F.map_entries("summary"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return runs.run_summary(v.tasks).select("run_id", F.array_join(entry, ",").alias("summary"))


@query("g07_run_outcome", """
    SELECT r.run_id, CASE WHEN c.n = r.task_count AND all_final THEN CASE WHEN step_failed OR any_failed THEN 'failed'
      WHEN any_stopped THEN 'aborted' ELSE 'success' END END AS outcome
    FROM v_runs r JOIN v_run_counts c USING (run_id)""")
def _(v):
    joined = v.runs.join(runs.run_summary(v.tasks), "run_id")
    return joined.select("run_id", runs.outcome(F.col("summary"), F.col("task_count"), F.col("step_failed")).alias("outcome"))


@query("g08_shown_status", "SELECT run_id, status, failed_tasks FROM v_entries")
def _(v):
    return v.run_rows.select(
        "run_id", runs.shown_status(F.col("summary"), F.col("step_failed")).alias("status"),
        runs.failed_tasks(F.col("summary")).alias("failed_tasks"))


@query("g09_failure_cause", f"""
    SELECT run_id, status, failures, started_at::VARCHAR AS started_at, CASE WHEN step_failed THEN 'step load failed; '
      ELSE '' END || failures || ' tasks failed' || coalesce(': ' || names, '') AS cause FROM (
      SELECT h.run_id, h.started_at, h.step_failed, count(*) FILTER (s IN {FAILURES}) AS failures,
        string_agg('task_' || task_no, ', ' ORDER BY 'task_' || task_no) FILTER (s IN {FAILURES}) AS names,
        bool_and(s IN {FINAL}) AS all_final, CASE WHEN step_failed OR bool_or(s = 'failed') THEN 'failed'
          WHEN bool_or(s IN ('stopped','aborted','upstream_failed')) THEN 'aborted' ELSE 'success' END AS status
      FROM (SELECT run_id, task_no, coalesce(status, 'failed') AS s FROM v_tasks_all LEFT JOIN v_tasks
              USING (run_id, task_no)) JOIN v_heads h USING (run_id) GROUP BY 1, 2, 3)
    WHERE all_final AND status <> 'success'""")
def _(v):
    rows = runs.expected_rows(v.tasks_all, v.tasks).withColumn("name", F.expr("concat('task_', task_no)"))
    heads = v.run_heads.withColumn("failed_step", F.lit("load"))
    causes = runs.failure_cause(rows, heads, longest=32_768)
    return causes.join(heads.select("run_id", "started_at"), "run_id").orderBy(F.desc("started_at"), "run_id")


@query("g10_run_stats", """
    SELECT pipeline, run_id, count(*) AS total, count(*) FILTER (status IN ('success','succeeded')) AS success,
      count(*) FILTER (status IN ('running','deps_ready')) AS running,
      count(*) FILTER (status IN ('waiting','waiting_paused','waiting_decision')) AS waiting,
      count(*) FILTER (status IN ('failed','upstream_failed')) AS failed, count(*) FILTER (status = 'skipped') AS skipped,
      count(*) FILTER (status IN ('stopped','aborted')) AS stopped FROM v_tasks GROUP BY ROLLUP (pipeline, run_id)""")
def _(v):
    return runs.run_stats(v.tasks)


@query("g11_daily_metrics", """
    SELECT run_date::VARCHAR AS run_date, total, success, failed, running,
      (2000 * success + total) // (2 * total) AS success_permille FROM (
      SELECT run_date, count(*) AS total, count(*) FILTER (status = 'success') AS success,
        count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('running','pending')) AS running
      FROM v_tasks GROUP BY 1)""")
def _(v):
    return runs.daily_metrics(v.tasks)


@query("g12_failure_health", """
    SELECT run_date::VARCHAR AS run_date, n AS failures_last_hour, CASE WHEN n > 10 THEN 'unhealthy' WHEN n > 0
      THEN 'degraded' ELSE 'healthy' END AS health FROM (
      SELECT run_date, count(*) FILTER (status = 'failed' AND finished_at >= run_date + INTERVAL 11 HOUR) AS n
      FROM v_tasks GROUP BY 1)""")
def _(v):
    noon = F.expr("cast(run_date AS timestamp_ntz) + interval 12 hours")
    return runs.failure_health(v.tasks, noon)


_CARD = f"""
    SELECT p.name AS pipeline, coalesce(l.status, 'idle') AS status,
      CASE WHEN l.status = 'running' AND l.asks THEN 'waiting_decision' END AS waiting_on, l.failed_tasks,
      CASE WHEN done > 0 THEN CASE WHEN (200 * ok) % (2 * done) > done OR ((200 * ok) % (2 * done) = done
        AND (100 * ok // done) % 2 = 1) THEN 100 * ok // done + 1 ELSE 100 * ok // done END END AS sla, a.recent
    FROM v_pipelines p LEFT JOIN (
      SELECT pipeline, count(*) FILTER (status NOT IN ('running','aborted')) AS done,
        count(*) FILTER (status = 'success') AS ok FROM v_window GROUP BY 1) r ON r.pipeline = p.name
    LEFT JOIN (SELECT * FROM v_window WHERE pos = 1) l ON l.pipeline = p.name
    LEFT JOIN (SELECT pipeline, string_agg(run_id || ':' || status || ':' || failed_tasks, ',' ORDER BY pos) AS recent
               FROM v_window WHERE pos <= 10 GROUP BY 1) a ON a.pipeline = p.name"""
_WINDOW = {"v_window": f"""
    SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY run_date DESC, started_at DESC, run_id DESC) AS pos
    FROM v_entries WHERE started_at::DATE BETWEEN DATE '{_TODAY}' - {_DAYS - 1} AND DATE '{_TODAY}'
      AND run_date >= DATE '{_TODAY}' - {_DAYS - 1}"""}


@query("g13_status_cards", _CARD, **_WINDOW)
def _(v):
    item = F.transform("recent_runs", lambda r: F.concat_ws(":", r["run_id"].cast("string"), r["status"],
                                                            r["failed_tasks"].cast("string")))
    return cards(v).select("pipeline", "status", "waiting_on", "failed_tasks", "sla",
                           F.array_join(item, ",").alias("recent"))


@query("p09_needs_attention", f"""
    SELECT pipeline FROM ({_CARD}) WHERE status = 'failed' OR waiting_on = 'waiting_decision'
      OR (status = 'running' AND failed_tasks > 0)""", **_WINDOW)
def _(v):
    return cards(v).where(runs.needs_attention()).select("pipeline")


@query("w05_recent_runs", """
    SELECT pipeline, run_id, status, position FROM (SELECT *, row_number() OVER (PARTITION BY pipeline
      ORDER BY run_date DESC, started_at DESC, run_id DESC) AS position FROM v_entries) WHERE position <= 10""")
def _(v):
    return runs.recent_runs(entries(v)).select("pipeline", "run_id", "status", "position")


@query("p06_run_entries", """
    SELECT run_id, pipeline, regexp_replace(right(pipeline || ':' || run_date || '.' || run_id, 20), '[.:]', '', 'g')
        AS execution_short, status, failed_tasks, run_date::VARCHAR AS run_date, started_at::VARCHAR AS started_at,
      finished_at::VARCHAR AS finished_at, (epoch_us(finished_at) - epoch_us(started_at)) // 1000 AS duration_ms,
      triggered_by FROM v_entries""")
def _(v):
    return entries(v).drop("summary", "step_failed")


@query("p03_filter_runs", """
    SELECT run_id, status, run_date::VARCHAR AS run_date FROM v_entries
    WHERE status = 'failed' AND run_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""")
def _(v):
    kept = runs.filter_runs(entries(v), status="failed", first="1997-01-01", last="1998-12-31")
    return kept.select("run_id", "status", "run_date")


def listed_tasks(v):
    return v.tasks.withColumns({
        "restarts": F.expr("CASE WHEN generation > 1 THEN generation - 1 END"),
        "retry_attempt": F.expr("cast(CASE WHEN pk % 4 = 0 THEN pk % 3 END AS int)"),
        "readiness": F.expr("CASE WHEN run_id % 7 <> 0 THEN '{}' WHEN run_id % 2 = 0 THEN '' END"),
    })


@query("p07_task_entries", f"""
    SELECT run_id, task_no, task_name, pipeline, status, (epoch_us(finished_at) - epoch_us(running_at)) // 1000
        AS duration_ms, generation - 1 AS restarts, CASE WHEN pk % 4 = 0 THEN pk % 3 ELSE 0 END AS retry_attempt,
      run_id % 7 = 0 AND status NOT IN {FINAL} AS stale FROM v_tasks""")
def _(v):
    return runs.task_entries(listed_tasks(v))


@query("p08_stale_rows", f"SELECT run_id, task_no, status FROM v_tasks WHERE run_id % 7 = 0 AND status NOT IN {FINAL}")
def _(v):
    return listed_tasks(v).where(runs.is_stale()).select("run_id", "task_no", "status")


_DATES = f"""
    SELECT run_id, pipeline, run_date::VARCHAR AS run_date, status, failed_tasks, started_at::VARCHAR AS started_at,
      finished_at::VARCHAR AS finished_at, (epoch_us(finished_at) - epoch_us(started_at)) // 1000 AS duration_ms FROM (
      SELECT t.run_id, t.pipeline, t.run_date, coalesce(e.status, CASE WHEN NOT t.all_final THEN 'stale'
          WHEN any_failed THEN 'failed' WHEN any_stopped THEN 'aborted' ELSE 'success' END) AS status,
        coalesce(e.failed_tasks, t.n_failed) AS failed_tasks, coalesce(e.started_at, t.first_start) AS started_at,
        CASE WHEN e.run_id IS NOT NULL THEN e.finished_at WHEN t.all_final THEN t.finish END AS finished_at
      FROM (SELECT run_id, pipeline, run_date, min(started_at) AS first_start, max(finished_at) AS finish,
              count(*) FILTER (status = 'failed') AS n_failed, bool_and(status IN {FINAL}) AS all_final,
              bool_or(status = 'failed') AS any_failed,
              bool_or(status IN ('stopped','aborted','upstream_failed')) AS any_stopped
            FROM v_tasks GROUP BY 1, 2, 3) t LEFT JOIN v_entries e USING (run_id))"""


@query("g22_runs_of_dates", _DATES)
def _(v):
    return runs.runs_of_dates(v.tasks, v.run_rows)


@query("j13_run_row_or_tasks", f"SELECT run_id, status FROM ({_DATES}) WHERE run_id % 7 = 0")
def _(v):
    return runs.runs_of_dates(v.tasks, v.run_rows).where("run_id % 7 = 0").select("run_id", "status")


@query("w04_latest_run_of_date", """
    SELECT pipeline, run_date::VARCHAR AS run_date, run_id FROM (
      SELECT *, row_number() OVER (PARTITION BY pipeline, run_date ORDER BY s DESC, run_id DESC) AS pos FROM (
        SELECT pipeline, run_date, run_id, min(started_at) AS s FROM v_tasks GROUP BY 1, 2, 3)) WHERE pos = 1""")
def _(v):
    return runs.latest_run_of_date(v.tasks)


@query("j12_registry_runs", """
    SELECT p.name AS pipeline, e.run_id, coalesce(e.status, 'idle') AS status
    FROM v_pipelines p LEFT JOIN v_entries e ON e.pipeline = p.name""")
def _(v):
    named = v.pipelines.select(F.col("name").alias("pipeline"))
    return named.join(entries(v), "pipeline", "left").select(
        "pipeline", "run_id", F.coalesce("status", F.lit("idle")).alias("status"))


@query("g31_group_counts", """
    SELECT lower(trim(group_name)) AS group_key, min_by(trim(group_name), name) AS label, count(*) AS pipelines
    FROM v_pipelines GROUP BY 1""")
def _(v):
    return runs.group_counts(v.pipelines)
