"""Registered checks of deadlines, pauses, queues and liveness."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgauge.operators import deadlines as dl
from flowgauge.suite.registry import query
from flowgauge.suite.sql_views import NOW_RUNS
from flowgauge.suite.views import runs_now

KEY = ["run_id", "task_no"]


def moved(start: str, limit: str) -> str:
    first = (f"CASE WHEN s1 < {start} + {limit} AND e1 > greatest(s1, {start})"
             f" THEN {start} + {limit} + (e1 - greatest(s1, {start})) ELSE {start} + {limit} END")
    return f"(CASE WHEN s2 IS NULL OR s2 >= {first} THEN {first} END)"


_TIMES = {"v_times": f"""
    SELECT *, CASE WHEN status = 'waiting' THEN coalesce(countdown_end, wait_at)
        WHEN status = 'deps_ready' THEN CASE WHEN NOT paused THEN coalesce(next_try, check_at) END
        WHEN status = 'running' THEN check_at WHEN status = 'waiting_decision' THEN decide_at END AS due_at
    FROM (SELECT *,
      CASE WHEN countdown_end IS NOT NULL OR paused THEN NULL
        WHEN orchestration_timeout IS NOT NULL THEN {moved('waiting_since', 'orchestration_timeout')}
        WHEN has_wait_for AND enabled_at IS NOT NULL THEN {moved('enabled_at', 'INTERVAL 7 DAY')} END AS wait_at,
      CASE WHEN decision_since IS NOT NULL AND decision_timeout IS NOT NULL THEN CASE WHEN paused
        THEN TIMESTAMP '9999-01-01' ELSE {moved('decision_since', 'decision_timeout')} END END AS decide_at,
      CASE WHEN start_failures >= 1 AND start_failed_first IS NOT NULL THEN start_failed_last
        + to_seconds([30, 60, 120, 300][least(start_failures, 4)]) END AS next_try,
      CASE WHEN start_failures >= 1 AND start_failed_first IS NOT NULL THEN {moved('start_failed_first', 'INTERVAL 15 MINUTE')} END AS warn_at,
      CASE WHEN start_failures >= 1 AND start_failed_first IS NOT NULL THEN {moved('start_failed_first', 'INTERVAL 6 HOUR')} END AS fail_at,
      coalesce(last_check, status_since) + to_minutes([10, 20, 30][least(checks, 2) + 1]) AS check_at
    FROM v_row_times)"""}


@query("t01_moved_deadline", f"""
    SELECT run_id, task_no, {moved('waiting_since', 'INTERVAL 3 HOUR')}::VARCHAR AS deadline FROM v_row_times""")
def _(v):
    deadline = dl.moved(F.col("waiting_since"), F.expr("make_dt_interval(0, 3)"), F.col("pauses"))
    return v.row_times.select(*KEY, deadline.alias("deadline"))


@query("t02_wait_deadline", "SELECT run_id, task_no, wait_at::VARCHAR AS due FROM v_times", **_TIMES)
def _(v):
    return v.row_times.select(*KEY, dl.wait_deadline().alias("due"))


@query("t03_decision_deadline", """
    SELECT run_id, task_no, (CASE WHEN paused THEN NULL ELSE decide_at END)::VARCHAR AS shown FROM v_times
    WHERE status = 'waiting_decision'""", **_TIMES)
def _(v):
    rows = v.row_times.where("status = 'waiting_decision'")
    return rows.select(*KEY, dl.shown_deadline(dl.decision_deadline()).alias("shown"))


@query("t04_start_deadlines", """
    SELECT run_id, task_no, next_try::VARCHAR AS next_try, warn_at::VARCHAR AS warn_at, fail_at::VARCHAR AS fail_at
    FROM v_times""", **_TIMES)
def _(v):
    return v.row_times.select(*KEY, *[c.alias(n) for n, c in dl.start_deadlines().items()])


@query("t05_due_time", "SELECT run_id, task_no, due_at::VARCHAR AS due_at FROM v_times", **_TIMES)
def _(v):
    return v.row_times.select(*KEY, dl.due_time().alias("due_at"))


@query("t06_expired_rows", f"""
    SELECT run_id, task_no, kind, expired_at::VARCHAR AS expired_at, CASE kind
      WHEN 'wait' THEN 'it waited past its limit at ' || expired_at::VARCHAR || ': 1 upstreams pending; asset a' || task_no
      WHEN 'decision' THEN 'no decision came within its decision timeout of ' || CASE hours // 24 WHEN 0 THEN '' WHEN 1 THEN '1 day, '
        ELSE hours // 24 || ' days, ' END || hours % 24 || ':00:00'
      ELSE 'its start kept failing for 6:00:00: ' || CASE WHEN task_no % 2 = 0 THEN 'throttled' ELSE 'no error kept' END END AS cause FROM (
      SELECT run_id, task_no, CASE WHEN status = 'waiting' AND wait_at <= {NOW_RUNS} THEN 'wait'
          WHEN status = 'waiting_decision' AND decide_at <= {NOW_RUNS} THEN 'decision'
          WHEN status = 'deps_ready' AND fail_at <= {NOW_RUNS} THEN 'start' END AS kind,
        CASE status WHEN 'waiting' THEN wait_at WHEN 'waiting_decision' THEN decide_at ELSE fail_at END AS expired_at,
        1 + sk % 48 AS hours
      FROM v_times JOIN (SELECT run_id, task_no, sk FROM v_tasks) USING (run_id, task_no)) WHERE kind IS NOT NULL""", **_TIMES)
def _(v):
    known = v.row_times.withColumns({
        "reasons": F.expr("array('1 upstreams pending', concat('asset a', task_no))"),
        "error": F.expr("CASE WHEN task_no % 2 = 0 THEN 'throttled' END")})
    return dl.expired_rows(known, runs_now())


@query("t07_countdown", """
    SELECT run_id, task_no, (CASE WHEN pk % 600 > 0 THEN running_at + to_seconds(pk % 600) END)::VARCHAR AS ends_at
    FROM v_tasks""")
def _(v):
    return v.tasks.select(*KEY, dl.countdown_end(F.col("running_at"), F.expr("pk % 600")).alias("ends_at"))


@query("t08_pause_intervals", """
    SELECT run_id, n, "at"::VARCHAR AS "start", e::VARCHAR AS "end" FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY "at" DESC) AS n FROM (
        SELECT *, lead("at") OVER (PARTITION BY run_id ORDER BY "at", event_id) AS e FROM (
          SELECT *, coalesce(lag(action) OVER (PARTITION BY run_id ORDER BY "at", event_id), 'resume') AS p FROM v_run_events)
        WHERE action <> p) WHERE action = 'pause')""")
def _(v):
    from pyspark.sql import Window
    n = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("start")))
    return dl.pause_intervals(v.run_events).withColumn("n", n)


def hints(v):
    return v.row_times.join(v.tasks.select("run_id", "task_no", "task_name", "pk"), KEY).withColumns({
        "left_at": F.expr("run_id % 13 = 0"), "countdown_ended": F.expr("countdown_end IS NOT NULL"),
        "resumed_at": F.expr("CASE WHEN pk % 2 = 0 THEN array_max(transform(pauses, p -> p.end)) END")})


def check_time():
    return F.expr("waiting_since + make_dt_interval(0, 0, 30)")


_LOST = {"v_lost": """
    SELECT r.run_id, r.task_no, t.task_name FROM v_row_times r JOIN v_tasks t USING (run_id, task_no)
    WHERE r.run_id % 13 <> 0 AND countdown_end IS NULL AND enabled_at IS NOT NULL
      AND greatest(enabled_at, CASE WHEN pk % 2 = 0 THEN e1 END) < waiting_since + INTERVAL 25 MINUTE"""}


@query("t09_lost_hints", "SELECT run_id, task_no FROM v_lost", **_LOST)
def _(v):
    return dl.lost_hints(hints(v), check_time()).select(*KEY)


@query("g30_lost_hint_warnings", """
    SELECT run_id, max(c) AS tasks, string_agg(task_name, ', ' ORDER BY task_name) FILTER (n <= 2) ||
      CASE WHEN max(c) > 2 THEN ' and ' || (max(c) - 2) || ' more' ELSE '' END AS names FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY task_name) AS n, count(*) OVER (PARTITION BY run_id) AS c
      FROM v_lost) GROUP BY 1""", **_LOST)
def _(v):
    return dl.lost_hint_warnings(dl.lost_hints(hints(v), check_time()), names=2)


@query("t10_dead_work", """
    SELECT r.run_id, r.task_no, CASE WHEN e.execution_status = 'FAILED' THEN 'fail'
      WHEN e.execution_status IS NOT NULL THEN 'check' WHEN r.status = 'deps_ready' THEN 'restart' ELSE 'fail' END AS verdict
    FROM v_row_times r LEFT JOIN v_executions e USING (run_id, task_no) WHERE r.status IN ('deps_ready', 'running')""")
def _(v):
    return dl.dead_work(v.row_times, v.executions, runs_now() + F.expr("interval 1 day"))


@query("g28_queue_health", f"""
    SELECT (min(due_at) FILTER (due_at <= {NOW_RUNS}))::VARCHAR AS oldest_due,
      count(*) FILTER (due_at <= {NOW_RUNS}) AS overdue, count(*) FILTER (start_failures > 0) AS retries FROM v_times""",
       **_TIMES)
def _(v):
    return dl.queue_health(v.row_times, runs_now())


@query("w10_due_runs", f"""
    SELECT run_id, min(due_at)::VARCHAR AS due_at FROM v_times WHERE due_at <= {NOW_RUNS} GROUP BY 1""", **_TIMES)
def _(v):
    return dl.due_runs(v.row_times, runs_now())


@query("w11_fair_quota", f"""
    WITH due AS (SELECT run_id, task_no, due_at, row_number() OVER (PARTITION BY run_id ORDER BY due_at, task_no) AS n
      FROM v_times WHERE status IN ('deps_ready', 'running') AND due_at <= {NOW_RUNS}),
    per_run AS (SELECT run_id, min(due_at) AS d, count(*) AS w FROM due WHERE n <= 50 GROUP BY 1),
    shares AS (SELECT run_id, 150 - coalesce(sum(w) OVER (ORDER BY d, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS l FROM per_run)
    SELECT run_id, task_no, due_at::VARCHAR AS due_at FROM due JOIN shares USING (run_id) WHERE n <= 50 AND n <= l
    """.replace("WITH due", "SELECT * FROM (WITH due") + ")", **_TIMES)
def _(v):
    return dl.fair_quota(v.row_times, runs_now(), total=200)
