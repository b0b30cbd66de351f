"""Registered checks of feeds, pages, timelines, notifications and the matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgauge.functions import calendar as cal
from flowgauge.operators import feeds, runs
from flowgauge.suite.registry import query
from flowgauge.suite.sql_views import FINAL, NOW_RUNS
from flowgauge.suite.views import runs_now


def entries(v):
    return runs.run_entries(v.run_rows)


def tied(v):
    """Runs whose starts repeat: the start is the day."""
    return v.run_heads.select("run_id", "pipeline", F.col("started_day").alias("started_at"))


@query("p01_older_than_cursor", """
    SELECT backfill_id FROM v_backfills WHERE started_at IS NULL OR started_at < TIMESTAMP '1997-03-01 12:00:00'""")
def _(v):
    before = F.lit("1997-03-01 12:00:00").cast("timestamp_ntz")
    return v.backfills.where(feeds.is_older(F.col("started_at"), before)).select("backfill_id")


@query("p02_feed_dates", """
    SELECT run_id, d::DATE::VARCHAR AS day FROM v_heads, LATERAL (SELECT unnest(generate_series(
      TIMESTAMP '1998-06-17', CASE WHEN run_id % 9 = 0 THEN TIMESTAMP '1998-06-30'
        ELSE least(run_date, DATE '1998-06-30')::TIMESTAMP END, INTERVAL 1 DAY)) AS d)""")
def _(v):
    cursors = v.run_heads.selectExpr(
        "run_id", "CASE WHEN run_id % 9 = 0 THEN 'yesterday' ELSE concat(run_date, 'T10:00:00Z') END AS before")
    return feeds.feed_dates(cursors, F.lit("1998-06-30").cast("date"), 14).select("run_id", "day")


@query("w01_feed_page", """
    SELECT run_id, started_at::VARCHAR AS started_at FROM (SELECT run_id, started_day AS started_at,
      rank() OVER (ORDER BY started_day DESC) AS r FROM v_heads WHERE started_day < TIMESTAMP '2000-01-01') WHERE r <= 50""")
def _(v):
    before = F.lit("2000-01-01").cast("timestamp_ntz")
    return feeds.page(tied(v), 50, before)[0].select("run_id", "started_at")


@query("w02_walked_days", """
    SELECT day::VARCHAR AS day, weight, read FROM (SELECT *, coalesce(sum(weight) OVER (ORDER BY day DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS read FROM (
      SELECT started_day::DATE AS day, sum(task_count)::BIGINT AS weight FROM v_runs GROUP BY 1)) WHERE read < 2000""")
def _(v):
    return feeds.walked_days(v.runs.withColumn("started_at", F.col("started_day")), 2000, F.col("task_count"))


@query("w03_task_page", """
    SELECT * FROM (WITH r AS (SELECT run_id, h.started_day AS d, count(*) AS size, count(*) FILTER (t.status = 'failed') AS kept
        FROM v_heads h JOIN v_tasks t USING (run_id) GROUP BY 1, 2),
      i AS (SELECT d, coalesce(sum(sum(kept)) OVER (ORDER BY d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shown
        FROM r GROUP BY 1)
    SELECT run_id, d::VARCHAR AS started_at, size, kept FROM r JOIN i USING (d) WHERE shown < 100)""")
def _(v):
    counts = v.tasks.groupBy("run_id").agg(
        F.count("*").alias("size"), F.count_if(F.col("status") == "failed").alias("kept"))
    return feeds.task_page(tied(v).join(counts, "run_id"), 100).select("run_id", "started_at", "size", "kept")


@query("w07_timeline", """
    SELECT task_run_id, event_id, event_type, event_time::VARCHAR AS event_time, position, date_diff('second', event_time, f)
      AS stage_seconds FROM (SELECT *, row_number() OVER w AS position, lead(event_time) OVER w AS f FROM v_task_events
      WINDOW w AS (PARTITION BY task_run_id ORDER BY event_time, ord, event_id))""")
def _(v):
    return feeds.timeline(v.task_events)


@query("g23_attempts", """
    SELECT task_run_id, count(*) FILTER (event_type = 'TASK_STARTED') AS starts,
      count(*) FILTER (event_type IN ('TASK_STARTED', 'TASK_RETRY_STARTED')) AS dispatches FROM v_task_events GROUP BY 1""")
def _(v):
    return feeds.attempts(v.task_events)


def alerts(v):
    due = F.expr("CASE WHEN status = 'waiting_decision' THEN CASE WHEN run_id % 31 = 0 THEN timestamp_ntz'9999-01-01 00:00:00'"
                 " ELSE running_at + interval 2 days END ELSE finished_at END")
    return v.tasks.withColumn("due_at", due)


_BELL = {"v_bell": f"""
    SELECT CASE WHEN rank = 0 THEN 'decision_required' ELSE 'failure' END AS type, run_id AS subject, task_no,
      CASE WHEN rank = 0 AND due_at < TIMESTAMP '9999-01-01' THEN due_at END AS deadline,
      CASE WHEN rank = 1 THEN due_at END AS finished_at FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rank, CASE WHEN rank = 0 THEN due_at END,
        due_at DESC, task_no) AS n FROM (
        SELECT run_id, task_no, CASE status WHEN 'failed' THEN 1 ELSE 0 END AS rank, CASE WHEN status = 'failed'
          THEN finished_at WHEN run_id % 31 = 0 THEN TIMESTAMP '9999-01-01' ELSE running_at + INTERVAL 2 DAY END AS due_at
        FROM v_tasks WHERE status IN ('failed', 'waiting_decision'))
      WHERE rank = 0 OR due_at >= {NOW_RUNS} - INTERVAL 2000 DAY) WHERE n = 1
    UNION ALL SELECT 'backfill', backfill_id, NULL, NULL, finished_at FROM v_backfills
      WHERE status IN ('completed', 'failed', 'partial', 'canceled') AND finished_at >= {NOW_RUNS} - INTERVAL 2000 DAY
    UNION ALL SELECT 'warning', run_id, NULL, NULL, started_at FROM v_heads
      WHERE run_id % 53 = 0 AND started_at >= {NOW_RUNS} - INTERVAL 2000 DAY"""}
_BELL_COLUMNS = "type, subject, task_no, deadline::VARCHAR AS deadline, finished_at::VARCHAR AS finished_at"


def bell(v):
    warnings = v.run_heads.where("run_id % 53 = 0").select("run_id", F.col("started_at").alias("finished_at"))
    since = runs_now() - F.expr("interval 2000 days")
    return feeds.notification_entries(alerts(v), v.backfills, warnings, since)


@query("w08_notifications", f"""
    SELECT {_BELL_COLUMNS} FROM v_bell ORDER BY type <> 'decision_required', deadline NULLS LAST,
      v_bell.finished_at DESC NULLS LAST, type, subject LIMIT 50""".replace("deadline NULLS", "v_bell.deadline NULLS"), **_BELL)
def _(v):
    return feeds.notifications(bell(v), 50)


@query("u02_notification_union", f"SELECT {_BELL_COLUMNS} FROM v_bell", **_BELL)
def _(v):
    return bell(v)


@query("w09_attention_scan", """
    SELECT run_id, task_no, finished_at::VARCHAR AS due_at FROM v_tasks WHERE status = 'failed'
      AND finished_at >= TIMESTAMP '2000-01-01'""")
def _(v):
    failed = alerts(v).where("status = 'failed' AND due_at >= timestamp_ntz'2000-01-01 00:00:00'")
    return failed.orderBy(F.desc("due_at")).select("run_id", "task_no", "due_at")


@query("w14_children", f"""
    SELECT run_id, task_no, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN pk % 6 <> 0 THEN started_at END
      NULLS FIRST, task_name) AS position FROM v_tasks""")
def _(v):
    rows = v.tasks.withColumn("started_at", F.expr("CASE WHEN pk % 6 <> 0 THEN started_at END"))
    return feeds.ordered_children(rows).select("run_id", "task_no", "position")


@query("u01_unified_feed", """
    SELECT 'execution' AS kind, run_id AS id, pipeline, status, started_at::VARCHAR AS started_at,
      finished_at::VARCHAR AS finished_at, failed_tasks, NULL AS total_partitions FROM v_entries
    UNION ALL SELECT 'backfill', backfill_id, target_pipeline, status, started_at::VARCHAR, finished_at::VARCHAR, NULL, total
    FROM v_backfills""")
def _(v):
    return feeds.unified_feed(entries(v), v.backfills)


@query("j10_runs_of_day", """
    SELECT run_id FROM v_heads WHERE CASE run_id % 4 WHEN 0 THEN run_date = DATE '1998-06-17'
      WHEN 1 THEN run_date = DATE '1998-06-17' WHEN 2 THEN strftime(run_date, '%G-W%V') = '1998-W25'
      ELSE strftime(run_date, '%Y-%m') = '1998-06' END""")
def _(v):
    granularity = F.expr("element_at(array('hourly', 'daily', 'weekly', 'monthly'), cast(run_id % 4 AS int) + 1)")
    keyed = v.run_heads.withColumn("run_key", cal.format_key(F.col("started_at"), granularity))
    return feeds.runs_of_day(keyed, "1998-06-17").select("run_id")


@query("g21_asset_matrix", """
    SELECT a.asset, d::DATE::VARCHAR AS run_date, CASE WHEN m.runs THEN 'running'
      WHEN m.last IN ('success', 'succeeded') THEN 'materialized' WHEN m.last IN ('failed', 'aborted', 'stopped') THEN 'failed'
      WHEN m.asset IS NULL AND a.asset IN ('asset_2', 'asset_3') THEN 'queued' END AS cell
    FROM (SELECT DISTINCT 'asset_' || (pk % 40) AS asset FROM v_tasks_all) a,
      unnest(generate_series(TIMESTAMP '1998-06-01', TIMESTAMP '1998-06-30', INTERVAL 1 DAY)) AS s(d)
    LEFT JOIN (SELECT 'asset_' || (pk % 40) AS asset, run_date, bool_or(status = 'running') AS runs,
        arg_max(status, (finished_at, status)) FILTER (finished_at IS NOT NULL) AS last FROM v_tasks GROUP BY 1, 2) m
      ON m.asset = a.asset AND m.run_date = d::DATE""")
def _(v):
    key = F.expr("pk % 40")
    producers = v.tasks_all.select(key.alias("task_name_key")).distinct().withColumn(
        "asset", F.concat(F.lit("asset_"), F.col("task_name_key").cast("string")))
    consumed = producers.where("asset IN ('asset_2', 'asset_3')")
    return feeds.asset_matrix(
        v.tasks.withColumn("task_name_key", key), producers, consumed, "1998-06-01", "1998-06-30")


@query("j16_matrix_grid", """
    SELECT DISTINCT 'asset_' || (pk % 40) AS asset, d::DATE::VARCHAR AS run_date FROM v_tasks_all,
      unnest(generate_series(TIMESTAMP '1998-06-01', TIMESTAMP '1998-06-30', INTERVAL 1 DAY)) AS s(d)""")
def _(v):
    producers = v.tasks_all.selectExpr("pk % 40 AS task_name_key").distinct().withColumn(
        "asset", F.expr("concat('asset_', task_name_key)"))
    grid = feeds.asset_matrix(v.tasks.withColumn("task_name_key", F.expr("pk % 40")), producers,
                              producers.where("false"), "1998-06-01", "1998-06-30")
    return grid.select("asset", "run_date")
