"""Registered checks of the streaming jobs: each must leave what its batch operator gives on the same rows."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from flowgauge.functions import calendar as cal
from flowgauge.session import cut_lineage
from flowgauge.streaming import jobs
from flowgauge.suite import facts as fact_suite
from flowgauge.suite.registry import query
from flowgauge.suite.state import WAKING
from flowgauge.suite.sql_views import NOW_FACTS
from flowgauge.suite.views import FACTS_NOW, facts_of, raw_facts_of, with_gaps


def events(v):
    return jobs.read_parquet_stream(v.spark, v.sf_dir, v.table("events").schema, "events.parquet")


def log_stream(v):
    """The log in two batches, in the files that the tasks which make it write."""
    folder = jobs.new_folder(v.spark, "row-log")
    v.row_log.write.parquet(folder)
    files = len(v.spark.read.schema(v.row_log.schema).parquet(folder).inputFiles())
    return jobs.read_parquet_stream(v.spark, folder, v.row_log.schema, files_per_batch=files // 2 + 1)


def timely_log_stream(v):
    """The log as it comes in time: a batch for what was written before the middle of 1995, and one for the rest.

    A batch is as many files as the first part has, and the second has no more than these.
    """
    folder = jobs.new_folder(v.spark, "row-log")
    early = F.col("at") < F.lit("1995-06-17").cast("timestamp_ntz")
    v.row_log.where(early).write.parquet(folder)
    files = max(1, len(v.spark.read.schema(v.row_log.schema).parquet(folder).inputFiles()))
    v.row_log.where(~early).coalesce(files).write.mode("append").parquet(folder)
    return jobs.read_parquet_stream(v.spark, folder, v.row_log.schema, files_per_batch=files)


@query("r01_ingest_facts", """
    SELECT asset_name, min(event_time)::VARCHAR AS event_time, key AS partition_key, min(day)::VARCHAR AS partition_date,
      min(granularity) AS granularity FROM v_normal WHERE day IS NOT NULL AND granularity IS NOT NULL
    GROUP BY asset_name, event_time, key""", **fact_suite._NORMAL)
def _(v):
    good, _ = jobs.ingest_facts(v.spark, raw_facts_of(facts_of(events(v))), jobs.new_folder(v.spark, "ingest"))
    return good.rows().select("asset_name", "event_time", "partition_key", "partition_date", "granularity")


@query("r02_push_requests", """
    SELECT run_name, consumer, run_date, kind, trigger_asset, first_event_time::VARCHAR AS first_event_time
    FROM v_requests""", **fact_suite._PUSH)
def _(v):
    tree = fact_suite.nodes(v)
    emitted = jobs.push_evaluation(
        v.spark, facts_of(events(v)), fact_suite.subscriptions(v), tree, jobs.new_folder(v.spark, "push"))
    return emitted.rows()


@query("r03_wake_waiting_runs", """
    SELECT run_id, count(DISTINCT task_no) AS waiting_tasks FROM v_tasks WHERE status = 'waiting'
      AND ['click', 'error', 'purchase', 'signup', 'view'][pk % 5 + 1] IN (SELECT asset_name FROM v_facts) GROUP BY 1""")
def _(v):
    return jobs.wake_waiting_runs(
        v.spark, facts_of(events(v)), fact_suite.waits(v), jobs.new_folder(v.spark, "wake")).rows()


@query("r04_wake_changed_runs", f"""
    SELECT run_id, count(*) AS changes FROM v_row_log WHERE old_status IS NOT NULL AND {WAKING} GROUP BY 1""")
def _(v):
    table = jobs.wake_changed_runs(v.spark, log_stream(v), jobs.new_folder(v.spark, "changes"))
    return table.rows().groupBy("run_id").agg(F.sum("changes").alias("changes"))


@query("r05_current_run_status", """
    SELECT run_id, CASE WHEN NOT bool_and(status IN ('success','succeeded','failed','skipped','aborted','upstream_failed',
        'stopped')) THEN 'running' WHEN bool_or(status = 'failed') THEN 'failed'
      WHEN bool_or(status IN ('stopped','aborted','upstream_failed')) THEN 'aborted' ELSE 'success' END AS status FROM (
      SELECT *, new_status AS status, row_number() OVER (PARTITION BY run_id, task_no
        ORDER BY generation_after DESC, "at" DESC, seq DESC) AS n FROM v_row_log) WHERE n = 1 GROUP BY 1""")
def _(v):
    return jobs.current_run_status(v.spark, timely_log_stream(v), jobs.new_folder(v.spark, "status")).rows()


@query("r06_hourly_counts", """
    SELECT date_trunc('hour', event_time)::TIMESTAMP::VARCHAR AS window_start, asset_name, count(*) AS facts
    FROM v_facts GROUP BY 1, 2""")
def _(v):
    return jobs.tumbling_counts(v.spark, facts_of(events(v)), "1 hour", jobs.new_folder(v.spark, "hours"))


def expected(v):
    """Each asset's days (or hours) of January, due a day after they end."""
    kinds = v.facts.select("asset_name", "granularity").distinct()
    moments = F.explode(F.expr("sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-30 00:00:00', interval 1 day)"))
    each = kinds.withColumn("moment", moments)
    g = F.col("granularity")
    start = cal.floor_to_bucket(F.col("moment"), g)
    return each.select("asset_name", cal.format_key(start, g).alias("partition_key"),
                       (cal.advance(start, g) + F.expr("interval 1 day")).alias("due_at")).distinct()


@query("r07_missing_partitions", """
    SELECT asset_name, k AS partition_key, due::VARCHAR AS due_at FROM (SELECT DISTINCT asset_name,
        CASE granularity WHEN 'hourly' THEN strftime(m, '%Y-%m-%dT%H') WHEN 'daily' THEN strftime(m, '%Y-%m-%d')
          WHEN 'weekly' THEN strftime(m, '%G-W%V') ELSE strftime(m, '%Y-%m') END AS k,
        CASE granularity WHEN 'hourly' THEN m + INTERVAL 25 HOUR WHEN 'daily' THEN m + INTERVAL 2 DAY
          WHEN 'weekly' THEN date_trunc('week', m) + INTERVAL 8 DAY
          ELSE date_trunc('month', m) + INTERVAL 1 MONTH + INTERVAL 1 DAY END::TIMESTAMP AS due
      FROM (SELECT DISTINCT asset_name, granularity FROM v_facts),
        unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS s(m))
    WHERE due <= (SELECT max(event_time) FROM v_gappy) AND (asset_name, k) NOT IN (SELECT (asset_name, partition_key) FROM v_gappy)""")
def _(v):
    return jobs.alert_missing(
        v.spark, with_gaps(facts_of(events(v))), expected(v), jobs.new_folder(v.spark, "missing")).rows()


def _on_time(views):
    """The views of push evaluation over the facts that came in time, under names of their own."""
    text = {name.replace("v_", "v_timely_", 1): sql for name, sql in views.items()}
    for name in [*views, "v_facts"]:
        text = {k: re.sub(rf"\b{name}\b", name.replace("v_", "v_timely_", 1), sql) for k, sql in text.items()}
    return {"v_timely_facts": "SELECT * FROM v_facts WHERE event_id % 13 <> 0"} | text


_RECENT = f" AND event_time >= {NOW_FACTS} - INTERVAL 48 HOUR"


@query("r08_late_facts", """
    SELECT run_name, consumer, run_date, kind, trigger_asset, first_event_time::VARCHAR AS first_event_time FROM v_requests
    WHERE run_name NOT IN (SELECT run_name FROM v_timely_requests)""",
       **_on_time(fact_suite._PUSH), **{**fact_suite._PUSH, "v_pairs": fact_suite._PUSH["v_pairs"] + _RECENT})
def _(v):
    """Every thirteenth fact comes late: what the catch-up of the last 48 hours requests beside the stream."""
    tree, subs = fact_suite.nodes(v), fact_suite.subscriptions(v)
    facts = facts_of(events(v))
    tables = jobs.push_evaluation(v.spark, facts.where("event_id % 13 <> 0"), subs, tree, jobs.new_folder(v.spark, "on-time"))
    emitted = tables.rows().select("run_name").withColumn("old", F.lit(True))
    emitted = cut_lineage(emitted)
    jobs.record_late(tables, v.facts.where("event_id % 13 = 0"), 1)
    jobs.replay_late(v.spark, tables, subs, tree, dt.datetime.fromisoformat(FACTS_NOW))
    return tables.rows().join(emitted.hint("merge"), "run_name", "left_anti")


@query("r10_sliding_success", """
    SELECT w::VARCHAR AS window_start, pipeline, count(*) AS completed, count(*) FILTER (ok) AS succeeded FROM (
      SELECT 'pl_' || o_custkey AS pipeline, o_orderstatus = 'O' AS ok, (date_trunc('day', o_orderdate) - to_days(d::INTEGER))::TIMESTAMP AS w
      FROM orders, unnest(range(14)) AS s(d) WHERE o_orderstatus IN ('F', 'O')) GROUP BY 1, 2""")
def _(v):
    schema = v.table("orders").schema
    ended = jobs.read_parquet_stream(v.spark, v.sf_dir, schema, "orders.parquet").selectExpr(
        "concat('pl_', o_custkey) AS pipeline", "o_orderdate AS started_at",
        "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'running' END AS status")
    return jobs.sliding_success(v.spark, ended, jobs.new_folder(v.spark, "sliding")).drop("sla")
