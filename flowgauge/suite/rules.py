"""Registered checks of trigger rules and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgauge.operators import rules
from flowgauge.suite.registry import query
from flowgauge.suite.sql_views import FAILURES, FINAL


@query("j05_upstream_rows", """
    SELECT e.run_id, e.task_no, e.upstream_no, u.status AS upstream_status, u.skip_origin AS upstream_origin,
      u.finished_at::VARCHAR AS upstream_finished_at, u.run_id IS NULL AS upstream_missing
    FROM v_edges e LEFT JOIN v_tasks u ON u.run_id = e.run_id AND u.task_no = e.upstream_no""")
def _(v):
    return rules.upstream_rows(v.edges, v.tasks)


@query("g01_upstream_counts", """
    SELECT run_id, task_no, total, success, failed, skipped, cascading, pending, missing_upstream FROM v_counts""")
def _(v):
    return rules.upstream_counts(v.tasks, v.edges).select(*rules.TASK_KEY, *rules.COUNTS, "missing_upstream")


@query("g02_trigger_verdict", """
    SELECT run_id, task_no, verdict, CASE verdict
      WHEN 'fail' THEN 'unknown trigger_rule ''always''; use a task without dependencies: it starts together with its run'
      WHEN 'ready' THEN CASE WHEN total = 0 THEN 'no upstreams' ELSE trigger_rule || ' is met' END
      WHEN 'wait' THEN 'waiting for its upstreams' WHEN 'upstream_failed' THEN failed || ' upstreams failed'
      ELSE CASE trigger_rule WHEN 'all_success' THEN cascading || ' upstreams were skipped by their own rule'
        WHEN 'one_failed' THEN 'no upstream failed' WHEN 'none_skipped' THEN skipped || ' upstreams were skipped'
        WHEN 'all_skipped' THEN 'not every upstream was skipped (' || skipped || ' of ' || total || ')'
        WHEN 'all_failed' THEN 'not every upstream failed (' || failed || ' of ' || total || ')'
        ELSE 'no upstream succeeded' END END AS reason FROM v_verdicts""")
def _(v):
    judged = rules.evaluate_rules(rules.upstream_counts(v.tasks, v.edges))
    return judged.select(*rules.TASK_KEY, "verdict", "reason")


@query("g03_enabled_at", """
    SELECT v.run_id, v.task_no, (CASE WHEN verdict IN ('wait', 'fail') THEN NULL
        WHEN verdict = 'ready' AND v.trigger_rule = 'one_success' THEN s_at
        WHEN verdict = 'ready' AND v.trigger_rule = 'one_failed' THEN f_at ELSE l_at END)::VARCHAR AS enabled_at,
      CASE WHEN verdict IN ('wait', 'fail') THEN t.started_at
        WHEN verdict = 'ready' AND v.trigger_rule = 'one_success' THEN greatest(coalesce(s_at, t.started_at), t.started_at)
        WHEN verdict = 'ready' AND v.trigger_rule = 'one_failed' THEN greatest(coalesce(f_at, t.started_at), t.started_at)
        ELSE greatest(coalesce(l_at, t.started_at), t.started_at) END::VARCHAR AS enabled_since
    FROM v_verdicts v JOIN v_tasks t USING (run_id, task_no)""")
def _(v):
    judged = rules.evaluate_rules(rules.upstream_counts(v.tasks, v.edges))
    since = rules.enabled_since(F.col("enabled_at"), F.col("started_at"))
    return judged.select(*rules.TASK_KEY, "enabled_at", since.alias("enabled_since"))
