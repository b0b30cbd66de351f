"""Registered checks of graphs and backfills."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from flowgauge.functions import calendar as cal
from flowgauge.operators import backfills as bf
from flowgauge.plans import graph
from flowgauge.suite.registry import query
from flowgauge.suite.sql_views import FAILURES, FINAL, VIEWS

_FORMAT = """CASE {g} WHEN 'daily' THEN strftime({t}, '%Y-%m-%d') WHEN 'weekly' THEN strftime({t}, '%G-W%V')
    ELSE strftime({t}, '%Y-%m') END"""
_FLOOR = """CASE {g} WHEN 'weekly' THEN date_trunc('week', {t}) WHEN 'monthly' THEN date_trunc('month', {t}) ELSE {t} END"""
_STEP = "CASE {g} WHEN 'daily' THEN INTERVAL 1 DAY WHEN 'weekly' THEN INTERVAL 7 DAY ELSE INTERVAL 1 MONTH END"


@query("n01_asset_graph", """
    SELECT DISTINCT outlet AS asset, pipeline, 'producer' AS role FROM v_task_io
    UNION SELECT unnest(inlets), pipeline, 'consumer' FROM v_task_io""")
def _(v):
    return graph.asset_graph(v.task_io)


@query("g26_producer_check", """
    SELECT asset, count(DISTINCT pipeline) FILTER (role = 'producer') AS producers FROM (
      SELECT outlet AS asset, pipeline, 'producer' AS role FROM v_task_io
      UNION ALL SELECT unnest(inlets), pipeline, 'consumer' FROM v_task_io) GROUP BY 1 HAVING producers <> 1""")
def _(v):
    return graph.producer_check(v.task_io)


@query("n02_cross_dependencies", """
    SELECT DISTINCT w.outlet AS asset, w.i AS upstream FROM (SELECT pipeline, outlet, unnest(inlets) AS i FROM v_task_io) w
    JOIN (SELECT outlet, min_by(pipeline, ordinal) AS owner FROM v_task_io GROUP BY 1) p ON p.outlet = w.i
    WHERE owner <> w.pipeline""")
def _(v):
    return graph.cross_dependencies(v.task_io)[1]


@query("n12_run_graph", """
    SELECT t.run_id, t.task_no, coalesce(string_agg(e.upstream_no::VARCHAR, ',' ORDER BY e.upstream_no), '') AS dependencies
    FROM v_tasks t LEFT JOIN v_edges e USING (run_id, task_no) GROUP BY 1, 2""")
def _(v):
    return graph.graph_of_tasks(v.tasks, v.edges).withColumn("dependencies", F.array_join("dependencies", ","))


_CLEAN = {"v_clean": """SELECT e.* FROM v_edges e JOIN v_tasks a USING (run_id, task_no)
    JOIN v_tasks u ON u.run_id = e.run_id AND u.task_no = e.upstream_no"""}


def graph_nodes(tasks):
    return tasks.select(F.col("run_id").alias("graph"), F.col("task_no").alias("node"))


def graph_edges(edges):
    return edges.select(F.col("run_id").alias("graph"), F.col("task_no").alias("node"), F.col("upstream_no").alias("upstream"))


@query("n05_levels", """
    SELECT graph, node, max(n) AS level FROM walk GROUP BY 1, 2""", walk="""
    SELECT run_id AS graph, task_no AS node, 0 AS n FROM v_tasks
    UNION SELECT w.graph, e.task_no, w.n + 1 FROM walk w JOIN v_clean e ON e.run_id = w.graph AND e.upstream_no = w.node""",
       **_CLEAN)
def _(v):
    return graph.levels(graph_nodes(v.tasks), graph_edges(v.edges))[0]


@query("n05_reverse_levels", "SELECT graph, node, max(n) AS level FROM walk GROUP BY 1, 2", walk="""
    SELECT run_id AS graph, task_no AS node, 0 AS n FROM v_tasks
    UNION SELECT w.graph, e.upstream_no, w.n + 1 FROM walk w JOIN v_clean e ON e.run_id = w.graph AND e.task_no = w.node""",
       **_CLEAN)
def _(v):
    return graph.levels(graph_nodes(v.tasks), graph_edges(v.edges), reverse=True)[0]


@query("n04_graph_problems", """
    SELECT run_id, task_no, 'unknown dependency' AS problem FROM v_edges e WHERE NOT EXISTS (
      SELECT 1 FROM v_tasks u WHERE u.run_id = e.run_id AND u.task_no = e.upstream_no)
    UNION SELECT run_id, task_no, 'cycle' FROM v_tasks_all WHERE run_id % 50 = 0 AND run_id IN (
      SELECT run_id FROM v_tasks_all WHERE task_no = 2)""")
def _(v):
    unknown = graph.unknown_dependencies(v.tasks, v.edges).select("run_id", "task_no").distinct()
    looped = v.edges.select("run_id", F.explode(F.expr(
        "CASE WHEN run_id % 50 = 0 AND task_no = 2 AND upstream_no = 1 THEN array(struct(task_no, upstream_no), struct(1 AS task_no, 2 AS upstream_no))"
        " ELSE array(struct(task_no, upstream_no)) END")).alias("e")).select("run_id", "e.*")
    _, stuck = graph.levels(graph_nodes(v.tasks_all), graph_edges(looped))
    cyclic = stuck.select(F.col("graph").alias("run_id"), F.col("node").alias("task_no"), F.lit("cycle").alias("problem"))
    return unknown.withColumn("problem", F.lit("unknown dependency")).unionByName(cyclic)


@query("n09_descendants", "SELECT DISTINCT graph, root, node FROM walk", walk="""
    SELECT e.run_id AS graph, e.upstream_no AS root, e.task_no AS node FROM v_edges e JOIN v_tasks t
      ON t.run_id = e.run_id AND t.task_no = e.upstream_no AND t.status = 'failed'
    UNION SELECT w.graph, w.root, e.task_no FROM walk w JOIN v_edges e ON e.run_id = w.graph AND e.upstream_no = w.node""")
def _(v):
    failed = v.tasks.where("status = 'failed'")
    return graph.descendants(graph_edges(v.edges), graph_nodes(failed).withColumnRenamed("node", "root"))


@query("n03_trigger_cycles", """
    SELECT list_aggregate(list_transform(range(1, len(nodes) + 1), lambda i: nodes[i] || ' → ' || labels[i] || ' →'),
      'string_agg', ' ') || ' ' || nodes[1] AS path FROM walk WHERE pos = nodes[1]""", walk="""
    SELECT [src] AS nodes, [label] AS labels, dst AS pos FROM v_triggers
    UNION ALL SELECT list_append(nodes, w.pos), list_append(labels, t.label), t.dst FROM walk w JOIN v_triggers t
      ON t.src = w.pos WHERE w.pos > nodes[1] AND NOT list_contains(nodes, w.pos) AND len(nodes) < 5 AND t.dst >= nodes[1]""")
def _(v):
    return graph.trigger_cycles(v.triggers).select("path")


COLUMNS = ["run_id", "task_no", "trigger_rule", "status", "skip_origin", "finished_at"]


def _unrolled(moved: str, origin: str, more: str = "") -> dict[str, str]:
    """One view for each task number, judged over the views of those before it: an upstream has a lower number.

    ``moved`` and ``origin`` give a row's status and skip origin from ``j`` (its verdict, its missing upstream, whether it is
    ``below`` a failed row); views are cumulative and end with ``v_done_g``.
    """
    views, before, reached = {}, "", ""
    for number, letter in enumerate("abcdefg", 1):
        below = "SELECT e.run_id, e.task_no FROM v_edges e JOIN v_tasks f ON f.run_id = e.run_id AND f.task_no = e.upstream_no" \
                f" AND f.status = 'failed' WHERE e.task_no <= {number}"
        views[f"v_below_{letter}"] = below if not reached else f"""{below} UNION SELECT run_id, task_no FROM {reached}
            UNION SELECT e.run_id, e.task_no FROM v_edges e JOIN {reached} u ON u.run_id = e.run_id AND u.task_no = e.upstream_no
              WHERE e.task_no = {number}"""
        reached = f"v_below_{letter}"
        ups = before or "(SELECT run_id, task_no, status, skip_origin FROM v_tasks WHERE false)"
        views[f"v_judged_{letter}"] = f"""
            SELECT c.*, {_VERDICT} AS verdict, (run_id, task_no) IN (SELECT (run_id, task_no) FROM {reached}) AS below FROM (
              SELECT t.run_id, t.task_no, t.trigger_rule, t.status, t.skip_origin, count(u.run_id) AS total,
                count(*) FILTER (u.status IN ('success','succeeded')) AS success,
                count(*) FILTER (u.status IN {FAILURES}) AS failed, count(*) FILTER (u.status = 'skipped') AS skipped,
                count(*) FILTER (u.status = 'skipped' AND u.skip_origin = 'rule') AS cascading,
                count(*) FILTER (u.run_id IS NOT NULL AND u.status NOT IN {FINAL}) AS pending,
                count(*) FILTER (e.upstream_no IS NOT NULL AND u.run_id IS NULL) AS missing
              FROM v_tasks t LEFT JOIN v_edges e ON e.run_id = t.run_id AND e.task_no = t.task_no
              LEFT JOIN {ups} u ON u.run_id = e.run_id AND u.task_no = e.upstream_no
              WHERE t.task_no = {number} GROUP BY 1, 2, 3, 4, 5) c"""
        own = f"SELECT run_id, task_no, {moved} AS status, {origin} AS skip_origin{more} FROM v_judged_{letter} j"
        views[f"v_done_{letter}"] = own if not before else f"SELECT * FROM {before} UNION ALL {own}"
        before = f"v_done_{letter}"
    return views


_VERDICT = re.search(r"CASE WHEN trigger_rule = 'always'.*?END AS verdict", VIEWS["v_verdicts"], re.S)[0].removesuffix(" AS verdict")
_WAITS = "status IN ('waiting', 'waiting_paused')"
_SETTLED = _unrolled(
    f"""CASE WHEN NOT {_WAITS} THEN status WHEN missing > 0 OR verdict = 'fail' THEN 'failed' WHEN verdict = 'skip' THEN 'skipped'
      WHEN verdict = 'upstream_failed' THEN 'upstream_failed' WHEN verdict = 'ready' THEN 'deps_ready' ELSE status END""",
    f"CASE WHEN {_WAITS} AND missing = 0 AND verdict = 'skip' THEN 'rule' ELSE skip_origin END")
_CHANGED = """below AND missing = 0 AND (status = 'upstream_failed' AND verdict <> 'upstream_failed'
    OR status = 'skipped' AND coalesce(skip_origin = 'rule', false) AND verdict <> 'skip')"""
_RESET = _unrolled(f"CASE WHEN {_CHANGED} THEN 'waiting' ELSE status END", f"CASE WHEN NOT ({_CHANGED}) THEN skip_origin END",
                   f", {_CHANGED} AS reset")


@query("n11_settled_rows", "SELECT run_id, task_no, status, skip_origin FROM v_done_g", **_SETTLED)
def _(v):
    return graph.settle(v.tasks, v.edges, COLUMNS).select("run_id", "task_no", "status", "skip_origin")


@query("n10_reset_set", "SELECT run_id, task_no FROM v_done_g WHERE reset", **_RESET)
def _(v):
    return graph.reset_set(v.tasks, v.edges, v.tasks.where("status = 'failed'"), COLUMNS)


def plan_parts(v):
    nodes = v.lineage_nodes
    owners = nodes.select(F.col("asset").alias("upstream"), F.col("pipeline").alias("owner"))
    edges = v.lineage_edges.join(nodes.select("asset", "pipeline").hint("merge"), "asset").join(owners.hint("merge"), "upstream").where(
        "owner <> pipeline").select("asset", "upstream")
    start = F.lit("2024-01-15").cast("timestamp_ntz")
    targets = nodes.join(edges.select(F.col("upstream").alias("asset")).distinct().hint("merge"), "asset", "left_anti").select(
        F.col("asset").alias("target"), cal.format_key(start, F.col("granularity")).alias("partition"))
    complete = nodes.where("pipeline LIKE '%2%'").select(
        "pipeline", F.explode(F.array(F.lit("2024-01"), F.lit("2024-W03"), F.lit("2024-01-08"))).alias("partition")).distinct()
    return nodes, edges, targets, complete


_PLAN = {"v_plan_edges": """
    SELECT e.asset, e.upstream, n.granularity AS g, u.granularity AS ug FROM v_lineage_edges e
    JOIN v_lineage_nodes n USING (asset) JOIN v_lineage_nodes u ON u.asset = e.upstream WHERE n.pipeline <> u.pipeline""",
    "v_plan_targets": f"""SELECT asset AS target, {_FLOOR.format(g='granularity', t="TIMESTAMP '2024-01-15'")}::TIMESTAMP AS t
      FROM v_lineage_nodes WHERE asset NOT IN (SELECT upstream FROM v_plan_edges)"""}


@query("n07_backfill_plan", f"""
    SELECT target, deepest - depth AS tier, asset, pipeline, k AS partition, NOT (asset = target) AND
      pipeline LIKE '%2%' AND k IN ('2024-01', '2024-W03', '2024-01-08') AS reused FROM (
      SELECT *, {_FORMAT.format(g='granularity', t='t')} AS k, max(depth) OVER (PARTITION BY target) AS deepest FROM (
        SELECT target, asset, t, max(depth) AS depth FROM walk GROUP BY 1, 2, 3) JOIN v_lineage_nodes USING (asset))""",
       walk=f"""
    SELECT target, target AS asset, t, 0 AS depth FROM v_plan_targets
    UNION SELECT w.target, e.upstream, x, w.depth + 1 FROM walk w JOIN v_plan_edges e ON e.asset = w.asset,
      LATERAL (SELECT unnest(generate_series(({_FLOOR.format(g='e.ug', t='w.t')})::TIMESTAMP,
        (w.t + {_STEP.format(g='e.g')} - INTERVAL 1 MICROSECOND)::TIMESTAMP, {_STEP.format(g='e.ug')})) AS x) b""", **_PLAN)
def _(v):
    return graph.backfill_plan(*plan_parts(v))


@query("j07_covering_join", f"""
    SELECT e.asset, e.upstream, u.granularity AS upstream_granularity, {_FORMAT.format(g='u.granularity', t='t')} AS upstream_key
    FROM v_lineage_edges e JOIN v_lineage_nodes n USING (asset) JOIN v_lineage_nodes u ON u.asset = e.upstream,
      LATERAL (SELECT {_FLOOR.format(g='n.granularity', t="TIMESTAMP '2024-01-15'")} AS s) a,
      LATERAL (SELECT unnest(generate_series(({_FLOOR.format(g='u.granularity', t='s')})::TIMESTAMP,
        (s + {_STEP.format(g='n.granularity')} - INTERVAL 1 MICROSECOND)::TIMESTAMP, {_STEP.format(g='u.granularity')})) AS t) b""")
def _(v):
    nodes = v.lineage_nodes.select("asset", "granularity")
    ups = nodes.select(F.col("asset").alias("upstream"), F.col("granularity").alias("upstream_granularity"))
    key = cal.format_key(F.lit("2024-01-15").cast("timestamp_ntz"), F.col("granularity"))
    return v.lineage_edges.join(nodes, "asset").join(ups, "upstream").select(
        "asset", "upstream", "upstream_granularity",
        F.explode(cal.covering_keys(key, F.col("granularity"), F.col("upstream_granularity"))).alias("upstream_key"))


@query("n08_run_frontier", """
    SELECT DISTINCT graph, root, node FROM walk""", walk="""
    SELECT run_id AS graph, max(task_no) AS root, max(task_no) AS node FROM v_tasks_all GROUP BY 1
    UNION SELECT w.graph, w.root, e.upstream_no FROM walk w JOIN v_edges e ON e.run_id = w.graph AND e.task_no = w.node
      JOIN v_tasks_all a ON a.run_id = e.run_id AND a.task_no = e.upstream_no AND a.pk % 10 <> 0
      LEFT JOIN v_tasks t ON t.run_id = e.run_id AND t.task_no = e.upstream_no
      WHERE t.status IS NULL OR t.status NOT IN ('success', 'succeeded')""")
def _(v):
    tasks = v.tasks_all.join(v.tasks.select("run_id", "task_no", "status"), ["run_id", "task_no"], "left")
    nodes = tasks.select(F.col("run_id").alias("graph"), F.col("task_no").alias("node"), "status", "pk")
    producers = nodes.groupBy("graph").agg(F.max("node").alias("root"))
    missing = nodes.where("status IS NULL OR status NOT IN ('success', 'succeeded')")
    return graph.run_frontier(graph_edges(v.edges), producers, missing, nodes.where("pk % 10 = 0"))


# Backfills.


@query("g17_backfill_status", """
    SELECT backfill_id, total, completed, failed, CASE WHEN canceled THEN 'canceled' WHEN completed + failed < total
      THEN 'running' WHEN failed = 0 THEN 'completed' WHEN completed = 0 THEN 'failed' ELSE 'partial' END AS status FROM (
      SELECT backfill_id, bool_or(canceled) AS canceled, count(*) AS total, count(*) FILTER (outcome = 'completed') AS completed,
        count(*) FILTER (outcome = 'failed') AS failed FROM v_outcomes GROUP BY 1)""")
def _(v):
    return bf.backfill_status(v.outcomes)


@query("g18_tier_gate", """
    SELECT backfill_id, tier, items, canceled OR coalesce(sum(f) OVER (PARTITION BY backfill_id ORDER BY tier
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS skipped FROM (
      SELECT backfill_id, tier, count(*) AS items, count(*) FILTER (outcome = 'failed') AS f, bool_or(canceled) AS canceled
      FROM v_outcomes GROUP BY 1, 2)""")
def _(v):
    return bf.gate_tiers(v.outcomes)


@query("g19_executable", """
    SELECT backfill_id, count(*) FILTER (NOT reused) AS executable, count(*) AS items FROM v_outcomes GROUP BY 1""")
def _(v):
    return bf.count_executable(v.outcomes)


_DONE = {"v_done": """
    SELECT pipeline, run_date::VARCHAR AS partition FROM (
      SELECT pipeline, run_date, count(DISTINCT task_name) FILTER (status IN ('success', 'succeeded')) AS done
      FROM v_tasks GROUP BY 1, 2) JOIN (SELECT pipeline, count(DISTINCT task_name) AS wanted FROM v_tasks GROUP BY 1)
    USING (pipeline) WHERE done = wanted"""}


def dated_tasks(v):
    return v.tasks.withColumn("partition", F.col("run_date").cast("string"))


def complete(v):
    expected = v.tasks.where("run_id >= 0").select("pipeline", "task_name").distinct()
    return bf.completed_partitions(dated_tasks(v), expected)


@query("g15_completed_partitions", "SELECT pipeline, partition FROM v_done", **_DONE)
def _(v):
    return complete(v)


@query("j11_partitions_to_run", """
    SELECT DISTINCT pipeline, run_date::VARCHAR AS partition FROM v_heads ANTI JOIN v_done ON v_done.pipeline = v_heads.pipeline
      AND v_done.partition = v_heads.run_date::VARCHAR""", **_DONE)
def _(v):
    asked = v.run_heads.select("pipeline", F.col("run_date").cast("string").alias("partition")).distinct()
    return bf.skip_completed(asked, complete(v))


@query("g16_output_missing", """
    SELECT e.pipeline, e.task_name, coalesce(d.done, 0) < a.asked AS missing
    FROM (SELECT DISTINCT pipeline, task_name FROM v_tasks) e
    JOIN (SELECT pipeline, count(DISTINCT run_date) AS asked FROM v_heads WHERE year(run_date) = 1997 GROUP BY 1) a USING (pipeline)
    LEFT JOIN (SELECT pipeline, task_name, count(DISTINCT run_date) AS done FROM v_tasks
      WHERE status IN ('success', 'succeeded') AND year(run_date) = 1997 GROUP BY 1, 2) d USING (pipeline, task_name)""")
def _(v):
    asked = v.run_heads.where("year(run_date) = 1997").select(
        "pipeline", F.col("run_date").cast("string").alias("partition")).distinct()
    return bf.output_missing(dated_tasks(v), v.tasks.select("pipeline", "task_name").distinct(), asked)


@query("u03_retry_selection", """
    WITH asked AS (SELECT DISTINCT backfill_id, partition_key FROM v_outcomes WHERE backfill_id % 3 > 0
        AND item % 4 = 0 AND (outcome = 'failed' OR backfill_id % 2 = 0)),
    failures AS (SELECT DISTINCT backfill_id, partition_key FROM v_outcomes WHERE outcome = 'failed'),
    stray AS (SELECT * FROM asked EXCEPT SELECT * FROM failures)
    SELECT *, 'not_failed' AS verdict FROM stray
    UNION ALL SELECT *, 'retry' FROM asked WHERE backfill_id NOT IN (SELECT backfill_id FROM stray)
    UNION ALL SELECT *, 'retry' FROM failures WHERE backfill_id NOT IN (SELECT backfill_id FROM asked)
    """.replace("WITH asked", "SELECT * FROM (WITH asked") + ")")
def _(v):
    asked = v.outcomes.where("backfill_id % 3 > 0 AND item % 4 = 0 AND (outcome = 'failed' OR backfill_id % 2 = 0)")
    return bf.retry_selection(asked, v.outcomes.where("outcome = 'failed'"))


@query("g24_expected_partitions", """
    SELECT name AS asset_name, g AS granularity, CASE WHEN n > 0 THEN CASE g WHEN 'hourly' THEN strftime(t, '%Y-%m-%dT%H')
        WHEN 'daily' THEN strftime(t, '%Y-%m-%d') WHEN 'weekly' THEN strftime(t, '%G-W%V') ELSE strftime(t, '%Y-%m') END END AS key,
      CASE WHEN n < 1 THEN 'end before start' END AS problem FROM (
      SELECT *, CASE WHEN a > z THEN 0 ELSE len(s) END AS n FROM (SELECT *, generate_series(a, z, i) AS s FROM (
        SELECT *, CASE g WHEN 'weekly' THEN date_trunc('week', d) WHEN 'monthly' THEN date_trunc('month', d) ELSE d END::TIMESTAMP AS a,
          CASE g WHEN 'weekly' THEN date_trunc('week', e) WHEN 'monthly' THEN date_trunc('month', e) ELSE e END::TIMESTAMP AS z,
          CASE g WHEN 'hourly' THEN INTERVAL 1 HOUR WHEN 'daily' THEN INTERVAL 1 DAY WHEN 'weekly' THEN INTERVAL 7 DAY
            ELSE INTERVAL 1 MONTH END AS i FROM (
          SELECT name, ['hourly', 'daily', 'weekly', 'monthly'][pipeline_no % 4 + 1] AS g, partition_start::TIMESTAMP AS d,
            TIMESTAMP '2023-09-30' AS e FROM v_pipelines)))), LATERAL (SELECT unnest(CASE WHEN n > 0 THEN s
              ELSE [a] END) AS t)""")
def _(v):
    assets = v.pipelines.selectExpr(
        "name AS asset_name", "partition_start",
        "element_at(array('hourly', 'daily', 'weekly', 'monthly'), cast(pipeline_no % 4 AS int) + 1) AS granularity")
    return bf.expected_partitions(assets, F.lit("2023-09-30"))


@query("g25_coarsen_keys", """
    SELECT DISTINCT asset_name, strftime(event_time, '%G-W%V') AS key FROM v_facts WHERE granularity <> 'monthly'""")
def _(v):
    return bf.coarsen(v.facts, "weekly")


@query("p04_filter_backfills", """
    SELECT backfill_id FROM v_backfills WHERE status = 'partial' AND partition_keys LIKE '["%'
      AND '1998-06-01' BETWEEN substr(partition_keys, 16, 10) AND substr(partition_keys, 3, 10)""")
def _(v):
    return bf.filter_backfills(v.backfills, status="partial", date="1998-06-01").select("backfill_id")


@query("w16_recent_backfills", """
    SELECT backfill_id, started_at::VARCHAR AS started_at FROM v_backfills WHERE started_at < TIMESTAMP '1999-01-01'
    ORDER BY started_at DESC, backfill_id LIMIT 200""")
def _(v):
    return bf.recent_backfills(v.backfills, "1999-01-01", 200).select("backfill_id", "started_at")


@query("j17_retries", """
    SELECT b.backfill_id, c.backfill_id AS retry_id, c.started_at::VARCHAR AS retry_started_at
    FROM v_backfills b JOIN v_backfills c ON c.parent_id = b.backfill_id""")
def _(v):
    return bf.retries_of(v.backfills)
