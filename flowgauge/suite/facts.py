"""Registered checks of fact sources, as-of look-ups and conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgauge.functions import calendar as cal
from flowgauge.operators import asof, conditions, rules
from flowgauge.session import scratch_dir
from flowgauge.sources import facts as src
from flowgauge.suite.registry import query
from flowgauge.suite.sql_views import NOW_FACTS
from flowgauge.suite.views import facts_now, with_gaps


def stored(v):
    """The facts as a table stored by date."""
    path = scratch_dir(v.spark, "stored-facts")
    src.write_facts(v.facts, path)
    return src.read_facts(v.spark, path)


@query("s01_scan_facts", """
    SELECT event_id, asset_name, partition_date::VARCHAR AS partition_date FROM v_facts
    WHERE asset_name IN ('click', 'error') AND partition_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-10'""")
def _(v):
    kept = src.scan_facts(stored(v), ["click", "error"], "2024-01-01", "2024-01-10")
    return kept.select("event_id", "asset_name", "partition_date")


@query("s01_facts_of_dates", """
    SELECT event_id, asset_name, partition_date::VARCHAR AS partition_date FROM v_facts
    WHERE partition_date IN (SELECT target_date FROM v_targets WHERE asset_name = 'view' AND day(target_date) % 7 = 1)""")
def _(v):
    wanted = v.targets.where("asset_name = 'view' AND day(target_date) % 7 = 1").select("target_date")
    return src.facts_of_dates(stored(v), wanted).select("event_id", "asset_name", "partition_date")


_NORMAL = {"v_normal": """
    SELECT event_id, asset_name, event_time, key, CASE WHEN partition_date IS NOT NULL THEN
        CASE WHEN regexp_matches(partition_date, '^\\d{4}-\\d{2}-\\d{2}$') THEN try_strptime(partition_date, '%Y-%m-%d') END
        ELSE start_at END::DATE AS day, coalesce(granularity, CASE WHEN start_at IS NOT NULL THEN shape END) AS granularity
    FROM (SELECT *, CASE WHEN contains(key, 'T') THEN 'hourly' WHEN contains(key, 'W') THEN 'weekly'
              WHEN length(key) = 7 THEN 'monthly' ELSE 'daily' END AS shape,
            CASE WHEN contains(key, 'T') THEN try_strptime(left(key, 13), '%Y-%m-%dT%H')
              WHEN contains(key, 'W') THEN try_strptime(key || '-1', '%G-W%V-%u')
              WHEN length(key) = 7 THEN try_strptime(key || '-01', '%Y-%m-%d')
              ELSE try_strptime(key, '%Y-%m-%d') END AS start_at
          FROM (SELECT *, coalesce(partition_key, execution_date, '') AS key FROM v_raw_facts))"""}


@query("s02_normalize_facts", """
    SELECT event_id, key AS partition_key, day::VARCHAR AS partition_date, granularity,
      day IS NOT NULL AND granularity IS NOT NULL AS readable FROM v_normal""", **_NORMAL)
def _(v):
    return src.normalize_facts(v.raw_facts).select(
        "event_id", "partition_key", "partition_date", "granularity", "readable")


@query("s03_unreadable_facts", """
    SELECT DISTINCT asset_name, event_time::VARCHAR AS event_time FROM v_normal
    WHERE day IS NULL OR granularity IS NULL""", **_NORMAL)
def _(v):
    return src.split_facts(v.raw_facts)[1]


@query("s04_merge_facts", """
    SELECT DISTINCT asset_name, partition_date::VARCHAR AS partition_date, event_time::VARCHAR AS event_time, granularity
    FROM v_facts WHERE partition_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' """)
def _(v):
    # what came first and what came late; some facts are in both
    base, extra = v.facts.where("event_id % 3 <> 0"), v.facts.where("event_id % 2 = 0 OR event_id % 3 = 0")
    return src.merge_facts(base, extra, "2024-01-05", "2024-01-20")


@query("s05_unique_fact_times", """
    SELECT event_id, max(ms - i) OVER (PARTITION BY asset_name ORDER BY i ROWS UNBOUNDED PRECEDING) + i AS fact_ms FROM (
      SELECT *, row_number() OVER (PARTITION BY asset_name ORDER BY ms, event_id) AS i FROM (
        SELECT event_id, asset_name, (epoch_us(event_time) // 1000) // 7200000 * 7200000 + 7199990 AS ms FROM v_facts))""")
def _(v):
    stamped = v.facts.select(
        "asset_name", "event_id", (F.floor(cal.millis(F.col("event_time")) / 7200000) * 7200000 + 7199990).alias("time_ms"))
    return src.assign_fact_times(stamped, source="event_id").select("event_id", "fact_ms")


@query("s06_facts_of_success", """
    SELECT t.run_id, task_no, o AS asset_name, finished_at::VARCHAR AS event_time,
      run_date::VARCHAR AS partition_date, coalesce(g, 'daily') AS granularity,
      CASE t.run_id % 10 WHEN 0 THEN 'none' WHEN 1 THEN 'all' ELSE 'auto' END AS cascade
    FROM v_tasks t JOIN (
      SELECT p_partkey, 'ds_' || p_size AS o, CASE p_partkey % 3 WHEN 0 THEN 'weekly' END AS g FROM part
      UNION ALL SELECT p_partkey, 'ds_b' || p_size, 'daily' FROM part WHERE p_partkey % 4 = 0) o ON o.p_partkey = t.pk
    WHERE status IN ('success', 'succeeded')""")
def _(v):
    outlets = v.table("part").select(
        F.col("p_partkey").alias("spec_task"), F.explode(F.expr(
            "array(struct(concat('ds_', p_size) AS n, CASE p_partkey % 3 WHEN 0 THEN 'weekly' ELSE '' END AS g),"
            " struct(CASE p_partkey % 4 WHEN 0 THEN concat('ds_b', p_size) ELSE '  ' END AS n, 'daily' AS g))")).alias("o"),
    ).select("spec_task", F.col("o.n").alias("outlet"), F.col("o.g").alias("outlet_granularity"))
    cascade = src.cascade_of(F.expr("run_id % 10 = 0"), F.expr("run_id % 10 <= 1"))
    tasks = v.tasks.withColumns({"spec_task": F.col("pk"), "run_key": F.date_format("run_date", "yyyy-MM-dd"),
                                 "cascade": cascade})
    return src.facts_of_success(tasks, outlets).drop("partition_key")


@query("s14_asset_names", "SELECT DISTINCT asset_name FROM v_facts")
def _(v):
    return src.asset_names(v.facts)


@query("g20_last_updated", """
    SELECT asset_name, max(event_time)::VARCHAR AS last_updated, max_by(partition_key, event_time) AS partition_key
    FROM v_facts GROUP BY 1""")
def _(v):
    return src.last_updated(v.facts)


@query("w06_recent_facts", """
    SELECT asset_name, event_id, position FROM (SELECT *, row_number() OVER (PARTITION BY asset_name
      ORDER BY event_time DESC, event_id DESC) AS position FROM v_facts) WHERE position <= 50""")
def _(v):
    return src.recent_facts(v.facts, 50).select("asset_name", "event_id", "position")


_SERVES = """(CASE WHEN f.granularity IN ('hourly', 'daily') THEN f.partition_date = t.target_date
    WHEN f.granularity = 'weekly' THEN f.partition_date <= t.target_date
      AND date_trunc('week', f.partition_date) >= date_trunc('week', t.target_date) - INTERVAL 7 DAY
    ELSE f.partition_date <= t.target_date
      AND date_trunc('month', f.partition_date) >= date_trunc('month', t.target_date) - INTERVAL 1 MONTH END)"""
_DAYS = {"v_days": """SELECT asset_name, partition_date, granularity, min(event_time) AS first_at,
    max(event_time) AS last_at FROM v_facts GROUP BY 1, 2, 3"""}


_GAPPY_DAYS = {"v_days": _DAYS["v_days"].replace("v_facts", "v_gappy")}


@query("j01_latest_fact", f"""
    SELECT t.asset_name, t.target_date::VARCHAR AS target_date, coalesce(bool_or({_SERVES}), false) AS ready,
      CASE WHEN bool_or({_SERVES}) THEN 'ok' WHEN count(f.asset_name) > 0 THEN 'stale' ELSE 'no_fact' END AS reason,
      (max(f.partition_date) FILTER ({_SERVES}))::VARCHAR AS partition_date,
      (max_by(f.last_at, f.partition_date) FILTER ({_SERVES}))::VARCHAR AS event_time
    FROM v_targets t LEFT JOIN v_days f ON f.asset_name = t.asset_name AND f.partition_date <= t.target_date
      AND f.partition_date >= date_trunc('month', t.target_date) - INTERVAL 1 MONTH GROUP BY 1, 2""", **_DAYS)
def _(v):
    return asof.latest(v.targets, v.facts)


@query("j02_fresh_fact", """
    SELECT t.asset_name, t.target_date::VARCHAR AS target_date, coalesce(d.last_at >= now - INTERVAL 1830 MINUTE, false) AS ready,
      CASE WHEN d.last_at IS NULL THEN 'no_fact' WHEN d.last_at >= now - INTERVAL 1830 MINUTE THEN 'ok' ELSE 'stale' END
        AS reason, d.partition_date::VARCHAR AS partition_date, d.last_at::VARCHAR AS event_time
    FROM (SELECT *, target_date::TIMESTAMP + INTERVAL 40 HOUR AS now FROM v_targets) t
    ASOF LEFT JOIN v_days d ON d.asset_name = t.asset_name AND d.partition_date <= t.target_date""", **_DAYS)
def _(v):
    timed = v.targets.withColumns({
        "now": F.expr("cast(target_date AS timestamp_ntz) + interval 40 hours"), "hours": F.lit(30.5)})
    return asof.within(timed, v.facts).drop("now", "hours")


@query("j03_consecutive_days", """
    SELECT t.asset_name, t.target_date::VARCHAR AS target_date, count(d.partition_date) = 4 AS ready,
      CASE WHEN count(d.partition_date) = 4 THEN 'ok' ELSE 'missing_dates' END AS reason,
      coalesce(string_agg(CASE WHEN d.partition_date IS NULL THEN need::VARCHAR END, ',' ORDER BY need), '') AS missing
    FROM (SELECT *, target_date - n::INTEGER AS need FROM v_targets, unnest([0, 1, 2, 3]) AS s(n)) t
    LEFT JOIN v_days d ON d.asset_name = t.asset_name AND d.partition_date = t.need GROUP BY 1, 2""", **_GAPPY_DAYS)
def _(v):
    found = asof.consecutive(v.targets.withColumn("days", F.lit(4)), with_gaps(v.facts))
    missing = F.array_join(F.transform("missing_dates", lambda d: d.cast("string")), ",")
    return found.select("asset_name", "target_date", "ready", "reason", missing.alias("missing"))


def probes(v):
    """What another asset looked like at the moment of each fact."""
    other = F.expr("element_at(array('click', 'error', 'purchase', 'signup', 'view'), cast(event_id % 5 AS int) + 1)")
    return v.facts.select(
        "event_id", other.alias("asset_name"), F.to_date("event_time").alias("target_date"),
        F.col("event_time").alias("cutoff"))


_PROBES = {**_DAYS, "v_probes": """
    SELECT event_id, ['click', 'error', 'purchase', 'signup', 'view'][event_id % 5 + 1] AS asset_name,
      event_time::DATE AS target_date, event_time AS cutoff FROM v_facts"""}


@query("j04_point_in_time", f"""
    SELECT t.event_id, t.asset_name, max(f.partition_date) IS NOT NULL AS ready,
      max(f.partition_date)::VARCHAR AS partition_date, arg_max(f.event_time, (f.partition_date, f.event_time))::VARCHAR
      AS event_time
    FROM v_probes t LEFT JOIN v_facts f ON f.asset_name = t.asset_name AND f.event_time <= t.cutoff AND {_SERVES}
    GROUP BY 1, 2""", **_PROBES)
def _(v):
    return asof.latest_as_of(probes(v), v.facts).select("event_id", "asset_name", "ready", "partition_date", "event_time")


@query("w12_fact_spans", """
    WITH days AS (SELECT DISTINCT asset_name, partition_date AS d FROM v_gappy),
    marked AS (SELECT *, d - (row_number() OVER (PARTITION BY asset_name ORDER BY d))::INTEGER AS g FROM days),
    spans AS (SELECT asset_name, min(d) AS a, max(d) AS b FROM marked GROUP BY asset_name, g),
    nexts AS (SELECT *, lead(a) OVER (PARTITION BY asset_name ORDER BY a) AS n FROM spans)
    SELECT asset_name, 'present' AS kind, a::VARCHAR AS "first", b::VARCHAR AS "last", b - a + 1 AS days FROM nexts
    UNION ALL SELECT asset_name, 'missing', (b + 1)::VARCHAR, (n - 1)::VARCHAR, n - b - 1 FROM nexts WHERE n IS NOT NULL
    """.replace("WITH days AS", "SELECT * FROM (WITH days AS") + ")")
def _(v):
    return asof.fact_spans(with_gaps(v.facts))


@query("j15_asset_staleness", f"""
    SELECT asset_name, CASE WHEN t IS NULL THEN 'unknown' WHEN h > 72 THEN 'stale' WHEN h > 48 THEN 'warning'
      ELSE 'fresh' END AS status, t::VARCHAR AS known_at FROM (
      SELECT *, (epoch_us({NOW_FACTS}) // 1000 - epoch_us(t) // 1000) / 3600000.0::DOUBLE AS h FROM (
        SELECT p_name AS asset_name, coalesce(max(ts) FILTER (ts::DATE = DATE '2024-01-29'), max(ts)) AS t
        FROM part LEFT JOIN events ON user_id % 64 = length(p_name) AND event_id % 5 = p_size % 5 GROUP BY 1))""")
def _(v):
    from flowgauge.operators import feeds
    owned = v.table("events").selectExpr("event_id", "ts", "user_id % 64 AS slot", "event_id % 5 AS part")
    named = v.table("part").selectExpr("p_name AS asset_name", "length(p_name) AS slot", "p_size % 5 AS part").distinct()
    seen = named.join(owned, ["slot", "part"]).select("asset_name", F.col("ts").alias("event_time"), "event_id")
    on_day = seen.where("cast(event_time AS date) = date'2024-01-29'")
    return feeds.asset_staleness(
        named.select("asset_name").distinct(), on_day, seen, facts_now()
    ).select("asset_name", "status", "known_at")


# Condition trees.


def nodes(v):
    return conditions.usable_nodes(conditions.flatten_conditions(v.schedules, "schedule_text"))


@query("s09_condition_nodes", """
    SELECT pipeline AS spec_id, '0' AS node_id, NULL AS parent_id, 0 AS depth, operator AS op, NULL AS asset_name,
      NULL::DOUBLE AS freshness_hours, NULL::INTEGER AS consecutive_days, NULL AS problem FROM v_subs
    UNION ALL SELECT pipeline, '0.0', '0', 1, 'leaf', a, NULL, NULL, NULL FROM v_subs
    UNION ALL SELECT pipeline, '0.1', '0', 1, 'leaf', b, 24, NULL, NULL FROM v_subs WHERE n % 3 = 1
    UNION ALL SELECT pipeline, '0.1', '0', 1, 'OR', NULL, NULL, NULL, NULL FROM v_subs WHERE n % 3 = 2
    UNION ALL SELECT pipeline, '0.1.0', '0.1', 2, 'leaf', b, NULL, 3, NULL FROM v_subs WHERE n % 3 = 2
    UNION ALL SELECT pipeline, '0.1.1', '0.1', 2, 'leaf', c, NULL, NULL, NULL FROM v_subs WHERE n % 3 = 2
    UNION ALL SELECT 'w' || p_partkey, '0', NULL, 0, 'AND', NULL, NULL, NULL, CASE WHEN p_partkey % 8 = 7 THEN 'not a list' END
      FROM part
    UNION ALL SELECT 'w' || p_partkey, '0.0', '0', 1, CASE WHEN k = 5 THEN NULL ELSE 'leaf' END,
      CASE WHEN k IN (0, 1, 2, 3, 4) THEN 'a' || p_size END, CASE k WHEN 1 THEN 1.5 WHEN 2 THEN 2 WHEN 4 THEN -1 END,
      CASE k WHEN 2 THEN 3 END, CASE k WHEN 2 THEN 'two windows at once' WHEN 3 THEN 'unknown keys in condition'
        WHEN 4 THEN 'freshness_hours must be positive' WHEN 5 THEN 'operator must be AND or OR'
        WHEN 6 THEN 'not an object' END FROM (SELECT *, p_partkey % 8 AS k FROM part) WHERE k <> 7""")
def _(v):
    waits = v.table("part").selectExpr("concat('w', p_partkey) AS spec_id", """CASE p_partkey % 8
        WHEN 0 THEN concat('[{"asset_name":"a', p_size, '"}]')
        WHEN 1 THEN concat('[{"asset_name":"a', p_size, '","freshness_hours":1.5}]')
        WHEN 2 THEN concat('[{"asset_name":"a', p_size, '","freshness_hours":2,"consecutive_days":3}]')
        WHEN 3 THEN concat('[{"asset_name":"a', p_size, '","hours":2}]')
        WHEN 4 THEN concat('[{"asset_name":"a', p_size, '","freshness_hours":-1}]')
        WHEN 5 THEN '[{"operator":1,"assets":[]}]' WHEN 6 THEN '["bare"]' ELSE '{"asset_name":"a"}' END AS wait_for""")
    return conditions.flatten_conditions(v.schedules, "schedule_text").unionByName(
        conditions.flatten_conditions(waits, "wait_for", "wait_for"))


@query("u05_schedule_assets", """
    SELECT pipeline AS spec_id, a AS asset_name FROM v_subs UNION SELECT pipeline, b FROM v_subs WHERE n % 3 > 0
    UNION SELECT pipeline, c FROM v_subs WHERE n % 3 = 2""")
def _(v):
    return conditions.asset_names_of(nodes(v))


def evaluations(v):
    now = F.expr("cast(target_date AS timestamp_ntz) + interval 40 hours")
    dates = v.facts.select(F.to_date("event_time").alias("target_date")).distinct().withColumn("now", now)
    specs = v.schedules.select("spec_id")
    return dates.withColumn("spec_id", F.explode(F.expr("transform(sequence(0, 24), x -> concat('p', x))"))).join(
        specs, "spec_id", "left_semi")


_LEAVES = {**_DAYS, "v_dates": "SELECT DISTINCT event_time::DATE AS target_date FROM v_facts",
    "v_grid": """SELECT s.*, target_date, target_date::TIMESTAMP + INTERVAL 40 HOUR AS now,
        (SELECT max(f.last_at) FROM v_days f, (SELECT target_date AS td) t WHERE false) AS unused
      FROM v_subs s, v_dates""",
    "v_plain": f"""SELECT t.asset_name, t.target_date, max_by(f.last_at, f.partition_date) AS at
      FROM (SELECT DISTINCT d.asset_name, x.target_date FROM v_days d, v_dates x) t JOIN v_days f
        ON f.asset_name = t.asset_name AND {_SERVES} GROUP BY 1, 2""",
    "v_fresh": """SELECT t.asset_name, t.target_date, max_by(f.last_at, f.partition_date) AS at
      FROM (SELECT DISTINCT d.asset_name, x.target_date FROM v_days d, v_dates x) t JOIN v_days f
        ON f.asset_name = t.asset_name AND f.partition_date <= t.target_date GROUP BY 1, 2""",
    "v_span": """SELECT t.asset_name, t.target_date, count(DISTINCT f.partition_date) = 3 AS ok
      FROM (SELECT DISTINCT d.asset_name, x.target_date FROM v_days d, v_dates x) t JOIN v_days f
        ON f.asset_name = t.asset_name AND f.partition_date BETWEEN t.target_date - 2 AND t.target_date GROUP BY 1, 2""",
    "v_state": """SELECT g.pipeline, g.n, g.operator, g.target_date, pa.at AS a_at, pa.at IS NOT NULL AS a_ok,
        fb.at AS b_at, coalesce(fb.at >= g.now - INTERVAL 24 HOUR, false) AS b_ok, coalesce(sb.ok, false) AS s_ok,
        pc.at AS c_at, pc.at IS NOT NULL AS c_ok FROM v_grid g
      LEFT JOIN v_plain pa ON pa.asset_name = g.a AND pa.target_date = g.target_date
      LEFT JOIN v_fresh fb ON fb.asset_name = g.b AND fb.target_date = g.target_date
      LEFT JOIN v_span sb ON sb.asset_name = g.b AND sb.target_date = g.target_date
      LEFT JOIN v_plain pc ON pc.asset_name = g.c AND pc.target_date = g.target_date""",
    "v_root": """SELECT pipeline AS spec_id, target_date, CASE n % 3 WHEN 0 THEN a_ok
        WHEN 1 THEN CASE operator WHEN 'AND' THEN a_ok AND b_ok ELSE a_ok OR b_ok END
        ELSE CASE operator WHEN 'AND' THEN a_ok AND (s_ok OR c_ok) ELSE a_ok OR s_ok OR c_ok END END AS ready,
      CASE n % 3 WHEN 0 THEN a_at
        WHEN 1 THEN CASE operator WHEN 'AND' THEN greatest(a_at, b_at)
          ELSE least(CASE WHEN a_ok THEN a_at END, CASE WHEN b_ok THEN b_at END) END
        ELSE CASE operator WHEN 'AND' THEN greatest(a_at, c_at) ELSE least(a_at, c_at) END END AS at FROM v_state"""}
_LEAVES["v_grid"] = """SELECT s.*, target_date, target_date::TIMESTAMP + INTERVAL 40 HOUR AS now FROM v_subs s, v_dates"""


@query("g14_evaluate_conditions", """
    SELECT spec_id, target_date::VARCHAR AS target_date, ready, (CASE WHEN ready THEN "at" END)::VARCHAR AS enabled_at
    FROM v_root""", **_LEAVES)
def _(v):
    tree = nodes(v)
    return conditions.evaluate_conditions(tree, evaluations(v), v.facts, conditions.depth_of(tree)).drop("now")


@query("g04_readiness", """
    SELECT t.run_id, t.task_no, CASE WHEN v.verdict IN ('skip', 'upstream_failed', 'fail') THEN v.verdict
      WHEN v.verdict = 'wait' OR NOT coalesce(r.ready, true) THEN 'wait' ELSE 'ready' END AS decision
    FROM v_tasks t JOIN v_verdicts v USING (run_id, task_no) LEFT JOIN v_root r ON t.sk % 3 = 0
      AND r.spec_id = 'p' || (t.pk % 25) AND r.target_date = DATE '2024-01-03' + (t.run_id % 25)::INTEGER""", **_LEAVES)
def _(v):
    tree = nodes(v)
    grid = evaluations(v)
    leaves = conditions.answer_leaves(tree, grid, v.facts)
    unready = leaves.where("NOT ready").groupBy("spec_id", "target_date").agg(
        F.sort_array(F.collect_list(F.concat_ws(": ", "asset_name", "reason"))).alias("unready"))
    root = conditions.evaluate_tree(tree, leaves, ["spec_id", "target_date", "now"], conditions.depth_of(tree))
    state = root.join(unready, ["spec_id", "target_date"], "left").select(
        "spec_id", "target_date", F.col("ready").alias("assets_ready"),
        F.coalesce("unready", F.array().cast("array<string>")).alias("unready"))
    asks = v.tasks.where("sk % 3 = 0").selectExpr(
        "run_id", "task_no", "concat('p', pk % 25) AS spec_id",
        "date_add(date'2024-01-03', cast(run_id % 25 AS int)) AS target_date")
    assets = asks.join(state, ["spec_id", "target_date"]).drop("spec_id", "target_date")
    judged = rules.evaluate_rules(rules.upstream_counts(v.tasks, v.edges))
    return rules.decide(judged, assets).drop("reasons")


# Push evaluation.


def subscriptions(v):
    return v.subscriptions.select("pipeline", "subscribed_at", F.explode(F.expr(
        "array_distinct(CASE n % 3 WHEN 0 THEN array(a) WHEN 1 THEN array(a, b) ELSE array(a, b, c) END)")).alias("asset_name"))


_CONSUMERS = {"v_sub_assets": """
    SELECT DISTINCT pipeline AS consumer, n, operator, subscribed_at, x AS asset_name FROM v_subs,
      unnest(CASE n % 3 WHEN 0 THEN [a] WHEN 1 THEN [a, b] ELSE [a, b, c] END) AS s(x)""",
    "v_pairs": """SELECT f.*, s.consumer, s.n, s.operator FROM v_facts f JOIN v_sub_assets s USING (asset_name)
      WHERE cascade <> 'none' AND consumer <> source_dag AND event_time >= subscribed_at"""}


@query("j08_fact_consumers", "SELECT event_id, consumer FROM v_pairs", **_CONSUMERS)
def _(v):
    return conditions.consumers_of(v.facts, subscriptions(v)).select("event_id", "consumer")


# As of each pair: leaf a plain, leaf b fresh or consecutive, leaf c plain, by first times per served date.
_PUSH = {**_CONSUMERS, **_DAYS,
    "v_moments": """SELECT DISTINCT p.consumer, s.n, s.operator, s.a, s.b, s.c, p.partition_date AS target_date, p.event_time AS cutoff
      FROM v_pairs p JOIN v_subs s ON s.pipeline = p.consumer WHERE cascade <> 'all'""",
    "v_served": f"""SELECT t.asset_name, t.target_date, min(f.first_at) AS at FROM
      (SELECT DISTINCT d.asset_name, m.target_date FROM v_days d, (SELECT DISTINCT target_date FROM v_moments) m) t
      JOIN v_days f ON f.asset_name = t.asset_name AND {_SERVES} GROUP BY 1, 2""",
    "v_covered": """SELECT t.asset_name, t.target_date, CASE WHEN count(*) = 3 THEN max(f.first_at) END AS at FROM
      (SELECT DISTINCT d.asset_name, m.target_date FROM v_days d, (SELECT DISTINCT target_date FROM v_moments) m) t
      JOIN (SELECT asset_name, partition_date, min(first_at) AS first_at FROM v_days GROUP BY 1, 2) f
        ON f.asset_name = t.asset_name AND f.partition_date BETWEEN t.target_date - 2 AND t.target_date GROUP BY 1, 2""",
    "v_recent": """SELECT m.b, m.target_date, m.cutoff, arg_max(f.event_time, (f.partition_date, f.event_time)) AS newest
      FROM (SELECT DISTINCT b, target_date, cutoff FROM v_moments WHERE n % 3 = 1) m JOIN v_facts f
        ON f.asset_name = m.b AND f.partition_date <= m.target_date AND f.event_time <= m.cutoff GROUP BY 1, 2, 3""",
    "v_holds": """SELECT m.consumer, m.target_date, m.cutoff, CASE n % 3 WHEN 0 THEN a_ok
        WHEN 1 THEN CASE operator WHEN 'AND' THEN a_ok AND b_ok ELSE a_ok OR b_ok END
        ELSE CASE operator WHEN 'AND' THEN a_ok AND (s_ok OR c_ok) ELSE a_ok OR s_ok OR c_ok END END AS holds FROM (
      SELECT m.*, coalesce(sa.at <= m.cutoff, false) AS a_ok, coalesce(sc.at <= m.cutoff, false) AS c_ok,
        coalesce(cb.at <= m.cutoff, false) AS s_ok, coalesce(rb.newest >= m.cutoff - INTERVAL 24 HOUR, false) AS b_ok
      FROM v_moments m LEFT JOIN v_served sa ON sa.asset_name = m.a AND sa.target_date = m.target_date
      LEFT JOIN v_served sc ON sc.asset_name = m.c AND sc.target_date = m.target_date
      LEFT JOIN v_covered cb ON cb.asset_name = m.b AND cb.target_date = m.target_date
      LEFT JOIN v_recent rb ON rb.b = m.b AND rb.target_date = m.target_date AND rb.cutoff = m.cutoff) m""",
    "v_requests": """SELECT rtrim(left(consumer, 80 - length(tail)), '-') || tail AS run_name, consumer, run_date, kind,
        trigger_asset, min(event_time) AS first_event_time FROM (
      SELECT *, '-' || run_date || '-' || kind || '-' || left(sha256(consumer || chr(31) || run_date || chr(31) || kind
          || chr(31) || disc), 8) AS tail FROM (
        SELECT p.consumer, p.event_time, p.partition_date::VARCHAR AS run_date,
          CASE WHEN cascade = 'all' OR operator = 'OR' THEN 'ev' ELSE 'and' END AS kind,
          CASE WHEN cascade = 'all' OR operator = 'OR' THEN asset_name END AS trigger_asset,
          CASE WHEN cascade = 'all' OR operator = 'OR' THEN asset_name || '|' || strftime(p.event_time, '%Y-%m-%dT%H:%M:%S.%f')
            ELSE '' END AS disc
        FROM v_pairs p LEFT JOIN v_holds h ON h.consumer = p.consumer AND h.target_date = p.partition_date
          AND h.cutoff = p.event_time WHERE cascade = 'all' OR h.holds)) GROUP BY 1, 2, 3, 4, 5"""}


def requests(v, facts=None):
    tree = nodes(v)
    new = v.facts if facts is None else facts
    return conditions.push_requests(new, subscriptions(v), tree, v.facts, conditions.depth_of(tree))


@query("r02_push_requests_batch", """
    SELECT run_name, consumer, run_date, kind, trigger_asset, first_event_time::VARCHAR AS first_event_time
    FROM v_requests""", **_PUSH)
def _(v):
    return requests(v)


@query("j18_replay_requests", f"""
    SELECT run_name FROM v_requests WHERE first_event_time >= {NOW_FACTS} - INTERVAL 48 HOUR
      AND ascii(right(run_name, 1)) % 2 = 1""",
    **{**_PUSH, "v_pairs": _PUSH["v_pairs"] + f" AND event_time >= {NOW_FACTS} - INTERVAL 48 HOUR"})
def _(v):
    recent = v.facts.where(F.col("event_time") >= facts_now() - F.expr("interval 48 hours"))
    asked = requests(v, recent)
    started = asked.where("ascii(right(run_name, 1)) % 2 = 0")
    return conditions.replay_requests(asked, started).select("run_name")


def waits(v):
    return v.tasks.where("status = 'waiting'").select("run_id", "task_no", F.expr(
        "element_at(array('click', 'error', 'purchase', 'signup', 'view'), cast(pk % 5 AS int) + 1)").alias("asset_name"))


@query("j09_waiting_runs", """
    SELECT run_id, count(DISTINCT task_no) AS waiting_tasks FROM v_tasks WHERE status = 'waiting'
      AND ['click', 'error', 'purchase', 'signup', 'view'][pk % 5 + 1] IN (
        SELECT asset_name FROM v_facts WHERE partition_date = DATE '2024-01-15') GROUP BY 1""")
def _(v):
    return conditions.waiting_runs(v.facts.where("partition_date = date'2024-01-15'"), waits(v))


@query("n13_forced_consumers", """
    SELECT DISTINCT asset_name, consumer FROM v_pairs WHERE cascade = 'all'""", **_CONSUMERS)
def _(v):
    forced = v.facts.where("cascade = 'all'")
    return conditions.consumers_of(forced, subscriptions(v)).select("asset_name", "consumer").distinct()
