"""Registered checks of the scalar expressions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgauge.functions import calendar as cal, schedules, text, timing, vocab
from flowgauge.operators import search
from flowgauge.session import cut_lineage
from flowgauge.suite.registry import query
from flowgauge.suite.sql_views import NOW_FACTS, texts
from flowgauge.suite.views import Views, facts_now, runs_now

_KEYS = """
    SELECT event_id, CASE event_id % 9
      WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H')
      WHEN 2 THEN (2018 + event_id % 8) || '-W' || lpad((event_id % 60)::VARCHAR, 2, '0')
      WHEN 3 THEN '2023-' || lpad((event_id % 14)::VARCHAR, 2, '0')
      WHEN 4 THEN '2024-02-' || lpad((event_id % 40)::VARCHAR, 2, '0')
      WHEN 5 THEN strftime(ts, '%Y-%m-%dT%H') || ':00Z' WHEN 6 THEN 'latest'
      WHEN 7 THEN strftime(ts, '%Y-%m-%dT') || lpad((event_id % 30)::VARCHAR, 2, '0') ELSE '2024-1-5' END AS key
    FROM events"""
_STARTS = """
    SELECT *, CASE
      WHEN regexp_matches(key, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}') THEN try_strptime(left(key, 13), '%Y-%m-%dT%H')
      WHEN regexp_matches(key, '^\\d{4}-W\\d{2}$') THEN CASE WHEN
           strftime(try_strptime(key || '-1', '%G-W%V-%u'), '%G-W%V') = key THEN try_strptime(key || '-1', '%G-W%V-%u') END
      WHEN regexp_matches(key, '^\\d{4}-\\d{2}$') THEN try_strptime(key || '-01', '%Y-%m-%d')
      WHEN regexp_matches(key, '^\\d{4}-\\d{2}-\\d{2}$') THEN try_strptime(key, '%Y-%m-%d') END AS start_at
    FROM v_keys"""
_SHAPE = """CASE WHEN contains(key, 'T') THEN 'hourly' WHEN contains(key, 'W') THEN 'weekly'
    WHEN length(key) = 7 THEN 'monthly' ELSE 'daily' END"""
_SCALAR = {"v_keys": _KEYS, "v_starts": _STARTS}


def keys(v: Views):
    pad = "lpad(cast(event_id % {n} AS string), 2, '0')"
    return v.table("events").selectExpr("event_id", f"""CASE event_id % 9
        WHEN 0 THEN date_format(ts, 'yyyy-MM-dd') WHEN 1 THEN date_format(ts, "yyyy-MM-dd'T'HH")
        WHEN 2 THEN concat(2018 + event_id % 8, '-W', {pad.format(n=60)})
        WHEN 3 THEN concat('2023-', {pad.format(n=14)}) WHEN 4 THEN concat('2024-02-', {pad.format(n=40)})
        WHEN 5 THEN concat(date_format(ts, "yyyy-MM-dd'T'HH"), ':00Z') WHEN 6 THEN 'latest'
        WHEN 7 THEN concat(date_format(ts, "yyyy-MM-dd'T'"), {pad.format(n=30)}) ELSE '2024-1-5' END AS key""")


@query("d01_detect_granularity",
       f"SELECT event_id, key, CASE WHEN start_at IS NOT NULL THEN {_SHAPE} END AS granularity FROM v_starts", **_SCALAR)
def _(v):
    return keys(v).withColumn("granularity", cal.detect_granularity(F.col("key")))


@query("d02_valid_key", f"""
    SELECT event_id, key, g AS granularity, coalesce(start_at IS NOT NULL AND g = {_SHAPE}, false) AS valid
    FROM v_starts, unnest(['hourly', 'daily', 'weekly', 'monthly']) AS s(g)""", **_SCALAR)
def _(v):
    each = keys(v).withColumn("granularity", F.explode(F.array(*[F.lit(g) for g in cal.GRANULARITIES])))
    return each.withColumn("valid", cal.is_valid_key(F.col("key"), F.col("granularity")))


@query("d03_partition_start", "SELECT event_id, key, start_at::VARCHAR AS start_at FROM v_starts", **_SCALAR)
def _(v):
    return keys(v).withColumn("start_at", cal.partition_start(F.col("key")))


@query("d04_partition_date", "SELECT event_id, key, start_at::DATE::VARCHAR AS day FROM v_starts", **_SCALAR)
def _(v):
    return keys(v).withColumn("day", cal.partition_date(F.col("key")))


_EACH = "unnest(['hourly', 'daily', 'weekly', 'monthly']) AS s(g)"
_UNIT = "CASE g WHEN 'hourly' THEN 'hour' WHEN 'daily' THEN 'day' WHEN 'weekly' THEN 'week' ELSE 'month' END"


def _each_granularity(df):
    return df.withColumn("granularity", F.explode(F.array(*[F.lit(g) for g in cal.GRANULARITIES])))


@query("d05_floor_to_bucket", f"""
    SELECT event_id, g AS granularity, date_trunc({_UNIT}, ts)::TIMESTAMP::VARCHAR AS bucket FROM events, {_EACH}""")
def _(v):
    each = _each_granularity(v.table("events"))
    return each.select("event_id", "granularity", cal.floor_to_bucket(F.col("ts"), F.col("granularity")).alias("bucket"))


@query("d06_advance", f"""
    SELECT event_id, g AS granularity, (date_trunc({_UNIT}, ts) + CASE g WHEN 'hourly' THEN INTERVAL 1 HOUR
      WHEN 'daily' THEN INTERVAL 1 DAY WHEN 'weekly' THEN INTERVAL 7 DAY ELSE INTERVAL 1 MONTH END)::TIMESTAMP::VARCHAR
      AS bucket FROM events, {_EACH}""")
def _(v):
    g = F.col("granularity")
    each = _each_granularity(v.table("events"))
    return each.select("event_id", "granularity", cal.advance(cal.floor_to_bucket(F.col("ts"), g), g).alias("bucket"))


@query("d07_format_key", f"""
    SELECT o_orderkey, g AS granularity, CASE g WHEN 'hourly' THEN strftime(o_orderdate, '%Y-%m-%dT%H')
      WHEN 'daily' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'weekly' THEN strftime(o_orderdate, '%G-W%V')
      ELSE strftime(o_orderdate, '%Y-%m') END AS key FROM orders, {_EACH}""")
def _(v):
    each = _each_granularity(v.table("orders"))
    return each.select(
        "o_orderkey", "granularity", cal.format_key(F.col("o_orderdate"), F.col("granularity")).alias("key"))


@query("d08_covering_keys", """
    SELECT partition_key, granularity, g AS upstream_granularity, CASE WHEN g = granularity THEN partition_key ELSE
      CASE g WHEN 'hourly' THEN strftime(t, '%Y-%m-%dT%H') WHEN 'daily' THEN strftime(t, '%Y-%m-%d')
      WHEN 'weekly' THEN strftime(t, '%G-W%V') ELSE strftime(t, '%Y-%m') END END AS upstream_key
    FROM (SELECT DISTINCT partition_key, granularity, CASE granularity WHEN 'hourly' THEN date_trunc('hour', event_time)
                    ELSE partition_date::TIMESTAMP END AS t0 FROM v_facts) f,
      unnest(['hourly', 'daily', 'weekly', 'monthly']) AS s(g),
      LATERAL (SELECT unnest(generate_series(
        CASE g WHEN 'weekly' THEN date_trunc('week', t0) WHEN 'monthly' THEN date_trunc('month', t0)
          WHEN 'daily' THEN date_trunc('day', t0) ELSE t0 END::TIMESTAMP,
        (t0 + CASE granularity WHEN 'hourly' THEN INTERVAL 1 HOUR WHEN 'daily' THEN INTERVAL 1 DAY
          WHEN 'weekly' THEN INTERVAL 7 DAY ELSE INTERVAL 1 MONTH END - INTERVAL 1 MICROSECOND)::TIMESTAMP,
        CASE g WHEN 'hourly' THEN INTERVAL 1 HOUR WHEN 'daily' THEN INTERVAL 1 DAY WHEN 'weekly' THEN INTERVAL 7 DAY
          ELSE INTERVAL 1 MONTH END)) AS t) u""")
def _(v):
    each = _each_granularity(
        v.facts.select("partition_key", F.col("granularity").alias("own")).distinct()).select(
        "partition_key", F.col("own").alias("granularity"), F.col("granularity").alias("upstream_granularity"),
        F.explode(cal.covering_keys(F.col("partition_key"), F.col("own"), F.col("granularity"))).alias("upstream_key"))
    return each


@query("d09_day_keys", """
    SELECT strftime(run_date, '%Y-%m-%d') AS day, k AS key FROM (SELECT DISTINCT run_date FROM v_heads), LATERAL (SELECT unnest(list_concat(
      list_transform(range(24), lambda h: strftime(run_date, '%Y-%m-%d') || 'T' || lpad(h::VARCHAR, 2, '0')),
      [strftime(run_date, '%Y-%m-%d'), strftime(run_date, '%G-W%V'), strftime(run_date, '%Y-%m')])) AS k)""")
def _(v):
    day = F.date_format("run_date", "yyyy-MM-dd")
    days = v.run_heads.select(day.alias("day")).distinct()
    return days.select("day", F.explode(cal.day_keys(F.col("day"))).alias("key"))


@query("d10_current_or_previous_period", """
    SELECT event_id, granularity, CASE granularity
        WHEN 'weekly' THEN date_diff('day', date_trunc('week', partition_date), date_trunc('week', goal)) IN (0, 7)
        WHEN 'monthly' THEN (year(goal) * 12 + month(goal)) - (year(partition_date) * 12 + month(partition_date))
             IN (0, 1) END AS in_period
    FROM (SELECT *, partition_date + (event_id % 50)::INTEGER AS goal FROM v_facts)""")
def _(v):
    goal = F.expr("date_add(partition_date, cast(event_id % 50 AS int))")
    return v.facts.select("event_id", "granularity", cal.in_current_or_previous_period(
        F.col("partition_date"), goal, F.col("granularity")).alias("in_period"))


@query("d11_oldest_useful_date",
       "SELECT run_id, (date_trunc('month', run_date) - INTERVAL 1 MONTH)::DATE::VARCHAR AS first_date FROM v_heads")
def _(v):
    return v.run_heads.select("run_id", cal.oldest_useful_date(F.col("run_date")).alias("first_date"))


_CADENCES = ("daily", "hourly", "weekly", "", "daily", "weekly", "hourly", "weekly", "monthly", "hourly", "daily", "")


@query("d12_cron_cadence",
       f"SELECT name, schedule, nullif({texts(_CADENCES)}[pipeline_no % 12 + 1], '') AS cadence FROM v_pipelines")
def _(v):
    return v.pipelines.select("name", "schedule", schedules.cron_cadence(F.col("schedule")).alias("cadence"))


@query("d13_schedule_expression", """
    SELECT name, CASE schedule WHEN '@daily' THEN 'cron(0 0 * * ? *)' WHEN '@hourly' THEN 'cron(0 * * * ? *)'
      WHEN '@weekly' THEN 'cron(0 0 ? * MON *)' ELSE CASE WHEN schedule LIKE 'cron(%' OR schedule LIKE 'rate(%'
      THEN schedule END END AS expression FROM v_pipelines""")
def _(v):
    return v.pipelines.select("name", schedules.resolve_schedule(F.col("schedule")).alias("expression"))


@query("d14_partition_column_granularity", """
    SELECT p_partkey, [NULL, 'hourly', 'daily', 'weekly', 'monthly', 'daily', NULL, 'hourly'][p_partkey % 8 + 1]
      AS granularity FROM part""")
def _(v):
    names = ("region", "YEAR,month,dd,hr", "year, month ,day", "yyyy,wk", "y,m", "dt,region,mm", "hour,region", "hh,d")
    picked = F.element_at(F.array(*[F.lit(n) for n in names]), F.expr("cast(p_partkey % 8 AS int) + 1"))
    return v.table("part").select(
        "p_partkey", schedules.granularity_of_partition_columns(F.split(picked, ",")).alias("granularity"))


@query("d15_date_dimension", """
    SELECT run_id, strftime(run_date, '%G-W%V') AS partition_key, strftime(d, '%Y-%m-%d') AS date_iso,
      strftime(d, '%Y%m%d') AS date_compact, strftime(d, '%Y/%m/%d') AS date_slash,
      strftime(d, '%Y_%m_%d') AS date_underscore, strftime(d, '%Y') AS "year", strftime(d, '%m') AS "month",
      strftime(d, '%d') AS "day", lower(dayname(d)) AS day_of_week, (d - 1)::VARCHAR AS previous_date,
      (d + 1)::VARCHAR AS next_date, (d - 7)::VARCHAR AS minus_7_days, (d - 14)::VARCHAR AS minus_14_days,
      (d - 30)::VARCHAR AS minus_30_days, strftime(d - 7, '%Y%m%d') AS minus_7_days_compact,
      strftime(d - 30, '%Y%m%d') AS minus_30_days_compact
    FROM (SELECT run_id, run_date, date_trunc('week', run_date)::DATE AS d FROM v_heads)""")
def _(v):
    key = cal.format_as(F.col("run_date"), "weekly")
    return v.run_heads.select("run_id", *[c.alias(n) for n, c in cal.date_dimension(key).items()])


@query("d16_duration_ms", """
    SELECT run_id, task_no, CASE WHEN finished_at IS NOT NULL THEN (epoch_us(finished_at) - epoch_us(running_at)) // 1000
      END AS duration_ms FROM v_tasks""")
def _(v):
    return v.tasks.select("run_id", "task_no", cal.duration_ms(F.col("running_at"), F.col("finished_at")).alias("duration_ms"))


@query("d18_staleness", f"""
    SELECT event_id, CASE WHEN t IS NULL THEN 'unknown' WHEN h > 72 THEN 'stale' WHEN h > 48 THEN 'warning'
        ELSE 'fresh' END AS status,
      CASE WHEN t IS NULL THEN 'No data' WHEN h > 72 THEN 'Stale (' || floor(h / 24)::BIGINT || 'd ago)'
        ELSE floor(h)::BIGINT || 'h ago' END AS label, floor(h)::BIGINT AS whole_hours
    FROM (SELECT event_id, t, (epoch_us({NOW_FACTS}) // 1000 - epoch_us(t) // 1000) / 3600000.0::DOUBLE AS h FROM (
      SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN event_time END AS t FROM v_facts))""")
def _(v):
    age = timing.staleness(F.expr("CASE WHEN event_id % 50 <> 0 THEN event_time END"), facts_now())
    return v.facts.select("event_id", age.alias("a")).select(
        "event_id", "a.status", "a.label", F.floor("a.hours").alias("whole_hours"))


@query("d19_retry_waits", """
    SELECT run_id, task_no, attempt::INTEGER AS attempt, w AS wait_seconds, CASE WHEN jitter THEN w // 2 ELSE w END
      AS least_seconds FROM (
      SELECT run_id, task_no, attempt, sk % 4 = 0 AS jitter, CASE WHEN pk % 2 = 0
        THEN least((10 + sk % 50) * (1 << attempt), CASE WHEN pk % 3 = 0 THEN 240 ELSE 3600 END)
        ELSE 10 + sk % 50 END AS w FROM v_tasks, LATERAL (SELECT unnest(range(pk % 10)) AS attempt))""")
def _(v):
    rows = v.tasks.withColumn("attempt", F.explode(F.expr(
        f"CASE WHEN pk % 10 = 0 THEN array() ELSE sequence(0, cast(least(pk % 10, {timing.MAX_RETRIES}) AS int) - 1) END")))
    wait = timing.retry_wait_seconds(
        F.expr("10 + sk % 50"), F.col("attempt"), F.expr("pk % 2 = 0"), F.expr("CASE WHEN pk % 3 = 0 THEN 240 END"))
    return rows.select("run_id", "task_no", F.col("attempt").cast("int").alias("attempt"), wait.alias("wait_seconds"),
                       F.when(F.expr("sk % 4 = 0"), F.floor(wait / 2)).otherwise(wait).alias("least_seconds"))


@query("d20_backoffs", """
    SELECT run_id, task_no, [600, 1200, 1800][least(pk % 6, 2) + 1] AS check_seconds,
      [30, 60, 120, 300][greatest(1, least(pk % 6, 4))] AS start_seconds,
      least(300 * (1 << (pk % 6)), 3600)::BIGINT AS push_seconds FROM v_tasks""")
def _(v):
    n = F.expr("cast(pk % 6 AS int)")
    return v.tasks.select(
        "run_id", "task_no", timing.check_backoff_seconds(n).alias("check_seconds"),
        timing.start_backoff_seconds(n).alias("start_seconds"), timing.push_retry_seconds(n).alias("push_seconds"))


@query("d21_attention_shard", """
    SELECT status || '#' || left(sha256(run_id || ':' || task_no), 1) AS shard, count(*) AS entries
    FROM v_tasks WHERE status IN ('waiting', 'failed', 'waiting_decision') GROUP BY 1""")
def _(v):
    rows = v.tasks.where("status IN ('waiting', 'failed', 'waiting_decision')")
    shard = text.attention_partition(F.col("status"), F.expr("concat(run_id, ':', task_no)"))
    return rows.groupBy(shard.alias("shard")).agg(F.count("*").alias("entries"))


@query("d22_run_name", """
    SELECT event_id, rtrim(left(head, 80 - length(tail)), '-') || tail AS run_name FROM (
      SELECT event_id, trim(regexp_replace(name, '[^A-Za-z0-9_-]+', '-', 'g'), '-') AS head,
        '-' || partition_key || '-' || kind || '-' ||
        left(sha256(name || chr(31) || partition_key || chr(31) || kind || chr(31) || disc), 8) AS tail
      FROM (SELECT event_id, partition_key, source_dag || '/' || asset_name || repeat(' x', (event_id % 60)::INTEGER) || '.'
              AS name, CASE WHEN event_id % 2 = 0 THEN 'and' ELSE 'ev' END AS kind,
              CASE WHEN event_id % 2 = 0 THEN '' ELSE asset_name || '|' || event_id END AS disc FROM v_facts))""")
def _(v):
    name = F.expr("concat(source_dag, '/', asset_name, repeat(' x', cast(event_id % 60 AS int)), '.')")
    kind = F.expr("CASE WHEN event_id % 2 = 0 THEN 'and' ELSE 'ev' END")
    discriminator = F.expr("CASE WHEN event_id % 2 = 0 THEN '' ELSE concat(asset_name, '|', event_id) END")
    return v.facts.select("event_id", text.run_name(name, F.col("partition_key"), kind, discriminator).alias("run_name"))


@query("d25_group_key", """
    SELECT lower(trim(group_name)) AS group_key, min_by(trim(group_name), name) AS label FROM v_pipelines GROUP BY 1""")
def _(v):
    return v.pipelines.groupBy(text.group_key(F.col("group_name")).alias("group_key")).agg(
        F.min_by(F.trim("group_name"), "name").alias("label"))


@query("d27_output_kind", """
    SELECT run_id, task_no, CASE WHEN pk % 11 = 0 THEN 'manual' WHEN pk % 13 = 0 THEN 'pointer'
      WHEN pk % 17 = 0 THEN 'truncated' WHEN pk % 19 = 0 THEN 'text' ELSE 'value' END AS kind FROM v_outputs""")
def _(v):
    return v.outputs.select("run_id", "task_no", text.output_kind(F.col("result")).alias("kind"))


@query("p05_search", """
    SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'brand#1')
      AND contains(lower(p_name || ' ' || p_brand), 'red')""")
def _(v):
    return v.table("part").where(
        text.matches_search(F.expr("concat(p_name, ' ', p_brand)"), F.lit("  BRAND#1  red "))).select("p_partkey")


@query("p05_search_index", """
    WITH asked AS (SELECT p_size AS search_id, CASE p_size % 4 WHEN 0 THEN upper(left(min(p_name), 4)) || '  ' || right(min(p_brand), 1)
        WHEN 1 THEN min(p_brand) WHEN 2 THEN right(min(p_name), 5) || ' a' ELSE 'zz' || p_size END AS search FROM part GROUP BY p_size)
    SELECT search_id, p_partkey FROM asked, part WHERE len(list_filter(regexp_split_to_array(lower(search), '\\s+'),
      lambda t: t <> '' AND NOT contains(lower(p_name || ' ' || p_brand), t))) = 0""".replace("WITH asked", "SELECT * FROM (WITH asked") + ")")
def _(v):
    part = v.table("part")
    registry = part.select("p_partkey", F.expr("concat(p_name, ' ', p_brand)").alias("shown"))
    searches = part.groupBy(F.col("p_size").alias("search_id")).agg(F.expr(
        "CASE p_size % 4 WHEN 0 THEN upper(left(min(p_name), 4)) || '  ' || right(min(p_brand), 1) WHEN 1 THEN min(p_brand)"
        " WHEN 2 THEN right(min(p_name), 5) || ' a' ELSE 'zz' || p_size END").alias("search"))
    index = cut_lineage(search.postings(registry, "p_partkey", "shown"))
    return search.search(registry, index, searches, "p_partkey", "shown")


@query("p11_restart_allowed", """
    SELECT run_id, started_at + INTERVAL 275 DAY > TIMESTAMP '2001-12-31' AS allowed FROM v_heads""")
def _(v):
    return v.run_heads.select("run_id", timing.restart_allowed(F.col("started_at"), runs_now()).alias("allowed"))


@query("p14_output_readable", """
    SELECT run_id, task_no, CASE WHEN status = 'success' OR (status = 'skipped' AND skip_origin IN ('manual', 'run'))
      THEN 'ok' WHEN status IN ('failed', 'upstream_failed', 'aborted', 'stopped') THEN 'upstream_failed'
      ELSE 'missing' END AS readable FROM v_tasks""")
def _(v):
    return v.tasks.select("run_id", "task_no", vocab.readable_class(F.col("status"), F.col("skip_origin")).alias("readable"))
