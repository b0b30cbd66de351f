"""State tables derived from the test tables: the inputs of every registered query.

Each view is a plain projection or a grouping over a whole test table, so its size grows with the data.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowgauge.functions import calendar as cal, vocab
from flowgauge.operators.runs import run_summary

# Reference instants, never the clock.
RUNS_NOW = "2001-12-31 00:00:00"
FACTS_NOW = "2024-01-31 00:00:00"

# Fixed value: rows of a table that one task gets where they are dealt out by a key.
TASK_ROWS = 100_000

# The schedule texts and column types the derived registry uses.
SCHEDULES = (
    "@daily", "@hourly", "@weekly", "cron(0 9 ? * MON-FRI *)", "cron(0 2 * * ? *)", "0 3 * * 1", "rate(1 hour)",
    "rate(7 days)", "cron(0 0 1 * ? *)", "*/15 * * * *", "", "@once",
)
TYPE_TEXTS = (
    "INT", "integer", "long", " bigint ", "decimal(10,2)", "Decimal(12)", "varchar(20)", "array<integer>",
    "map<string, long>", "struct<a:int,b:array<bool>>", "datetime", "decimal(50,2)", "array<nothing>", "real",
    "struct<a int, b  string>", "struct<a:int,a:int>", "struct<a:int,b:struct<a:int>>", "array<" * 14 + "long" + ">" * 14,
    "map<string,struct<x:int,y:int,x:date>>", "struct<ab:int,b:int>",
)


def lit_array(values) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def runs_now():
    return F.lit(RUNS_NOW).cast("timestamp_ntz")


def facts_now():
    return F.lit(FACTS_NOW).cast("timestamp_ntz")


def minutes(n) -> str:
    return f"make_dt_interval(0, 0, {n}, 0)"


def facts_of(events: DataFrame) -> DataFrame:
    """The facts an event table (or stream) stands for."""
    granularity = F.expr(
        "CASE event_type WHEN 'click' THEN 'hourly' WHEN 'signup' THEN 'weekly' WHEN 'error' THEN 'monthly'"
        " ELSE 'daily' END")
    return events.withColumn("granularity", granularity).select(
        "event_id", F.col("event_type").alias("asset_name"), F.col("ts").alias("event_time"), "granularity",
        cal.format_key(F.col("ts"), F.col("granularity")).alias("partition_key"),
        cal.floor_to_bucket(F.col("ts"), F.col("granularity")).cast("date").alias("partition_date"),
        F.expr("CASE event_id % 10 WHEN 0 THEN 'none' WHEN 1 THEN 'all' ELSE 'auto' END").alias("cascade"),
        F.expr("concat('p', user_id % 7)").alias("source_dag"),
    )


def with_gaps(facts: DataFrame) -> DataFrame:
    """Facts without those of some days: for the queries that look for what is missing."""
    return facts.where(
        "CASE granularity WHEN 'monthly' THEN true WHEN 'weekly' THEN weekofyear(event_time) % 3 <> 0"
        " ELSE (day(event_time) * 7 + length(asset_name)) % 5 <> 0 END")


def raw_facts_of(facts: DataFrame) -> DataFrame:
    """Facts as writers of all ages left them: missing keys, broken keys, loose dates."""
    return facts.selectExpr(
        "event_id", "asset_name", "event_time", "cascade", "source_dag",
        "CASE WHEN event_id % 53 = 0 THEN '2024-02-31' WHEN event_id % 59 = 0 THEN 'latest'"
        " WHEN event_id % 7 = 0 THEN NULL ELSE partition_key END AS partition_key",
        "partition_key AS execution_date",
        "CASE WHEN event_id % 61 = 0 THEN NULL ELSE granularity END AS granularity",
        "CASE WHEN event_id % 3 = 0 THEN date_format(partition_date, 'yyyy-MM-dd')"
        " WHEN event_id % 67 = 0 THEN '20240131' END AS partition_date",
    )


class Views:
    """The derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def dealt(self, name: str, key: str) -> DataFrame:
        """A table dealt out by ``key`` in tasks of about ``TASK_ROWS`` rows, so what a task holds doesn't grow with the table."""
        rows = self.table(name)
        return rows.repartition(max(6, rows.count() // TASK_ROWS + 1), key)

    @cached_property
    def tasks_all(self) -> DataFrame:
        slots = self.dealt("lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("run_id"), "l_linenumber").agg(
            F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"),
            F.min("l_quantity").cast("int").alias("q"),
        )
        # At most seven line numbers exist per order, so this window's groups are bounded.
        number = F.row_number().over(Window.partitionBy("run_id").orderBy("l_linenumber"))
        return slots.select("run_id", number.alias("task_no"), "pk", "sk", "q")

    @cached_property
    def runs(self) -> DataFrame:
        counts = self.tasks_all.groupBy("run_id").agg(F.max("task_no").alias("task_count"))
        return self.run_heads.join(counts, "run_id", "left").withColumn(
            "task_count", F.coalesce("task_count", F.lit(0)))

    @cached_property
    def run_heads(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS run_id",
            "concat('pl_', o_custkey) AS pipeline",
            "o_custkey AS pipeline_no",
            "cast(o_orderdate AS date) AS run_date",
            "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400) AS started_at",
            "o_orderdate AS started_day",
            "o_orderkey % 97 = 0 AS step_failed",
            "lower(substring(o_orderpriority, 3)) AS triggered_by",
        )

    @cached_property
    def tasks(self) -> DataFrame:
        rules = lit_array(vocab.TRIGGER_RULES)
        base = self.tasks_all.where("(run_id + task_no) % 41 <> 0").join(
            self.run_heads.select("run_id", "pipeline", "run_date", "started_at"), "run_id"
        ).withColumn("k", F.expr("(pk + 3 * sk + task_no) % 20"))
        rows = base.selectExpr(
            "run_id", "task_no", "concat('task_', task_no) AS task_name", "pipeline", "run_date", "pk", "sk",
            """CASE k WHEN 0 THEN 'failed' WHEN 1 THEN 'upstream_failed' WHEN 2 THEN 'stopped' WHEN 3 THEN 'aborted'
               WHEN 8 THEN 'waiting' WHEN 9 THEN 'running' WHEN 10 THEN 'waiting_decision' WHEN 11 THEN 'succeeded'
               ELSE CASE WHEN k BETWEEN 4 AND 7 THEN 'skipped' ELSE 'success' END END AS status""",
            "CASE k WHEN 4 THEN 'manual' WHEN 5 THEN 'run' WHEN 6 THEN 'rule' END AS skip_origin",
            f"CASE WHEN pk % 50 = 0 THEN 'always' ELSE element_at({rules}, cast(pk % 9 AS int) + 1) END AS trigger_rule",
            "started_at", f"started_at + {minutes('task_no')} AS running_at", "q",
            "CASE WHEN run_id % 23 = 0 THEN 2 ELSE 1 END AS generation",
        )
        return rows.withColumn(
            "finished_at", F.when(vocab.is_final(F.col("status")), F.expr(f"running_at + {minutes('q')}")))

    @cached_property
    def edges(self) -> DataFrame:
        return self.tasks_all.where("task_no > 1").select(
            "run_id", "task_no",
            F.explode(F.expr("CASE WHEN task_no % 2 = 1 AND task_no > 2 THEN array(task_no - 1, task_no - 2)"
                             " ELSE array(task_no - 1) END")).alias("upstream_no"))

    @cached_property
    def pipelines(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "concat('pl_', c_custkey) AS name", "c_custkey AS pipeline_no",
            "CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN concat(' Team', c_custkey % 4)"
            " ELSE concat('team', c_custkey % 4, ' ') END AS group_name",
            f"element_at({lit_array(SCHEDULES)}, cast(c_custkey % 12 AS int) + 1) AS schedule",
            "date_format(date_add(date'2023-01-01', cast(c_custkey % 300 AS int)), 'yyyy-MM-dd') AS partition_start",
        )

    @cached_property
    def facts(self) -> DataFrame:
        return facts_of(self.table("events"))

    @cached_property
    def raw_facts(self) -> DataFrame:
        return raw_facts_of(self.facts)

    @cached_property
    def targets(self) -> DataFrame:
        assets = self.facts.select("asset_name").distinct()
        return assets.select("asset_name", F.explode(
            F.expr("sequence(date'2024-01-01', date'2024-03-10')")).alias("target_date"))

    @cached_property
    def subscriptions(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "concat('p', n_nationkey) AS pipeline", "n_nationkey AS n",
            "CASE WHEN n_nationkey % 2 = 0 THEN 'AND' ELSE 'OR' END AS operator",
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(n_nationkey % 5) AS subscribed_at",
            "array('click', 'error', 'purchase', 'signup', 'view') AS names",
        ).selectExpr(
            "pipeline", "n", "operator", "subscribed_at",
            "element_at(names, n % 5 + 1) AS a", "element_at(names, (n + 1 + n % 3) % 5 + 1) AS b",
            "element_at(names, (n + 2) % 5 + 1) AS c",
        )

    @cached_property
    def schedules(self) -> DataFrame:
        """Each subscribing pipeline's schedule as the JSON text a registry holds: one of three shapes."""
        leaf_b = "'{\"asset_name\":\"' || b || '\",\"freshness_hours\":24}'"
        leaf_b3 = "'{\"asset_name\":\"' || b || '\",\"consecutive_days\":3}'"
        return self.subscriptions.selectExpr(
            "pipeline AS spec_id", "n",
            "CASE n % 3 WHEN 0 THEN '{\"operator\":\"' || operator || '\",\"assets\":[\"' || a || '\"]}'"
            " WHEN 1 THEN '{\"operator\":\"' || operator || '\",\"assets\":[\"' || a || '\",' || " + leaf_b + " || ']}'"
            " ELSE '{\"operator\":\"' || operator || '\",\"assets\":[\"' || a || '\",{\"operator\":\"OR\",\"assets\":['"
            " || " + leaf_b3 + " || ',\"' || c || '\"]}]}' END AS schedule_text")

    @cached_property
    def lineage_nodes(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey AS asset", "p_brand AS pipeline",
            "CASE p_partkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END AS granularity")

    @cached_property
    def lineage_edges(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("asset"),
            F.explode(F.expr("array_distinct(array(p_partkey div 2, p_partkey div 3))")).alias("upstream"),
        ).where("upstream > 0 AND upstream <> asset")

    @cached_property
    def task_io(self) -> DataFrame:
        """One row per task: the asset it writes, the pipeline that owns it and the assets it reads."""
        return self.table("part").selectExpr(
            "p_brand AS pipeline", "p_partkey AS task", "p_partkey AS ordinal",
            "CASE WHEN p_partkey % 40 = 0 THEN p_partkey div 2 ELSE p_partkey END AS outlet",
            "CASE p_partkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' END AS granularity",
            "filter(array_distinct(array(p_partkey div 2, p_partkey div 3, p_partkey + 1000000)), x -> x > 0) AS inlets")

    @cached_property
    def triggers(self) -> DataFrame:
        """Pipeline-triggers-pipeline edges: blocks of five suppliers, so cycles grow with the table."""
        return self.table("supplier").select(F.col("s_suppkey").alias("n")).select(F.explode(F.expr(
            "filter(array("
            " CASE WHEN n % 5 <> 4 THEN struct(n AS src, n + 1 AS dst) ELSE struct(n AS src, n - 4 AS dst) END,"
            " CASE WHEN n % 5 = 1 THEN struct(n AS src, n + 2 AS dst) END,"
            " CASE WHEN n % 25 = 7 THEN struct(n AS src, n AS dst) END,"
            " CASE WHEN n % 5 = 0 THEN struct(n AS src, n + 5 AS dst) END), x -> x IS NOT NULL)"
        )).alias("e")).select("e.src", "e.dst", F.expr("concat('asset_', e.src)").alias("label"))

    @cached_property
    def declarations(self) -> DataFrame:
        types = lit_array(TYPE_TEXTS)
        return self.table("part").groupBy(
            F.col("p_name").alias("asset"), F.col("p_brand").alias("pipeline"),
            F.expr("p_size % 5").alias("ordinal"),
        ).agg(F.min("p_partkey").alias("pk")).selectExpr(
            "asset", "pipeline", "ordinal", "concat('c', ordinal) AS column_name", "pk",
            f"element_at({types}, cast(pk % {len(TYPE_TEXTS)} AS int) + 1) AS type_text",
            "pk % 2 = 0 AS nullable", "pk % 11 = 0 AS primary_key", "pk % 13 = 0 AS partition_key",
            "CASE WHEN pk % 3 = 0 THEN 'described' ELSE '' END AS description")

    @cached_property
    def outcomes(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_custkey AS backfill_id", "o_orderkey AS item", "date_format(o_orderdate, 'yyyy-MM-dd') AS partition_key",
            "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'pending' END AS outcome",
            "o_custkey % 29 = 0 AS canceled", "cast(o_orderkey % 4 AS int) AS tier", "o_orderkey % 6 = 0 AS reused",
            "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400) AS at")

    @cached_property
    def backfills(self) -> DataFrame:
        """One record per backfill, with a parent for some and its partition keys as JSON text."""
        return self.outcomes.groupBy("backfill_id").agg(
            F.min("partition_key").alias("first_key"), F.max("partition_key").alias("last_key"),
            F.min("at").alias("started_at"), F.max("at").alias("finished_at"),
            F.count("*").alias("total"), F.count_if(F.expr("outcome = 'completed'")).alias("completed"),
            F.count_if(F.expr("outcome = 'failed'")).alias("failed"),
        ).selectExpr(
            "backfill_id", "concat('pl_', backfill_id % 20) AS target_pipeline",
            "CASE WHEN backfill_id % 29 = 0 THEN 'canceled' WHEN backfill_id % 3 = 0 THEN 'running'"
            " WHEN failed = 0 THEN 'completed' WHEN completed = 0 THEN 'failed' ELSE 'partial' END AS status",
            "CASE WHEN backfill_id % 31 = 0 THEN NULL ELSE started_at END AS started_at",
            "CASE WHEN backfill_id % 3 = 0 THEN NULL ELSE finished_at END AS finished_at",
            "total", "completed", "failed",
            "CASE WHEN backfill_id % 17 = 0 THEN '[broken' WHEN backfill_id % 19 = 0 THEN '[]'"
            " ELSE '[\"' || last_key || '\",\"' || first_key || '\"]' END AS partition_keys",
            "CASE WHEN backfill_id % 4 = 1 THEN backfill_id - 1 END AS parent_id",
            "CASE WHEN backfill_id % 5 = 0 THEN 'all' ELSE 'auto' END AS cascade")

    @cached_property
    def task_events(self) -> DataFrame:
        return self.table("events").selectExpr(
            "user_id AS task_run_id", "event_id",
            "cast(date_trunc('HOUR', ts) AS timestamp_ntz) AS event_time",
            "CASE event_type WHEN 'signup' THEN '05' WHEN 'error' THEN '20' WHEN 'view' THEN '30' ELSE '10' END AS ord",
            "CASE event_type WHEN 'signup' THEN 'DEPS_READY' WHEN 'click' THEN 'TASK_STARTED'"
            " WHEN 'purchase' THEN 'TASK_RETRY_STARTED' WHEN 'error' THEN 'TASK_FINISHED' ELSE 'MANUAL_DECISION' END"
            " AS event_type")

    @cached_property
    def run_events(self) -> DataFrame:
        """Pause and resume clicks per run: one stream of alternating and repeated requests."""
        return self.table("events").selectExpr(
            "user_id AS run_id", "event_id", "ts AS at",
            "CASE WHEN event_type IN ('click', 'purchase') THEN 'pause' ELSE 'resume' END AS action")

    @cached_property
    def row_log(self) -> DataFrame:
        """Every write to a task row, with the image before and after it."""
        steps = F.expr("""filter(array(
            struct(1 AS seq, cast(null AS string) AS old_status, 'waiting' AS new_status, 'start_run' AS writer,
                   'start_run' AS kind, 0 AS raise),
            CASE WHEN status <> 'waiting' THEN struct(2 AS seq, 'waiting' AS old_status,
                CASE WHEN run_id % 101 = 0 THEN 'running' ELSE 'deps_ready' END AS new_status,
                CASE WHEN run_id % 101 = 0 THEN 'run_task' ELSE 'dispatcher' END AS writer,
                CASE WHEN run_id % 101 = 0 THEN 'run_task' ELSE 'decision' END AS kind, 0 AS raise) END,
            CASE WHEN status <> 'waiting' AND run_id % 101 <> 0 THEN struct(3 AS seq, 'deps_ready' AS old_status,
                'running' AS new_status, 'run_task' AS writer, 'run_task' AS kind, 0 AS raise) END,
            CASE WHEN status NOT IN ('waiting', 'running') THEN struct(4 AS seq, 'running' AS old_status,
                status AS new_status,
                CASE WHEN status IN ('success', 'waiting_decision', 'succeeded') THEN 'run_task'
                     WHEN status IN ('failed', 'upstream_failed') THEN 'dispatcher' ELSE 'console' END AS writer,
                CASE WHEN status IN ('success', 'waiting_decision', 'succeeded') THEN 'run_task'
                     WHEN status IN ('failed', 'upstream_failed') THEN 'decision' ELSE 'action' END AS kind,
                CASE WHEN status IN ('skipped', 'stopped') AND run_id % 10 <> 0 THEN 1 ELSE 0 END AS raise) END,
            CASE WHEN run_id % 23 = 0 AND status NOT IN ('waiting', 'running') THEN struct(5 AS seq,
                status AS old_status, 'waiting' AS new_status, 'console' AS writer, 'action' AS kind, 1 AS raise) END
            ), x -> x IS NOT NULL)""")
        rows = self.tasks.select("run_id", "task_no", "status", "started_at", F.explode(steps).alias("s"))
        raised = "CASE WHEN s.seq = 5 AND status IN ('skipped', 'stopped') AND run_id % 10 <> 0 THEN 2 ELSE 1 END"
        return rows.selectExpr(
            "run_id", "task_no", "s.seq AS seq", "s.old_status AS old_status", "s.new_status AS new_status",
            "s.writer AS writer", "s.kind AS kind", f"{raised} AS generation_before",
            f"{raised} + s.raise AS generation_after",
            "run_id % 103 <> 0 AS conditional", "run_id % 103 <> 0 AS checks_run_version",
            f"CASE WHEN (run_id + task_no) % 107 = 0 THEN 9 ELSE {raised} END AS writer_generation",
            f"started_at + {minutes('s.seq')} AS at")

    @cached_property
    def pauses(self) -> DataFrame:
        return self.run_heads.selectExpr(
            "run_id",
            f"struct(started_at + {minutes('10')} AS start,"
            f" started_at + {minutes('10 + (pipeline_no % 4) * 5')} AS end) AS first",
            f"struct(started_at + {minutes('60')} AS start, cast(null AS timestamp_ntz) AS end) AS second",
        ).selectExpr("run_id", "CASE WHEN run_id % 31 = 0 THEN array(first, second) ELSE array(first) END AS pauses")

    @cached_property
    def row_times(self) -> DataFrame:
        """What each task row records that its deadlines read, next to its run's pauses."""
        rows = self.tasks.join(self.pauses, "run_id")
        m = minutes
        return rows.selectExpr(
            "run_id", "task_no", "pauses",
            "CASE WHEN status = 'success' AND pk % 4 = 0 THEN 'deps_ready' ELSE status END AS status",
            "started_at AS waiting_since",
            f"CASE WHEN sk % 4 <> 0 THEN started_at + {m('pk % 50')} END AS enabled_at",
            "pk % 3 = 0 AS has_wait_for",
            f"CASE WHEN pk % 7 = 0 THEN {m('30 + sk % 600')} END AS orchestration_timeout",
            f"CASE WHEN pk % 11 = 0 THEN running_at + {m('20')} END AS countdown_end",
            f"CASE WHEN sk % 9 = 0 THEN started_at + {m('3')} END AS start_failed_first",
            f"CASE WHEN sk % 9 = 0 THEN started_at + {m('9')} END AS start_failed_last",
            "cast(CASE WHEN sk % 9 = 0 THEN pk % 6 ELSE 0 END AS int) AS start_failures",
            "running_at AS status_since",
            f"CASE WHEN pk % 5 = 0 THEN running_at + {m('12')} END AS last_check",
            "cast(pk % 5 AS int) AS checks",
            "CASE WHEN status = 'waiting_decision' THEN running_at END AS decision_since",
            f"CASE WHEN status = 'waiting_decision' THEN {m('60 * (1 + sk % 48)')} END AS decision_timeout")

    @cached_property
    def run_rows(self) -> DataFrame:
        """Run rows with their summary; every seventh run is older than run rows and has none."""
        ends = self.tasks.groupBy("run_id").agg(F.max("finished_at").alias("finished_at"))
        return self.run_heads.where("run_id % 7 <> 0").join(run_summary(self.tasks), "run_id", "left").join(
            ends, "run_id", "left").withColumn(
            "execution", F.expr("concat(pipeline, ':', run_date, '.', run_id)"))

    @cached_property
    def executions(self) -> DataFrame:
        """What is known of the execution behind each unfinished row at a check."""
        return self.tasks.where("status IN ('running') OR (status = 'success' AND pk % 4 = 0)").selectExpr(
            "run_id", "task_no", "CASE pk % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'FAILED' END AS execution_status")

    @cached_property
    def outputs(self) -> DataFrame:
        """A stored output of most tasks: values, markers, pointers, cut and bare texts."""
        return self.tasks.where("(run_id + task_no) % 5 <> 0").selectExpr(
            "run_id", "pipeline", "task_no", "run_date",
            "CASE WHEN pk % 11 = 0 THEN '{\"_manually_resolved\":true,\"_resolution\":\"skip\",\"_operator\":\"op'"
            " || sk || '\",\"_reason\":\"r\",\"_pipeline_execution\":\"' || run_id || '\"}'"
            " WHEN pk % 13 = 0 THEN '{\"_s3_ref\":\"store://bucket/' || pk || '.json\"}'"
            " WHEN pk % 17 = 0 THEN '{\"_truncated\":true}'"
            " WHEN pk % 19 = 0 THEN 'plain text'"
            " WHEN pk % 23 = 0 THEN '{\"_manually_resolved\":\"yes\"}'"
            " ELSE '{\"rows\":' || pk || '}' END AS result")

    # State tables the audit checks read.

    @cached_property
    def audit_tasks(self) -> DataFrame:
        return self.tasks.selectExpr(
            "run_id", "task_no", "status", "generation",
            "CASE WHEN (run_id * 7 + task_no) % 211 = 0 THEN 'wait_token' END AS token_fields",
            "started_at + make_dt_interval(455) AS expires_at",
            "(run_id + task_no) % 37 <> 0 AS output_recorded",
            f"started_at + {minutes('CASE WHEN pk % 10 = 0 THEN 900 ELSE 0 END')} AS waiting_since")

    @cached_property
    def audit_runs(self) -> DataFrame:
        now = f"timestamp_ntz'{RUNS_NOW}'"
        return self.run_heads.selectExpr(
            "run_id",
            "CASE WHEN run_id % 89 = 0 THEN 'creating' ELSE 'active' END AS status",
            "concat('tk', run_id) AS token",
            "CASE WHEN run_id % 13 <> 0 THEN concat('tk', run_id) END AS answered",
            "run_id % 17 = 0 AS stop_mark", "run_id % 34 = 0 AS stop_done", "run_id % 19 = 0 AS request_pending",
            "run_id % 31 = 0 AS paused",
            f"CASE WHEN run_id % 11 <> 0 THEN {now} + {minutes('run_id % 50')} END AS due_at",
            "started_at + make_dt_interval(455) AS expires_at",
            "run_id % 5 = 0 AS execution_ended",
            f"CASE WHEN run_id % 5 = 0 THEN started_at + {minutes('600')} END AS execution_ended_at")

    @cached_property
    def audit_executions(self) -> DataFrame:
        return self.tasks.select(
            "run_id", "task_no", "generation",
            F.expr("status = 'running' OR (run_id + task_no) % 83 = 0").alias("running"),
            F.explode(F.expr("CASE WHEN (run_id + task_no) % 97 = 0 THEN array(1, 2) ELSE array(1) END")).alias("copy"))

    @cached_property
    def audit_starts(self) -> DataFrame:
        return self.tasks.selectExpr(
            "run_id", "task_no", "generation",
            "CASE WHEN (run_id + task_no) % 79 = 0 THEN 'waiting' ELSE 'deps_ready' END AS row_status",
            "CASE WHEN (run_id + task_no) % 71 = 0 THEN generation + 1 ELSE generation END AS row_generation")

    @cached_property
    def audit_passes(self) -> DataFrame:
        return self.run_heads.selectExpr(
            "run_id AS pass_id", "cast(run_id % 7 = 0 AS int) AS unresolved_reads", "cast(run_id % 3 AS int) AS starts",
            "cast(run_id % 2 AS int) AS closes", "cast(run_id % 5 = 0 AS int) AS answers")

    @cached_property
    def audit_answers(self) -> DataFrame:
        """Answers given to every fourth run, each with the rows of its run that have not ended."""
        unfinished = self.audit_tasks.groupBy("run_id").agg(
            F.count_if(~vocab.is_final(F.col("status"))).cast("int").alias("unfinished"))
        answered = self.run_heads.where("run_id % 4 = 0").selectExpr(
            "run_id", "concat('tk', run_id) AS token", "run_id % 17 = 0 AS stop_mark",
            "cast(run_id % 3 AS int) AS raced_task")
        return answered.join(unfinished, "run_id", "left").withColumn("unfinished", F.coalesce("unfinished", F.lit(0)))
