"""Streaming jobs: the batch operators of this library, applied batch by batch to live tables.

Every job writes what a micro-batch produced to a folder of that batch, overwriting it, so a batch that is run again
after a failure leaves the same rows: the sinks are idempotent and the sources replayable. State that must last
(which facts, runs or alerts were already seen) is read back from those folders, never from the driver. By default no job
drops late rows: a late fact is a row like any other, and what it may still change is decided by the operators.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from flowgauge.operators import audit, conditions, runs
from flowgauge.session import cut_lineage, scratch_dir
from flowgauge.sources import facts as fact_source
from flowgauge.streaming import stateful
from flowgauge.streaming.fact_index import FactIndex, Reach
from flowgauge.streaming.tables import DayTable, remove


def read_parquet_stream(spark: SparkSession, folder: str, schema: T.StructType, name: str | None = None,
                        files_per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder (one file name, if given)."""
    reader = spark.readStream.schema(schema)
    if name:
        reader = reader.option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


class BatchTable:
    """A table made of one folder per micro-batch and, where ``day_of`` names a time, one below it for each of its days."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, day_of: str | None = None):
        self.spark, self.path, self.schema, self.day_of = spark, path, schema, day_of
        self.write(spark.createDataFrame([], schema), -1)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        if self.day_of:
            day = F.coalesce(F.to_date(self.day_of).cast("string"), F.lit("none"))
            rows.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/batch_id={batch_id}")
        else:
            rows.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def before(self, batch_id: int, first=None, last=None) -> DataFrame:
        """What earlier batches wrote; the folder of this batch, if it was tried before, does not count.

        Where the table has days, only the folders from ``first`` to ``last`` and that of rows without a day are read.
        """
        rows = self._all().where(F.col("batch_id") < batch_id)
        if self.day_of and first is not None:
            rows = rows.where(F.col("day").between(str(first), str(last)) | (F.col("day") == "none"))
        elif self.day_of:
            rows = rows.where(F.col("day") == "none")
        return rows.select(*self.schema.names)

    def _all(self) -> DataFrame:
        fields = [*self.schema.fields, T.StructField("batch_id", T.LongType())]
        if self.day_of:
            fields.append(T.StructField("day", T.StringType()))
        return self.spark.read.schema(T.StructType(fields)).parquet(self.path)

    def all(self) -> DataFrame:
        return self._all().select(*self.schema.names, "batch_id")

    def rows(self) -> DataFrame:
        return self._all().select(*self.schema.names)


def drain(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run ``step`` on everything the stream holds now, batch by batch, and stop."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(step).start()
    )
    query.awaitTermination()


def ingest_facts(spark: SparkSession, raw: DataFrame, folder: str) -> tuple[BatchTable, BatchTable]:
    """Normalise facts as they arrive; unreadable ones go aside, once each, and hold nothing up.

    A fact that was stored before, by asset and time, is skipped; of several facts of one asset and time in a batch the one
    with the least key stays. Stored facts lie in a folder for each day of their time, and a batch reads those between its
    first and its last day, and the folder of those without a time.
    """
    columns = ["asset_name", "event_time", "partition_key", "partition_date", "granularity", "cascade", "source_dag"]
    key = ["asset_name", "event_time"]
    shape = fact_source.normalize_facts(raw).select(*columns).schema
    good = BatchTable(spark, f"{folder}/facts", shape, day_of="event_time")
    bad = BatchTable(spark, f"{folder}/unreadable", T.StructType([shape["asset_name"], shape["event_time"]]), day_of="event_time")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        readable, unreadable = fact_source.split_facts(batch)
        days = batch.agg(F.min(F.to_date("event_time")).alias("first"), F.max(F.to_date("event_time")).alias("last")).first()

        def fresh(rows: DataFrame, table: BatchTable) -> DataFrame:
            seen = table.before(batch_id, days["first"], days["last"]).select(*[F.col(c).alias(f"seen_{c}") for c in key])
            same = [F.col(c).eqNullSafe(F.col(f"seen_{c}")) for c in key]
            return rows.join(seen, same[0] & same[1], "left_anti")

        rest = [c for c in columns if c not in key]
        one = readable.groupBy(*key).agg(F.min(F.struct(*rest)).alias("first")).select(*key, "first.*").select(*columns)
        good.write(fresh(one, good), batch_id)
        bad.write(fresh(unreadable, bad), batch_id)
        batch.unpersist()

    drain(raw, step, f"{folder}/checkpoint")
    return good, bad


_REQUEST = T.StructType([
    T.StructField("run_name", T.StringType()), T.StructField("consumer", T.StringType()),
    T.StructField("run_date", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("trigger_asset", T.StringType()), T.StructField("first_event_time", T.TimestampNTZType())])
#: How far back the catch-up replays facts, and how often it runs.
REPLAY_WINDOW, REPLAY_EVERY = dt.timedelta(hours=48), dt.timedelta(hours=1)
#: What the numbers of replays (by their hour) and of late batches begin with, above those of a stream's batches.
REPLAYS, LATE = 1 << 40, 1 << 41


class PushTables:
    """What push evaluation stores: the index of facts, and the requested runs in a folder for each run date."""

    def __init__(self, spark: SparkSession, folder: str):
        self.index = FactIndex(spark, f"{folder}/facts")
        self.requests = DayTable(spark, f"{folder}/requests", _REQUEST, "run_date", lambda rows: rows.dropDuplicates(["run_name"]))

    def emit(self, facts: DataFrame, subscriptions: DataFrame, nodes: DataFrame, depth: int, reach: Reach, batch_id: int) -> None:
        """Store the requests of ``facts`` that are not there yet. Only what these facts concern is read."""
        span = facts.agg(F.min("partition_date").alias("first"), F.max("partition_date").alias("last")).first()
        if span["first"] is None:
            return
        asked = conditions.push_requests(facts, subscriptions, nodes, self.index.known(facts, reach), depth)
        if self.requests.days(span["first"], span["last"]):
            before = self.requests.read(span["first"], span["last"], besides=batch_id)
            asked = conditions.replay_requests(asked, before)
        self.requests.add(asked, batch_id)
        self.requests.compact(span["first"], span["last"])

    def rows(self) -> DataFrame:
        return self.requests.rows()


def push_evaluation(spark: SparkSession, facts: DataFrame, subscriptions: DataFrame, nodes: DataFrame,
                    folder: str, history: DataFrame | None = None) -> PushTables:
    """Run requests of facts as they arrive, each deterministic run name emitted once.

    A batch adds its facts to the index and reads from it what its own facts are judged by; ``history`` is indexed first.
    """
    depth, reach = conditions.depth_of(nodes), Reach(nodes)
    tables = PushTables(spark, folder)
    if history is not None:
        tables.index.add(history, -1)

    def step(batch: DataFrame, batch_id: int) -> None:
        arrived = batch.select(*tables.index.columns).persist()
        tables.index.add(arrived, batch_id)
        tables.emit(arrived, subscriptions, nodes, depth, reach, batch_id)
        tables.index.compact(arrived)
        arrived.unpersist()

    drain(facts, step, f"{folder}/checkpoint")
    return tables


def record_late(tables: PushTables, facts: DataFrame, number: int) -> None:
    """Index facts that no push evaluation has seen, as the batch ``number`` of such facts."""
    tables.index.add(facts, LATE + number)
    tables.index.compact(facts)


def replay_due(now: dt.datetime, last: dt.datetime | None) -> bool:
    """Whether the catch-up is to run again; it may always when it never ran."""
    return last is None or now - last >= REPLAY_EVERY


def replay_late(spark: SparkSession, tables: PushTables, subscriptions: DataFrame, nodes: DataFrame, now: dt.datetime) -> None:
    """The scheduled catch-up: replay the facts recorded in the last 48 hours and store the requests that are not there.

    Each fact is judged as of its own time, as when it arrives, so a replay gives the answer that the stream gives and
    never another one for a run that was requested. Two runs in one hour are one run. Only the folders of these hours and
    what the facts in them are judged by are read, so the work doesn't grow with the past.
    """
    recent = tables.index.recorded(now - REPLAY_WINDOW, now).persist()
    hour = int(now.replace(tzinfo=dt.timezone.utc).timestamp()) // 3600
    tables.emit(recent, subscriptions, nodes, conditions.depth_of(nodes), Reach(nodes), REPLAYS + hour)
    recent.unpersist()


def wake_waiting_runs(spark: SparkSession, facts: DataFrame, waits: DataFrame, folder: str) -> BatchTable:
    """Per batch, the runs with a task that waits on one of its facts' assets."""
    table = BatchTable(spark, f"{folder}/runs", T.StructType([
        T.StructField("run_id", T.LongType()), T.StructField("waiting_tasks", T.LongType())]))
    drain(facts, lambda batch, n: table.write(conditions.waiting_runs(batch, waits), n), f"{folder}/checkpoint")
    return table


def wake_changed_runs(spark: SparkSession, log: DataFrame, folder: str) -> BatchTable:
    """Per batch, the runs whose task rows changed in a way that wakes a pass, once each."""
    table = BatchTable(spark, f"{folder}/runs", T.StructType([
        T.StructField("run_id", T.LongType()), T.StructField("changes", T.LongType())]))
    drain(log, lambda batch, n: table.write(audit.woken_runs(batch), n), f"{folder}/checkpoint")
    return table


class RunStatuses:
    """Statuses of runs, one row for each, and the rows that came after their run's state had gone."""

    def __init__(self, spark: SparkSession, folder: str, log: T.StructType):
        shape = T.StructType([log["run_id"], T.StructField("status", T.StringType()), T.StructField("version", T.LongType()),
                              T.StructField("first_at", T.TimestampNTZType())])
        self.statuses = DayTable(spark, f"{folder}/statuses", shape, "first_at", self._newest, monthly=True)
        self.late = BatchTable(spark, f"{folder}/late", T.StructType([log[name] for name in stateful.RUN_ROW]))

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        newest = rows.groupBy("run_id", "first_at").agg(F.max(F.struct("version", "status")).alias("newest"))
        return newest.select("run_id", "newest.status", "newest.version", "first_at")

    def rows(self) -> DataFrame:
        return self.statuses.rows().select("run_id", "status")


def current_run_status(spark: SparkSession, log: DataFrame, folder: str, keep: dt.timedelta = dt.timedelta(days=7)) -> RunStatuses:
    """Run statuses kept current from a change log.

    What is held of a run is the newest image of each of its rows; what changes its status is written to the folder of the
    month it was first seen in. ``keep`` after a run has ended, by the newest time in the log, its images go. A row older than
    that whose run has no images can't be judged any more and is reported aside. A batch reads what the batch before it held
    and writes what it holds itself, by joins and grouping, so a batch that is run again leaves the same.
    """
    tables = RunStatuses(spark, folder, log.schema)
    held = f"{folder}/held"
    shape = stateful.held_schema(log.schema)
    marked = T.StructType([*shape.fields, T.StructField("changed", T.BooleanType())])
    times = BatchTable(spark, f"{folder}/times", T.StructType([T.StructField("at", T.TimestampNTZType())]))
    spark.createDataFrame([], marked).write.mode("overwrite").parquet(f"{held}/batch_id=-1")

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*stateful.RUN_ROW).persist()
        times.write(rows.agg(F.max("at").alias("at")), batch_id)
        clock = times.before(batch_id).agg(F.max("at")).first()[0]
        before = spark.read.schema(marked).parquet(f"{held}/batch_id={batch_id - 1}").drop("changed")
        after, late = stateful.next_statuses(before, rows, clock, keep)
        after.select(*marked.names).write.mode("overwrite").parquet(f"{held}/batch_id={batch_id}")
        tables.late.write(late, batch_id)
        stored = spark.read.schema(marked).parquet(f"{held}/batch_id={batch_id}")
        changed = stored.where("changed").select("run_id", "status", "version", "first_at").distinct()
        tables.statuses.add(changed, batch_id)
        days = changed.agg(F.min("first_at").alias("first"), F.max("first_at").alias("last")).first()
        if days["first"] is not None:
            tables.statuses.compact(days["first"], days["last"])
        remove(spark, f"{held}/batch_id={batch_id - 2}")
        rows.unpersist()

    drain(log, step, f"{folder}/checkpoint")
    return tables


def _latest_groups(table: BatchTable, keys: list[str]) -> DataFrame:
    """The last value each group had; a group changes only by being emitted again by a later batch."""
    values = [f.name for f in table.schema.fields if f.name not in keys]
    newest = table.all().groupBy(*keys).agg(F.max(F.struct("batch_id", *values)).alias("v"))
    return newest.select(*keys, *[F.col(f"v.{name}").alias(name) for name in values])


def _timed(rows: DataFrame, column: str, late: str | None) -> DataFrame:
    """Rows with an event time. Without ``late`` every window stays open, one small state row each, and counts stay
    whole however late a row is; with it, windows older than that are closed and later rows for them are lost."""
    timed = rows.withColumn(column, F.col(column).cast("timestamp"))
    return timed.withWatermark(column, late) if late else timed


def tumbling_counts(spark: SparkSession, facts: DataFrame, width: str, folder: str, late: str | None = None) -> DataFrame:
    """Facts per asset and tumbling window, updated as batches arrive."""
    counted = _timed(facts, "event_time", late).groupBy(
        F.window("event_time", width), "asset_name").agg(F.count("*").alias("facts")).select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"), "asset_name", "facts")
    table = BatchTable(spark, f"{folder}/counts", counted.schema)
    drain(counted, lambda batch, n: table.write(batch, n), f"{folder}/checkpoint", mode="update")
    return _latest_groups(table, ["window_start", "asset_name"])


def sliding_success(spark: SparkSession, ended: DataFrame, folder: str, days: int = 14, late: str | None = None) -> DataFrame:
    """Completed and successful runs per pipeline and window of ``days`` days; running and aborted runs do not count.

    The state holds a pane, the counts of one day, for each pipeline and day. A pane comes into the windows that start up
    to ``days`` - 1 days before it and leaves those after it: a running sum over these two changes gives every window.
    """
    panes = _timed(ended, "started_at", late).where(~F.col("status").isin("running", "aborted")).groupBy(
        F.window("started_at", "1 day"), "pipeline").agg(
        F.count("*").alias("completed"), F.count_if(F.col("status") == "success").alias("succeeded")).select(
        F.col("window.start").cast("timestamp_ntz").alias("day"), "pipeline", "completed", "succeeded")
    table = BatchTable(spark, f"{folder}/panes", panes.schema)
    drain(panes, lambda batch, n: table.write(batch, n), f"{folder}/checkpoint", mode="update")
    return windows_of_panes(_latest_groups(table, ["day", "pipeline"]), days)


def windows_of_panes(panes: DataFrame, days: int) -> DataFrame:
    """Every window of ``days`` days with a completed run: window_start, pipeline, completed, succeeded, sla."""
    counts = ["completed", "succeeded"]
    enters = F.struct(F.col("day") - F.expr(f"interval {days - 1} days"), *counts)
    leaves = F.struct(F.col("day") + F.expr("interval 1 day"), *[(-F.col(c)).alias(c) for c in counts])
    kind = f"struct<window_start: timestamp_ntz, {', '.join(c + ': bigint' for c in counts)}>"
    changes = panes.select("pipeline", F.explode(F.array(enters.cast(kind), leaves.cast(kind))).alias("c")).select("pipeline", "c.*")
    changes = changes.groupBy("pipeline", "window_start").agg(*[F.sum(c).alias(c) for c in counts])
    order = Window.partitionBy("pipeline").orderBy("window_start")
    running = changes.select("pipeline", "window_start", F.lead("window_start").over(order).alias("until"),
                             *[F.sum(c).over(order).alias(c) for c in counts]).where("completed > 0")
    start = F.explode(F.expr("sequence(window_start, until - interval 1 day, interval 1 day)"))
    rates = running.select(start.alias("window_start"), "pipeline", *counts)
    return rates.withColumn("sla", runs.half_even_percent(F.col("succeeded"), F.col("completed")))


def missing_partitions(expected: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """Expected partitions (``asset_name``, ``partition_key``, ``due_at``) whose limit passed without a fact."""
    present = facts.select("asset_name", "partition_key").distinct()
    return expected.where(F.col("due_at") <= now).join(present, ["asset_name", "partition_key"], "left_anti")


def alert_missing(spark: SparkSession, facts: DataFrame, expected: DataFrame, folder: str,
                  now: Column | None = None) -> BatchTable:
    """Alerts for partitions that are overdue at the newest event time seen so far, each raised once.

    Every expected partition is open from the start, with a timer at its limit; its first fact closes it, and the timer
    that fires while it is open is the alert. The state is the open partitions, and nothing stored is read again. A fact
    dated after ``now`` (the wall clock unless given) is no sign that time has passed.
    """
    wall = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    shape = expected.select("asset_name", "partition_key", "due_at").schema
    alerts = BatchTable(spark, f"{folder}/alerts", shape)
    raised = stateful.overdue(facts, expected, wall).withColumn("due_at", F.timestamp_millis("due_ms").cast("timestamp_ntz"))
    with stateful.keyed_state(spark):
        drain(raised, lambda batch, n: alerts.write(batch.select(*shape.names), n), f"{folder}/checkpoint")
    return alerts


def new_folder(spark: SparkSession, job: str) -> str:
    return scratch_dir(spark, job)
