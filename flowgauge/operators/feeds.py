"""Feeds, pages, queues and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowgauge.functions import calendar as cal, timing, vocab
from flowgauge.operators import slices


def asset_staleness(assets: DataFrame, on_day: DataFrame, ever: DataFrame, now: Column) -> DataFrame:
    """How old each asset is: its newest event of the shown day, else its newest ever, else unknown."""
    recent = on_day.groupBy("asset_name").agg(F.max("event_time").alias("recent_at"))
    last = ever.groupBy("asset_name").agg(F.max("event_time").alias("last_at"))
    joined = assets.join(recent, "asset_name", "left").join(last, "asset_name", "left")
    known = F.coalesce("recent_at", "last_at")
    age = timing.staleness(known, now)
    return joined.select("asset_name", known.alias("known_at"), age.alias("age")).select(
        "asset_name", "known_at", "age.status", "age.label", "age.hours")


def is_older(started_at: Column, before) -> Column:
    """Whether a row is still to be served after the cursor; rows without a time sort oldest."""
    return F.lit(True) if before is None else started_at.isNull() | (started_at < before)


def feed_dates(cursors: DataFrame, today: Column, days: int) -> DataFrame:
    """The days each cursor's page walks: from its day (today at the latest) back to the window's edge."""
    day = F.try_to_timestamp(F.substring("before", 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    start = F.least(F.coalesce(day, today), today)
    oldest = F.date_sub(today, days - 1)
    walk = F.when(start >= oldest, F.sequence(start, oldest, F.expr("interval -1 day")))
    return cursors.select("*", F.explode(walk).alias("day"))


def page(rows: DataFrame, limit: int, before=None, tie: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """One page newest first that never splits rows of one start time, and a one-row table with the next cursor.

    The cut is the start time of the ``limit``-th row, found by a top-k over partitions; its twins are then taken by
    comparing with that one value, so nothing is ranked globally. Rows without a time come last, cut at ``limit``.
    """
    kept = rows.where(is_older(F.col("started_at"), before))
    top = kept.select("started_at", tie).orderBy(F.desc_nulls_last("started_at"), tie).limit(limit)
    ends = top.agg(F.count("*").alias("n"), F.min("started_at").alias("cut"),
                   F.count_if(F.col("started_at").isNull()).alias("untimed")).first()
    if ends["untimed"]:
        timed = kept.where("started_at IS NOT NULL")
        rest = kept.where("started_at IS NULL").orderBy(tie).limit(ends["untimed"])
        found, cut = timed.unionByName(rest), None
    elif ends["n"] < limit:
        found, cut = kept, None
    else:
        found, cut = kept.where(F.col("started_at") >= F.lit(ends["cut"])), ends["cut"]
        if kept.where((F.col("started_at") < F.lit(cut)) | F.col("started_at").isNull()).isEmpty():
            cut = None
    cursor = rows.sparkSession.createDataFrame([(cut,)], "next timestamp_ntz")
    return found.orderBy(F.desc_nulls_last("started_at"), tie), cursor


def walked_days(rows: DataFrame, want: int, weight: Column) -> DataFrame:
    """The newest start days a walk reads until it holds ``want``, whole days; a row per day at most is windowed."""
    daily = rows.groupBy(F.to_date("started_at").alias("day")).agg(F.sum(weight).alias("weight"))
    before = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    return daily.withColumn("read", F.coalesce(F.sum("weight").over(before), F.lit(0))).where(F.col("read") < want)


def task_page(runs: DataFrame, limit: int, budget: int | None = None) -> DataFrame:
    """The runs whose tasks fill one page: whole runs, all of one instant together, until the page is full.

    ``runs`` carry ``size`` (rows read, at least one) and ``kept`` (rows shown). Only the newest days that hold ``limit``
    shown rows can matter, so they alone are ordered. A caller who wants to bound the rows that a page reads passes a
    ``budget``: the page then also ends before the run that would go beyond it.
    """
    sized = runs.withColumn("size", F.greatest("size", F.lit(1)))
    days = walked_days(sized, limit, F.col("kept")).select("day")
    newest = sized.join(days, F.to_date("started_at").eqNullSafe(F.col("day")), "left_semi")
    instants = newest.groupBy("started_at").agg(
        F.sum("size").alias("size"), F.sum("kept").alias("kept"), F.max_by("size", F.struct("run_id")).alias("last_size"))
    order = Window.orderBy(F.desc("started_at"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    firsts = newest.groupBy("started_at").agg(F.min_by("size", "run_id").alias("first_size"))
    seen = instants.join(firsts, "started_at").withColumns({
        "shown": F.coalesce(F.sum("kept").over(before), F.lit(0)), "read": F.coalesce(F.sum("size").over(before), F.lit(0)),
        "position": F.row_number().over(order)})
    stop = F.col("shown") >= limit
    if budget is not None:
        stop = stop | ((F.col("position") > 1) & (F.col("read") + F.col("first_size") > budget))
    ended = seen.withColumn("stopped", F.max(stop.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return newest.join(ended.where("stopped = 0").select("started_at"), "started_at", "left_semi")


def timeline(events: DataFrame) -> DataFrame:
    """Each event with its place in its task's timeline and how long the stage it opens lasts.

    Order is time, order suffix, event. Places and followers are taken inside days and carried from day to day, so a
    task with a huge history is never sorted whole.
    """
    key, order = ["task_run_id"], ["event_time", "ord", "event_id"]
    cut = events.withColumn("slice", F.to_date("event_time"))
    inside = Window.partitionBy(*key, "slice").orderBy(*order)
    slices = cut.groupBy(*key, "slice").agg(F.count("*").alias("n"), F.min("event_time").alias("first_at"))
    across = Window.partitionBy(*key).orderBy("slice")
    carried = slices.select(
        *key, "slice", F.coalesce(F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lead("first_at").over(across).alias("next_first"))
    local = cut.withColumns({"nth": F.row_number().over(inside), "following": F.lead("event_time").over(inside)})
    joined = local.join(carried, [*key, "slice"])
    until = F.coalesce("following", "next_first")
    return joined.select(
        *key, "event_id", "event_type", "event_time", (F.col("before") + F.col("nth")).alias("position"),
        F.expr("timestampdiff(SECOND, event_time, coalesce(following, next_first))").alias("stage_seconds"))


def attempts(events: DataFrame) -> DataFrame:
    """Starts of each task (first dispatches only) and all dispatches, retries included."""
    started = F.count_if(F.col("event_type") == "TASK_STARTED")
    retried = F.count_if(F.col("event_type") == "TASK_RETRY_STARTED")
    return events.groupBy("task_run_id").agg(started.alias("starts"), (started + retried).alias("dispatches"))


def notification_entries(tasks: DataFrame, backfills: DataFrame, warnings: DataFrame, since: Column) -> DataFrame:
    """Everything the bell can show: one entry per run that asks or failed, ended backfills and warnings."""
    asks = (F.col("status") == "waiting_decision")
    entry = tasks.where(asks | ((F.col("status") == "failed") & (F.col("due_at") >= since))).groupBy("run_id").agg(
        F.min(F.struct(F.when(asks, 0).otherwise(1).alias("rank"),
                       F.when(asks, F.col("due_at").cast("timestamp")).otherwise(None).alias("d"),
                       (-F.unix_micros(F.col("due_at").cast("timestamp"))).alias("recency"), "task_no", "due_at")).alias("e"))
    shown = F.when(F.col("e.due_at") < F.lit("9999-01-01").cast("timestamp_ntz"), F.col("e.due_at"))
    none = F.lit(None).cast("timestamp_ntz")
    per_run = entry.select(
        F.when(F.col("e.rank") == 0, "decision_required").otherwise("failure").alias("type"),
        F.col("run_id").alias("subject"), F.col("e.task_no").alias("task_no"),
        F.when(F.col("e.rank") == 0, shown).alias("deadline"),
        F.when(F.col("e.rank") == 1, F.col("e.due_at")).alias("finished_at"))
    ended = backfills.where(F.col("status").isin(*vocab.ENDED_BACKFILL) & (F.col("finished_at") >= since)).select(
        F.lit("backfill").alias("type"), F.col("backfill_id").alias("subject"), F.lit(None).cast("int").alias("task_no"),
        none.alias("deadline"), "finished_at")
    warned = warnings.where(F.col("finished_at") >= since).select(
        F.lit("warning").alias("type"), F.col("run_id").alias("subject"), F.lit(None).cast("int").alias("task_no"),
        none.alias("deadline"), "finished_at")
    return per_run.unionByName(ended).unionByName(warned)


def notifications(entries: DataFrame, limit: int) -> DataFrame:
    """The bell: the first entries, decisions by deadline (paused last), then failures, warnings and ended backfills by
    recency."""
    return entries.orderBy(
        F.col("type") != "decision_required", F.asc_nulls_last("deadline"), F.desc_nulls_last("finished_at"),
        "type", "subject").limit(limit)


def unified_feed(entries: DataFrame, backfills: DataFrame) -> DataFrame:
    """Runs and backfills as one feed, each with its kind and its own columns."""
    runs = entries.select(F.lit("execution").alias("kind"), F.col("run_id").alias("id"), "pipeline", "status",
                          "started_at", "finished_at", "failed_tasks")
    others = backfills.select(
        F.lit("backfill").alias("kind"), F.col("backfill_id").alias("id"), F.col("target_pipeline").alias("pipeline"),
        F.coalesce("status", F.lit("pending")).alias("status"), "started_at", "finished_at",
        F.col("total").alias("total_partitions"))
    return runs.unionByName(others, allowMissingColumns=True)


def runs_of_day(runs: DataFrame, day: str) -> DataFrame:
    """Runs whose date key, in whatever granularity, holds or lies in the day."""
    keys = runs.sparkSession.range(1).select(F.explode(cal.day_keys(F.lit(day))).alias("run_key"))
    return runs.join(keys, "run_key", "left_semi")


def asset_matrix(tasks: DataFrame, producers: DataFrame, consumed: DataFrame, first: str, last: str) -> DataFrame:
    """One cell per asset and date from its producers' task rows: running, materialized, failed, queued or null.

    Every asset is spread over the days from ``first`` to ``last``; cells come from one grouped aggregate.
    """
    shown = F.col("run_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    made = tasks.where(shown).join(producers, "task_name_key").groupBy("asset", "run_date").agg(
        F.bool_or(F.col("status") == "running").alias("runs"),
        F.max(F.when(F.col("finished_at").isNotNull(), F.struct("finished_at", "status"))).alias("last"))
    assets = producers.select("asset").distinct().join(consumed.select("asset").distinct().withColumn(
        "awaited", F.lit(True)), "asset", "left")
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    grid = assets.select("asset", "awaited", F.explode(days).alias("run_date"))
    status = F.col("last.status")
    cell = (
        F.when(F.col("runs"), "running").when(vocab.is_success(status), "materialized")
        .when(status.isin("failed", "aborted", "stopped"), "failed")
        .when(F.col("runs").isNull() & F.col("awaited"), "queued")
    )
    return grid.join(made, ["asset", "run_date"], "left").select("asset", "run_date", cell.alias("cell"))


def ordered_children(tasks: DataFrame) -> DataFrame:
    """A run's rows with their position: by start, those without one first, then by name."""
    return slices.numbered(tasks, ["run_id"], [F.asc_nulls_first("started_at"), F.col("task_name")], "position")
