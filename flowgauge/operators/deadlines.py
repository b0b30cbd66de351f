"""Deadlines moved by pauses, due times, liveness and lost hints, as Column expressions over row tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowgauge.functions import timing, vocab

# The limits of waits and starts, and where a held decision falls due.
WAIT_FOR_DAYS = 7
START_WARN_MINUTES = 15
START_FAIL_HOURS = 6
FAR_FUTURE = "9999-01-01 00:00:00"
LOST_HINT_MINUTES = 5
VISIBLE_MINUTES = 2


def _minutes(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))


def _far_future() -> Column:
    return F.lit(FAR_FUTURE).cast("timestamp_ntz")


def is_paused(pauses: Column) -> Column:
    last = F.try_element_at(pauses, F.lit(-1))
    return F.coalesce((F.size(pauses) > 0) & last["end"].isNull(), F.lit(False))


def moved(start: Column, limit: Column, pauses: Column) -> Column:
    """``start + limit`` moved by the paused time inside the wait; null while an open pause holds it.

    ``pauses`` is ordered by start, so an interval beyond the deadline leaves it alone, as do all after it.
    """

    def step(deadline, pause):
        begin = F.greatest(pause["start"], start)
        longer = deadline + (pause["end"] - begin)
        return (
            F.when(deadline.isNull() | (pause["start"] >= deadline), deadline)
            .when(pause["end"].isNull(), F.lit(None))
            .when(pause["end"] > begin, longer)
            .otherwise(deadline)
        )

    return F.aggregate(F.coalesce(pauses, F.array()), (start + limit).cast("timestamp_ntz"),
                       lambda d, p: step(d, p).cast("timestamp_ntz"))


def countdown_end(ready_at: Column, wait_seconds: Column) -> Column:
    return F.when(wait_seconds > 0, ready_at + timing.seconds(wait_seconds))


def wait_deadline() -> Column:
    """When a waiting row fails for its wait; its own timeout replaces the limit on awaited facts."""
    pauses = F.col("pauses")
    own = moved(F.col("waiting_since"), F.col("orchestration_timeout"), pauses)
    facts = moved(F.col("enabled_at"), F.make_dt_interval(F.lit(WAIT_FOR_DAYS)), pauses)
    return F.when(F.col("countdown_end").isNotNull() | is_paused(pauses), F.lit(None)).when(
        F.col("orchestration_timeout").isNotNull(), own).when(
        F.col("has_wait_for") & F.col("enabled_at").isNotNull(), facts)


def decision_deadline() -> Column:
    known = F.col("decision_since").isNotNull() & F.col("decision_timeout").isNotNull()
    due = moved(F.col("decision_since"), F.col("decision_timeout"), F.col("pauses"))
    return F.when(known, F.when(is_paused(F.col("pauses")), _far_future()).otherwise(due))


def shown_deadline(due: Column) -> Column:
    return F.when(due < _far_future(), due)


def start_deadlines() -> dict[str, Column]:
    """Next try, warning and failure of a start that failed; null where none did."""
    first, last, failures = F.col("start_failed_first"), F.col("start_failed_last"), F.col("start_failures")
    tried = (failures >= 1) & first.isNotNull() & last.isNotNull()
    return {
        "next_try": F.when(tried, last + timing.seconds(timing.start_backoff_seconds(failures))),
        "warn_at": F.when(tried, moved(first, _minutes(START_WARN_MINUTES), F.col("pauses"))),
        "fail_at": F.when(tried, moved(first, F.make_dt_interval(F.lit(0), F.lit(START_FAIL_HOURS)), F.col("pauses"))),
    }


def liveness_check() -> Column:
    since = F.coalesce("last_check", "status_since")
    return since + timing.seconds(timing.check_backoff_seconds(F.col("checks")))


def work_due_time() -> Column:
    """When started work is next looked at: a failed start's next try, else its liveness check."""
    next_try = start_deadlines()["next_try"]
    held = (F.col("status") == "deps_ready") & is_paused(F.col("pauses"))
    tried = F.when(F.col("status") == "deps_ready", next_try)
    return F.when(F.col("status").isin("deps_ready", "running") & ~held, F.coalesce(tried, liveness_check()))


def due_time() -> Column:
    """A row's next due time by its status; null where only other rows or a resume can move it."""
    status = F.col("status")
    return (
        F.when(status == "waiting", F.coalesce(F.col("countdown_end"), wait_deadline()))
        .when(status == "waiting_decision", decision_deadline())
        .otherwise(work_due_time())
    )


def with_deadlines(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "wait_deadline": wait_deadline(), "decision_deadline": decision_deadline(), **start_deadlines(),
    })


def span(interval: Column) -> Column:
    """An interval as days, hours, minutes and seconds: ``2 days, 3:00:00``."""
    day, hour, minute, second = (F.extract(F.lit(part), interval).cast("int") for part in ("DAY", "HOUR", "MINUTE", "SECOND"))
    days = F.when(day == 1, F.lit("1 day, ")).when(day > 1, F.concat(day.cast("string"), F.lit(" days, "))).otherwise("")
    return F.concat(days, F.format_string("%d:%02d:%02d", hour, minute, second))


def expired_rows(rows: DataFrame, now: Column) -> DataFrame:
    """Waits, decisions and starts past their deadline, with which of them it was and its cause.

    ``rows`` may carry ``reasons`` (what a wait still waits for) and ``error`` (of the last start); a cause ends in them.
    """
    timed = with_deadlines(rows)
    status = F.col("status")
    kind = (
        F.when((status == "waiting") & (F.col("wait_deadline") <= now), "wait")
        .when((status == "waiting_decision") & (F.col("decision_deadline") <= now), "decision")
        .when((status == "deps_ready") & (F.col("fail_at") <= now), "start")
    )
    limit = F.when(kind == "wait", F.col("wait_deadline")).when(
        kind == "decision", F.col("decision_deadline")).otherwise(F.col("fail_at"))
    reasons = F.array_join("reasons", "; ") if "reasons" in rows.columns else F.lit("its rule is not met")
    error = F.coalesce("error", F.lit("no error kept")) if "error" in rows.columns else F.lit("no error kept")
    cause = (
        F.when(kind == "wait", F.concat(F.lit("it waited past its limit at "), limit.cast("string"), F.lit(": "), reasons))
        .when(kind == "decision", F.concat(F.lit("no decision came within its decision timeout of "), span(F.col("decision_timeout"))))
        .otherwise(F.concat(F.lit(f"its start kept failing for {START_FAIL_HOURS}:00:00: "), error))
    )
    return timed.select("run_id", "task_no", kind.alias("kind"), limit.alias("expired_at"), cause.alias("cause")).where(
        "kind IS NOT NULL")


def pause_intervals(events: DataFrame) -> DataFrame:
    """A run's pauses from its pause and resume requests: repeats change nothing.

    Only changes of state matter, so repeats are dropped first, inside slices of a day with the last request carried
    in, then pauses are paired with the resume that follows.
    """
    order = ["at", "event_id"]
    cut = events.withColumn("slice", F.to_date("at"))
    inside = Window.partitionBy("run_id", "slice").orderBy(*order)
    ends = cut.groupBy("run_id", "slice").agg(F.max(F.struct(*order, "action"))["action"].alias("final"))
    carried = ends.withColumn("carried", F.lag("final").over(Window.partitionBy("run_id").orderBy("slice")))
    previous = F.coalesce(F.lag("action").over(inside), F.col("carried"), F.lit("resume"))
    changes = cut.join(carried.drop("final"), ["run_id", "slice"]).withColumn("previous", previous).where(
        F.col("action") != F.col("previous")).select("run_id", "slice", *order, "action")
    # What is left alternates; pair each pause with the change after it, in its slice or a later one.
    firsts = changes.groupBy("run_id", "slice").agg(F.min(F.struct(*order))["at"].alias("first_at"))
    later = firsts.withColumn("next_at", F.lead("first_at").over(Window.partitionBy("run_id").orderBy("slice")))
    return changes.join(later.drop("first_at"), ["run_id", "slice"]).withColumn(
        "end", F.coalesce(F.lead("at").over(inside), F.col("next_at"))).where("action = 'pause'").select(
        "run_id", F.col("at").alias("start"), "end")


def lost_hints(rows: DataFrame, check_time: Column) -> DataFrame:
    """Rows a check found decidable since longer than the grace: nothing else explains the wait."""
    effective = F.greatest("enabled_at", "resumed_at")
    late = effective < check_time - _minutes(LOST_HINT_MINUTES)
    return rows.where(~F.col("left_at") & ~F.col("countdown_ended") & F.col("enabled_at").isNotNull() & late)


def lost_hint_warnings(lost: DataFrame, names: int) -> DataFrame:
    """Per run, how many rows lost their hint and the first names; names are cut before they are collected."""
    counted = lost.groupBy("run_id").agg(F.count("*").alias("tasks"))
    first = lost.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("task_name"))).where(
        F.col("n") <= names).groupBy("run_id").agg(
        F.array_join(F.sort_array(F.collect_list("task_name")), ", ").alias("shown"))
    more = F.when(F.col("tasks") > names, F.concat(
        F.lit(" and "), (F.col("tasks") - names).cast("string"), F.lit(" more"))).otherwise("")
    return counted.join(first, "run_id").select("run_id", "tasks", F.concat("shown", more).alias("names"))


def dead_work(rows: DataFrame, executions: DataFrame, now: Column) -> DataFrame:
    """What a check finds of started rows: ``failed`` work, a ``restart``, or a later check."""
    joined = rows.where(F.col("status").isin("deps_ready", "running")).join(executions, ["run_id", "task_no"], "left")
    state = F.col("execution_status")
    visible = F.col("status_since").isNotNull() & (now - F.col("status_since") >= _minutes(VISIBLE_MINUTES))
    verdict = (
        F.when(state.isNotNull() & (state != "RUNNING"), "fail")
        .when(state.isNotNull() | ~visible, "check")
        .when(F.col("status") == "deps_ready", "restart")
        .otherwise("fail")
    )
    return joined.select("run_id", "task_no", verdict.alias("verdict"))


def queue_health(rows: DataFrame, now: Column) -> DataFrame:
    """The oldest overdue entry and how many entries are overdue or retried."""
    timed = rows.withColumn("due_at", due_time())
    overdue = F.col("due_at") <= now
    return timed.agg(F.min(F.when(overdue, F.col("due_at"))).alias("oldest_due"), F.count_if(overdue).alias("overdue"),
                     F.count_if(F.col("start_failures") > 0).alias("retries"))


def due_runs(rows: DataFrame, now: Column) -> DataFrame:
    """Each run with a due row, once, earliest first."""
    timed = rows.withColumn("due_at", due_time()).where(F.col("due_at") <= now)
    return timed.groupBy("run_id").agg(F.min("due_at").alias("due_at")).orderBy("due_at", "run_id")


def fair_quota(rows: DataFrame, now: Column, total: int) -> DataFrame:
    """The started rows a sweep looks at: the longest due first, a quarter of the total per run at most, and a quarter
    kept in hand. Runs are served in due order, so only as many runs as there are calls can be reached at all."""
    share, usable = max(1, total // 4), total - total // 4
    timed = rows.select("run_id", "task_no", work_due_time().alias("due_at")).where(F.col("due_at") <= now)
    mine = Window.partitionBy("run_id").orderBy("due_at", "task_no")
    capped = timed.withColumn("n", F.row_number().over(mine)).where(F.col("n") <= share)
    runs = capped.groupBy("run_id").agg(F.min("due_at").alias("run_due"), F.count("*").alias("wanted"))
    reached = runs.orderBy("run_due", "run_id").limit(usable)
    before = Window.orderBy("run_due", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    left = reached.withColumn("left", usable - F.coalesce(F.sum("wanted").over(before), F.lit(0))).where("left > 0")
    return capped.join(left.select("run_id", "left"), "run_id").where("n <= left").select("run_id", "task_no", "due_at")
