"""Runs: status roll-ups, summaries, outcomes, causes, statistics and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowgauge.functions import calendar as cal, text, vocab

# Recent runs on a card, the card's window.
RECENT_RUNS = 10
CARD_DAYS = 14
UNHEALTHY_ABOVE = 10


def expected_rows(expected: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every task a run's version names, with its status; a task without a row counts as failed."""
    actual = tasks.select("run_id", "task_no", "status")
    joined = expected.select("run_id", "task_no").join(actual, ["run_id", "task_no"], "left")
    return joined.select("run_id", "task_no", F.coalesce("status", F.lit("failed")).alias("status"),
                         F.col("status").isNull().alias("row_missing"))


def _roll_up() -> list[Column]:
    status = F.col("status")
    return [
        F.bool_and(vocab.is_final(status)).alias("all_final"),
        F.bool_or(F.coalesce(status == "failed", F.lit(False))).alias("any_failed"),
        F.bool_or(F.coalesce(status.isin(*vocab.STOPPED_KINDS), F.lit(False))).alias("any_stopped"),
    ]


def run_status(tasks: DataFrame) -> DataFrame:
    rolled = tasks.groupBy("run_id").agg(*_roll_up())
    return rolled.select("run_id", vocab.run_status(
        F.col("all_final"), F.col("any_failed"), F.col("any_stopped")).alias("status"))


def run_summary(tasks: DataFrame) -> DataFrame:
    """A run's rows per status as a map; the map holds at most one entry per status name."""
    counted = tasks.groupBy("run_id", "status").agg(F.count("*").cast("int").alias("n"))
    return counted.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("summary"))


def _present(summary: Column) -> Column:
    return F.map_keys(F.map_filter(summary, lambda _, n: n > 0))


def outcome(summary: Column, task_count: Column, step_failed: Column) -> Column:
    """A run's outcome once its counts cover every task and all are final; null until then."""
    present = _present(summary)
    counted = F.aggregate(F.map_values(summary), F.lit(0), lambda a, n: a + n)
    complete = (counted == task_count) & (F.size(present) > 0) & F.forall(present, vocab.is_final)
    any_failed = step_failed | F.array_contains(present, "failed")
    stopped = F.exists(present, lambda s: s.isin(*vocab.STOPPED_KINDS))
    return F.when(F.coalesce(complete, F.lit(False)), vocab.run_status(F.lit(True), any_failed, stopped))


def shown_status(summary: Column, step_failed: Column) -> Column:
    """What a run list shows: the outcome of the rows counted so far, ``running`` while there is none."""
    counted = F.aggregate(F.map_values(summary), F.lit(0), lambda a, n: a + n)
    return F.coalesce(outcome(summary, counted, step_failed), F.lit("running"))


def failed_tasks(summary: Column) -> Column:
    return F.coalesce(F.try_element_at(summary, F.lit("failed")), F.lit(0))


#: Parts of a run in which the names for its cause are picked.
_CAUSE_SALTS = 64


def failed_rows(rows: DataFrame) -> DataFrame:
    """Every row that failed for good: the full list that a cause text is a short form of."""
    return rows.where(vocab.is_final_failure(F.col("status")))


def failure_cause(rows: DataFrame, runs: DataFrame, longest: int) -> DataFrame:
    """The cause text of every run that ended other than in success, in at most ``longest`` characters.

    ``rows`` are a run's expected rows, ``runs`` carry ``step_failed`` and ``failed_step``. The number of failures is
    exact and ``failed_rows`` has them all. A text can only hold the first ``longest / 3`` names by spelling (a name and
    its separator take three characters), so each salt of a run keeps that many, which bounds what one task sorts.
    """
    most = longest // 3 + 1
    rolled = rows.groupBy("run_id").agg(
        *_roll_up(), F.count_if(vocab.is_final_failure(F.col("status"))).alias("failures"))
    ended = runs.select("run_id", "step_failed", "failed_step").join(rolled, "run_id").where("all_final").withColumn(
        "status", F.when(F.col("step_failed"), "failed").otherwise(vocab.run_status(
            F.col("all_final"), F.col("any_failed"), F.col("any_stopped")))
    ).where("status <> 'success'")

    failed = failed_rows(rows).select(
        "run_id", "name", F.pmod(F.xxhash64("name"), F.lit(_CAUSE_SALTS)).alias("salt"))
    in_salt = F.row_number().over(Window.partitionBy("run_id", "salt").orderBy("name"))
    firsts = failed.withColumn("r", in_salt).where(F.col("r") <= most)
    in_run = F.row_number().over(Window.partitionBy("run_id").orderBy("name"))
    firsts = firsts.withColumn("r", in_run).where(F.col("r") <= most)
    names = firsts.groupBy("run_id").agg(F.sort_array(F.collect_list("name")).alias("names"))

    joined = ended.join(names, "run_id", "left").withColumn(
        "names", F.coalesce("names", F.array().cast("array<string>")))
    head = F.concat(
        F.when(F.col("step_failed"), F.concat(F.lit("step "), "failed_step", F.lit(" failed; "))).otherwise(""),
        F.col("failures").cast("string"), F.lit(" tasks failed"))
    return joined.withColumn("head", head).select(
        "run_id", "status", "failures", _listed(F.col("head"), F.col("names"), F.col("failures"), longest).alias("cause"))


def _listed(head: Column, names: Column, total: Column, longest: int) -> Column:
    """``head: a, b and k more`` with as many names as the cause may hold."""
    start = F.struct((F.length(head) + 2).cast("long").alias("used"), F.lit(0).cast("long").alias("shown"),
                     F.lit(False).alias("full"))

    def step(acc, name):
        added = F.length(name) + F.when(acc["shown"] > 0, 2).otherwise(0)
        rest = total - acc["shown"] - 1
        tail = F.when(rest > 0, F.length(F.concat(F.lit(" and "), rest.cast("string"), F.lit(" more")))).otherwise(0)
        fits = ~acc["full"] & (acc["used"] + added + tail <= longest)
        return F.struct(
            F.when(fits, acc["used"] + added).otherwise(acc["used"]).cast("long").alias("used"),
            F.when(fits, acc["shown"] + 1).otherwise(acc["shown"]).cast("long").alias("shown"),
            (~fits).alias("full"))

    shown = F.aggregate(names, start, step, lambda acc: acc["shown"])
    more = total - shown
    listed = F.array_join(F.slice(names, F.lit(1), shown.cast("int")), ", ")
    tail = F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise("")
    return F.when(total > 0, F.concat(head, F.lit(": "), listed, tail)).otherwise(head)


# The groups of a run page's statistics.
STAT_GROUPS = {
    "success": ("success", "succeeded"),
    "running": ("running", "deps_ready"),
    "waiting": ("waiting", "waiting_paused", "waiting_decision"),
    "failed": ("failed", "upstream_failed"),
    "skipped": ("skipped",),
    "stopped": ("stopped", "aborted"),
}


def run_stats(tasks: DataFrame) -> DataFrame:
    """Rows per status group for each run, each pipeline and overall, from one expanded aggregation."""
    counts = [F.count_if(F.col("status").isin(*names)).alias(group) for group, names in STAT_GROUPS.items()]
    return tasks.rollup("pipeline", "run_id").agg(F.count("*").alias("total"), *counts)


def daily_metrics(tasks: DataFrame) -> DataFrame:
    """Counts and the success rate in tenths of a percent (half up) for each logical date."""
    status = F.col("status")
    counted = tasks.groupBy("run_date").agg(
        F.count("*").alias("total"), F.count_if(status == "success").alias("success"),
        F.count_if(status == "failed").alias("failed"), F.count_if(status.isin("running", "pending")).alias("running"))
    rate = F.expr("(2000 * success + total) div (2 * total)")
    return counted.withColumn("success_permille", F.when(F.col("total") > 0, rate).otherwise(0))


def failure_health(tasks: DataFrame, now: Column) -> DataFrame:
    """For each date, failures finished in the hour before that date's check ``now``, and what they say."""
    recent = (F.col("status") == "failed") & (F.col("finished_at") >= now - F.expr("interval 1 hour"))
    counted = tasks.groupBy("run_date").agg(F.count_if(recent).alias("failures_last_hour"))
    n = F.col("failures_last_hour")
    return counted.withColumn(
        "health", F.when(n > UNHEALTHY_ABOVE, "unhealthy").when(n > 0, "degraded").otherwise("healthy"))


def run_entries(run_rows: DataFrame) -> DataFrame:
    """Run rows as a run list shows them."""
    status = shown_status(F.col("summary"), F.col("step_failed"))
    finished = F.when(status != "running", F.col("finished_at"))
    return run_rows.select(
        "run_id", "pipeline", text.short_id(F.col("execution")).alias("execution_short"), status.alias("status"),
        failed_tasks(F.col("summary")).alias("failed_tasks"), "run_date", "started_at", finished.alias("finished_at"),
        cal.duration_ms(F.col("started_at"), finished).alias("duration_ms"), "triggered_by", "summary", "step_failed")


def half_even_percent(part: Column, whole: Column) -> Column:
    """100 * part / whole rounded half to even, in integers; null without a whole."""
    quotient = F.floor(F.lit(100) * part / whole)
    twice = (F.lit(100) * part - quotient * whole) * 2
    up = (twice > whole) | ((twice == whole) & (quotient % 2 == 1))
    return F.when(whole > 0, (quotient + F.when(up, 1).otherwise(0)).cast("int"))


def recent_runs(entries: DataFrame, n: int = RECENT_RUNS) -> DataFrame:
    """The ``n`` newest runs of each pipeline; the limit is applied before the shuffle as well."""
    newest = Window.partitionBy("pipeline").orderBy(
        F.desc_nulls_last("run_date"), F.desc_nulls_last("started_at"), F.desc("run_id"))
    return entries.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= n)


def _has(summary: Column, status: str) -> Column:
    return F.coalesce(F.try_element_at(summary, F.lit(status)) > 0, F.lit(False))


def pipeline_cards(entries: DataFrame, pipelines: DataFrame, today: Column, days: int = CARD_DAYS) -> DataFrame:
    """Each registered pipeline's card: last status, what it waits on, service level and ten recent runs."""
    oldest = F.date_sub(today, days - 1)
    window = entries.where((F.to_date("started_at") >= oldest) & (F.to_date("started_at") <= today)
                           & (F.col("run_date") >= oldest))
    done = ~F.col("status").isin("running", "aborted")
    rates = window.groupBy("pipeline").agg(
        F.count_if(done).alias("done"), F.count_if(F.col("status") == "success").alias("succeeded"))
    asks = F.when(_has(F.col("summary"), "waiting_decision"), "waiting_decision").when(
        _has(F.col("summary"), "waiting_paused"), "waiting_paused")
    item = F.struct("position", "run_id", "run_date", "started_at", "status", "failed_tasks", asks.alias("asks"))
    recent = recent_runs(window).groupBy("pipeline").agg(F.sort_array(F.collect_list(item)).alias("recent"))
    last = F.col("recent")[0]
    cards = pipelines.select(F.col("name").alias("pipeline")).join(rates, "pipeline", "left").join(
        recent, "pipeline", "left")
    return cards.select(
        "pipeline", F.coalesce(last["status"], F.lit("idle")).alias("status"),
        F.when(last["status"] == "running", last["asks"]).alias("waiting_on"), last["failed_tasks"].alias("failed_tasks"),
        half_even_percent(F.col("succeeded"), F.col("done")).alias("sla"),
        F.transform("recent", lambda r: F.struct(r["run_id"], r["run_date"], r["status"], r["failed_tasks"])).alias(
            "recent_runs"))


def needs_attention() -> Column:
    """Whether a card needs its viewer: failed, waiting for a decision, or running with a failed task."""
    return (
        F.coalesce(F.col("status") == "failed", F.lit(False))
        | F.coalesce(F.col("waiting_on") == "waiting_decision", F.lit(False))
        | ((F.col("status") == "running") & (F.coalesce("failed_tasks", F.lit(0)) > 0))
    )


def task_entries(tasks: DataFrame) -> DataFrame:
    """Task rows as a task list shows them; work starts at ``running_at`` where it is known."""
    return tasks.select(
        "run_id", "task_no", "task_name", "pipeline", F.coalesce("status", F.lit("unknown")).alias("status"),
        cal.duration_ms(F.coalesce("running_at", "started_at"), F.col("finished_at")).alias("duration_ms"),
        F.coalesce("restarts", F.lit(0)).alias("restarts"), F.coalesce("retry_attempt", F.lit(0)).alias("retry_attempt"),
        is_stale().alias("stale"))


def is_stale() -> Column:
    """A row of the older format (it has no readiness) that is not final: nothing finishes it any more."""
    return F.coalesce(F.col("readiness") == "", F.lit(True)) & ~vocab.is_final(F.col("status"))


def runs_of_dates(tasks: DataFrame, run_rows: DataFrame) -> DataFrame:
    """The runs of every logical date, found through task rows; a run row, where there is one, says how the run is."""
    status = F.coalesce("status", F.lit("waiting"))
    counted = tasks.withColumn("status", status).groupBy("run_id", "pipeline", "run_date").agg(
        *_roll_up(), F.min("started_at").alias("first_start"), F.max("finished_at").alias("last_finish"),
        F.count_if(F.col("status") == "failed").cast("int").alias("failed_rows"))
    entries = run_entries(run_rows).select(
        "run_id", F.col("status").alias("row_status"), F.col("failed_tasks").alias("row_failed"),
        F.col("started_at").alias("row_start"), F.col("finished_at").alias("row_finish"))
    joined = counted.join(entries, "run_id", "left")
    known = F.col("row_status").isNotNull()
    derived = F.when(~F.col("all_final"), "stale").otherwise(vocab.run_status(
        F.col("all_final"), F.col("any_failed"), F.col("any_stopped")))
    start = F.when(known, F.col("row_start")).otherwise(F.col("first_start"))
    finish = F.when(known, F.col("row_finish")).when(derived != "stale", F.col("last_finish"))
    return joined.select(
        "run_id", "pipeline", "run_date", F.coalesce("row_status", derived).alias("status"),
        F.coalesce("row_failed", "failed_rows").alias("failed_tasks"), start.alias("started_at"),
        finish.alias("finished_at"), cal.duration_ms(start, finish).alias("duration_ms"))


def latest_run_of_date(tasks: DataFrame) -> DataFrame:
    """Per pipeline and date, the run whose earliest row started last; ties go to the greater run."""
    starts = tasks.groupBy("pipeline", "run_date", "run_id").agg(F.min("started_at").alias("started_at"))
    return starts.groupBy("pipeline", "run_date").agg(
        F.max(F.struct("started_at", "run_id"))["run_id"].alias("run_id"))


def filter_runs(entries: DataFrame, status: str | None = None, pipeline: str | None = None,
                first: str | None = None, last: str | None = None) -> DataFrame:
    """Runs by shown status, pipeline and logical date; a status no run can show keeps none."""
    kept = entries
    if status and status not in vocab.SHOWN_RUN_STATUSES:
        return kept.where(F.lit(False))
    if pipeline:
        kept = kept.where(F.col("pipeline") == pipeline)
    if first:
        kept = kept.where(F.col("run_date") >= F.lit(first).cast("date"))
    if last:
        kept = kept.where(F.col("run_date") <= F.lit(last).cast("date"))
    return kept.where(F.col("status") == status) if status else kept


def group_counts(pipelines: DataFrame) -> DataFrame:
    """Pipelines per group A-Z, the ungrouped last."""
    grouped = pipelines.groupBy(text.group_key(F.col("group_name")).alias("group_key")).agg(
        F.min_by(F.trim("group_name"), "name").alias("label"), F.count("*").alias("pipelines"))
    return grouped.orderBy(F.col("group_key") == "", "group_key")
