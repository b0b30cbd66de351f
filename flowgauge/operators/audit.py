"""Audit queries over recorded state: each returns its violations, none when the state is sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowgauge.functions import vocab

TASK = ["run_id", "task_no"]
# The statuses work may run in, those only a decision leaves, and writes that end an ownership.
MAY_RUN = ("deps_ready", "running")
HELD = ("waiting", "waiting_paused")
OWNERSHIP_ENDS = ("action", "request", "stop")
CHECK_EVERY_MINUTES = 30

_OPEN = ("waiting", "deps_ready", "waiting_paused", "waiting_decision", "running", "pending")
_WAITS = ("waiting", "waiting_paused")
_NO_OUTCOME = tuple(s for s in vocab.TASK_STATUSES if s not in vocab.SUCCESSES)
# The moves of a task row: statuses it may leave (None: no row yet), status it takes, writers,
# and whether it wakes a pass.
MOVES = (
    ((None,), "waiting", ("start_run",), False),
    ((None,), "skipped", ("start_run",), False),
    (("waiting",), "waiting_paused", ("dispatcher",), False),
    (("waiting_paused",), "waiting", ("dispatcher",), False),
    (_WAITS, "deps_ready", ("dispatcher",), False),
    (_WAITS, "skipped", ("dispatcher",), True),
    (_WAITS, "upstream_failed", ("dispatcher",), True),
    (_WAITS, "failed", ("dispatcher",), True),
    (("deps_ready",), "failed", ("dispatcher",), True),
    (("deps_ready",), "running", ("run_task",), False),
    (("running",), "success", ("run_task",), True),
    (("running",), "waiting_decision", ("run_task",), True),
    (("deps_ready", "running"), "failed", ("dispatcher",), True),
    (("waiting_decision",), "failed", ("dispatcher",), True),
    (_NO_OUTCOME, "skipped", ("console",), True),
    (_NO_OUTCOME, "success", ("console",), True),
    (_OPEN + ("waiting_delay",), "failed", ("console",), True),
    (_OPEN + ("waiting_delay",), "stopped", ("console", "dispatcher"), True),
    (vocab.FINAL + ("waiting_decision",), "waiting", ("console",), True),
    (("upstream_failed", "skipped"), "waiting", ("dispatcher",), True),
)


def _pair(old: Column, new: Column, *more: Column) -> Column:
    return F.concat_ws(">", F.coalesce(old, F.lit("-")), new, *more)


def _wakes() -> Column:
    pairs = sorted({f"{old or '-'}>{to}" for sources, to, _, wakes in MOVES if wakes for old in sources})
    return _pair(F.col("old_status"), F.col("new_status")).isin(*pairs)


def illegal_moves(log: DataFrame) -> DataFrame:
    """Writes no transition of the table allows that writer; the table has a few dozen pairs, so it is a literal set."""
    legal = sorted({f"{old or '-'}>{to}>{w}" for sources, to, writers, _ in MOVES for old in sources for w in writers})
    move = _pair(F.col("old_status"), F.col("new_status"), F.col("writer"))
    changed = F.col("old_status").isNull() | (F.col("old_status") != F.col("new_status"))
    return log.where(changed & ~move.isin(*legal))


def waking_changes(log: DataFrame) -> DataFrame:
    """Changes of task rows that wake a pass: a listed pair, on a row that has a generation."""
    return log.where(F.col("old_status").isNotNull() & F.col("generation_after").isNotNull() & _wakes())


def woken_runs(log: DataFrame) -> DataFrame:
    return waking_changes(log).groupBy("run_id").agg(F.count("*").alias("changes"))


def run_without_right(tasks: DataFrame, executions: DataFrame) -> DataFrame:
    """Rows with token fields, and rows that may not run yet have a running execution."""
    tokens = tasks.where("token_fields IS NOT NULL").select(*TASK, F.lit("token").alias("violation"))
    idle = tasks.where(~F.col("status").isin(*MAY_RUN)).join(
        executions.where("running").select(*TASK, "generation").distinct(), [*TASK, "generation"], "left_semi")
    return tokens.unionByName(idle.select(*TASK, F.lit("execution").alias("violation")))


def unlawful_leave(writes: DataFrame) -> DataFrame:
    """Rows that left their wait other than by a conditional decision or an ownership-ending write."""
    left = writes.where(F.col("old_status").isin(*HELD) & (F.col("new_status") != F.col("old_status")))
    other = ~F.col("kind").isin("decision", *OWNERSHIP_ENDS)
    bare = (F.col("kind") == "decision") & ~(F.col("conditional") & F.col("checks_run_version"))
    return left.where(other | bare).select(*TASK, "seq", F.when(other, "writer").otherwise("conditions").alias("violation"))


def early_starts(starts: DataFrame) -> DataFrame:
    return starts.where((F.col("row_status") != "deps_ready") | (F.col("row_generation") != F.col("generation"))).select(
        *TASK, "generation")


def repeated_executions(executions: DataFrame) -> DataFrame:
    return executions.groupBy(*TASK, "generation").agg(F.count("*").alias("executions")).where("executions > 1")


def foreign_writes(writes: DataFrame) -> DataFrame:
    """Work that wrote under another generation than its own, or changed it."""
    return writes.where((F.col("kind") == "run_task") & (
        (F.col("writer_generation") != F.col("generation_before")) | (F.col("generation_after") != F.col("generation_before"))
    )).select(*TASK, "seq")


def kept_generations(writes: DataFrame) -> DataFrame:
    """Ownership-ending writes that did not raise the generation by one."""
    return writes.where(F.col("kind").isin(*OWNERSHIP_ENDS) & (F.col("new_status") != F.col("old_status"))
                        & (F.col("generation_after") != F.col("generation_before") + 1)).select(*TASK, "seq")


def _open_per_run(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("run_id").agg(
        F.count_if(~vocab.is_final(F.col("status"))).alias("open_rows"),
        F.count_if(F.col("status") == "waiting_decision").alias("deciding"))


def _answered() -> Column:
    return F.coalesce(F.col("answered") == F.col("token"), F.lit(False))


def unfounded_ends(runs: DataFrame, tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """Runs whose end does not follow from their rows: unanswered, ended early, or answered early.

    An answer carries how many rows were ``unfinished`` when it was given: a run that was answered rightly and restarted
    later has open rows now, and no violation.
    """
    live = runs.where("status <> 'creating'")
    state = live.join(_open_per_run(tasks), "run_id", "left").withColumn("open_rows", F.coalesce("open_rows", F.lit(0)))
    unanswered = state.where((F.col("open_rows") == 0) & F.col("token").isNotNull() & ~_answered()
                             & ~F.col("execution_ended") & F.col("due_at").isNull())
    open_rows = tasks.where(~vocab.is_final(F.col("status")))
    raced = answers.select("run_id", F.col("raced_task").alias("task_no")).distinct()
    ended = live.where(F.col("execution_ended") & ~F.col("stop_mark")).select("run_id", "execution_ended_at")
    early = open_rows.join(raced, TASK, "left_anti").join(ended, "run_id").where(
        ~F.coalesce(F.col("waiting_since") > F.col("execution_ended_at"), F.lit(False)))
    answered = answers.where(~F.col("stop_mark") & (F.col("unfinished") > 0))
    return (
        unanswered.select("run_id", F.lit("not answered").alias("violation"))
        .unionByName(early.select("run_id", F.lit("ended early").alias("violation")).distinct())
        .unionByName(answered.select("run_id", F.lit("answered early").alias("violation")).distinct())
    )


def uncovered_work(runs: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """Runs with work left and no check due within half an hour."""
    state = runs.join(_open_per_run(tasks), "run_id", "left")
    unanswered = F.col("token").isNotNull() & ~_answered() & ~F.col("execution_ended")
    work = (F.coalesce("open_rows", F.lit(0)) > 0) | (F.col("stop_mark") & ~F.col("stop_done")) | F.col(
        "request_pending") | unanswered
    late = F.col("due_at") > now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(CHECK_EVERY_MINUTES))
    return state.where((F.col("status") != "creating") & work & (F.col("due_at").isNull() | late)).select(
        "run_id", F.when(F.col("due_at").isNull(), "no due time").otherwise("due too late").alias("violation"))


def blind_passes(passes: DataFrame) -> DataFrame:
    return passes.where("unresolved_reads > 0 AND (starts > 0 OR closes > 0 OR answers > 0)").select("pass_id")


def expired_live_rows(runs: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    live = runs.where(~F.col("execution_ended"))
    rows = tasks.where(F.col("expires_at") <= now).join(live.select("run_id"), "run_id", "left_semi")
    return live.where(F.col("expires_at") <= now).select("run_id", F.lit(None).cast("int").alias("task_no")).unionByName(
        rows.select("run_id", "task_no"))


def unrecorded_successes(tasks: DataFrame) -> DataFrame:
    return tasks.where((F.col("status") == "success") & ~F.col("output_recorded")).select(*TASK)


def stuck_runs(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    state = runs.where(~F.col("execution_ended") & ~F.col("paused")).join(_open_per_run(tasks), "run_id", "left")
    waits = (F.coalesce("deciding", F.lit(0)) > 0) & F.col("due_at").isNotNull()
    return state.where(~waits).select("run_id")
