"""Audits: a planted violation is found and the near miss beside it is not."""

import datetime as dt

from pyspark.sql import functions as F

from flowgauge.operators import audit

NOW = dt.datetime(2024, 1, 1)
RUNS = ("run_id long, status string, token string, answered string, stop_mark boolean, stop_done boolean,"
        " request_pending boolean, paused boolean, due_at timestamp_ntz, expires_at timestamp_ntz,"
        " execution_ended boolean, execution_ended_at timestamp_ntz")
TASKS = ("run_id long, task_no int, status string, generation int, token_fields string, expires_at timestamp_ntz,"
         " output_recorded boolean, waiting_since timestamp_ntz")
LATER = dt.datetime(2025, 1, 1)


def run(n, **over):
    row = {"run_id": n, "status": "active", "token": "t", "answered": None, "stop_mark": False, "stop_done": False,
           "request_pending": False, "paused": False, "due_at": NOW, "expires_at": LATER, "execution_ended": False,
           "execution_ended_at": None, **over}
    return tuple(row.values())


def task(n, status, **over):
    row = {"run_id": n, "task_no": 1, "status": status, "generation": 1, "token_fields": None, "expires_at": LATER,
           "output_recorded": True, "waiting_since": NOW, **over}
    return tuple(row.values())


def ids(df, column="run_id"):
    return sorted({r[column] for r in df.collect()})


def test_moves(spark):
    rows = [(1, "waiting", "deps_ready", "dispatcher"), (2, "waiting", "running", "run_task"), (3, None, "waiting", "start_run"),
            (4, "failed", "waiting", "console"), (5, "failed", "waiting", "dispatcher"), (6, "running", "running", "run_task")]
    log = spark.createDataFrame(rows, "run_id long, old_status string, new_status string, writer string")
    assert ids(audit.illegal_moves(log)) == [2, 5]


def test_coverage(spark):
    runs = spark.createDataFrame([
        run(1), run(2, due_at=None), run(3, due_at=NOW + dt.timedelta(minutes=30)), run(4, due_at=NOW + dt.timedelta(minutes=31)),
        run(5, due_at=None, answered="t"), run(6, due_at=None, status="creating")], RUNS)
    tasks = spark.createDataFrame([task(n, "success" if n == 5 else "running") for n in range(1, 7)], TASKS)
    assert ids(audit.uncovered_work(runs, tasks, F.lit(NOW))) == [2, 4]


def test_ends(spark):
    runs = spark.createDataFrame([
        run(1, due_at=None), run(2), run(3, execution_ended=True, execution_ended_at=NOW), run(
            4, execution_ended=True, execution_ended_at=NOW - dt.timedelta(hours=1)),
        run(5, execution_ended=True, execution_ended_at=NOW, stop_mark=True)], RUNS)
    tasks = spark.createDataFrame([task(1, "success"), task(2, "success"), task(3, "running"), task(4, "waiting"), task(5, "running")], TASKS)
    kind = "run_id long, token string, stop_mark boolean, raced_task int, unfinished int"
    assert ids(audit.unfounded_ends(runs, tasks, spark.createDataFrame([], kind))) == [1, 3]
    # the first was restarted after a right answer, the second answered too early, the third stopped
    answers = spark.createDataFrame([(4, "t", False, None, 0), (2, "t", False, None, 2), (5, "t", True, None, 1)], kind)
    found = audit.unfounded_ends(runs, tasks, answers).where("violation = 'answered early'")
    assert ids(found) == [2]


def test_expiry_and_liveness(spark):
    runs = spark.createDataFrame([run(1, expires_at=NOW), run(2), run(3, paused=True), run(4, execution_ended=True)], RUNS)
    tasks = spark.createDataFrame([task(1, "running"), task(2, "waiting_decision"), task(3, "running"), task(4, "failed")], TASKS)
    assert ids(audit.expired_live_rows(runs, tasks, F.lit(NOW))) == [1]
    assert ids(audit.stuck_runs(runs, tasks)) == [1]
