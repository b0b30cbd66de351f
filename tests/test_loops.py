"""Loops and pages against brute force on small random inputs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from flowgauge.operators import deadlines, feeds, runs
from flowgauge.plans import graph
from flowgauge.sources import facts as src
from tests.test_rules import expected

COLUMNS = ["run_id", "task_no", "trigger_rule", "status", "skip_origin", "finished_at"]
SCHEMA = "run_id long, task_no int, trigger_rule string, status string, skip_origin string, finished_at timestamp_ntz"
LETTER = {("success", None): "S", ("skipped", "manual"): "K", ("skipped", "rule"): "R", ("failed", None): "F",
          ("upstream_failed", None): "B"}


def letter(row):
    return LETTER.get(row, "P")


def random_runs(seed, n=40):
    rnd = random.Random(seed)
    names = ["all_success", "one_success", "all_done", "one_failed", "none_failed", "all_skipped", "always"]
    states = [("success", None), ("failed", None), ("waiting", None), ("waiting", None), ("skipped", "rule"),
              ("skipped", "manual"), ("upstream_failed", None), ("running", None)]
    tasks, edges = {}, []
    for run in range(n):
        for t in range(1, 8):
            tasks[run, t] = (rnd.choice(names), *rnd.choice(states))
            for u in rnd.sample(range(1, t), k=min(t - 1, rnd.randint(0, 2))):
                edges.append((run, t, u))
        if run % 10 == 0:
            del tasks[run, 1]
    return tasks, edges


def frames(spark, tasks, edges):
    rows = [(r, t, *v, None) for (r, t), v in tasks.items()]
    return (spark.createDataFrame(rows, SCHEMA),
            spark.createDataFrame(edges, "run_id long, task_no int, upstream_no int"))


def test_settle_matches_brute_force(spark):
    tasks, edges = random_runs(1)
    want = {k: (s, o) for k, (_, s, o) in tasks.items()}
    for run, t in sorted(tasks):
        rule, status, _ = tasks[run, t]
        ups = [u for r, n, u in edges if (r, n) == (run, t)]
        if status != "waiting":
            continue
        if any((run, u) not in want for u in ups):
            want[run, t] = ("failed", None)
            continue
        verdict = expected(rule, tuple(letter(want[run, u]) for u in ups))
        want[run, t] = {"fail": ("failed", None), "skip": ("skipped", "rule"), "upstream_failed": ("upstream_failed", None),
                        "ready": ("deps_ready", None), "wait": ("waiting", None)}[verdict]
    t, e = frames(spark, tasks, edges)
    got = {(r.run_id, r.task_no): (r.status, r.skip_origin) for r in graph.settle(t, e, COLUMNS).collect()}
    assert got == want


def test_reset_set_matches_brute_force(spark):
    tasks, edges = random_runs(2)
    restarted = {(r, t) for (r, t), v in tasks.items() if v[1] == "failed"}
    below = set()
    grown = set(restarted)
    while grown:
        grown = {(r, t) for r, t, u in edges if (r, u) in grown and (r, t) not in below}
        below |= grown
    state = {k: (s, o) for k, (_, s, o) in tasks.items()}
    want = set()
    for run, t in sorted(below & set(tasks)):
        decided = {("upstream_failed", None): "upstream_failed", ("skipped", "rule"): "skip"}.get(state[run, t])
        ups = [u for r, n, u in edges if (r, n) == (run, t)]
        if decided is None or any((run, u) not in state for u in ups):
            continue
        if expected(tasks[run, t][0], tuple(letter(state[run, u]) for u in ups)) != decided:
            want.add((run, t))
            state[run, t] = ("waiting", None)
    t, e = frames(spark, tasks, edges)
    roots = spark.createDataFrame(sorted(restarted), "run_id long, task_no int")
    assert {(r.run_id, r.task_no) for r in graph.reset_set(t, e, roots, COLUMNS).collect()} == want


def test_pages_cover_the_feed_once(spark):
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(n, start + dt.timedelta(days=rnd.randint(0, 30))) for n in range(200)]
    df = spark.createDataFrame(rows, "run_id long, started_at timestamp_ntz").persist()
    seen, before = [], None
    while True:
        found, cursor = feeds.page(df, 17, before)
        page = found.collect()
        seen += [r.run_id for r in page]
        cut = cursor.first()[0]
        if cut is None:
            break
        assert min(r.started_at for r in page) == cut
        before = F.lit(cut)
    assert sorted(seen) == list(range(200))


def test_untimed_rows_come_last_and_end_paging(spark):
    rows = [(1, dt.datetime(2024, 1, 2)), (2, None), (3, None), (4, None)]
    df = spark.createDataFrame(rows, "run_id long, started_at timestamp_ntz")
    found, cursor = feeds.page(df, 2)
    assert [r.run_id for r in found.collect()] == [1, 2] and cursor.first()[0] is None


def test_task_page_matches_walk(spark):
    rnd = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(n, start + dt.timedelta(hours=rnd.randint(0, 60)), rnd.randint(1, 9), rnd.randint(0, 3)) for n in range(120)]
    for limit, budget in ((10, 1000), (1000, 60), (1000, 100000), (25, None)):
        page, last, read, want = 0, None, 0, set()
        for n, at, size, kept in sorted(rows, key=lambda r: (r[1], -r[0]), reverse=True):
            if at != last and (page >= limit or (budget is not None and last is not None and read + size > budget)):
                break
            want.add(n)
            page, last, read = page + kept, at, read + size
        df = spark.createDataFrame(rows, "run_id long, started_at timestamp_ntz, size int, kept int")
        assert {r.run_id for r in feeds.task_page(df, limit, budget).collect()} == want


def test_unique_times_cross_slices(spark):
    rnd = random.Random(7)
    rows = [("a" if rnd.random() < .7 else "b", n, rnd.randint(0, 40)) for n in range(300)]
    df = spark.createDataFrame(rows, "asset_name string, source long, time_ms long")
    got = {r.source: r.fact_ms for r in src.assign_fact_times(df, slice_ms=10).collect()}
    for asset in "ab":
        last = None
        for _, n, ms in sorted((r for r in rows if r[0] == asset), key=lambda r: (r[2], r[1])):
            last = ms if last is None else max(ms, last + 1)
            assert got[n] == last


def test_every_pause_is_kept(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, n, start + dt.timedelta(hours=7 * n), "pause" if n % 3 < 2 else "resume") for n in range(60)]
    df = spark.createDataFrame(rows, "run_id long, event_id long, at timestamp_ntz, action string")
    got = sorted((r.start, r.end) for r in deadlines.pause_intervals(df).collect())
    hours = dt.timedelta(hours=7)
    assert got == [(start + 3 * k * hours, start + (3 * k + 2) * hours) for k in range(20)]


def test_cause_is_cut_at_its_limit(spark):
    names = [f"{'x' * 200}{n:05d}" for n in range(400)]
    rows = spark.createDataFrame([(1, n, "failed") for n in names], "run_id long, name string, status string")
    heads = spark.createDataFrame([(1, False, "s")], "run_id long, step_failed boolean, failed_step string")
    cause = runs.failure_cause(rows, heads, 32_768).first().cause
    assert len(cause) <= 32_768 and cause.startswith("400 tasks failed: ")
    shown = cause.count("x" * 200)
    assert cause.endswith(f" and {400 - shown} more") and len(cause) + 207 > 32_768


def test_cycle_ends_a_plan(spark):
    nodes = spark.createDataFrame([(1, "a", "daily"), (2, "b", "daily")], "asset long, pipeline string, granularity string")
    edges = spark.createDataFrame([(1, 2), (2, 1)], "asset long, upstream long")
    targets = spark.createDataFrame([(1, "2024-01-01")], "target long, partition string")
    complete = spark.createDataFrame([], "pipeline string, partition string")
    try:
        graph.backfill_plan(nodes, edges, targets, complete)
    except ValueError as error:
        assert "cycle" in str(error)
    else:
        raise AssertionError("a cycle must be reported")


def test_pointers_are_followed(spark, tmp_path):
    (tmp_path / "bucket").mkdir()
    (tmp_path / "bucket" / "7.json").write_text('{"rows":\n7}')
    from flowgauge.operators import outputs

    rows = spark.createDataFrame(
        [(1, '{"_s3_ref":"store://bucket/7.json"}'), (2, '{"_s3_ref":"store://bucket/8.json"}'), (3, '{"a":1}')],
        "run_id long, result string")
    got = {r.run_id: r.document for r in outputs.dereference(rows, outputs.documents_below(spark, str(tmp_path))).collect()}
    assert got == {1: '{"rows":\n7}', 2: None}
