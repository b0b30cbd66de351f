"""Streaming jobs fed in several batches leave what the batch operators give on all rows."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from flowgauge.operators import conditions
from flowgauge.streaming import jobs, stateful
from flowgauge.streaming.fact_index import FactIndex, Reach
from flowgauge.streaming.tables import DayTable, folders

FACTS = ("event_id long, asset_name string, event_time timestamp_ntz, granularity string, partition_key string,"
         " partition_date date, cascade string, source_dag string")


def facts(spark, n=120, seed=11):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at = start + dt.timedelta(minutes=97 * i)
        day = at.date() - dt.timedelta(days=rnd.choice([0, 0, 0, 1, 3]))
        rows.append((i, rnd.choice(["a", "b", "c"]), at, "daily", day.isoformat(), day,
                     rnd.choice(["auto", "auto", "all", "none"]), rnd.choice(["p1", "x"])))
    return spark.createDataFrame(rows, FACTS)


def in_files(spark, df, order, pieces):
    """A stream that meets ``df`` one file, and so one batch, at a time."""
    folder = tempfile.mkdtemp(prefix="run-")
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // pieces)
    for n in range(pieces):
        part = spark.createDataFrame(rows[n * size:(n + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(folder)
    return jobs.read_parquet_stream(spark, folder, df.schema, files_per_batch=1)


def setup(spark):
    specs = spark.createDataFrame([
        ("p1", '{"operator":"AND","assets":["a",{"asset_name":"b","freshness_hours":30}]}'),
        ("p2", '{"operator":"OR","assets":["b",{"asset_name":"c","consecutive_days":3}]}'),
        ("p3", '{"operator":"AND","assets":["c",{"operator":"OR","assets":["a","b"]}]}')], "spec_id string, text string")
    nodes = conditions.usable_nodes(conditions.flatten_conditions(specs, "text"))
    subs = nodes.where("op = 'leaf'").select(F.col("spec_id").alias("pipeline"), "asset_name").distinct().withColumn(
        "subscribed_at", F.lit("2024-01-02").cast("timestamp_ntz"))
    return nodes, subs


def brute_holds(rows, spec, target, cutoff):
    """Whether a schedule holds as of ``cutoff``, read fact by fact."""
    known = [r for r in rows if r.event_time <= cutoff]

    def plain(asset):
        return any(r.asset_name == asset and r.partition_date == target for r in known)

    def fresh(asset, hours):
        mine = [r for r in known if r.asset_name == asset and r.partition_date <= target]
        if not mine:
            return False
        newest = max(r.partition_date for r in mine)
        return max(r.event_time for r in mine if r.partition_date == newest) >= cutoff - dt.timedelta(hours=hours)

    def span(asset, days):
        have = {r.partition_date for r in known if r.asset_name == asset}
        return all(target - dt.timedelta(days=n) in have for n in range(days))

    return {"p1": lambda: plain("a") and fresh("b", 30), "p2": lambda: plain("b") or span("c", 3),
            "p3": lambda: plain("c") and (plain("a") or plain("b"))}[spec]()


def test_push_requests_batch_stream_and_brute_force(spark):
    nodes, subs = setup(spark)
    df = facts(spark).persist()
    batch = conditions.push_requests(df, subs, nodes, df, conditions.depth_of(nodes)).collect()
    rows = df.collect()
    want = set()
    uses = {"p1": "ab", "p2": "bc", "p3": "abc"}
    for r in rows:
        for spec, assets in uses.items():
            if r.cascade == "none" or r.asset_name not in assets or r.source_dag == spec or r.event_time < dt.datetime(2024, 1, 2):
                continue
            if r.cascade == "all" or brute_holds(rows, spec, r.partition_date, r.event_time):
                event = r.cascade == "all" or spec == "p2"
                want.add((spec, r.partition_key, "ev" if event else "and", r.event_time if event else None))
    got = {(b.consumer, b.run_date, b.kind, b.first_event_time if b.kind == "ev" else None) for b in batch}
    assert got == want
    stream = in_files(spark, df, "event_time", 4)
    emitted = jobs.push_evaluation(spark, stream, subs, nodes, jobs.new_folder(spark, "push-test")).rows().collect()
    assert sorted(r.run_name for r in emitted) == sorted(b.run_name for b in batch)


def test_ingest_skips_what_was_stored(spark):
    df = facts(spark, 40)
    twice = df.unionByName(df.where("event_id % 2 = 0")).withColumn("execution_date", F.col("partition_key")).withColumn(
        "partition_date", F.when(F.col("event_id") % 10 == 3, "20240101").otherwise(F.col("partition_date").cast("string")))
    good, bad = jobs.ingest_facts(spark, in_files(spark, twice, "event_time", 3), jobs.new_folder(spark, "ingest-test"))
    assert good.rows().count() == 36 and bad.rows().count() == 4


def test_windows_count_late_rows(spark):
    df = facts(spark, 60)
    stream = in_files(spark, df, F.desc("event_time"), 3)
    got = jobs.tumbling_counts(spark, stream, "1 day", jobs.new_folder(spark, "count-test"))
    want = df.groupBy(F.to_date("event_time").alias("d"), "asset_name").count().collect()
    assert {(r.window_start.date(), r.asset_name, r.facts) for r in got.collect()} == {(r.d, r.asset_name, r["count"]) for r in want}


def test_a_fact_from_the_future_raises_no_alert(spark):
    now = dt.datetime(2024, 2, 1)
    day = dt.date(2024, 1, 1)
    rows = [(1, "a", dt.datetime(2024, 1, 1, 5), "daily", "2024-01-01", day, "auto", "x"),
            (2, "a", dt.datetime(2030, 1, 1), "daily", "2030-01-01", dt.date(2030, 1, 1), "auto", "x")]
    expected = spark.createDataFrame([("a", "2024-01-01", dt.datetime(2024, 1, 1, 1)), ("b", "2024-01-01", dt.datetime(2024, 1, 1, 1)),
                                      ("b", "2029-01-01", dt.datetime(2029, 1, 2))], "asset_name string, partition_key string, due_at timestamp_ntz")
    stream = in_files(spark, spark.createDataFrame(rows, FACTS), "event_id", 2)
    alerts = jobs.alert_missing(spark, stream, expected, tempfile.mkdtemp(prefix="run-"), F.lit(now))
    assert [(r.asset_name, r.partition_key) for r in alerts.rows().collect()] == [("b", "2024-01-01")]


def test_a_batch_reads_only_the_stored_days_it_touches(spark):
    shape = spark.createDataFrame([], "asset_name string, event_time timestamp_ntz").schema
    table = jobs.BatchTable(spark, tempfile.mkdtemp(prefix="run-") + "/t", shape, day_of="event_time")
    for n in range(4):
        table.write(spark.createDataFrame([("a", dt.datetime(2024, 1, 1 + n, 3))], shape), n)
    found = table.before(3, dt.date(2024, 1, 2), dt.date(2024, 1, 9))
    assert [r.event_time.day for r in found.orderBy("event_time").collect()] == [2, 3]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_an_alert_leaves_when_its_timer_fires(spark):
    """Three batches, in time order: what is open is closed by a fact or alerted once; the batch twin says the same."""
    start = dt.datetime(2024, 1, 1)
    expected = [(a, (start + dt.timedelta(days=n)).date().isoformat(), start + dt.timedelta(days=n + 1)) for a in "ab" for n in range(9)]
    kept = [(n, "a", start + dt.timedelta(days=n, hours=5)) for n in range(9) if n not in (2, 5)]
    kept += [(20 + n, "b", start + dt.timedelta(days=n, hours=6)) for n in range(9) if n not in (0, 7, 8)]
    rows = [(i, a, at, "daily", at.date().isoformat(), at.date(), "auto", "x") for i, a, at in kept]
    facts_of_days = spark.createDataFrame(rows, FACTS)
    due = spark.createDataFrame(expected, "asset_name string, partition_key string, due_at timestamp_ntz")
    folder = tempfile.mkdtemp(prefix="run-")
    alerts = jobs.alert_missing(spark, in_files(spark, facts_of_days, "event_time", 3), due, folder, F.lit(dt.datetime(2025, 1, 1)))
    clock = max(at for _, _, at in kept)
    twin = {(r.asset_name, r.partition_key) for r in jobs.missing_partitions(due, facts_of_days, F.lit(clock)).collect()}
    got = [(r.asset_name, r.partition_key) for r in alerts.rows().collect()]
    assert twin == {("a", "2024-01-03"), ("a", "2024-01-06"), ("b", "2024-01-01"), ("b", "2024-01-08")} and len(got) == len(set(got)) and set(got) == twin
    batches = {(r.asset_name, r.partition_key): r.batch_id for r in alerts.all().collect()}
    assert batches["b", "2024-01-01"] <= batches["a", "2024-01-03"] < batches["a", "2024-01-06"]


def test_state_of_alerts_holds_open_partitions_only(spark):
    """A fact that comes out of order, long before the clock, still closes its partition."""
    start = dt.datetime(2024, 1, 1)
    due = spark.createDataFrame([("a", "x", start + dt.timedelta(days=30)), ("a", "y", start + dt.timedelta(days=30))],
                                "asset_name string, partition_key string, due_at timestamp_ntz")
    rows = [(1, "a", start + dt.timedelta(days=20), "daily", "z", None, "auto", "p"), (2, "a", start, "daily", "x", None, "auto", "p"),
            (3, "a", start + dt.timedelta(days=40), "daily", "w", None, "auto", "p")]
    stream = in_files(spark, spark.createDataFrame(rows, FACTS), "event_id", 3)
    alerts = jobs.alert_missing(spark, stream, due, tempfile.mkdtemp(prefix="run-"), F.lit(dt.datetime(2025, 1, 1)))
    assert [(r.asset_name, r.partition_key) for r in alerts.rows().collect()] == [("a", "y")]


def test_a_late_fact_counts_for_48_hours_and_changes_no_answer(spark):
    nodes, subs = setup(spark)
    now, day = dt.datetime(2024, 1, 10), dt.date(2024, 1, 8)
    on_time = facts(spark, 6).unionByName(spark.createDataFrame(
        [(800, "a", now - dt.timedelta(hours=3), "daily", "2024-01-09", dt.date(2024, 1, 9), "auto", "x")], FACTS))
    tables = jobs.push_evaluation(spark, in_files(spark, on_time, "event_time", 1), subs, nodes, tempfile.mkdtemp(prefix="run-"))
    before = {r.run_name for r in tables.rows().collect()}
    late = [(900 + h, asset, now - dt.timedelta(hours=h), "daily", day.isoformat(), day, "all", "x") for h, asset in ((47, "a"), (48, "b"), (49, "c"))]
    jobs.record_late(tables, spark.createDataFrame(late, FACTS), 1)
    for _ in range(2):  # run again in the same hour
        jobs.replay_late(spark, tables, subs, nodes, now)
    after = tables.rows().collect()
    assert before <= {r.run_name for r in after} and len(after) == len({r.run_name for r in after})
    new = [r for r in after if r.run_name not in before]
    assert sorted(r.trigger_asset for r in new) == ["a", "a", "b", "b", "b"]  # the consumers of a and b, none of c


def test_replays_are_due_hourly():
    now = dt.datetime(2024, 1, 1)
    assert jobs.replay_due(now, None) and jobs.replay_due(now, now - dt.timedelta(hours=1))
    assert not jobs.replay_due(now, now - dt.timedelta(minutes=59))


def test_what_a_batch_reads_does_not_grow(spark):
    """The files that the batch of a day reads, with ever more days behind it."""
    index = FactIndex(spark, tempfile.mkdtemp(prefix="run-") + "/index")
    reach = Reach(spark.createDataFrame([(24.0, 3)], "freshness_hours double, consecutive_days int"))
    start, read = dt.datetime(2024, 1, 1), {}
    for n in range(36):
        at = start + dt.timedelta(days=4 * n)
        batch = spark.createDataFrame([(n, "a", at, "daily", at.date().isoformat(), at.date(), "auto", "x")], FACTS).coalesce(1)
        index.add(batch, n)
        if n % 7 == 0:
            known = index.known(batch, reach)
            read[n] = len(known.inputFiles())
            assert known.agg(F.max("event_time")).first()[0] == at
    # a day's events, and first times back to the first day of the month before
    assert max(read.values()) <= 1 + 62 // 4 + 1 and len(index.events.days()) == 36


def test_what_facts_are_judged_by_is_read_as_it_is(spark):
    """Events are not made distinct first: least and greatest times are the same."""
    index = FactIndex(spark, tempfile.mkdtemp(prefix="run-") + "/index")
    reach = Reach(spark.createDataFrame([(24.0, 1)], "freshness_hours double, consecutive_days int"))
    index.add(facts(spark, 10), 0)
    known = index.known(facts(spark, 10), reach)
    assert not known.isEmpty() and "Exchange" not in known._jdf.queryExecution().executedPlan().toString()


def test_days_are_merged_when_they_are_crowded(spark):
    shape = spark.createDataFrame([], "name string, at timestamp_ntz").schema
    table = DayTable(spark, tempfile.mkdtemp(prefix="run-") + "/t", shape, "at", lambda rows: rows.distinct())
    for n in range(DayTable.CROWD + 3):
        table.add(spark.createDataFrame([("same", dt.datetime(2024, 1, 1)), (f"n{n}", dt.datetime(2024, 1, 1 + n % 2))], shape), n)
        table.add(spark.createDataFrame([(f"n{n}", dt.datetime(2024, 1, 1 + n % 2)), ("same", dt.datetime(2024, 1, 1))], shape), n)
    want = sorted((r.name, r["at"].day) for r in table.rows().collect())
    assert table.compact("2024-01-01", "2024-01-01") == ["2024-01-01"] and table.compact() == []
    assert folders(spark, f"{table.path}/day=2024-01-01") == [f"batch_id={DayTable.MERGED - 1}"]
    assert sorted((r.name, r["at"].day) for r in table.rows().collect()) == want
    assert {r["at"].day for r in table.read("2024-01-02", "2024-01-09").collect()} == {2}
    assert table.read(besides=1).where("name = 'n1'").isEmpty()


def log_rows(run, start, ends, task_count=2):
    """A run whose tasks wait, run and end; ``ends`` are their last statuses."""
    rows = []
    for task in range(1, task_count + 1):
        steps = ["waiting", "running", ends[task - 1]]
        for seq, status in enumerate(steps, 1):
            rows.append((run, task, 1, start + dt.timedelta(minutes=10 * seq + task), seq, status))
    return rows


LOG = "run_id long, task_no int, generation_after int, at timestamp_ntz, seq int, new_status string"


def test_statuses_follow_the_log_and_ended_runs_go(spark):
    start = dt.datetime(2024, 1, 1)
    rows = log_rows(1, start, ["success", "failed"]) + log_rows(2, start, ["success", "running"])
    rows += log_rows(3, start + dt.timedelta(days=2), ["success", "skipped"])
    middle = [(2, 2, 1, start + dt.timedelta(days=2, hours=3), 4, "stopped")]
    restart = [(3, 2, 2, start + dt.timedelta(days=2, hours=5), 4, "waiting"), (3, 2, 2, start + dt.timedelta(days=2, hours=6), 5, "failed")]
    late = [(1, 2, 2, start + dt.timedelta(hours=2), 4, "waiting"), (9, 1, 1, start, 1, "waiting")]
    fresh = log_rows(4, start + dt.timedelta(days=9), ["success", "running"])
    batches = [rows, middle + restart, fresh, late, [(4, 2, 1, start + dt.timedelta(days=9, hours=1), 4, "success")]]
    folder = tempfile.mkdtemp(prefix="run-")
    for part in batches:
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.read_parquet_stream(spark, folder, spark.createDataFrame([], LOG).schema, files_per_batch=1)
    got = jobs.current_run_status(spark, stream, tempfile.mkdtemp(prefix="run-"), keep=dt.timedelta(days=3))
    assert {(r.run_id, r.status) for r in got.rows().collect()} == {(1, "failed"), (2, "aborted"), (3, "failed"), (4, "success")}
    assert sorted((r.run_id, r.new_status) for r in got.late.rows().collect()) == [(1, "waiting"), (9, "waiting")]


def test_a_busy_run_leaves_a_task_as_few_rows(spark):
    rows = [(1, n % 3, 1, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n), n, "running") for n in range(5_000)]
    df = spark.createDataFrame(rows, LOG).coalesce(2)
    left = stateful.reduced(df, ["run_id", "task_no"], ["generation_after", "at", "seq"]).collect()
    assert len(left) <= 12 and {max(r.seq for r in left if r.task_no == t) for t in range(3)} == {4997, 4998, 4999}


def test_facts_without_a_time_are_reported_once(spark):
    raw = [(n, "a", None, "daily", "2024-01-01", "2024-01-01", "auto", "x", "2024-01-01") for n in range(3)]
    ties = [(10, "b", dt.datetime(2024, 1, 1, 3), "daily", key, "2024-01-01", "auto", "x", key) for key in ("2024-01-02", "2024-01-01")]
    shape = FACTS.replace("partition_date date", "partition_date string") + ", execution_date string"
    good, bad = jobs.ingest_facts(spark, in_files(spark, spark.createDataFrame(raw, shape), "event_id", 3), jobs.new_folder(spark, "null-test"))
    assert [(r.asset_name, r.event_time) for r in bad.rows().collect()] == [("a", None)] and good.rows().isEmpty()
    good, _ = jobs.ingest_facts(spark, in_files(spark, spark.createDataFrame(ties, shape), "event_id", 1), jobs.new_folder(spark, "tie-test"))
    assert [r.partition_key for r in good.rows().collect()] == ["2024-01-01"]


def test_windows_of_panes_are_those_of_every_row(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("pq"), dt.datetime(2024, 1, 1) + dt.timedelta(days=rnd.choice([0, 1, 2, 5, 30, 33]), hours=rnd.randint(0, 23)),
             rnd.choice(["success", "failed", "running"])) for _ in range(80)]
    ended = spark.createDataFrame(rows, "pipeline string, started_at timestamp_ntz, status string")
    got = jobs.sliding_success(spark, in_files(spark, ended, "started_at", 3), tempfile.mkdtemp(prefix="run-"), days=4)
    want = {}
    for pipeline, at, status in rows:
        if status != "running":
            for back in range(4):
                first = dt.datetime.combine(at.date(), dt.time()) - dt.timedelta(days=back)
                done, good = want.get((pipeline, first), (0, 0))
                want[pipeline, first] = (done + 1, good + (status == "success"))
    assert {(r.pipeline, r.window_start): (r.completed, r.succeeded) for r in got.collect()} == want
