"""Push evaluation."""

import datetime as dt
import random

from pyspark.sql import functions as F

from flowgauge.operators import asof, conditions
from flowgauge.session import cut_lineage


def test_a_start_is_named_once_and_not_for_each_fact(spark, monkeypatch):
    named = spark.sparkContext.accumulator(0)

    def name(*parts):
        named.add(1)
        return "-".join(parts)

    monkeypatch.setattr(conditions.text, "run_name", F.udf(name, "string"))
    specs = spark.createDataFrame([("p", '{"operator":"AND","assets":["a"]}')], "spec_id string, text string")
    nodes = conditions.usable_nodes(conditions.flatten_conditions(specs, "text"))
    subs = spark.createDataFrame([("p", "a", None)], "pipeline string, asset_name string, subscribed_at timestamp_ntz")
    start, day = dt.datetime(2024, 1, 8), dt.date(2024, 1, 8)
    facts = spark.createDataFrame(
        [(n, "a", start + dt.timedelta(minutes=n), "daily", "2024-01-08", day, "all" if n == 50 else "auto", "x") for n in range(60)],
        "event_id long, asset_name string, event_time timestamp_ntz, granularity string, partition_key string, partition_date date,"
        " cascade string, source_dag string")
    rows = conditions.push_requests(facts, subs, nodes, facts, conditions.depth_of(nodes)).collect()
    assert {(r.kind, r.trigger_asset, r.first_event_time) for r in rows} == {("and", None, start), ("ev", "a", start + dt.timedelta(minutes=50))}
    assert 0 < named.value <= 4


FACTS = ("event_id long, asset_name string, event_time timestamp_ntz, granularity string, partition_key string, partition_date date,"
         " cascade string, source_dag string")


def test_schedules_are_asked_at_turns_and_not_for_each_fact(spark, monkeypatch):
    """Every fact's verdict against a reading of all facts, and how many moments were asked for."""
    rnd = random.Random(5)
    start, rows = dt.datetime(2024, 1, 1), []
    for n in range(500):
        at = start + dt.timedelta(minutes=3 * (n % 450))  # some at one moment
        asset = "b" if n % 60 in (1, 2, 3) else "a"
        day = at.date() - dt.timedelta(days=rnd.choice([0, 0, 0, 0, 1]) if asset == "b" else 0)
        rows.append((n, asset, None if n % 97 == 0 else at, "daily", day.isoformat(), day, "auto", "p" if n % 9 == 0 else None))
    rows.append((900, "a", start + dt.timedelta(days=40), "daily", "2024-02-10", dt.date(2024, 2, 10), "auto", "x"))
    specs = spark.createDataFrame([("p", '{"operator":"OR","assets":[{"asset_name":"a","consecutive_days":2},{"operator":"AND",'
                                         '"assets":["a",{"asset_name":"b","freshness_hours":0.75}]}]}')], "spec_id string, text string")
    nodes = conditions.usable_nodes(conditions.flatten_conditions(specs, "text"))
    subs = spark.createDataFrame([("p", "a", None), ("p", "b", None)], "pipeline string, asset_name string, subscribed_at timestamp_ntz")
    asked, plain = [], asof.newest_known_date
    monkeypatch.setattr(asof, "newest_known_date", lambda moments, facts: asked.append(moments.count()) or plain(moments, facts))
    facts = spark.createDataFrame(rows, FACTS)
    got = conditions.push_requests(facts, subs, nodes, facts, conditions.depth_of(nodes)).collect()

    def holds(target, now):
        known = [r for r in rows if r[2] is not None and r[2] <= now]
        days = {r[5] for r in known if r[1] == "a"}
        newest = max(((r[5], r[2]) for r in known if r[1] == "b" and r[5] <= target), default=None)
        fresh = newest is not None and newest[1] >= now - dt.timedelta(minutes=45)
        return {target, target - dt.timedelta(days=1)} <= days or target in days and fresh

    want = {(r[1], r[5].isoformat(), r[2]) for r in rows if r[2] is not None and r[7] != "p" and holds(r[5], r[2])}
    assert {(r.trigger_asset, r.run_date, r.first_event_time) for r in got} == want and len(got) == len(want)
    assert sum(asked) < 150


def test_stretches_answer_as_the_events_do(spark):
    rnd = random.Random(6)
    start = dt.datetime(1969, 12, 30)
    rows = [(n, rnd.choice("ab"), rnd.choice([start + dt.timedelta(seconds=rnd.randrange(400_000), microseconds=rnd.randrange(3)), None] if n % 9 == 0
             else [start + dt.timedelta(seconds=rnd.randrange(400_000))]), "daily", "", start.date() + dt.timedelta(days=rnd.randrange(4)), "auto", "x")
            for n in range(150)]
    facts = spark.createDataFrame(rows, FACTS)
    probes = spark.createDataFrame(
        [(a, start.date() + dt.timedelta(days=d), start + dt.timedelta(seconds=s), h) for a in "abc" for d in (0, 1, 3) for h in (0.5, 3.0, 30.0, 1e-9)
         for s in rnd.sample(range(450_000), 8)] +
        [(r[1], r[5], r[2] + dt.timedelta(hours=h, microseconds=m), h) for r in rows if r[2] for h in (0.5, 3.0) for m in (0, 1)],
        "asset_name string, target_date date, cutoff timestamp_ntz, hours double").distinct()
    keep = ["asset_name", "target_date", "cutoff", "hours", "ready"]
    want = {tuple(r) for r in asof.within_as_of(probes, facts).select(*keep).collect()}
    firsts = facts.groupBy("asset_name", "partition_date").agg(F.min("event_time").alias("event_time"))
    found = asof.within_ready_as_of(probes, firsts, asof.stretches(facts, probes)).select(*keep).collect()
    assert {tuple(r) for r in found} == want and {r.ready for r in found} == {True, False}


def test_started_names_are_merged_by_shuffle(spark):
    asked = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_name string, n int")
    fresh = conditions.replay_requests(asked, cut_lineage(spark.createDataFrame([("r1",)], "run_name string")))
    assert "Broadcast" not in fresh._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in fresh.collect()] == [("r2", 2)]
