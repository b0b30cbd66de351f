"""Slices of rows inside hot keys, and what is carried over them."""

import datetime as dt
import random

from pyspark.sql import functions as F

from flowgauge.operators import asof, feeds, slices
from flowgauge.sources import facts as src

START = dt.datetime(2024, 1, 1)


def test_a_hot_minute_is_spread_over_many_slices(spark):
    rows = spark.range(200_000).select(F.lit("hot").alias("asset_name"), (F.col("id") % 60_000).alias("time_ms"), F.col("id").alias("source"))
    rows = rows.unionByName(spark.range(1_000).select(F.concat(F.lit("a"), F.col("id")).alias("asset_name"), F.lit(5).cast("long").alias("time_ms"), "id").withColumnRenamed("id", "source"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a slice may be as small as these rows
    try:
        cut = slices.sliced(rows.repartition(8), ["asset_name"], [F.col("time_ms"), F.col("source")])
        held = [r["count"] for r in cut.groupBy("slice").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(held) >= 4 and max(held) < 2 * sum(held) / len(held)
    timed = src.assign_fact_times(rows).where("asset_name = 'hot'")
    assert timed.select("fact_ms").distinct().count() == 200_000
    assert timed.where("fact_ms < time_ms").isEmpty()


def test_positions_cross_slices(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 1, 1, 2]), n, rnd.choice([None, START, START + dt.timedelta(days=1)]), f"t{rnd.randrange(50)}_{n}") for n in range(300)]
    df = spark.createDataFrame(rows, "run_id long, task_no int, started_at timestamp_ntz, task_name string").repartition(5)
    got = {r.task_no: r.position for r in feeds.ordered_children(df).collect()}
    for run in (1, 2):
        order = sorted((r for r in rows if r[0] == run), key=lambda r: (r[2] is not None, r[2] or START, r[3]))
        assert [got[r[1]] for r in order] == list(range(1, len(order) + 1))


def test_the_newest_event_and_date_before_a_moment(spark):
    rnd = random.Random(3)
    days = [dt.date(2023, 12, 30) + dt.timedelta(days=n) for n in range(9)] + [dt.date(1, 1, 1), dt.date(9999, 12, 31), dt.date(1969, 7, 20)]
    facts = [(rnd.choice("aab"), rnd.choice(days), START + dt.timedelta(minutes=rnd.randrange(300))) for _ in range(120)]
    probes = {(rnd.choice("abc"), rnd.choice(days), START + dt.timedelta(minutes=rnd.randrange(300))) for _ in range(60)}
    df = spark.createDataFrame(facts, "asset_name string, partition_date date, event_time timestamp_ntz").repartition(4)
    asked = spark.createDataFrame(sorted(probes), "asset_name string, target_date date, cutoff timestamp_ntz")
    got = {(r.asset_name, r.target_date, r.cutoff): r.partition_date for r in asof.newest_known_date(asked, df).collect()}
    assert got == {(a, t, c): max((d for x, d, e in facts if x == a and d <= t and e <= c), default=None) for a, t, c in probes}
    last = asof.last_event_before(asked, df, ["asset_name"], "cutoff", "last").collect()
    assert {(r.asset_name, r.target_date, r.cutoff): r["last"] for r in last} == {
        (a, t, c): max((e for x, _, e in facts if x == a and e <= c), default=None) for a, t, c in probes}
