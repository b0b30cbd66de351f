"""Stored facts, and the index of a registry for searches."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from flowgauge.functions import text
from flowgauge.operators import catalog, search
from flowgauge.sources import facts as src


def stored(spark):
    rows = [(n, "abc"[n % 3], dt.datetime(2024, 1, 1) + dt.timedelta(hours=n), dt.date(2024, 1, 1) + dt.timedelta(days=n % 20)) for n in range(400)]
    df = spark.createDataFrame(rows, "event_id long, asset_name string, event_time timestamp_ntz, partition_date date")
    path = tempfile.mkdtemp(prefix="run-") + "/facts"
    src.write_facts(df, path)
    return df, src.read_facts(spark, path)


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "1000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_scan_reads_the_folders_of_its_dates(spark):
    df, table = stored(spark)
    found = src.scan_facts(table, ["a"], "2024-01-03", "2024-01-05")
    plan = plan_of(found)
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "partition_date" in filters and "2024-01-03" in filters and "2024-01-05" in filters
    assert "asset_name" in plan.split("PushedFilters: [")[1].split("]")[0]
    want = {r.event_id for r in src.scan_facts(df, ["a"], "2024-01-03", "2024-01-05").collect()}
    assert want and {r.event_id for r in found.collect()} == want


def test_dates_of_a_join_prune_folders_at_run_time(spark):
    df, table = stored(spark)
    dates = spark.createDataFrame([(dt.date(2024, 1, n), n) for n in range(1, 15)], "on date, n int").where("n % 5 = 2").select("on")
    found = src.facts_of_dates(table, dates)
    assert "dynamicpruning" in plan_of(found)
    want = {r.event_id for r in df.collect() if r.partition_date.day in (2, 7, 12)}
    assert {r.event_id for r in found.collect()} == want


def test_a_file_holds_its_assets_in_order(spark):
    _, table = stored(spark)
    rows = table.select(F.input_file_name().alias("f"), "asset_name", F.monotonically_increasing_id().alias("n")).collect()
    by_file = {}
    for r in sorted(rows, key=lambda r: r.n):
        by_file.setdefault(r.f, []).append(r.asset_name)
    assert all(names == sorted(names) for names in by_file.values())


def test_searches_share_an_index_and_agree_with_the_scan(spark):
    rnd = random.Random(4)
    words = ["Orders", "daily", "ÄRGER", "a", "eu-west", "x1", "customer_orders", "sales", "İstanbul"]
    rows = [(n, " ".join(rnd.choices(words, k=rnd.randint(0, 4)))) for n in range(80)] + [(90, None), (91, "")]
    registry = spark.createDataFrame(rows, "id long, shown string")
    asked = [(0, "ord"), (1, "DAILY a"), (2, ""), (3, "   "), (4, "zzz"), (5, "x1 sales"), (6, "ärger"), (7, "e"), (8, "customer_orders eu-w"),
             (9, None), (10, "rs da"), (11, "orders orders"), (12, "st")]
    searches = spark.createDataFrame(asked, "search_id long, search string")
    index = search.postings(registry, "id", "shown").persist()
    got = {tuple(r) for r in search.search(registry, index, searches, "id", "shown").collect()}
    scan = registry.crossJoin(searches).where(text.matches_search(F.col("shown"), F.col("search")))
    assert got == {(r.search_id, r.id) for r in scan.collect()} and len({s for s, _ in got}) > 8


def test_a_contract_may_be_empty_and_names_may_hold_dots(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "yy", 2)], "`a.b` long, `c d` string, `e``f` long")
    assert catalog.contract_violations(df, []).collect() == []
    assert catalog.contract_violations(df, [{"name": "a.b"}]).collect() == []
    found = catalog.contract_violations(df, [
        {"name": "a.b", "unique": True, "primary_key": True}, {"name": "c d", "max_length": 1}, {"name": "e`f", "nullable": False}])
    assert {tuple(r) for r in found.collect()} == {("a.b", "unique", 2), ("a.b", "primary key", 2), ("c d", "length", 1), ("e`f", "not null", 1)}
