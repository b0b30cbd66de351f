"""Posting lists of a registry."""

from pyspark.sql import functions as F

from flowgauge.operators import search


def test_texts_are_cut_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "TEXTS_PER_TASK", 20)
    rows = [(n, f"red {n}") for n in range(200)] + [(7, "red 7"), (8, "blue"), (9, None), (None, "green")]
    index = search.postings(spark.createDataFrame(rows, "key long, shown string").coalesce(1), "key", "shown")
    tasks = [r["count"] for r in index.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(tasks) > 6 and max(tasks) < sum(tasks) / 4
    want = set()
    for key, shown in rows:
        text = shown or ""
        want |= {(text[i:i + n], key) for n in range(4) for i in range(len(text) - n + 1)}
    got = [tuple(r) for r in index.collect()]
    assert set(got) == want and len(got) == len(want)
