"""The state tables that queries read, over small tables of their own."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from flowgauge.operators import audit
from flowgauge.streaming import jobs
from flowgauge.suite import streams, views as suite_views
from flowgauge.suite.views import Views

ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string"
LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"


def views(spark, **tables):
    folder = tempfile.mkdtemp(prefix="run-")
    for name, (rows, shape) in tables.items():
        spark.createDataFrame(rows, shape).write.parquet(f"{folder}/{name}.parquet")
    return Views(spark, folder)


def test_an_answer_counts_the_unfinished_rows_of_its_run(spark):
    start = dt.datetime(1995, 1, 1)
    orders = [(run, 1, start, "1-URGENT") for run in (4, 8, 12, 68)]
    # 7 + 1 and 6 + 2 give waiting rows, 20 a failed one
    lines = [(4, 1, 7, 0, 1.0), (4, 2, 6, 0, 1.0), (8, 1, 19, 0, 1.0), (12, 1, 19, 0, 1.0), (68, 1, 7, 0, 1.0)]
    v = views(spark, orders=(orders, ORDERS), lineitem=(lines, LINES))
    assert {r.run_id: r.unfinished for r in v.audit_answers.collect()} == {4: 2, 8: 0, 12: 0, 68: 1}
    found = audit.unfounded_ends(v.audit_runs, v.audit_tasks, v.audit_answers).where("violation = 'answered early'")
    assert [r.run_id for r in found.collect()] == [4]  # the last is stopped


def held(df):
    """How many rows each task of ``df`` gives."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]


def many(spark, runs=400):
    orders = [(run, run, dt.datetime(1995, 1 + run % 12, 1), "1-URGENT") for run in range(runs)]
    lines = [(run, n, 7 * run + n, n, 1.0) for run in range(runs) for n in range(1, 4)]
    return views(spark, orders=(orders, ORDERS), lineitem=(lines, LINES))


def test_a_task_gets_no_more_rows_of_a_larger_table(spark, monkeypatch):
    monkeypatch.setattr(suite_views, "TASK_ROWS", 50)
    tasks = held(many(spark).tasks_all)
    assert sum(tasks) == 1200 and max(tasks) < 150


def test_the_log_lies_in_as_many_files_as_tasks_wrote(spark, monkeypatch):
    monkeypatch.setattr(suite_views, "TASK_ROWS", 50)
    monkeypatch.setattr(jobs, "read_parquet_stream", lambda spark, folder, schema, name=None, files_per_batch=None: (folder, files_per_batch))
    v = many(spark)
    folder, taken = streams.log_stream(v)
    files = spark.read.parquet(folder)
    assert files.count() == v.row_log.count()
    assert len(files.inputFiles()) > 12 and taken < len(files.inputFiles()) <= 2 * taken
