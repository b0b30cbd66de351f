"""Ordered work inside keys that may be hot: slices of about equally many rows, with what a slice inherits carried over.

Spark's range partitioner samples the rows and cuts them where as many lie on either side, whatever the keys: a key with a
third of all rows, or with a million rows in one minute, fills many slices, and small keys share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowgauge.session import cut_lineage


def sliced(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``slice``: numbers that ascend with ``keys`` and ``order``. The cut is kept, so all readers see the same
    slices even if an executor is lost."""
    ranged = rows.repartitionByRange(*[F.col(k) for k in keys], *order)
    return cut_lineage(ranged.withColumn("slice", F.spark_partition_id()))


def earlier(keys: list[str]):
    """The window over the slices of a key that come before each of them, for rows with a key and a slice."""
    return Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """``rows`` with their position from 1 among those of the same ``keys``, by ``order``."""
    cut = sliced(rows, keys, order)
    local = cut.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "slice").orderBy(*order)))
    counts = cut.groupBy(*keys, "slice").agg(F.count("*").alias("held"))
    before = counts.select(*keys, "slice", F.coalesce(F.sum("held").over(earlier(keys)), F.lit(0)).alias("before"))
    joined = local.join(before, [*keys, "slice"])
    return joined.withColumn(out, (F.col(out) + F.col("before")).cast("int")).drop("slice", "before")


def greatest_before(probes: DataFrame, events: DataFrame, keys: list[str], moment: str, value: str, out: str) -> DataFrame:
    """``probes`` with the greatest ``value`` among the ``events`` of the same keys at or before each probe's moment, or null.

    ``events`` have ``event_time``. Both are ordered in one line, where an event stands before the probes of its moment.
    """
    ident = probes.select(*keys, moment).distinct()
    line = events.groupBy(*keys, F.col("event_time").alias("on")).agg(F.max(value).alias("held")).withColumn("probe", F.lit(0))
    line = line.unionByName(ident.select(*keys, F.col(moment).alias("on"), F.lit(1).alias("probe")), allowMissingColumns=True)
    order = [F.col("on"), F.col("probe")]
    cut = sliced(line, keys, order)
    inside = Window.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("seen", F.max("held").over(inside)).where("probe = 1")
    tops = cut.groupBy(*keys, "slice").agg(F.max("held").alias("top"))
    carried = tops.select(*keys, "slice", F.max("top").over(earlier(keys)).alias("carried"))
    found = local.join(carried, [*keys, "slice"]).select(
        *keys, F.col("on").alias(moment), F.greatest("seen", "carried").alias(out))
    return probes.join(found, [*keys, moment], "left")
