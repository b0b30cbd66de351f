"""Processors that keep a value for each key and act when event time passes a moment, and what is held of runs between batches.

The clock of a job is the greatest time it has met. Rows older than the clock are not dropped: the column the watermark is
taken from ends before the state, so only timers follow it. Rows of one key are reduced before they are shuffled.
"""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowgauge.functions import vocab
from flowgauge.session import ship_package

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOCK = "clock"


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """The state store that timers need, for queries started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def ticking(rows: DataFrame, at: Column, until: Column | None = None) -> DataFrame:
    """``rows`` of a stream whose event time is the greatest ``at``; a row without one, or after ``until``, moves nothing."""
    sound = at.isNotNull() if until is None else at.isNotNull() & (at <= until)
    clock = F.when(sound, at.cast("timestamp")).otherwise(F.timestamp_seconds(F.lit(0)))
    return rows.withColumn(CLOCK, clock).withWatermark(CLOCK, "0 seconds").drop(CLOCK)


def reduced(rows: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row of each batch of a task for each ``keys``: the one that is greatest in ``newest``.

    It has no state and no shuffle, so a key with a large share of all rows leaves every task as a few rows.
    """
    shape = rows.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            table = pa.Table.from_batches([batch])
            order = table.sort_by([(name, "descending") for name in newest]) if newest else table
            firsts = order.append_column("_row", pa.array(range(order.num_rows), pa.int64())).group_by(keys).aggregate([("_row", "min")])
            yield from order.take(firsts["_row_min"]).to_batches()

    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, shape)


class Overdue(StatefulProcessor):
    """An open partition for each key, with a timer at its limit. A fact closes it; a timer that fires gives an alert."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._due = handle.getValueState("due", T.StructType([T.StructField("due_at", T.LongType())]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        due = int(min(initialState["due_ms"]))
        self._due.update((due,))
        self._handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        if self._due.exists():
            self._handle.deleteTimer(self._due.get()[0])
            self._due.clear()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self._due.get()[0]
        self._due.clear()
        yield pd.DataFrame({"asset_name": [key[0]], "partition_key": [key[1]], "due_ms": [due]})

    def close(self) -> None:
        pass


def overdue(facts: DataFrame, expected: DataFrame, until: Column) -> DataFrame:
    """A stream of asset_name, partition_key, due_ms: partitions whose limit passed before a fact came for them."""
    keys = ["asset_name", "partition_key"]
    seen = reduced(facts.select(*keys, "event_time"), keys, ["event_time"])
    open_from = expected.groupBy(*keys).agg(F.min(F.unix_millis(F.col("due_at").cast("timestamp"))).alias("due_ms"))
    return ticking(seen, F.col("event_time"), until).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Overdue(), outputStructType="asset_name string, partition_key string, due_ms long",
        outputMode="append", timeMode="eventTime", initialState=open_from.groupBy(*keys))


#: The columns of a change log that a run's status is made of.
RUN_ROW = ("run_id", "task_no", "generation_after", "at", "seq", "new_status")


#: What is kept of a run: the newest image of each of its rows, beside the run's status, its version, the time it was first seen
#: at and the time from which its images go.
_HELD = ("run_id", "status", "version", "first_at", "until")


def _status(status: Column) -> Column:
    """The status of a run from those of its rows, as an aggregate."""
    return F.when(~F.bool_and(vocab.is_final(status)), "running").when(F.bool_or(status == "failed"), "failed").when(
        F.bool_or(status.isin(*vocab.STOPPED_KINDS)), "aborted").otherwise("success")


def held_schema(log: T.StructType) -> T.StructType:
    return T.StructType([*[log[name] for name in RUN_ROW], T.StructField("status", T.StringType()), T.StructField("version", T.LongType()),
                         T.StructField("first_at", T.TimestampNTZType()), T.StructField("until", T.TimestampNTZType())])


def next_statuses(held: DataFrame, batch: DataFrame, clock: dt.datetime | None, keep: dt.timedelta) -> tuple[DataFrame, DataFrame]:
    """What is held after a batch of log rows, a row for each task with ``changed`` runs marked, and the rows that came too late.

    ``clock`` is the greatest time of the batches before. Images of a run that ended ``keep`` before it are as good as gone, and
    a row that is older than that and whose run has no images is late.
    """
    key = ["run_id", "task_no"]
    now, kept = F.lit(clock).cast("timestamp_ntz"), F.lit(keep)
    order = F.struct("generation_after", "at", "seq", "new_status")
    live = held if clock is None else held.where(F.col("until").isNull() | (F.col("until") > now))
    newest = batch.groupBy(*key).agg(F.max(order).alias("image")).select(*key, "image.*")
    runs = live.select(*_HELD).distinct()
    judged = newest.join(runs.select("run_id", F.lit(True).alias("known")), "run_id", "left")
    old = F.lit(False) if clock is None else F.col("known").isNull() & F.coalesce(F.col("at") + kept <= now, F.lit(True))
    late = judged.where(old).select(*RUN_ROW)
    rows = judged.where(~old).select(*RUN_ROW, F.lit(True).alias("new")).unionByName(live.select(*RUN_ROW, F.lit(False).alias("new")))
    images = rows.groupBy(*key).agg(F.max(order).alias("image"), F.bool_or("new").alias("new"), F.min(F.when(F.col("new"), F.col("at"))).alias("seen_at"))
    images = images.select(*key, "image.*", "new", "seen_at")
    told = images.groupBy("run_id").agg(
        _status(F.col("new_status")).alias("is_now"), F.max("at").alias("last_at"), F.min("seen_at").alias("seen_at"),
        F.bool_or("new").alias("new")).join(runs, "run_id", "left")
    ends = F.col("last_at") + kept
    later = ends if clock is None else F.greatest(ends, now + F.expr("interval 1 millisecond"))
    states = told.select(
        "run_id", F.col("is_now").alias("status"), F.coalesce("first_at", "seen_at").alias("first_at"),
        (F.coalesce("version", F.lit(0)) + (~F.col("is_now").eqNullSafe(F.col("status"))).cast("long")).alias("version"),
        F.when(~F.col("new"), F.col("until")).when(F.col("is_now") != "running", later).alias("until"),
        (~F.col("is_now").eqNullSafe(F.col("status"))).alias("changed"))
    return images.drop("new", "seen_at").join(states, "run_id"), late
