"""What push evaluation needs of all facts so far, kept so that a batch reads what it is about and not the whole past."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowgauge.streaming.tables import DayTable

_FACT = T.StructType([
    T.StructField("asset_name", T.StringType()), T.StructField("partition_date", T.DateType()),
    T.StructField("granularity", T.StringType()), T.StructField("event_time", T.TimestampNTZType()),
])
_EVENT = T.StructType([*_FACT.fields, T.StructField("cascade", T.StringType()), T.StructField("source_dag", T.StringType())])


def _first(rows: DataFrame) -> DataFrame:
    return rows.groupBy("asset_name", "partition_date", "granularity").agg(F.min("event_time").alias("event_time"))


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.distinct()


class Reach:
    """How far back the conditions of a node table look: hours of events, and dates in a row."""

    def __init__(self, nodes: DataFrame):
        found = nodes.agg(F.max("freshness_hours").alias("hours"), F.max("consecutive_days").alias("days")).first()
        self.hours, self.days = float(found["hours"] or 0), int(found["days"] or 1)


class FactIndex:
    """First times by asset and date, in folders by date, and events, in folders by the day they were recorded.

    Whether a condition holds for a date as of a moment depends on the first time of each date it may look at, and, for
    freshness alone, on the events of so many hours before the moment. A date that an event of these hours is for is
    the oldest that can be the newest known one of a fresh asset, so first times are read from there on.
    """

    #: What it reads of facts.
    columns = _EVENT.names

    def __init__(self, spark: SparkSession, path: str):
        self.firsts = DayTable(spark, f"{path}/firsts", _FACT, "partition_date", _first)
        self.events = DayTable(spark, f"{path}/events", _EVENT, "event_time", _distinct)

    def add(self, facts: DataFrame, batch_id: int) -> None:
        self.firsts.add(_first(facts), batch_id)
        self.events.add(facts.select(*_EVENT.names).distinct(), batch_id)

    def recorded(self, since: dt.datetime, until: dt.datetime) -> DataFrame:
        """The facts recorded from ``since`` to ``until``."""
        return self.events.merge(self._between(since, until))

    def _between(self, since: dt.datetime, until: dt.datetime) -> DataFrame:
        """As ``recorded``, where a fact may come more than once."""
        return self.events.read(since, until).where(
            F.col("event_time").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")))

    def known(self, facts: DataFrame, reach: Reach) -> DataFrame:
        """All that counts when the schedules of consumers of ``facts`` are judged as of their times; some of it repeated."""
        span = facts.agg(
            F.min("event_time").alias("since"), F.max("event_time").alias("until"),
            F.min("partition_date").alias("first"), F.max("partition_date").alias("last")).first()
        if span["first"] is None or span["since"] is None:
            return self.firsts.read().limit(0)
        oldest = min((span["first"].replace(day=1) - dt.timedelta(days=1)).replace(day=1),
                     span["first"] - dt.timedelta(days=reach.days - 1))
        if not reach.hours:
            return self.firsts.read(oldest, span["last"])
        events = self._between(span["since"] - dt.timedelta(hours=reach.hours), span["until"]).select(*_FACT.names)
        touched = events.agg(F.min("partition_date")).first()[0]
        return self.firsts.read(min(oldest, touched or oldest), span["last"]).unionByName(events)

    def compact(self, facts: DataFrame) -> None:
        """Merge what crowds the days that ``facts`` were added to."""
        span = facts.agg(
            F.min("event_time").alias("since"), F.max("event_time").alias("until"),
            F.min("partition_date").alias("first"), F.max("partition_date").alias("last")).first()
        if span["since"] is not None:
            self.events.compact(span["since"], span["until"])
        if span["first"] is not None:
            self.firsts.compact(span["first"], span["last"])
