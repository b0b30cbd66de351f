import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowgauge.functions import calendar as cal, schedules


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "k string").select(make(F.col("k")).alias("r")).first()[0]


@pytest.mark.parametrize("key, expected", [
    ("2024-01-15T14", dt.datetime(2024, 1, 15, 14)), ("2024-01-15T14:30Z", dt.datetime(2024, 1, 15, 14)),
    ("2024-01-15", dt.datetime(2024, 1, 15)), ("2024-W03", dt.datetime(2024, 1, 15)),
    ("2020-W53", dt.datetime(2020, 12, 28)), ("2025-W01", dt.datetime(2024, 12, 30)), ("2024-02", dt.datetime(2024, 2, 1)),
    ("2024-02-31", None), ("2024-W53", None), ("2024-W00", None), ("2024-13", None), ("2024-01-15T24", None),
    ("latest", None), ("", None), ("2024-1-5", None),
])
def test_partition_start(spark, key, expected):
    assert one(spark, key, cal.partition_start) == expected


@pytest.mark.parametrize("moment, expected", [
    ("2024-12-30", "2025-W01"), ("2021-01-03", "2020-W53"), ("2024-01-01", "2024-W01"),
])
def test_weekly_key_uses_iso_year(spark, moment, expected):
    assert one(spark, moment, lambda k: cal.format_as(k.cast("timestamp_ntz"), "weekly")) == expected


@pytest.mark.parametrize("key, own, upstream, expected", [
    ("2024-01-15", "daily", "daily", ["2024-01-15"]),
    ("2024-W05", "weekly", "monthly", ["2024-01", "2024-02"]),
    ("2024-01-15T07", "hourly", "daily", ["2024-01-15"]),
    ("2024-02", "monthly", "weekly", ["2024-W05", "2024-W06", "2024-W07", "2024-W08", "2024-W09"]),
])
def test_covering_keys(spark, key, own, upstream, expected):
    assert one(spark, key, lambda k: cal.covering_keys(k, F.lit(own), F.lit(upstream))) == expected


def test_a_day_has_24_hours(spark):
    assert len(one(spark, "2024-03-31", lambda k: cal.covering_keys(k, F.lit("daily"), F.lit("hourly")))) == 24
    assert len(one(spark, "2024-03-31", cal.day_keys)) == 27
    assert one(spark, "2024-02-31", cal.day_keys) == ["2024-02-31"]


@pytest.mark.parametrize("text, expected", [
    (None, "daily"), ("  ", "daily"), ("@midnight", "daily"), ("rate(5 minutes)", "hourly"), ("rate(2 hours)", None),
    ("rate(7 days)", "weekly"), ("cron(0 9 ? * MON *)", "weekly"), ("0 9 * * MON-FRI", None), ("0 */6 * * *", None),
    ("0 */1 * * *", "hourly"), ("0 0 1 1 *", None), ("0 0 L * *", None), ("0 0 1 * ? 2024", None), ("0 0 1,15 * *", None),
    ("cron(0 0 1 * ? *)", "monthly"), ("nonsense", None),
])
def test_cron_cadence(spark, text, expected):
    assert one(spark, text, schedules.cron_cadence) == expected
