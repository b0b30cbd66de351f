"""Waits, backoffs and lifetimes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowgauge.functions.calendar import millis

# Hours after which data is worth a warning or stale; seconds of each backoff; days a row lives.
WARNING_HOURS = 48
STALE_HOURS = 72
CHECK_BACKOFF_SECONDS = (600, 1200, 1800)
START_BACKOFF_SECONDS = (30, 60, 120, 300)
PUSH_RETRY_SECONDS = 300
PUSH_RETRY_MAX_SECONDS = 3600
RETRY_CAP_SECONDS = 3600
MAX_RETRIES = 9
LIFETIME_DAYS = {
    "history": 455, "output": 365, "input": 90, "timeline": 90, "warning": 8, "retry": 7,
    "backfill_running": 455, "backfill_ended": 90,
}
RESTART_DAYS = 365 - 90


def seconds(value: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), value.cast("decimal(18,6)"))


def days(value: int) -> Column:
    return F.make_dt_interval(F.lit(value))


def staleness(event_time: Column, now: Column) -> Column:
    """How old data is: a struct of ``status``, ``label`` and ``hours``; unknown without a time."""
    hours = (millis(now) - millis(event_time)) / F.lit(3600000.0)
    whole = F.floor(hours).cast("string")
    status = F.when(hours > STALE_HOURS, "stale").when(hours > WARNING_HOURS, "warning").otherwise("fresh")
    label = F.when(
        hours > STALE_HOURS, F.concat(F.lit("Stale ("), F.floor(hours / 24).cast("string"), F.lit("d ago)"))
    ).otherwise(F.concat(whole, F.lit("h ago")))
    return F.struct(
        F.when(event_time.isNull(), "unknown").otherwise(status).alias("status"),
        F.when(event_time.isNull(), "No data").otherwise(label).alias("label"),
        hours.alias("hours"),
    )


def retry_wait_seconds(delay: Column, attempt: Column, exponential: Column, cap: Column) -> Column:
    """Seconds before retry ``attempt`` (from 0): fixed, or doubling up to the cap."""
    doubled = delay.cast("bigint") * F.pow(F.lit(2), attempt).cast("bigint")
    return F.when(exponential, F.least(doubled, F.coalesce(cap, F.lit(RETRY_CAP_SECONDS)))).otherwise(delay)


def _nth(values, position: Column) -> Column:
    table = F.array(*[F.lit(v) for v in values])
    return F.element_at(table, F.greatest(F.lit(1), F.least(position, F.lit(len(values)))).cast("int"))


def check_backoff_seconds(checks: Column) -> Column:
    return _nth(CHECK_BACKOFF_SECONDS, checks + 1)


def start_backoff_seconds(failures: Column) -> Column:
    return _nth(START_BACKOFF_SECONDS, failures)


def push_retry_seconds(attempts: Column) -> Column:
    doubled = F.lit(PUSH_RETRY_SECONDS) * F.pow(F.lit(2), F.least(F.greatest(attempts, F.lit(0)), F.lit(10)))
    return F.least(doubled.cast("bigint"), F.lit(PUSH_RETRY_MAX_SECONDS))


def lives_until(written_at: Column, kind: str) -> Column:
    return written_at + days(LIFETIME_DAYS[kind])


def restart_allowed(started_at: Column, now: Column) -> Column:
    return now < started_at + days(RESTART_DAYS)
