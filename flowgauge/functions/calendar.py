"""The partition calendar as Column expressions: hourly, daily, weekly and monthly keys in UTC.

Moments are ``timestamp_ntz`` holding UTC; sessions run with ``spark.sql.session.timeZone=UTC``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

GRANULARITIES = ("hourly", "daily", "weekly", "monthly")
_COARSENESS = {name: rank for rank, name in enumerate(GRANULARITIES)}

# The shapes of the four key formats.
_HOUR_SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}"
_DAY_SHAPE = r"^\d{4}-\d{2}-\d{2}$"
_WEEK_SHAPE = r"^\d{4}-W\d{2}$"
_MONTH_SHAPE = r"^\d{4}-\d{2}$"


def ntz(value: Column) -> Column:
    return value.cast("timestamp_ntz")


def by_granularity(granularity: Column, make) -> Column:
    """``make(name)`` for the granularity a row carries; null for any other name."""
    chosen = F.when(granularity == GRANULARITIES[0], make(GRANULARITIES[0]))
    for name in GRANULARITIES[1:]:
        chosen = chosen.when(granularity == name, make(name))
    return chosen


def _day(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def _week_monday(key: Column) -> Column:
    """Monday of an ISO week key; null when the year has no such week."""
    year = F.substring(key, 1, 4).try_cast("int")
    week = F.substring(key, 7, 2).try_cast("int")
    fourth = _day(F.concat(F.substring(key, 1, 4), F.lit("-01-04")))
    monday = F.date_add(F.trunc(fourth, "WEEK"), (week - 1) * 7)
    # Thursday decides the ISO year a week belongs to.
    return F.when((week >= 1) & (year >= 1) & (F.year(F.date_add(monday, 3)) == year), monday)


def _start_as(key: Column, granularity: str) -> Column:
    """Start of the partition when ``key`` is a valid key of ``granularity``, else null."""
    if granularity == "hourly":
        hour = F.substring(key, 12, 2).try_cast("int")
        day = _day(F.substring(key, 1, 10))
        start = ntz(day) + F.make_interval(hours=hour)
        return F.when(key.rlike(_HOUR_SHAPE) & hour.between(0, 23), start)
    if granularity == "daily":
        return F.when(key.rlike(_DAY_SHAPE), ntz(_day(key)))
    if granularity == "weekly":
        return F.when(key.rlike(_WEEK_SHAPE), ntz(_week_monday(key)))
    return F.when(key.rlike(_MONTH_SHAPE), ntz(_day(F.concat(key, F.lit("-01")))))


def format_name(key: Column) -> Column:
    return (
        F.when(key.contains("T"), "hourly")
        .when(key.rlike(_WEEK_SHAPE), "weekly")
        .when(key.rlike(_MONTH_SHAPE), "monthly")
        .when(key.rlike(_DAY_SHAPE), "daily")
    )


def key_start_as(key: Column, granularity: Column) -> Column:
    return by_granularity(granularity, lambda name: _start_as(key, name))


def is_valid_key(key: Column, granularity: Column) -> Column:
    return F.coalesce(key_start_as(key, granularity).isNotNull(), F.lit(False))


def partition_start(key: Column) -> Column:
    """UTC start of the partition ``key`` names, whatever its format; null for anything that is no key."""
    return F.coalesce(*[_start_as(key, name) for name in GRANULARITIES])


def detect_granularity(key: Column) -> Column:
    return F.when(partition_start(key).isNotNull(), format_name(key))


def partition_date(key: Column) -> Column:
    return partition_start(key).cast("date")


_TRUNC = {"hourly": "HOUR", "daily": "DAY", "weekly": "WEEK", "monthly": "MONTH"}


def floor_as(moment: Column, granularity: str) -> Column:
    return ntz(F.date_trunc(_TRUNC[granularity], moment))


def floor_to_bucket(moment: Column, granularity: Column) -> Column:
    return by_granularity(granularity, lambda name: floor_as(moment, name))


def _step(granularity: str) -> Column:
    return {
        "hourly": F.expr("make_dt_interval(0, 1)"),
        "daily": F.expr("make_dt_interval(1)"),
        "weekly": F.expr("make_dt_interval(7)"),
        "monthly": F.expr("make_ym_interval(0, 1)"),
    }[granularity]


def advance_as(moment: Column, granularity: str) -> Column:
    return moment + _step(granularity)


def advance(moment: Column, granularity: Column) -> Column:
    return by_granularity(granularity, lambda name: advance_as(moment, name))


def format_as(moment: Column, granularity: str) -> Column:
    if granularity == "hourly":
        return F.date_format(moment, "yyyy-MM-dd'T'HH")
    if granularity == "daily":
        return F.date_format(moment, "yyyy-MM-dd")
    if granularity == "weekly":
        iso_year = F.extract(F.lit("YEAROFWEEK"), moment)
        return F.concat(
            F.lpad(iso_year.cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(moment).cast("string"), 2, "0")
        )
    return F.date_format(moment, "yyyy-MM")


def format_key(moment: Column, granularity: Column) -> Column:
    return by_granularity(granularity, lambda name: format_as(moment, name))


def _covering_between(start: Column, end: Column, granularity: str) -> Column:
    first = floor_as(start, granularity)
    last = end - F.expr("interval 1 microsecond")
    return F.transform(F.sequence(first, last, _step(granularity)), lambda moment: format_as(moment, granularity))


def covering_keys(key: Column, granularity: Column, upstream_granularity: Column) -> Column:
    """Every upstream key whose window meets the window of ``key``; never empty for a valid key."""
    start = key_start_as(key, granularity)
    end = advance(start, granularity)
    keys = by_granularity(upstream_granularity, lambda name: _covering_between(start, end, name))
    return F.when(granularity == upstream_granularity, F.array(key)).otherwise(keys)


def day_keys(day: Column) -> Column:
    """A daily key with the 24 hours it holds, its ISO week and its month; any other text is only itself."""
    start = _start_as(day, "daily")
    end = advance_as(start, "daily")
    all_keys = F.concat(*[_covering_between(start, end, name) for name in GRANULARITIES])
    return F.when(start.isNotNull(), all_keys).otherwise(F.array(day))


def oldest_useful_date(target: Column) -> Column:
    """First day of the month before the target's."""
    return F.add_months(F.trunc(target, "MM"), -1)


def in_current_or_previous_period(fact: Column, target: Column, granularity: Column) -> Column:
    """Whether ``fact`` lies in the target's ISO week (or month) or in the one before."""
    weeks = F.datediff(F.trunc(target, "WEEK"), F.trunc(fact, "WEEK"))
    months = (F.year(target) * 12 + F.month(target)) - (F.year(fact) * 12 + F.month(fact))
    return F.when(granularity == "weekly", weeks.isin(0, 7)).when(granularity == "monthly", months.isin(0, 1))


def serves(fact: Column, target: Column, granularity: Column) -> Column:
    """Whether a fact of one partition date satisfies a plain condition on ``target``."""
    return F.when(granularity.isin("hourly", "daily"), fact == target).otherwise(
        (fact <= target) & in_current_or_previous_period(fact, target, granularity)
    )


def last_served_date(fact: Column, granularity: Column) -> Column:
    """The last target date a fact serves: its own day, or the end of the period after its own."""
    return (
        F.when(granularity.isin("hourly", "daily"), fact)
        .when(granularity == "weekly", F.date_add(F.trunc(fact, "WEEK"), 13))
        .when(granularity == "monthly", F.date_sub(F.add_months(F.trunc(fact, "MM"), 2), 1))
    )


def coarser_or_equal(fine: str, coarse: str) -> bool:
    return _COARSENESS[coarse] >= _COARSENESS[fine]


# The names a date row carries, each with its rendering.
_DATE_FORMS = {
    "date_iso": "yyyy-MM-dd", "date_compact": "yyyyMMdd", "date_slash": "yyyy/MM/dd", "date_underscore": "yyyy_MM_dd",
    "year": "yyyy", "month": "MM", "day": "dd",
}
_DATE_SHIFTS = {"previous_date": -1, "next_date": 1, "minus_7_days": -7, "minus_14_days": -14, "minus_30_days": -30}


def date_dimension(key: Column) -> dict[str, Column]:
    """The date columns of a run, read from the first day of the partition its key names."""
    day = partition_date(key)
    columns = {name: F.date_format(day, form) for name, form in _DATE_FORMS.items()}
    columns["day_of_week"] = F.lower(F.date_format(day, "EEEE"))
    for name, days in _DATE_SHIFTS.items():
        columns[name] = F.date_format(F.date_add(day, days), "yyyy-MM-dd")
    for name in ("minus_7_days", "minus_30_days"):
        columns[f"{name}_compact"] = F.replace(columns[name], F.lit("-"), F.lit(""))
    columns["partition_key"] = key
    return columns


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two UTC moments; null when either is missing."""
    return F.floor((_micros(end) - _micros(start)) / 1000).cast("long")


def _micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def millis(moment: Column) -> Column:
    """Epoch milliseconds of a UTC moment."""
    return F.unix_millis(moment.cast("timestamp"))


def from_millis(value: Column) -> Column:
    return ntz(F.timestamp_millis(value))
