"""As-of look-ups of facts: period-aware, by freshness, by consecutive days and as of a moment.

Every look-up starts from *day facts*, one row per asset, date and granularity. The grouping has a partial step
before its shuffle, so however many facts a hot asset has, what is joined below is at most its calendar. A fact is
then spread over the dates it can serve (at most two months) and joined on (asset, date): no range join is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowgauge.functions import calendar as cal
from flowgauge.operators import slices
from flowgauge.session import cut_lineage

_DAY_KEY = ["asset_name", "partition_date", "granularity"]
#: Days from the year 1 to the end of the year 9999 are numbers of so many binary digits.
_DATE_BITS = 22


def day_facts(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*_DAY_KEY).agg(F.min("event_time").alias("first_at"), F.max("event_time").alias("last_at"))


def _useful_until(day: Column) -> Column:
    """The last target whose look-back (to the first of its previous month) still reaches ``day``."""
    return F.date_sub(F.add_months(F.trunc(day, "MM"), 2), 1)


def served_dates(days: DataFrame) -> DataFrame:
    """Every target date a day's facts are looked at for, and whether they serve it."""
    seen = days.withColumn("target_date", F.explode(
        F.sequence("partition_date", _useful_until(F.col("partition_date")))))
    return seen.withColumn("serves", cal.serves(F.col("partition_date"), F.col("target_date"), F.col("granularity")))


def latest(targets: DataFrame, facts: DataFrame) -> DataFrame:
    """Plain condition: the newest-dated fact that serves the target; ties within a date go to the newest event."""
    best = served_dates(day_facts(facts)).groupBy("asset_name", "target_date").agg(
        F.max(F.when(F.col("serves"), F.struct("partition_date", "last_at"))).alias("best"))
    joined = targets.join(best.withColumn("seen", F.lit(True)), ["asset_name", "target_date"], "left")
    return joined.select(
        *targets.columns, F.col("best").isNotNull().alias("ready"),
        F.when(F.col("best").isNotNull(), "ok").when(F.col("seen"), "stale").otherwise("no_fact").alias("reason"),
        F.col("best.partition_date").alias("partition_date"), F.col("best.last_at").alias("event_time"))


def _hours(hours: Column) -> Column:
    """So many hours, parts of one included."""
    return F.make_dt_interval(secs=(hours.cast("double") * 3600).cast("decimal(18,6)"))


def within(targets: DataFrame, facts: DataFrame) -> DataFrame:
    """Freshness: the newest event of the latest date up to the target, at most ``hours`` old at ``now``.

    Targets carry ``now`` and ``hours``. Days and targets are merged on one calendar line per asset and each target
    takes the last day before it: the line holds at most a row per date and target.
    """
    days = facts.groupBy("asset_name", "partition_date").agg(F.max("event_time").alias("last_at"))
    dates = targets.select("asset_name", "target_date").distinct()
    line = days.select("asset_name", F.col("partition_date").alias("on"), F.lit(0).alias("probe"),
                       F.struct("partition_date", "last_at").alias("day")).unionByName(
        dates.select("asset_name", F.col("target_date").alias("on"), F.lit(1).alias("probe")), allowMissingColumns=True)
    order = Window.partitionBy("asset_name").orderBy("on", "probe").rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("day", F.last("day", ignorenulls=True).over(order)).where("probe = 1").select(
        "asset_name", F.col("on").alias("target_date"), "day")
    joined = targets.join(found, ["asset_name", "target_date"], "left")
    newest = F.col("day.last_at")
    fresh = F.coalesce(newest >= F.col("now") - _hours(F.col("hours")), F.lit(False))
    return joined.select(
        *targets.columns, fresh.alias("ready"),
        F.when(newest.isNull(), "no_fact").when(fresh, "ok").otherwise("stale").alias("reason"),
        F.col("day.partition_date").alias("partition_date"), newest.alias("event_time"))


def consecutive(targets: DataFrame, facts: DataFrame) -> DataFrame:
    """Coverage: every one of the ``days`` dates ending at the target has a fact; else the dates that lack one."""
    present = facts.select("asset_name", F.col("partition_date").alias("need"), F.lit(True).alias("present")).distinct()
    asked = targets.select("asset_name", "target_date", "days").distinct()
    needs = asked.withColumn("need", F.explode(F.expr("sequence(date_sub(target_date, days - 1), target_date)")))
    missing = needs.join(present, ["asset_name", "need"], "left").groupBy("asset_name", "target_date", "days").agg(
        F.sort_array(F.collect_list(F.when(F.col("present").isNull(), F.col("need")))).alias("missing_dates"))
    joined = targets.join(missing, ["asset_name", "target_date", "days"])
    ready = F.size("missing_dates") == 0
    return joined.select(
        *targets.columns, ready.alias("ready"), F.when(ready, "ok").otherwise("missing_dates").alias("reason"),
        "missing_dates")


def last_event_before(probes: DataFrame, events: DataFrame, keys: list[str], moment: str, out: str) -> DataFrame:
    """The newest event of the same keys at or before each probe's moment, or null."""
    return slices.greatest_before(probes, events.withColumn("newest", F.col("event_time")), keys, moment, "newest", out)


def latest_as_of(probes: DataFrame, facts: DataFrame) -> DataFrame:
    """Plain condition counting only facts recorded by ``cutoff``: the date that serves and its newest event by then."""
    served = served_dates(day_facts(facts)).where("serves").select(
        "asset_name", "target_date", "partition_date", "granularity", "first_at")
    dated = probes.join(served, ["asset_name", "target_date"]).where("first_at <= cutoff").groupBy(
        "asset_name", "target_date", "cutoff").agg(F.max("partition_date").alias("partition_date"))
    events = facts.select("asset_name", "partition_date", "event_time")
    found = last_event_before(dated, events, ["asset_name", "partition_date"], "cutoff", "event_time")
    joined = probes.join(found, ["asset_name", "target_date", "cutoff"], "left")
    return joined.withColumn("ready", F.col("partition_date").isNotNull())


def latest_ready_as_of(probes: DataFrame, facts: DataFrame) -> DataFrame:
    """As :func:`latest_as_of` where only the verdict matters: one first time per served date decides it."""
    first = served_dates(day_facts(facts)).where("serves").groupBy("asset_name", "target_date").agg(
        F.min("first_at").alias("ready_from"))
    joined = probes.join(first, ["asset_name", "target_date"], "left")
    return joined.withColumn("ready", F.coalesce(F.col("ready_from") <= F.col("cutoff"), F.lit(False))).drop("ready_from")


def consecutive_ready_as_of(probes: DataFrame, facts: DataFrame) -> DataFrame:
    """Coverage as of ``cutoff``: the day by which the last of the ``days`` dates had its first fact."""
    first = facts.groupBy("asset_name", F.col("partition_date").alias("need")).agg(F.min("event_time").alias("first_at"))
    asked = probes.select("asset_name", "target_date", "days").distinct()
    needs = asked.withColumn("need", F.explode(F.expr("sequence(date_sub(target_date, days - 1), target_date)")))
    covered = needs.join(first, ["asset_name", "need"], "left").groupBy("asset_name", "target_date", "days").agg(
        F.count("first_at").alias("present"), F.max("first_at").alias("ready_from"))
    joined = probes.join(covered, ["asset_name", "target_date", "days"], "left")
    ready = (F.col("present") == F.col("days")) & (F.col("ready_from") <= F.col("cutoff"))
    return joined.withColumn("ready", F.coalesce(ready, F.lit(False))).drop("present", "ready_from")


def newest_known_date(moments: DataFrame, facts: DataFrame) -> DataFrame:
    """``moments`` (``asset_name``, ``target_date``, ``cutoff``) with the latest date up to the target that had a fact by the
    cutoff, or null.

    A scan by time finds the latest date known by the cutoff. Where that lies after the target there are two conditions, on
    date and time: dates are counted in blocks of 1, 2, 4 … days, all dates up to a target are at most one block of each
    size, and the same scan runs inside the blocks.
    """
    firsts = cut_lineage(facts.groupBy("asset_name", "partition_date").agg(F.min("event_time").alias("event_time")))
    probe = ["asset_name", "target_date", "cutoff"]
    simple = cut_lineage(slices.greatest_before(moments.select(*probe), firsts, ["asset_name"], "cutoff", "partition_date", "known"))
    late = F.coalesce(F.col("known") > F.col("target_date"), F.lit(False))
    answered, rest = simple.where(~late).withColumnRenamed("known", "partition_date"), simple.where(late).select(*probe)
    if rest.isEmpty():
        return moments.join(answered, probe, "left")
    number, sizes = "datediff({}, date'0001-01-01')", f"sequence(0, {_DATE_BITS - 1})"
    blocks = firsts.join(rest.select("asset_name").distinct(), "asset_name", "left_semi").select(
        "asset_name", "partition_date", "event_time", F.expr(
            f"inline(transform({sizes}, s -> struct(s AS size, shiftright({number.format('partition_date')}, s) AS block)))"))
    until = f"({number.format('target_date')} + 1)"
    covering = rest.select(*probe, F.expr(
        f"inline(transform(filter({sizes}, s -> shiftright({until}, s) & 1 = 1),"
        f" s -> struct(s AS size, shiftright({until}, s) - 1 AS block)))"))
    found = slices.greatest_before(covering, blocks, ["asset_name", "size", "block"], "cutoff", "partition_date", "known")
    best = found.groupBy(*probe).agg(F.max("known").alias("partition_date"))
    return moments.join(answered.unionByName(best), probe, "left")


def within_as_of(probes: DataFrame, facts: DataFrame) -> DataFrame:
    """Freshness as of ``cutoff``, which is also ``now``: the latest date known by then, and its newest event by then."""
    dated = newest_known_date(probes.select("asset_name", "target_date", "cutoff").distinct(), facts)
    events = facts.select("asset_name", "partition_date", "event_time")
    found = last_event_before(
        dated.where("partition_date IS NOT NULL"), events, ["asset_name", "partition_date"], "cutoff", "event_time")
    joined = probes.join(found, ["asset_name", "target_date", "cutoff"], "left")
    fresh = F.col("event_time") >= F.col("cutoff") - _hours(F.col("hours"))
    return joined.withColumn("ready", F.coalesce(fresh, F.lit(False)))


def stretches(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The events of each date as stretches in which every event comes at most ``hours`` after the one before.

    ``wanted`` has the hours that are asked for each asset. Events are first grouped by the bucket of that width they lie in,
    so a hot date shrinks before its buckets are put in order.
    """
    width = F.greatest(((F.col("hours") * 3600).cast("decimal(18,6)") * 1_000_000).cast("long"), F.lit(1))
    micros = F.unix_micros(F.col("event_time").cast("timestamp"))
    asked = cut_lineage(wanted.select("asset_name", F.col("hours").cast("double").alias("hours")).distinct())
    timed = facts.where("event_time IS NOT NULL").join(asked, "asset_name")
    key = ["asset_name", "partition_date", "hours"]
    buckets = timed.groupBy(*key, (micros - F.pmod(micros, width)).alias("bucket")).agg(
        F.min("event_time").alias("first"), F.max("event_time").alias("last"))
    order = Window.partitionBy(*key).orderBy("bucket")
    opens = F.coalesce(F.lag("last").over(order) < F.col("first") - _hours(F.col("hours")), F.lit(False))
    return buckets.withColumn("opens", opens).withColumn("stretch", F.count_if("opens").over(order)).groupBy(*key, "stretch").agg(
        F.min("first").alias("first"), F.max("last").alias("last")).drop("stretch")


def within_ready_as_of(probes: DataFrame, firsts: DataFrame, known: DataFrame) -> DataFrame:
    """As :func:`within_as_of` where only the verdict matters: ``firsts`` are the first facts of each date, and the moments from
    the first event of a stretch (``known``) to so many hours after its last are those with an event recent enough."""
    probe = ["asset_name", "target_date", "cutoff"]
    dated = newest_known_date(probes.select(*probe).distinct(), firsts)
    asked = probes.select(*probe, "hours").distinct().join(dated.where("partition_date IS NOT NULL"), probe)
    begun = known.select("asset_name", "partition_date", "hours", F.col("first").alias("event_time"), "last")
    found = slices.greatest_before(asked, begun, ["asset_name", "partition_date", "hours"], "cutoff", "last", "last")
    joined = probes.join(found, [*probe, "hours"], "left")
    fresh = F.col("last") >= F.col("cutoff") - _hours(F.col("hours"))
    return joined.withColumn("ready", F.coalesce(fresh, F.lit(False)))


def fact_spans(facts: DataFrame) -> DataFrame:
    """Islands and gaps of each asset: runs of consecutive dates present, and the runs missing between them."""
    days = facts.select("asset_name", "partition_date").distinct()
    order = Window.partitionBy("asset_name").orderBy("partition_date")
    island = F.date_sub("partition_date", F.row_number().over(order))
    spans = days.withColumn("island", island).groupBy("asset_name", "island").agg(
        F.min("partition_date").alias("first"), F.max("partition_date").alias("last"))
    ordered = Window.partitionBy("asset_name").orderBy("first")
    following = spans.withColumn("next", F.lead("first").over(ordered))
    present = following.select("asset_name", F.lit("present").alias("kind"), "first", "last")
    gaps = following.where("next IS NOT NULL").select(
        "asset_name", F.lit("missing").alias("kind"), F.date_add("last", 1).alias("first"), F.date_sub("next", 1).alias("last"))
    return present.unionByName(gaps).withColumn("days", F.datediff("last", "first") + 1)
