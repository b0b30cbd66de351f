"""Asset facts: reading, normalising, merging, dating and building them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowgauge.functions import calendar as cal, vocab
from flowgauge.functions.schedules import strip
from flowgauge.operators import slices

FACT_TIME = "event_time"


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts that were stored by date: a date bound, or a join with a table of dates, reads the folders of those dates only."""
    return spark.read.parquet(path)


def write_facts(facts: DataFrame, path: str, mode: str = "append") -> None:
    """Store facts in a folder for each date, with an asset's facts side by side.

    Facts of a date and asset go to one file, and a hot asset's to several of like size; in a file they stand by asset and
    time, so that a reader of one asset skips the row groups of others.
    """
    dealt = facts.hint("rebalance", F.col("partition_date"), F.col("asset_name"))
    dealt.sortWithinPartitions("partition_date", "asset_name", FACT_TIME).write.mode(mode).partitionBy("partition_date").parquet(path)


def facts_of_dates(facts: DataFrame, dates: DataFrame) -> DataFrame:
    """The stored facts of the ``dates`` (one column). Spark finds the folders to read from the dates when it runs."""
    wanted = dates.toDF("partition_date").where("partition_date IS NOT NULL").distinct()
    return facts.join(wanted, "partition_date", "left_semi").select(*facts.columns)


def scan_facts(facts: DataFrame, assets: list[str] | None = None, first=None, last=None) -> DataFrame:
    """Facts of the assets with ``first <= partition_date <= last``; a missing bound is open."""
    kept = facts
    if assets is not None:
        kept = kept.where(F.col("asset_name").isin(*assets))
    if first is not None:
        kept = kept.where(F.col("partition_date") >= F.lit(first).cast("date"))
    if last is not None:
        kept = kept.where(F.col("partition_date") <= F.lit(last).cast("date"))
    return kept


def _given(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", text)


def normalize_facts(raw: DataFrame) -> DataFrame:
    """Raw fact rows, old or new, with one key, date and granularity; ``readable`` is false where any is bad."""
    key = F.coalesce(_given(F.col("partition_key")), _given(F.col("execution_date")), F.lit(""))
    # One element, one lambda: the key is read once however often the calendar's branches name it.
    reading = F.transform(F.array(key), lambda k: F.struct(
        k.alias("key"), cal.partition_start(k).cast("date").alias("day"), cal.format_name(k).alias("shape")))
    keyed = raw.withColumn("_read", F.get(reading, F.lit(0)))
    written = _given(F.col("partition_date").cast("string"))
    strict = F.when(written.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(written, F.lit("yyyy-MM-dd")).cast("date"))
    day = F.when(written.isNotNull(), strict).otherwise(F.col("_read.day"))
    detected = F.when(F.col("_read.day").isNotNull(), F.col("_read.shape"))
    granularity = F.coalesce(_given(F.col("granularity")), detected)
    known = F.when(granularity.isin(*cal.GRANULARITIES), granularity)
    return keyed.withColumns({
        "partition_key": F.col("_read.key"), "partition_date": day, "granularity": known}).drop("_read").withColumn(
        "readable", F.col("partition_date").isNotNull() & F.col("granularity").isNotNull()
        & F.col("asset_name").isNotNull() & F.col(FACT_TIME).isNotNull())


def split_facts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable facts, and the unreadable ones reported once per (asset, time)."""
    normal = normalize_facts(raw)
    bad = normal.where(~F.col("readable")).select("asset_name", FACT_TIME).dropDuplicates()
    return normal.where("readable").drop("readable"), bad


def merge_facts(base: DataFrame, extra: DataFrame, first=None, last=None) -> DataFrame:
    """Indexed and recent reads as one set: one fact per (asset, date, time), the recent read winning."""
    columns = ["asset_name", "partition_date", FACT_TIME, "granularity"]
    both = base.select(*columns, F.lit(1).alias("rank")).unionByName(extra.select(*columns, F.lit(0).alias("rank")))
    bounded = scan_facts(both, None, first, last)
    return bounded.groupBy("asset_name", "partition_date", FACT_TIME).agg(
        F.min(F.struct("rank", "granularity"))["granularity"].alias("granularity"))


def assign_fact_times(facts: DataFrame, time_ms: str = "time_ms", source: str = "source",
                      slice_ms: int | None = None) -> DataFrame:
    """Give every fact of an asset its own millisecond: a collision moves to the next free one, in (time, source) order.

    The n-th fact gets ``n + max over the first n of (time - position)``. Positions and maxima are first taken inside
    slices, then carried over the slices of an asset, so no task ever sorts all facts of a hot asset. Slices hold about as
    many rows each, or ``slice_ms`` of time if that is given.
    """
    cut = slices.sliced(facts, ["asset_name"], [F.col(time_ms), F.col(source)]) if slice_ms is None else facts.withColumn(
        "slice", F.floor(F.col(time_ms) / slice_ms))
    ordered = Window.partitionBy("asset_name", "slice").orderBy(time_ms, source)
    local = cut.withColumn("nth", F.row_number().over(ordered).cast("long")).withColumn(
        "lead_ms", F.max(F.col(time_ms) - F.col("nth")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    tops = local.groupBy("asset_name", "slice").agg(F.count("*").alias("n"), F.max("lead_ms").alias("top"))
    before = slices.earlier(["asset_name"])
    offset = tops.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    carried = offset.withColumn("carried", F.max(F.col("top") - F.col("offset")).over(before))
    joined = local.join(carried.select("asset_name", "slice", "offset", "carried"), ["asset_name", "slice"])
    best = F.greatest(F.col("lead_ms") - F.col("offset"), F.col("carried"))
    return joined.withColumn("fact_ms", best + F.col("offset") + F.col("nth")).drop(
        "slice", "nth", "lead_ms", "offset", "carried")


def cascade_of(suppressed: Column, cascade_all: Column) -> Column:
    """The cascade of a run's facts; a suppressed run outranks one that cascades to all."""
    return F.when(suppressed, "none").when(cascade_all, "all").otherwise("auto")


def facts_of_success(tasks: DataFrame, outlets: DataFrame) -> DataFrame:
    """One fact per named outlet of each successful task, dated by its run's key.

    ``outlets`` is keyed by ``spec_task``; a fact whose name, key, granularity or cascade is bad is left out.
    """
    done = tasks.where(vocab.is_success(F.col("status")))
    joined = done.join(outlets.where(strip(F.coalesce("outlet", F.lit(""))) != ""), "spec_task")
    granularity = F.coalesce(_given(F.col("outlet_granularity")), cal.detect_granularity(F.col("run_key")))
    day = cal.partition_date(F.col("run_key"))
    return joined.select(
        "run_id", "task_no", F.col("outlet").alias("asset_name"), F.col("finished_at").alias(FACT_TIME),
        F.col("run_key").alias("partition_key"), day.alias("partition_date"), granularity.alias("granularity"),
        "cascade",
    ).where(F.col("partition_date").isNotNull() & F.col("granularity").isin(*cal.GRANULARITIES)
            & F.col("cascade").isin(*vocab.CASCADES))


def last_updated(facts: DataFrame) -> DataFrame:
    """The newest fact of each asset, whatever date it is for."""
    return facts.groupBy("asset_name").agg(
        F.max(F.struct(FACT_TIME, "partition_key")).alias("newest")).select(
        "asset_name", F.col(f"newest.{FACT_TIME}").alias("last_updated"), "newest.partition_key")


def asset_names(facts: DataFrame) -> DataFrame:
    return facts.select("asset_name").distinct()


def recent_facts(facts: DataFrame, n: int, key: str = "asset_name") -> DataFrame:
    """The ``n`` newest facts per asset (or per date); the limit is applied before the shuffle as well."""
    newest = Window.partitionBy(key).orderBy(F.desc(FACT_TIME), F.desc("event_id"))
    return facts.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= n)
