"""What the operators share: registration, reading a table, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowgauge.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: A group with more than one row in HOT_SHARE is hot; so there are fewer than HOT_SHARE hot groups, whatever the input.
HOT_SHARE = 10_000
#: Ids that are broadcast at most: some 20 MB.
BROADCAST_IDS = 1_000_000
_SHIPPED: set[str] = set()
#: Bytes between words: space and the control characters 9 to 13.
SPACES = r"\x20\x09-\x0D"
SPACE_MARKS = " \t\n\v\f\r"
#: A-Z to lower case, every other byte as it is.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Bytes of text that a task holds as Python objects at a time, a single text excepted.
SLICE = 4 << 20


def query(name: str, sql: str | None = None):
    """Register ``build(spark, sf_dir)`` under ``name``, with its DuckDB twin where there is one."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the folder, for tables that are removed by ``forget``."""
    path = scratch_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Remove folders that this job wrote and no longer reads."""
    context = spark.sparkContext
    for path in paths:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Hand memory that is free back to the system: what a Python worker keeps for its next task, others on the machine lack."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query shuffles is removed when that query ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Make this package known to Python on the executors, once for each Spark application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(file.relative_to(root.parent)))
    where = context._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark, 'code')}/{root.name}.zip")
    out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(data.getvalue()))
    out.close()
    context.addPyFile(where.toString())
    _SHIPPED.add(context.applicationId)


def by_batch(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batch, column: int = 1, most: int = SLICE):
    """``batch`` in runs of rows with at most ``most`` bytes in a text column; a longer text is a run of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first = held = 0
    for row, size in enumerate(sizes):
        if row > first and held + size > most:
            yield batch.slice(first, row - first)
            first, held = row, 0
        held += size
    if first < batch.num_rows:
        yield batch.slice(first)


def word_chars(text: str) -> int:
    """Code points that are not white space."""
    return len(text) - sum(map(text.count, SPACE_MARKS))


def crc_rest(key: Column, modulus: int) -> Column:
    """crc32 of a key's text, modulo ``modulus``; a missing key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def chosen(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in ``ids`` (one column). Up to BROADCAST_IDS ids go to all tasks, so that rows stay where
    they are; more are joined by shuffle."""
    ids = stored(ids.toDF("_id").distinct(), "ids")
    named = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return rows.join(named, F.col(f"`{key}`") == F.col("_id"), "left_semi")


def with_group_facts(rows: DataFrame, key: str, facts: DataFrame, size: str, total: int) -> DataFrame:
    """``rows`` left joined with one row of ``facts`` for each ``key``, however many rows a key has.

    Groups above total / HOT_SHARE rows (``size`` has the count) are fewer than HOT_SHARE, so they are broadcast and
    their rows never shuffled by the key; every other key is a small share of the rows and joins by shuffle.
    """
    found = [c for c in facts.columns if c != key]
    hot_rows = F.col(size) * HOT_SHARE > F.lit(total)
    hot = facts.where(hot_rows).select(F.col(key).alias("_hot_key"), F.struct(*found).alias("_hot"))
    cool = facts.where(~hot_rows).select(F.col(key).alias("_cool_key"), F.struct(*found).alias("_cool"))
    known = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").drop("_hot_key")
    # a row that is settled must not follow its key into one partition
    spread = F.concat(F.lit("-"), F.xxhash64(*[F.col(c) for c in rows.columns]).cast("string"))
    known = known.withColumn("_join_key", F.when(F.col("_hot").isNotNull(), spread).otherwise(F.col(key)))
    joined = known.join(cool, F.col("_join_key") == F.col("_cool_key"), "left")
    both = F.coalesce(F.col("_hot"), F.col("_cool"))
    return joined.select(*[F.col(c) for c in rows.columns], *[both[c].alias(c) for c in found])


def with_few_facts(rows: DataFrame, key: str, facts: DataFrame, size: str) -> DataFrame:
    """As ``with_group_facts``, for ``facts`` that are few as a rule: up to BROADCAST_IDS / 10 of them go to all tasks."""
    if facts.count() <= BROADCAST_IDS // 10:
        return rows.join(F.broadcast(facts.drop(size) if size in rows.columns else facts), key, "left")
    return with_group_facts(rows, key, facts, size, rows.count())
