"""Tables that streaming jobs write batch by batch and read by day, with as few files for a day as it needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def _hadoop_path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders right below ``path``; none if there is no such folder."""
    where, system = _hadoop_path(spark, path)
    if not system.exists(where):
        return []
    return sorted(f.getPath().getName() for f in system.listStatus(where) if f.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    where, system = _hadoop_path(spark, path)
    system.delete(where, True)


class DayTable:
    """Rows in a folder for each day of a column, where every batch adds a folder of its own and old ones become one.

    ``merge`` makes one row of those that stand for the same thing. It must not matter whether it sees a row twice (as a
    least value or a distinct set does not): a reader that meets both the merged folder and those it was made of, because
    the job ended in between, still gets the right rows. Rows without a day are left out.
    """

    #: Folders of a day above which they are merged; the numbers of merged folders lie below all others.
    CROWD, MERGED = 16, -(1 << 50)

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, day: str, merge: Callable[[DataFrame], DataFrame],
                 monthly: bool = False):
        """``day`` names the column; with ``monthly`` the days of a month share the folder of its first."""
        self.spark, self.path, self.schema, self.day, self.merge, self.monthly = spark, path, schema, day, merge, monthly

    def _label(self) -> Column:
        date = F.col(self.day).cast("date")
        return F.date_format(F.trunc(date, "MM") if self.monthly else date, "yyyy-MM-dd")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Store the rows of a batch; a batch that is run again replaces its own."""
        dated = rows.select(*self.schema.names, self._label().alias("day"))
        self._write(dated.where("day IS NOT NULL"), batch_id)

    def _write(self, dated: DataFrame, batch_id: int) -> None:
        dealt = dated.hint("rebalance", F.col("day")).withColumn("batch_id", F.lit(batch_id).cast("long"))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(self.path)

    def days(self, first=None, last=None) -> list[str]:
        if self.monthly and first is not None:
            first = f"{str(first)[:8]}01"
        found = [name.removeprefix("day=") for name in folders(self.spark, self.path) if name.startswith("day=")]
        return [d for d in found if (first is None or d >= str(first)[:10]) and (last is None or d <= str(last)[:10])]

    def _stored(self, paths: list[str]) -> DataFrame:
        shape = T.StructType([*self.schema.fields, T.StructField("day", T.StringType()), T.StructField("batch_id", T.LongType())])
        if not paths:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).option("basePath", self.path).parquet(*paths)

    def read(self, first=None, last=None, besides: int | None = None) -> DataFrame:
        """The rows of the days from ``first`` to ``last``, as batches wrote them, without those of the batch ``besides``.

        Only the folders of these days are listed and read.
        """
        rows = self._stored([f"{self.path}/day={d}" for d in self.days(first, last)])
        if besides is not None:
            rows = rows.where(F.col("batch_id") != besides)
        return rows.select(*self.schema.names)

    def rows(self) -> DataFrame:
        return self.merge(self.read())

    def compact(self, first=None, last=None) -> list[str]:
        """Merge the crowded ones of these days; the days that were."""
        crowded = {}
        for day in self.days(first, last):
            held = [name for name in folders(self.spark, f"{self.path}/day={day}") if name.startswith("batch_id=")]
            if len(held) > self.CROWD:
                crowded[day] = held
        if not crowded:
            return []
        old = [f"{self.path}/day={day}/{name}" for day, held in crowded.items() for name in held]
        least = min(int(path.rsplit("=", 1)[1]) for path in old)
        merged = self.merge(self._stored(old).select(*self.schema.names))
        self._write(merged.withColumn("day", self._label()), min(least, self.MERGED) - 1)
        for path in old:
            remove(self.spark, path)
        return list(crowded)
