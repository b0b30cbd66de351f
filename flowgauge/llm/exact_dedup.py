"""Exact de-duplication by skew-safe combining: within a task, then by salted digest, then over the salts.

Every stage groups by the whole content beside its digest, so texts that only share a digest stay apart. A salt is the
number of the task that read the row: each task has already reduced its copies of a text to one row, so a text that
makes up a third of the corpus reaches any partition as one row for each task at most, and the last stage as one row for
each salt. All of it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from flowgauge.llm import support

#: Partitions over which the copies of one text are merged before they meet.
SALTS = 256


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _body(docs: DataFrame, text: str) -> Column:
    return F.coalesce(docs[text], F.lit(""))


def _combined(rows: DataFrame, *partial: Column, final: list[Column]) -> DataFrame:
    """One row for each content of ``rows`` (digest, body and what is aggregated): per task and salt, then per digest."""
    salted = rows.withColumn("salt", F.spark_partition_id() % SALTS)
    return salted.groupBy("digest", "salt", "body").agg(*partial).groupBy("digest", "body").agg(*final)


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
            digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each different text: digest, body, keep_id (the largest id), group_size."""
    body = _body(docs, text)
    rows = docs.select(digest(body).alias("digest"), body.alias("body"), docs[doc_id].alias("id"))
    return _combined(
        rows, F.max("id").alias("id"), F.count(F.lit(1)).alias("n"),
        final=[F.max("id").alias("keep_id"), F.sum("n").alias("group_size")],
    )


def marked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
           digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the largest id stays. A
    missing id ranks below every id; where all ids of a text are missing, keep_id is null and the rows count as kept.
    Rows that repeat both id and text are one document, so all of them carry the same answer. Other columns are not
    read. An empty table gives no rows.
    """
    # contents that occur once need no look-up; of a digest with several contents none may be looked up by digest alone
    found = classes(docs, text, doc_id, digest)
    by_digest = found.groupBy("digest").agg(
        F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
    )
    known = support.stored(by_digest.where("contents > 1 or group_size > 1"), "dedup-classes")
    rows = docs.select(docs[doc_id].alias("doc_id"), digest(_body(docs, text)).alias("digest"))
    joined = support.with_group_facts(rows, "digest", known, "group_size", docs.count())
    clashing = known.where("contents > 1").select("digest")
    if clashing.isEmpty():
        return _answer(joined)
    body = _body(docs, text)
    full = docs.select(docs[doc_id].alias("doc_id"), digest(body).alias("digest"), body.alias("body"))
    apart = full.join(clashing, "digest", "left_semi").join(found, ["digest", "body"])
    single = joined.where(F.coalesce(F.col("contents"), F.lit(1)) == 1)
    return _answer(single).unionByName(_answer(apart))


def _answer(rows: DataFrame) -> DataFrame:
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select(
        "doc_id", keep.alias("keep_id"), F.coalesce(F.col("group_size"), F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "digest",
    )


def survivors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
              digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: for each text the row with the largest id.

    Rows of equal text and id are one document and come out once; where their other columns differ, the largest values
    stay. A null text counts as empty, and stays null only if every row of that content is null.
    """
    others = [c for c in docs.columns if c not in (text, doc_id)]
    body = _body(docs, text)
    rest = F.struct(docs[doc_id].alias("id"), docs[text].isNotNull().alias("has_text"),
                    *[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(others)])
    rows = docs.select(digest(body).alias("digest"), body.alias("body"), rest.alias("row"))
    best = _combined(rows, F.max("row").alias("row"), final=[F.max("row").alias("row")])
    value = {text: F.when(F.col("row.has_text"), F.col("body")), doc_id: F.col("row.id")}
    value |= {c: F.col(f"row.c{i}") for i, c in enumerate(others)}
    return best.select(*[value[c].alias(c) for c in docs.columns])


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@support.query("op4_exact_dedup", SQL)
def op4(spark, sf_dir):
    return marked(support.table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")
