"""Passing outputs between tasks as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowgauge.functions import text, vocab
from flowgauge.operators.rules import upstream_rows


def resolve_upstream_outputs(edges: DataFrame, tasks: DataFrame, outputs: DataFrame) -> DataFrame:
    """For each task and upstream of a run, the stored value or why there is none.

    An upstream's state in this run decides first, so an older run's output of the same date is never returned for an
    upstream that has none in this one.
    """
    stored = outputs.select("run_id", F.col("task_no").alias("upstream_no"), "result")
    joined = upstream_rows(edges, tasks).join(stored, ["run_id", "upstream_no"], "left")
    readable = F.when(F.col("upstream_missing"), "missing").otherwise(
        vocab.readable_class(F.col("upstream_status"), F.col("upstream_origin")))
    kind = text.output_kind(F.col("result"))
    outcome = (
        F.when(readable != "ok", readable).when(F.col("result").isNull(), "missing").when(kind == "manual", "manually_resolved")
        .when(kind == "truncated", "truncated").when(kind == "pointer", "pointer").otherwise("value")
    )
    return joined.select("run_id", "task_no", "upstream_no", outcome.alias("outcome"),
                         F.when(outcome.isin("value", "pointer"), F.col("result")).alias("result"))


def pointers(outputs: DataFrame) -> DataFrame:
    return outputs.where(text.output_kind(F.col("result")) == "pointer").withColumn(
        "path", text.output_field(F.col("result"), text.POINTER_FIELD))


def object_key(path: Column) -> Column:
    """Bucket and key of an object's address, whatever its scheme."""
    return F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*:)?/*", "")


def documents_below(spark: SparkSession, root: str) -> DataFrame:
    """Whole files below ``root`` as (path, document); a path is what follows the root: a bucket, then its key."""
    found = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    above = object_key(F.lit(root.rstrip("/") + "/"))
    file = object_key(F.col("_metadata.file_path"))
    return found.select(file.substr(F.length(above) + 1, F.length(file)).alias("path"), F.col("value").alias("document"))


def dereference(outputs: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored pointers with the documents (path, document) that they name, by bucket and whole key."""
    wanted = pointers(outputs).withColumn("key", object_key(F.col("path")))
    known = documents.select(object_key(F.col("path")).alias("key"), "document")
    return wanted.join(known, "key", "left").drop("key")


def manual_resolutions(outputs: DataFrame) -> DataFrame:
    """Outputs a person resolved: how, who, why and in which run."""
    marked = outputs.where(text.output_kind(F.col("result")) == "manual")
    defaults = {"resolution": "unknown", "operator": "unknown", "reason": "", "marked_run": ""}
    return marked.select("run_id", "task_no", *[
        F.coalesce(text.output_field(F.col("result"), field), F.lit(defaults[name])).alias(name)
        for name, field in text.MARKER_FIELDS.items()])
