"""From raw documents to packed sequences: good, different documents of sources mixed to target weights.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowgauge.llm import exact_dedup, mixing, near_dedup, packing, quality, support

#: How often a source may be repeated in the mix; the largest is used once and whole.
EPOCHS = 2.0


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learnt from the labels, does not reject."""
    return quality.accepted(docs, quality.fitted(docs, support.table(spark, sf_dir, "labels")))


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.survivors(docs)


def not_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.survivors(docs)


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again, so that the mix is as even as EPOCHS allows."""
    return mixing.mixed(docs, epochs=EPOCHS, budget=None).select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.packed(docs, packing.public_tokenizer("word_bpe_49k.json"))


STAGES = [("quality", good), ("exact_dedup", different), ("near_dedup", not_near), ("mixing", weighted), ("packing", sequences)]

#: A learnt model and a tokenizer cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again, over ``documents``."""
    docs = support.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = support.stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
