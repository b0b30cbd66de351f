"""Every-term search of a registry by posting lists: one index for many searches, candidates by intersection, then verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowgauge.functions import text as texts
from flowgauge.session import cut_lineage

#: So many of a search's grams, the rarest, are intersected; the others are left to the check of the text itself.
INTERSECTED = 4
#: So many texts, about, are cut into grams by one task.
TEXTS_PER_TASK = 10_000


def _substrings(value: Column, size: int) -> Column:
    count = F.length(value) - (size - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(value, i, F.lit(size)))).otherwise(
        F.array().cast("array<string>"))


def postings(registry: DataFrame, key: str, text: str) -> DataFrame:
    """gram, key: the texts that hold each run of up to three characters; the empty run has all texts.

    Texts are dealt out by their key before they are cut, so a task holds the grams of its texts only and no gram is shuffled.
    """
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *[_substrings(lower, n) for n in (1, 2, 3)]))
    dealt = registry.repartition(registry.count() // TEXTS_PER_TASK + 1, key)
    return dealt.select(F.explode(grams).alias("gram"), F.col(key).alias("key")).distinct()


def asked_grams(searches: DataFrame) -> DataFrame:
    """search_id, gram: what a text must hold to match: the grams of three of every term, or the term if it is shorter."""
    terms = F.filter(F.split(F.lower("search"), r"\s+"), lambda t: t != "")
    of_term = F.transform(terms, lambda t: F.when(F.length(t) < 3, F.array(t)).otherwise(_substrings(t, 3)))
    grams = F.array_distinct(F.flatten(of_term))
    wanted = F.when(F.size(grams) > 0, grams).otherwise(F.array(F.lit("")))
    return searches.where("search IS NOT NULL").select("search_id", F.explode(wanted).alias("gram"))


def search(registry: DataFrame, index: DataFrame, searches: DataFrame, key: str, text: str) -> DataFrame:
    """search_id and ``key`` of every text of ``registry`` in which all terms of a search (search_id, search) occur.

    ``index`` is what :func:`postings` made of the registry, built once and stored. A search reads the lists of its rarest
    grams; a search without terms matches all texts.
    """
    asked = asked_grams(searches)
    sizes = index.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("texts"))
    sized = asked.join(sizes, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rarest = Window.partitionBy("search_id").orderBy("texts", "gram")
    chosen = sized.withColumn("n", F.row_number().over(rarest)).where(F.col("n") <= INTERSECTED)
    chosen = cut_lineage(chosen.select("search_id", "gram"))  # a few rows, and known to be a few where they meet the index
    needed = chosen.groupBy("search_id").agg(F.count("*").alias("needed"))
    met = chosen.join(index, "gram").groupBy("search_id", "key").agg(F.count("*").alias("held"))
    candidates = met.join(needed, "search_id").where("held = needed").select("search_id", "key")
    read = registry.select(F.col(key).alias("key"), F.col(text).alias("read"))
    verified = candidates.join(read, "key").join(searches.select("search_id", "search"), "search_id")
    return verified.where(texts.matches_search(F.col("read"), F.col("search"))).select("search_id", F.col("key").alias(key))
