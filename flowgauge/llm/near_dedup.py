"""Near-duplicates by MinHash: universal minima in bands, signature check, full sets, and connected components.

Documents of equal word sequences are one class, named by the key of its words, so copies never meet in a band and an id
that stands for several texts is in several classes. Classes that share a band are a bucket.
No bucket is spread into its pairs: first every class is compared with the leader (smallest key) that it meets in most
buckets, and what is linked so is contracted. After that only buckets that still hold several components matter, and of
their pairs only those that include a stray, a class outside the bucket's largest component. Small buckets give them as
pairs. Large ones are brought together by their largest component, and the full sets of their strays are held against those
of all members in blocks, inside tasks, which return links alone.
A pair is taken on if its signatures may agree that often, and linked only if its full shingle sets do.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from flowgauge.llm import shingles, support

#: 100 * intersection >= 75 * union links two documents.
SIMILAR = 75
#: Rows and bands. At similarity 0.75 a pair misses all bands with a probability of 1e-6.
ROWS, BANDS = 5, 51
#: A similar pair's signatures agree less than asked with a probability below 4e-6.
DEVIATIONS = 4.5
#: Stray pairs up to which a bucket gives them as rows; sets on each side of a block, and shingles compared at a time.
PAIRS, BLOCK, COLUMNS = 64, 512, 4096


def sketches(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """For each document: id, n (its shingles), key (of its word sequence) and signature (16 bits of each minimum)."""
    schema = T.StructType([
        T.StructField("id", docs.schema[doc_id].dataType), T.StructField("n", T.LongType()),
        T.StructField("key", T.BinaryType()), T.StructField("signature", T.BinaryType()),
    ])

    def run(batches):
        import pyarrow as pa
        import xxhash

        minhash = shingles.MinHash(ROWS * BANDS, 1)
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for words, own in shingles.shingle_sets(batch.column(1)):
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(words.tobytes()) if len(own) else None)
                signatures.append(minhash.minima(own).astype(np.uint16).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())],
                names=schema.names)

    return support.by_batch(docs.select(docs[doc_id].alias("id"), docs[text].alias("text")), run, schema)


def shingle_table(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """For each document: the key of its words as id, and its full set of shingle hashes as bytes."""
    schema = T.StructType([T.StructField("id", T.BinaryType()), T.StructField("shingles", T.BinaryType())])

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            keys, sets = [], []
            for words, own in shingles.shingle_sets(batch.column(1)):
                keys.append(xxhash.xxh3_128_digest(words.tobytes()))
                sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=schema.names)

    return support.by_batch(docs.select(docs[doc_id].alias("id"), docs[text].alias("text")), run, schema)


def _with_both(pairs: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with ``column`` of both sides as left and right."""
    right = facts.select(F.col("id").alias("b"), F.col(column).alias("right"))
    left = facts.select(F.col("id").alias("a"), F.col(column).alias("left"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")


def _filtered(pairs: DataFrame, holds) -> DataFrame:
    """Pairs for which ``holds(left, right)`` is true for the bytes of both sides."""
    kind = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [holds(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return support.by_batch(pairs, run, kind)


def _may_agree(left, right) -> bool:
    """Whether so many minima agree as must, by DEVIATIONS, at the similarity asked for."""
    count, p = ROWS * BANDS, SIMILAR / 100
    least = count * p - DEVIATIONS * (count * p * (1 - p)) ** 0.5
    return int((np.frombuffer(left, np.uint16) == np.frombuffer(right, np.uint16)).sum()) >= least


def _similar(left, right) -> bool:
    x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= SIMILAR * (len(x) + len(y) - shared)


def _sets(docs: DataFrame, keys: DataFrame, classes: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The shingles of the classes that ``keys`` names, once each."""
    wanted = support.stored(keys.toDF("id").distinct(), "near-wanted")
    named = classes.join(wanted, "id", "left_semi").select("doc")
    sets = shingle_table(support.chosen(docs.select(doc_id, text), doc_id, named), text, doc_id)
    return sets.join(wanted, "id", "left_semi").dropDuplicates(["id"])


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The links among ``pairs``: by signature, then on full sets."""
    near = support.stored(_filtered(_with_both(pairs, classes, "signature"), _may_agree), "near-pairs")
    ends = near.select("a").union(near.select("b"))
    sets = _sets(docs, ends, classes, text, doc_id)
    return support.stored(_filtered(_with_both(near, sets, "shingles"), _similar), "near-links")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left shares with each on the right."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not left or not right:
        return out
    here, there = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(here, there)
    sides = []
    for sets, values in ((left, here), (right, there)):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(common, values)
        real = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == values) if len(common) else np.zeros(len(values), bool)
        sides.append((owner[real], at[real]))
    for first in range(0, len(common), COLUMNS):
        tables = []
        for sets, (owner, at) in zip((left, right), sides, strict=True):
            table = np.zeros((len(sets), min(COLUMNS, len(common) - first)), np.float32)
            own = (at >= first) & (at < first + COLUMNS)
            table[owner[own], at[own] - first] = 1
            tables.append(table)
        out += (tables[0] @ tables[1].T).astype(np.int64)  # at most COLUMNS each, exact in single precision
    return out


def _stray_links(members: DataFrame, classes: DataFrame, docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Links (a, b) between strays and members of other components, for each group of ``members`` (top, id, component)."""
    counts = members.groupBy("top").agg(F.count(F.lit(1)).alias("members"), F.sum((F.col("component") != F.col("top")).cast("long")).alias("strays"))
    blocks = counts.select("top", F.ceil(F.col("members") / BLOCK).alias("rows"), F.ceil(F.col("strays") / BLOCK).alias("columns"))
    sets = _sets(docs, members.select("id"), classes, text, doc_id)
    known = members.join(blocks, "top").join(support.stored(sets, "near-sets"), "id")
    row, column = (F.pmod(F.xxhash64("id"), F.col(c)) for c in ("rows", "columns"))
    every = "sequence(0L, {} - 1L)"
    kind = ["top", "id", "component", "shingles"]
    held = known.select(*kind, row.alias("row"), F.explode(F.expr(every.format("columns"))).alias("column"), F.lit(False).alias("stray"))
    strays = known.where("component <> top").select(*kind, F.explode(F.expr(every.format("rows"))).alias("row"), column.alias("column"), F.lit(True).alias("stray"))

    def compare(table):
        import pyarrow as pa

        stray = table["stray"].to_numpy()
        names, parts = (table[c].combine_chunks().dictionary_encode() for c in ("id", "component"))
        ids, parts = names.indices.to_numpy().astype(np.int64), parts.indices.to_numpy().astype(np.int64)
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        one, two = np.flatnonzero(stray), np.flatnonzero(~stray)
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        shared = overlaps([own[i] for i in one], [own[i] for i in two])
        similar = 100 * shared >= SIMILAR * (sizes[one][:, None] + sizes[two][None, :] - shared)
        similar &= parts[one][:, None] != parts[two][None, :]
        x, y = np.nonzero(similar)
        a, b = ids[one[x]], ids[two[y]]
        pairs = np.stack([a, parts[two[y]], b], axis=1) if len(x) else np.zeros((0, 3), np.int64)
        # one link to a component is as good as many
        first = np.unique(pairs[np.lexsort(pairs.T[::-1])][:, :2], axis=0, return_index=True)[1] if len(pairs) else []
        pairs = pairs[np.lexsort(pairs.T[::-1])][first] if len(pairs) else pairs
        return pa.table({"a": names.dictionary.take(pa.array(pairs[:, 2])), "b": names.dictionary.take(pa.array(pairs[:, 0]))})

    support.ship(docs.sparkSession)
    found = held.unionByName(strays).groupBy("top", "row", "column").applyInArrow(compare, "a binary, b binary")
    return support.stored(found, "near-links")


def components(edges: DataFrame) -> DataFrame:
    """Nodes of ``edges`` (u, v) with the smallest node of their component, by alternating large and small stars.

    A large star links every greater neighbour of a node to the node's least neighbour; a small star links the node and
    its smaller neighbours to the least of them. Rounds go on until the edges stay as they are; then all are stars.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = support.stored(edges, "star"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        around = edges.union(edges.select("v", "u"))
        least = around.groupBy("u").agg(F.min("v").alias("least"))
        large = around.join(least.select("u", F.least("u", "least").alias("least")), "u").where("v > u")
        large = large.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = support.stored(small.union(least).distinct(), "star")


def _labelled(members: DataFrame, links: list[DataFrame]) -> DataFrame:
    known = components(reduce(DataFrame.union, links).select(F.col("a").alias("u"), F.col("b").alias("v")))
    joined = members.join(known.withColumnRenamed("node", "id"), "id", "left")
    return joined.withColumn("component", F.coalesce("component", "id"))


def _sized(pairs: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the similarity."""
    return pairs.where(100 * F.least("n", "n_other") >= SIMILAR * F.greatest("n", "n_other"))


def _open(members: DataFrame) -> DataFrame:
    """Buckets of ``members`` (bucket, id, component) with several components: how many classes, the largest, and the rest."""
    by_part = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("held"))
    parts = by_part.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("held").alias("members"),
                                          F.max(F.struct("held", "component")).alias("top"))
    return parts.where("parts > 1").select("bucket", "members", F.col("top.component").alias("top"),
                                           (F.col("members") - F.col("top.held")).alias("strays"))


def links(docs: DataFrame, classes: DataFrame, text: str, doc_id: str) -> list[DataFrame]:
    """Tables of links (a, b) that connect all similar classes (id: the key, n, signature, doc: the id of a document of the class)."""
    width = 2 * ROWS
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                                    lambda i: F.xxhash64(i, F.col("signature").substr(i * width + 1, F.lit(width)))))
    spread = classes.select("id", "n", band.alias("band", "hash"))
    spread = spread.select("id", "n", F.xxhash64("band", "hash").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("leader"))
    members = support.stored(spread.join(buckets.where("members > 1").select("bucket", "leader"), "bucket"), "near-buckets")

    met = members.where("id <> leader").groupBy("leader", "id", "n").agg(F.count(F.lit(1)).alias("times"))
    met = _sized(met.join(classes.select(F.col("id").alias("leader"), F.col("n").alias("n_other")), "leader"))
    met = support.stored(met.select(F.col("leader").alias("a"), F.col("id").alias("b"), "times"), "near-leaders")
    best = met.groupBy("b").agg(F.min(F.struct((-F.col("times")).alias("times"), "a")).alias("best"))
    first = best.select("best.a", "b")
    found = [_verified(first, classes, docs, text, doc_id)]

    labelled = support.stored(_labelled(members.select("bucket", "id", "n"), found), "near-labelled")
    parts = support.stored(_open(labelled), "near-open")
    few = F.col("strays") * F.col("members") <= PAIRS
    small = labelled.join(parts.where(few), "bucket")
    strays = small.where("component <> top").select(
        "bucket", F.col("id").alias("stray"), F.col("n").alias("n_other"), F.col("component").alias("other"))
    once = (F.col("component") == F.col("top")) | (F.col("id") < F.col("stray"))
    crossed = _sized(small.join(strays, "bucket").where((F.col("component") != F.col("other")) & once))
    crossed = crossed.select(F.least("id", "stray").alias("a"), F.greatest("id", "stray").alias("b"))
    more = crossed.distinct().join(first, ["a", "b"], "left_anti")
    found.append(_verified(more, classes, docs, text, doc_id))
    large = labelled.join(parts.where(~few).select("bucket", "top"), "bucket").select("top", "id", "component").distinct()
    found.append(_stray_links(support.stored(large, "near-large"), classes, docs, text, doc_id))
    return found


def marked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    A-Z is lower-cased; null texts, empty texts and texts of white space have no shingles and are linked with nothing.
    component_id is the smallest id that links reach, and the row that has it is kept. Rows that repeat an id with the same
    words are one document; those with other words are another one, and of several with the smallest id one is kept. A row without an id is linked with nothing, has no component and is kept. Other columns are
    not read. No rows give no rows.
    """
    return _judged(docs, text, doc_id).drop("key")


def _judged(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """What ``marked`` returns, and the key of each row's words."""
    sketched = support.stored(sketches(docs, text, doc_id), "near-sketches")
    linked = sketched.where("key is not null and id is not null")
    first = linked.groupBy("key").agg(F.min(F.struct("id", "n", "signature")).alias("first"), F.count(F.lit(1)).alias("copies"))
    first = support.stored(first.select("key", "copies", "first.*"), "near-classes")
    classes = first.select(F.col("key").alias("id"), "n", "signature", F.col("id").alias("doc"))
    known = components(reduce(DataFrame.union, links(docs, classes, text, doc_id)).select(
        F.col("a").alias("u"), F.col("b").alias("v")))
    nodes = known.union(known.select("component", "component").distinct())
    nodes = support.stored(nodes.join(first.select(F.col("key").alias("node"), "id"), "node"), "near-nodes")
    least = nodes.groupBy("component").agg(F.min(F.struct("id", "node")).alias("least"), F.count(F.lit(1)).alias("held"))
    total = sketched.count()
    nodes = support.with_group_facts(nodes.select("node", "component"), "component", support.stored(least, "near-least"), "held", total)
    nodes = nodes.select(F.col("node").alias("key"), F.col("least.id").alias("component"), F.col("least.node").alias("top"))
    facts = first.select("key", "copies", "id").join(nodes, "key", "left").where("copies > 1 or component is not null")
    facts = facts.select("key", "copies", F.coalesce("component", "id").alias("component"), F.coalesce("top", "key").alias("top"))
    rows = support.with_group_facts(sketched.select("id", "n", "key"), "key", support.stored(facts, "near-facts"), "copies", total)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    kept = F.col("id").isNull() | (F.col("id") == component) & F.coalesce(F.col("key") == F.col("top"), F.lit(True))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                       kept.alias("kept"), "key")


def survivors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``marked`` keeps, with all their columns, whatever they are called.

    What ``marked`` says of nulls, empty, long and repeated texts holds here too; no rows give no rows.
    """
    free = "_" * max(map(len, docs.columns))  # longer than every name there is
    gone, held, own, key = (f"{free}_{name}" for name in ("gone", "held", "own", "key"))
    judged = support.stored(_judged(docs, text, doc_id).select("doc_id", "key", "kept"), "near-judged")
    drop = support.stored(judged.where(~F.col("kept")).select(F.col("doc_id").alias(gone), F.col("key").alias(key)).distinct(), "near-drop")
    kept = support.chosen(judged.where("kept"), "doc_id", drop.select(gone))
    both = support.stored(kept.select(F.col("doc_id").alias(held)).distinct(), "near-both")  # ids of a kept and a dropped text
    clear = support.stored(drop.select(gone).distinct().join(both, F.col(gone) == F.col(held), "left_anti"), "near-clear")

    def named(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= support.BROADCAST_IDS else ids

    rest = docs.join(named(clear), docs[doc_id] == F.col(gone), "left_anti")
    if both.isEmpty():
        return rest
    single = rest.join(named(both), rest[doc_id] == F.col(held), "left_anti")
    several = rest.join(named(both), rest[doc_id] == F.col(held), "left_semi")
    at, schema = docs.columns.index(text), T.StructType([*docs.schema.fields, T.StructField(own, T.BinaryType())])

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            keys = [xxhash.xxh3_128_digest(words.tobytes()) if len(own) else None for words, own in shingles.shingle_sets(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=schema.names)

    keyed = support.by_batch(several, run, schema)
    keyed = keyed.join(drop, (keyed[doc_id] == F.col(gone)) & (F.col(own) == F.col(key)), "left_anti")
    return single.unionByName(keyed.drop(own))


@support.query("op9_near_dedup")
def op9(spark, sf_dir):
    found = marked(support.table(spark, sf_dir, "documents"))
    # of several texts with the smallest id, ``marked`` keeps one; the query keeps that id
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
