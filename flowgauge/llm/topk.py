"""Exact top-k by inner product: a ball tree in each shard, searched by branch and bound.

Vectors become integers, so scores are exact. A shard is a bounded set of vectors in one ball tree: every node has a centre
and a radius, and no vector in it can score more with a query than <query, centre> + |query| * radius. Queries come in
blocks. A block meets every shard; a task has a run of shards for a block and keeps, for each query, the k best scores so
far. It opens a node for the queries whose bound reaches their current k-th score, which they carry on from shard to shard.
Before that, one round over a single shard for each block has found a k-th score that all tasks start from. Trees and blocks
are shuffled to their tasks, never broadcast: their files are far smaller than they are.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from flowgauge.llm import support

K = 5
#: Vectors of a shard, vectors of a leaf, queries of a block, and shards that one task searches for a block.
SHARD, LEAF, BLOCK, RUN = 4096, 64, 1024, 16
#: Sums below this are exact in doubles.
_EXACT = 1 << 52
#: A score that no k-th score lies below.
_NONE = np.iinfo(np.int64).min


def as_integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as a long; null for a vector that is null or has a null or non-finite part."""
    doubles = vector.cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


@dataclass
class BallTree:
    """Nodes in depth-first order: rows ``start`` to ``end`` of ``vectors``, ``left`` and ``right`` (-1 in a leaf)."""

    ids: np.ndarray
    vectors: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> BallTree:
        order = np.lexsort((ids,))
        points = vectors.astype(float)
        starts, ends, lefts, rights, centres, radii = [], [], [], [], [], []
        nodes = [(0, len(ids), -1, False)]
        while nodes:
            start, end, parent, is_right = nodes.pop()
            number = len(starts)
            if parent >= 0:
                (rights if is_right else lefts)[parent] = number
            own = points[order[start:end]]
            centre = own.mean(axis=0)
            far = np.sqrt(((own - centre) ** 2).sum(axis=1))
            for values, value in ((starts, start), (ends, end), (lefts, -1), (rights, -1), (centres, centre), (radii, far.max())):
                values.append(value)
            if end - start <= leaf or far.max() == 0:
                continue
            one = own[far.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            along = own @ (other - one)
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argsort(along, kind="stable")]
            nodes += [(start + half, end, number, True), (start, start + half, number, False)]
        return cls(ids[order], vectors[order], *map(np.array, (starts, ends, lefts, rights, centres, radii)))

    def search(self, query: np.ndarray, own: int | None, k: int, best: list[tuple[int, int]], floor: int | None) -> None:
        """Merge into ``best`` (a heap of (score, -id)) what the tree has; ``floor`` is a score that the k-th reaches."""
        self.search_all(query[None, :], [own], k, [best], [floor])

    def search_all(self, queries: np.ndarray, owns: list, k: int, best: list[list[tuple[int, int]]], floors: list) -> None:
        """As ``search`` for many queries: a node is opened once, for those whose bound there reaches their k-th score so far.

        A query without such a score begins in the leaf with its highest bound, so that it has one for the others.
        """
        points = queries.astype(float)
        lengths = np.sqrt((points**2).sum(axis=1))
        bounds = self.centre @ points.T + self.radius[:, None] * lengths
        bounds += 1e-9 * (np.abs(bounds) + lengths * (self.radius[:, None] + np.abs(self.centre).max(initial=0.0) + 1)) + 0.5
        least = np.full(len(queries), _NONE)
        for i, (heap, floor) in enumerate(zip(best, floors, strict=True)):
            if len(heap) == k or floor is not None:
                least[i] = heap[0][0] if len(heap) == k else floor
        leaves = np.flatnonzero(self.left < 0)
        begun = np.where(least == _NONE, leaves[bounds[leaves].argmax(axis=0)], -1)

        def read(node, asking):
            start, end = self.start[node], self.end[node]
            scores = products(self.vectors[start:end], queries[asking]).T
            who, row = np.nonzero(scores >= least[asking][:, None])
            for i, score, vec_id in zip(asking[who].tolist(), scores[who, row].tolist(), self.ids[start:end][row].tolist(), strict=True):
                heap = best[i]
                if vec_id == owns[i]:
                    continue
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec_id))
                elif (score, -vec_id) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec_id))
                else:
                    continue
                if len(heap) == k:
                    least[i] = max(least[i], heap[0][0])

        for node in np.unique(begun[begun >= 0]).tolist():
            read(node, np.flatnonzero(begun == node))
        waiting = [(0, np.arange(len(queries)))]
        while waiting:
            node, asking = waiting.pop()
            asking = asking[(bounds[node, asking] >= least[asking]) & (begun[asking] != node)]
            if not len(asking):
                continue
            if self.left[node] < 0:
                read(node, asking)
                continue
            children = (int(self.left[node]), int(self.right[node]))
            waiting += [(child, asking) for child in sorted(children, key=lambda c: bounds[c, asking].sum())]


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers, by doubles where their sums cannot be rounded; ``query`` may be several, in rows."""
    top = float(np.abs(vectors.astype(float)).max(initial=0)) * float(np.abs(query.astype(float)).max(initial=0)) * query.shape[-1]
    if top < _EXACT:
        return (vectors.astype(float) @ query.astype(float).T).astype(np.int64)
    return vectors.astype(np.int64) @ query.astype(np.int64).T


def searched(vectors: DataFrame, is_query: Column, k: int = K, embedding: str = "embedding", vec_id: str = "vec_id",
             shard: int = SHARD) -> DataFrame:
    """For every query its ``k`` highest scores among all other rows: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller id; a query with fewer candidates has all of them. Vectors that are null or hold null or
    non-finite components take no part, nor do rows without an id; vectors of different lengths have no score with each
    other. Rows that repeat an id and its vector are one candidate. Other columns are not read. No rows give no rows.
    """
    support.ship(vectors.sparkSession)
    rows = vectors.select(vectors[vec_id].cast("long").alias("id"), as_integers(vectors[embedding]).alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("vector").isNotNull() & F.col("id").isNotNull()).distinct()
    rows = support.stored(rows.withColumn("size", F.size("vector").cast("long")), "topk-vectors")
    shards = max(1, -(-rows.count() // shard))
    asks = rows.where("asks")
    blocks = max(1, -(-asks.count() // BLOCK))
    place = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(shards))

    def pack_tree(key, table):
        import pyarrow as pa

        tree = BallTree.build(table["id"].to_numpy(), _narrow(_matrix(table["vector"], key[0].as_py())))
        return pa.table({"size": [key[0].as_py()], "shard": [key[1].as_py()], "tree": [_dumped(tree)]})

    def pack_block(key, table):
        import pyarrow as pa

        order = np.argsort(table["id"].to_numpy(), kind="stable")
        block = (table["id"].to_numpy()[order], _narrow(_matrix(table["vector"], key[0].as_py())[order]))
        return pa.table({"size": [key[0].as_py()], "block": [key[1].as_py()], "queries": [_dumped(block)]})

    trees = rows.select("size", place.alias("shard"), "id", "vector").groupBy("size", "shard").applyInArrow(
        pack_tree, "size long, shard long, tree binary")
    trees = support.stored(trees, "topk-trees")
    packed = asks.select("size", F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(blocks)).alias("block"), "id", "vector")
    packed = support.stored(packed.groupBy("size", "block").applyInArrow(pack_block, "size long, block long, queries binary"), "topk-queries")

    one = T.StructType([T.StructField("size", T.LongType()), T.StructField("block", T.LongType()), T.StructField("floors", T.BinaryType())])
    home = packed.withColumn("shard", F.col("block") % shards).join(trees.hint("merge"), ["size", "shard"], "left")

    def first_round(batches):
        import pyarrow as pa

        for batch in batches:
            for size, block, queries, tree in zip(*(batch.column(i) for i in range(4)), strict=True):
                ids, points = _loaded(queries)
                floors: list[int | None] = [None] * len(ids)
                if tree.is_valid:
                    best: list[list[tuple[int, int]]] = [[] for _ in floors]
                    _loaded(tree).search_all(points, ids.tolist(), k, best, floors)
                    floors = [heap[0][0] if len(heap) == k else None for heap in best]
                yield pa.RecordBatch.from_arrays([pa.array([size.as_py()], pa.int64()), pa.array([block.as_py()], pa.int64()),
                                                  pa.array([_dumped(floors)], pa.binary())], names=one.names)

    floors = home.select("size", "block", "queries", "tree").mapInArrow(first_round, one)
    known = support.stored(packed.join(floors.hint("merge"), ["size", "block"]), "topk-floors")

    # every block of queries against every shard of its length: a task gets a block once and then the trees of its run
    of_runs = F.sequence(F.lit(0).cast("long"), F.lit((shards - 1) // RUN).cast("long"))
    of_blocks = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    to_search = known.select("size", "block", F.explode(of_runs).alias("run"), F.lit(-1).cast("long").alias("shard"), "queries", "floors").unionByName(
        trees.select("size", F.explode(of_blocks).alias("block"), F.floor(F.col("shard") / RUN).alias("run"), "shard", "tree"), allowMissingColumns=True)
    runs = to_search.repartition(max(1, blocks * -(-shards // RUN)), "size", "block", "run").sortWithinPartitions("size", "block", "run", "shard")
    result = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])

    def search_run(batches):
        import pyarrow as pa

        at, heaps, ids, points, least = None, [], [], None, []

        def ended():
            found = [(q, -v, s) for q, heap in zip(ids, heaps, strict=True) for s, v in heap]
            columns = zip(*found) if found else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=result.names)

        for batch in batches:
            for size, block, run, queries, floors, tree in zip(*(batch.column(i) for i in range(6)), strict=True):
                if queries.is_valid:
                    if at is not None:
                        yield ended()
                    at, (own, points), least = (size.as_py(), block.as_py(), run.as_py()), _loaded(queries), _loaded(floors)
                    ids, heaps = own.tolist(), [[] for _ in own]
                elif (size.as_py(), block.as_py(), run.as_py()) == at:  # else no query has this length
                    _loaded(tree).search_all(points, ids, k, heaps, least)
        if at is not None:
            yield ended()

    found = runs.select("size", "block", "run", "queries", "floors", "tree").mapInArrow(search_run, result)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column, size: int) -> np.ndarray:
    chunked = column.combine_chunks()
    return chunked.flatten().to_numpy().reshape(len(chunked), size)


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as they need."""
    top = max(abs(int(matrix.min(initial=0))), abs(int(matrix.max(initial=0))))
    return matrix.astype(next((kind for kind in (np.int16, np.int32) if top <= np.iinfo(kind).max), np.int64))


def _dumped(value) -> bytes:
    import pickle

    return pickle.dumps(value, protocol=5)


def _loaded(value):
    import pickle

    return pickle.loads(value.as_buffer())


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@support.query("op6_ball_tree_search", SQL)
def op6(spark, sf_dir):
    vectors = support.table(spark, sf_dir, "embeddings")
    return searched(vectors, F.col("vec_id") % 50 == 0)
