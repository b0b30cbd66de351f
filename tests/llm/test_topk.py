import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.llm import topk


def brute(rows, k):
    known = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            known[i] = [math.floor(256 * x) for x in e]
    out = []
    for q, v in known.items():
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in known.items() if i != q and len(w) == len(v))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(found[:k])]
    return sorted(out)


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for name in ("id", "vector", "size", "asks", "shard", "tree", "score", "rank"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def run(spark, rows, **more):
    return sorted(tuple(r) for r in topk.searched(table(spark, rows), F.col("vec_id") % 50 == 0, **more).collect())


def rounded(values):
    return [float(np.float32(v)) for v in values]


@pytest.mark.parametrize("kind", ["random", "clusters", "ties"])
def test_search_agrees_with_brute_force(spark, kind):
    rng = random.Random(kind)
    rows = []
    for i in range(700):
        if kind == "ties":
            v = [float(rng.randint(-1, 1)) for _ in range(3)]
        elif kind == "clusters":
            v = [math.cos(i % 7 * d) + rng.gauss(0, 0.05) for d in range(8)]
        else:
            v = [rng.gauss(0, 1) for _ in range(8)]
        rows.append((i, rounded(v)))
    assert run(spark, rows, shard=90) == brute(rows, 5)


def test_odd_rows_take_no_part(spark):
    good = [(i, rounded([i * 0.01, 1 - i * 0.02])) for i in range(101)]
    odd = [(150, None), (200, [1.0, None]), (250, [float("nan"), 1.0]), (300, [float("inf"), 1.0]), (None, [1.0, 1.0]), (350, []), (400, [1.0, 2.0, 3.0]),
           (450, [2.0, 2.0, 3.0]), (0, good[0][1]), (7, good[7][1])]
    got = run(spark, good + odd, shard=30)
    want = [r for r in brute(good + odd[:-2], 5) if r[0] != 350]
    assert [r for r in got if r[0] != 350] == want


def test_fewer_candidates_than_k_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == brute([(0, [1.0]), (1, [2.0])], 5)
    assert run(spark, [(0, [1.0])]) == []
    assert topk.searched(table(spark, [(0, [1.0])]).limit(0), F.lit(True)).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(2**18 - i)]) for i in range(60)]
    assert run(spark, rows, shard=16) == brute(rows, 5)


def test_bounds_leave_nodes_out():
    rng = np.random.default_rng(2)
    vectors = np.concatenate([rng.integers(-5, 5, (2000, 6)) + 1000 * np.eye(6, dtype=int)[i] for i in range(6)])
    tree = topk.BallTree.build(np.arange(len(vectors)), vectors)
    read = []
    plain = topk.products
    try:
        topk.products = lambda v, q: read.append(len(v)) or plain(v, q)
        tree.search(vectors[0], 0, 5, [], None)
    finally:
        topk.products = plain
    assert 0 < sum(read) < len(vectors) / 3


def test_nothing_is_broadcast(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(120)]
    found = topk.searched(table(spark, rows), F.col("vec_id") % 50 == 0, shard=10)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 5)


def test_queries_search_a_tree_together():
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.integers(-4, 5, (300, 4)) + 50 * np.eye(4, dtype=int)[i] for i in range(4)]).astype(np.int16)
    ids = rng.permutation(len(vectors))
    tree = topk.BallTree.build(ids, vectors, leaf=16)
    asking = rng.integers(0, len(vectors), 40)
    scores = vectors[asking].astype(int) @ vectors.astype(int).T
    want = [sorted((-s, i) for s, i in zip(row.tolist(), ids.tolist()) if i != ids[q])[:5] for row, q in zip(scores, asking)]
    floors = [None if n % 3 else -w[-1][0] for n, w in enumerate(want)]
    best = [[] for _ in asking]
    tree.search_all(vectors[asking], ids[asking].tolist(), 5, best, floors)
    assert [sorted((-s, -i) for s, i in heap) for heap in best] == want
