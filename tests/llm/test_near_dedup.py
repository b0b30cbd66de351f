import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowgauge.llm import near_dedup, shingles, support
from tests.llm.helpers import documents, prose, shingle_set


def brute(rows):
    """Components over all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingle_set(t))
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, shared in Counter(j for x in s for j in holders[x] if i is not None and j is not None and j < i).items():
            if 100 * shared >= 75 * (len(s) + len(sets[j]) - shared):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def edited(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = prose(rng.randint(0, 10**9), 1)
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(i, prose(seed * 1000 + i, rng.randint(1, 120))) for i in range(150)]
    base = prose(seed + 77, 100)
    chain = base
    for i in range(200, 260):  # a chain whose ends differ: each is close to the one before
        rows.append((i, chain))
        chain = edited(chain, rng, 2)
    for i in range(300, 380):  # a group around one text, some of them just outside
        rows.append((i, edited(base, rng, rng.randint(0, 6))))
    passage = prose(seed + 5, 60)
    for i in range(400, 440):  # a passage that many otherwise different texts hold
        rows.append((i, passage + " " + prose(seed * 31 + i, rng.randint(15, 60))))
    rows += [(i, base.upper()) for i in range(500, 520)]
    rows += [(600, None), (601, ""), (602, " \n"), (603, "three words only"), (604, "Three  WORDS\tonly"), (605, "three words"), (606, prose(6, 30_000)),
             (607, prose(6, 30_000) + " more")]
    rng.shuffle(rows)
    return rows


def check(spark, rows):
    got = near_dedup.marked(documents(spark, rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    wrong = [(r.doc_id, r.component_id, want[r.doc_id]) for r in got
             if r.doc_id is not None and ((r.n_shingles, r.component_id) != want[r.doc_id] or r.kept != (r.doc_id == r.component_id))]
    assert not wrong, wrong[:5]
    return got


def test_components_are_those_of_all_pairs(spark):
    check(spark, corpus(1))


@pytest.mark.parametrize("seed", [2, 4])
def test_large_buckets_are_compared_in_blocks(spark, monkeypatch, seed):
    for name, value in (("PAIRS", 2), ("BLOCK", 7), ("COLUMNS", 50)):
        monkeypatch.setattr(near_dedup, name, value)
    check(spark, corpus(seed))


def test_overlaps_are_those_of_sets():
    rng = np.random.default_rng(0)
    left, right = ([np.unique(rng.integers(0, 300, rng.integers(0, 90), np.uint64)) for _ in range(n)] for n in (9, 13))
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in right] for x in left]
    assert near_dedup.overlaps(left, right).tolist() == want
    assert near_dedup.overlaps([], right).shape == (0, 13)


def test_rows_that_repeat_and_rows_without_id(spark):
    text = prose(1, 50)
    rows = [(5, text), (5, text), (7, text + " tail"), (None, text), (None, None), (9, "x")]
    got = check(spark, rows)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2


def test_survivors_keep_their_columns(spark):
    docs = documents(spark, corpus(3)[:200])
    kept = near_dedup.survivors(docs)
    assert kept.columns == docs.columns
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_nothing_in_nothing_out(spark):
    docs = documents(spark, [(1, "x")]).limit(0)
    assert near_dedup.marked(docs).count() == 0 and near_dedup.survivors(docs).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_alternating_stars_find_the_least_node(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(50, 150), rng.randint(50, 150)) for _ in range(70)] + [(200, i) for i in range(201, 230)] + [(7, 7)]
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for e in edges for n in e if root(n) != n}


def test_bands_make_a_miss_unlikely():
    assert (1 - 0.75**near_dedup.ROWS) ** near_dedup.BANDS < 1.1e-6


def test_minima_estimate_the_similarity():
    rng = np.random.default_rng(3)
    shared, a, b = (rng.integers(0, 1 << 63, n, np.uint64) for n in (700, 150, 150))
    minhash = shingles.MinHash(1024, 1)
    one, two = minhash.minima(np.concatenate([shared, a])), minhash.minima(np.concatenate([shared, b]))
    assert abs((one == two).mean() - 0.7) < 0.06


def test_shingles_are_those_of_word_runs():
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["a", "B", "c\x0b", "d", "é", "É"], k=rng.randint(0, 12))) for _ in range(300)] + [None, "", "  a b ", "A B"]
    sets = [frozenset(own.tolist()) for _, own in shingles.shingle_sets(pa.array(texts))]
    plain = [frozenset(shingle_set(t)) for t in texts]
    for i in range(len(texts)):
        assert len(sets[i]) == len(plain[i])
        for j in range(i):
            assert len(sets[i] & sets[j]) == len(plain[i] & plain[j])


def test_texts_of_one_id_are_judged_each(spark):
    near, other, third = prose(1, 80), prose(2, 80), prose(3, 60)
    rows = [(1, near), (5, near + " tail"), (5, other), (6, other + " more"), (7, third), (7, third + " end"), (8, "")]
    docs = documents(spark, rows)
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.marked(docs).collect()}
    assert got[5, len(shingle_set(near + " tail"))] == (1, False)
    assert got[5, len(shingle_set(other))] == (5, True) and got[6, len(shingle_set(other + " more"))] == (5, False)
    kept = near_dedup.survivors(docs)
    assert kept.columns == docs.columns
    left = sorted((r.doc_id, r.text) for r in kept.collect())
    assert [x for x in left if x[0] != 7] == [(1, near), (5, other), (8, "")] and sum(i == 7 for i, _ in left) == 1


def test_survivors_of_columns_with_any_name(spark):
    near, other = prose(1, 80), prose(2, 80)
    docs = documents(spark, [(1, near), (5, near + " tail"), (5, other)])
    for name in ("_drop", "_both", "_own", "_key", "_gone", "_held", "____gone"):
        docs = docs.selectExpr("*", f"'x' AS `{name}`")
    kept = near_dedup.survivors(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text, r._drop) for r in kept.collect()) == [(1, near, "x"), (5, other, "x")]


def test_the_query_keeps_the_id_of_its_component(spark):
    rows = [(1, prose(1, 80)), (1, prose(1, 80) + " tail"), (2, prose(1, 80) + " end"), (None, prose(3, 60))]
    documents(spark, rows).write.parquet(path := support.scratch_dir(spark, "near-test") + "/documents.parquet")
    got = support.QUERIES["op9_near_dedup"](spark, path.rsplit("/", 1)[0]).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
