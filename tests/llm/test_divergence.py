import re
from collections import Counter

import numpy as np

from flowgauge.llm import divergence, support
from tests.llm.helpers import CLASH, prose


def documents(spark, rows):
    """``rows``: (doc_id, text, lang, source)."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    for name in (*CLASH, "term", "total", "tile", "rank", "value", "n", "terms", "whole", "class"):
        if name not in df.columns:
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def plain(rows, ranks=divergence.RANKS):
    """The contract, spelt out over dense counts."""
    found, docs, groups = {}, {}, {}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        found.setdefault((lang, source), Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        of = {s: {t: found[lang, s][t] for t in kept} for s in sources}
        of_lang = {t: sum(of[s][t] for s in sources) for t in kept}

        def shares(counts):
            total = sum(counts.values()) + len(kept)
            return {t: 1 + 1_000_000_000 * (n + 1) // total for t, n in counts.items()}

        p, q = {s: shares(of[s]) for s in sources}, shares(of_lang)
        for s in sources:
            pairs = [(x, sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in kept)) for x in sources if x != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


ROWS = [(i, prose(i, 40 + i % 7), "ab"[i % 2], f"s{i % 5}") for i in range(60)] + [
    (None, None, None, None), (1, "", "a", "bare"), (2, "é É ñandú don't x1y", "c", "one"), (3, "é É x y", "c", ""), (4, "É x", "c", "one"), (5, "É", "c", "two"),
    (6, "only once", "d", "p"), (7, None, "d", "q"), (8, "1 2 3", "d", "r"), (9, prose(3, 30_000), "a", "s1"), (9, prose(3, 30), "a", "s1")]


def test_results_are_those_of_dense_counts(spark):
    assert got(divergence.audited(documents(spark, ROWS))) == plain(ROWS)


def test_many_small_blocks_and_tiles_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 8)
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "HELD", 50)
    assert got(divergence.audited(documents(spark, ROWS), ranks=3)) == plain(ROWS, 3)


def test_no_rows(spark):
    assert got(divergence.audited(documents(spark, ROWS[:1]).where("false"))) == set()


def test_equal_subtrees_are_one_node_and_priced_once():
    counts = np.zeros((3, 1000), np.int64)
    counts[0, 3], counts[1, 3], counts[2, 900] = 5, 5, 7
    trees = divergence.Trees(counts)
    assert trees.roots[0] == trees.roots[1] != trees.roots[2]
    # ten levels over 1,024 places hold 3,069 nodes unshared
    assert sum(len(level) for level in trees.levels) < 60
    pair, x, y, places = trees.met(np.array([0, 0]), np.array([1, 2]))
    assert sorted(zip(pair.tolist(), x.tolist(), y.tolist(), places.tolist())) == [
        (0, 0, 0, 999), (0, 5, 5, 1), (1, 0, 0, 998), (1, 0, 7, 1), (1, 5, 0, 1)]


def test_prices_of_random_trees_and_of_huge_counts():
    rng = np.random.default_rng(4)
    for terms, most in ((1, 3), (2, 9), (37, 4), (300, 50), (5, 1 << 40)):
        counts = rng.integers(0, most, (6, terms))
        totals = counts.sum(axis=1) + terms
        one, two = np.triu_indices(6, 1)
        there, back = divergence.prices(divergence.Trees(counts), totals, one, two)
        p = [[1 + 10**9 * (int(n) + 1) // int(t) for n in row] for row, t in zip(counts, totals)]
        for a, b, x, y in zip(one, two, there, back):
            assert x == sum((s - t) ** 2 // t for s, t in zip(p[a], p[b]))
            assert y == sum((s - t) ** 2 // s for s, t in zip(p[a], p[b]))


def test_the_query_reads_whole_tables(spark):
    df = support.QUERIES["op11_source_divergence"](spark, "/root/testdata/sf0.001")
    rows = support.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang", "source").collect()
    assert got(df) == plain([tuple(r) for r in rows])
