import math

import duckdb
import pytest

from flowgauge.llm import mixing, support
from tests.llm.helpers import documents, prose, words

ROWS = [(i, prose(i, 5 + i % 40), f"s{min(i % 11, 4)}") for i in range(300)] + [
    (900, None, "s1"), (901, "", "s1"), (902, " \n", None), (903, prose(5, 9), None), (904, prose(6, 4000), "s2"), (905, "", "empty"),
    (906, prose(7, 9), "s3"), (906, prose(7, 9), "s3"), (None, prose(8, 30), "s0")]


def totals(spark, rows):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    whole = sum(sizes.values())
    return spark.createDataFrame([(str(s), n, n / whole) for s, n in sizes.items()], "source string, tokens long, share double"), sizes


def entropy(sizes, alpha):
    w = [n**alpha for n in sizes if n]
    return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)


def test_exponent_meets_the_entropy_and_no_larger_one_does(spark):
    table, sizes = totals(spark, ROWS)
    target = 0.9
    alpha = mixing.temperature(table, entropy=target)
    most = math.log(sum(1 for n in sizes.values() if n))
    step = 1 / mixing.GRID
    assert entropy(sizes.values(), alpha) >= target * most - 1e-9
    assert alpha == 1 or entropy(sizes.values(), alpha + step) < target * most + 1e-9
    assert mixing.temperature(table, entropy=1.0 + 1e-6) == 0 and mixing.temperature(table, entropy=0.01) == 1


@pytest.mark.parametrize("limit", [1.5, 3.0])
def test_exponent_keeps_to_the_repetition_limit_and_no_smaller_one_does(spark, limit):
    table, sizes = totals(spark, ROWS)
    budget = sum(sizes.values())

    def repeats(alpha):
        z = sum(n**alpha for n in sizes.values() if n)
        return max(n**alpha / z * budget / n for n in sizes.values() if n)

    alpha = mixing.temperature(table, epochs=limit, budget=budget)
    assert repeats(alpha) <= limit + 1e-9
    assert alpha == 0 or repeats(alpha - 1 / mixing.GRID) > limit - 1e-9


def test_quotas_are_filled_and_epochs_are_permutations(spark):
    docs = documents(spark, ROWS, 5)
    uses = mixing.mixed(docs, epochs=4.0, budget=9000, block_tokens=200)
    rows = uses.select("row.doc_id", "row.source", "row.block", "tokens", "quota", "epoch", "block_start").collect()
    assert {r[2] for r in rows} == {"x"}  # the clashing column is inside `row`
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    assert "empty" not in by and None in by
    _, sizes = totals(spark, ROWS)
    longest = max(len(words(t)) for _, t, _ in ROWS)
    for source, mine in by.items():
        used, quota = sum(r.tokens for r in mine), mine[0].quota
        assert quota - longest < used <= quota
        members = sorted(str(i) for i, _, s in ROWS if s == source)
        for epoch in range(quota // sizes[source]):
            assert sorted(str(r.doc_id) for r in mine if r.epoch == epoch) == members
        part = [str(r.doc_id) for r in mine if r.epoch == quota // sizes[source]]
        assert all(part.count(d) <= members.count(d) for d in set(part))
    assert sum(q for q in {s: m[0].quota for s, m in by.items()}.values()) <= 9000


def test_least_budget_uses_every_document(spark):
    uses = mixing.mixed(documents(spark, ROWS), epochs=2.0, budget=None, block_tokens=300).collect()
    used = [r.row.doc_id for r in uses]
    assert {i for i, _, s in ROWS if s != "empty"} <= set(used)
    assert max(used.count(d) for d in set(used) - {906}) <= 2


def test_twin_agrees_on_small_blocks(spark, tmp_path):
    docs = documents(spark, ROWS).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    sql = mixing.SQL.replace("65535", "199").replace("65536", "200")
    expected = sorted(map(str, con.execute(sql).fetchall()))
    uses = mixing.mixed(docs, entropy=mixing.ENTROPY, epochs=mixing.EPOCHS, block_tokens=200)
    got = uses.select("row.doc_id", "row.source", "tokens", "quota", "epoch", "block", "block_start").collect()
    assert sorted(str(tuple(r)) for r in got) == expected


def test_nothing_in_nothing_out_and_no_python(spark):
    docs = documents(spark, ROWS)
    assert mixing.mixed(docs.limit(0), entropy=0.9).count() == 0
    plan = mixing.mixed(docs, entropy=0.9)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "op1_source_mixing" in support.QUERIES


def test_a_source_without_words_is_used_once_without_a_budget(spark):
    rows = [(i, prose(i, 20), "a") for i in range(40)] + [(i, prose(i, 20), "b") for i in range(40, 50)]
    rows += [(100, "", "c"), (101, " \n", "c"), (102, None, "c"), (103, "", None)]
    docs = documents(spark, rows)
    used = [r.row.doc_id for r in mixing.mixed(docs, epochs=2.0, budget=None).collect()]
    assert {i for i, _, _ in rows} == set(used) and all(used.count(i) == 1 for i in (100, 101, 102, 103))
    empty = documents(spark, rows[-4:])
    assert sorted(r.row.doc_id for r in mixing.mixed(empty, epochs=2.0, budget=None).collect()) == [100, 101, 102, 103]
    assert not {100, 101, 102, 103} & {r.row.doc_id for r in mixing.mixed(docs).collect()}
