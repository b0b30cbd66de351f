import hashlib

from pyspark.sql import functions as F

from flowgauge.llm import exact_dedup
from tests.llm.helpers import documents, prose

LONG = prose(1, 60_000)
ROWS = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, " "), (6, LONG), (7, LONG), (7, LONG), (8, "A b"), (None, "only"), (None, "a b"),
        (9, "unique")] + [(i, "hot") for i in range(100, 700)]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_marks_as_a_plain_grouping_does(spark):
    got = exact_dedup.marked(documents(spark, ROWS, 8)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(ROWS)


def test_texts_that_share_a_digest_stay_apart(spark):
    rows = [(i, t) for i, t in ROWS if t != LONG]
    weak = exact_dedup.marked(documents(spark, rows), digest=lambda t: F.length(t).cast("string")).drop("digest").collect()
    assert sorted((tuple(r) for r in weak), key=str) == sorted((r[:4] for r in expected(rows)), key=str)


def test_survivors_have_their_columns_and_come_once(spark):
    docs = documents(spark, ROWS, 8)
    got = exact_dedup.survivors(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(((r.doc_id, r.text or "") for r in rows), key=str) == sorted(
        {(e[1], t or "") for e, t in ((x, next(t for i, t in ROWS if hashlib.sha256((t or "").encode()).hexdigest() == x[4])) for x in expected(ROWS))}, key=str)
    assert {r.digest for r in rows} == {"x"} and {r.n_chars for r in rows} == {7}


def test_nothing_in_nothing_out(spark):
    docs = documents(spark, ROWS).limit(0)
    assert exact_dedup.marked(docs).count() == 0 and exact_dedup.survivors(docs).count() == 0


def test_a_task_reduces_its_copies_before_the_shuffle(spark):
    plan = exact_dedup.classes(documents(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max") >= 2 and "Python" not in plan
