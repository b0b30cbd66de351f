import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.llm import quality, support
from tests.llm.helpers import documents, prose


def bad(seed):
    return " | ".join(prose(seed, 40).upper().split()) + " !!!"


ROWS = [(i, prose(i, 20 + i % 90) if i % 4 else bad(i)) for i in range(400)]
ODD = [(900, None), (901, ""), (902, " \n "), (903, prose(1, 50_000)), (904, ROWS[1][1]), (904, ROWS[1][1]), (None, ROWS[4][1])]


def labels(spark, rows):
    return spark.createDataFrame([(i, q, 0) for i, q in rows], "doc_id long, quality int, toxic int")


def test_learns_the_form_and_scores_every_row(spark):
    docs = documents(spark, ROWS + ODD)
    marks = labels(spark, [(i, int(i % 4 != 0)) for i in range(400)] + [(3, None), (None, 1), (5000, 0), (1, 1)])
    model = quality.fitted(docs, marks)
    got = quality.scored(docs, model).collect()
    assert len(got) == len(ROWS + ODD) and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got if r.doc_id is not None}
    assert all((scores[i] >= quality.THRESHOLD) == (i % 4 != 0) for i in range(400))
    assert scores[904] == scores[1] and scores[900] == scores[901] == scores[902]
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.where("digest = 'x'").count() == sum(r.score >= quality.THRESHOLD for r in got)
    again = {r.doc_id: r.score for r in quality.scored(docs, quality.fitted(docs, marks)).collect() if r.doc_id is not None}
    assert again == scores


def test_labels_source_language_and_id_are_no_inputs(spark):
    docs = documents(spark, ROWS)
    model = quality.fitted(docs, labels(spark, [(i, int(i % 4 != 0)) for i in range(400)]))
    other = docs.withColumns({"doc_id": F.col("doc_id") + 10_000, "lang": F.lit("zz"), "source": F.lit(None), "n_chars": F.lit(0)})
    one = sorted(r.score for r in quality.scored(docs, model).collect())
    assert one == sorted(r.score for r in quality.scored(other, model).collect())


def test_rows_of_remainder_zero_teach_nothing(spark):
    docs = documents(spark, ROWS)
    right = [(i, int(i % 4 != 0)) for i in range(400)]
    import zlib

    held = {i for i, _ in right if zlib.crc32(str(i).encode()) % 5 == 0}
    wrong = [(i, 1 - q if i in held else q) for i, q in right]
    a, b = (quality.fitted(docs, labels(spark, rows)) for rows in (right, wrong))
    assert a.base == b.base and all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True))


def test_interactions_are_learnt():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (2000, len(quality.FIGURES)))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # no figure alone says anything
    model = quality.train(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    assert {0, 1} in [{f, g} for f, g, *_ in model.pairs]


def test_without_both_labels_all_get_the_share(spark):
    docs = documents(spark, ROWS[:20] + ODD)
    none = quality.scored(docs, quality.fitted(docs, labels(spark, []))).collect()
    assert {r.score for r in none} == {0.5}
    ones = quality.scored(docs, quality.fitted(docs, labels(spark, [(i, 1) for i in range(20)]))).collect()
    assert len({r.score for r in ones}) == 1 and ones[0].score > 0.9
    assert quality.scored(docs.limit(0), quality.train(np.zeros((0, len(quality.FIGURES))), np.zeros(0))).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_labels_are_found(spark, sf):
    found = support.QUERIES["op3_quality_model"](spark, f"/root/testdata/{sf}")
    marks = support.table(spark, f"/root/testdata/{sf}", "labels")
    rows = found.where("held_out").join(marks, "doc_id").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    good = [r.score for r in rows if r.quality == 1]
    poor = [r.score for r in rows if r.quality == 0]
    assert np.mean([g > p for g in good for p in poor]) > 0.97


def test_figures_are_finite_for_any_text():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("ab é\n\t|.!🙂0A\x00", k=rng.randint(0, 50)))
        values = quality.figures(text)
        assert len(values) == len(quality.FIGURES) and np.isfinite(values).all()


def test_many_rows_of_one_label_do_not_crowd_out_the_other(spark, monkeypatch):
    """More rows join than labels were sampled; those of label 0 alone would fill any bound on rows."""
    marks = labels(spark, [(i, int(i % 4 != 0)) for i in range(400)])
    often = documents(spark, ROWS + [ROWS[8]] * 1000)
    scores = {r.doc_id: r.score for r in quality.scored(often, quality.fitted(often, marks, sample=400)).collect()}
    assert all((scores[i] >= quality.THRESHOLD) == (i % 4 != 0) for i in range(400))
    monkeypatch.setattr(quality, "TEXTS", 2)
    mixed = documents(spark, ROWS + [(8, bad(i)) for i in range(1000, 2000)])  # one id, many different texts
    model = quality.fitted(mixed, marks, sample=400)
    scores = {r.doc_id: r.score for r in quality.scored(documents(spark, ROWS), model).collect()}
    assert all((scores[i] >= quality.THRESHOLD) == (i % 4 != 0) for i in range(400))


def test_a_weight_is_as_good_as_repeated_rows():
    rng = np.random.default_rng(3)
    x, times = rng.uniform(-1, 1, (300, len(quality.FIGURES))), rng.integers(1, 5, 300)
    y = (x[:, 0] + 0.5 * rng.uniform(-1, 1, 300) > 0).astype(float)
    one, two = quality.train(x, y, times.astype(float)), quality.train(np.repeat(x, times, axis=0), np.repeat(y, times))
    assert np.allclose(one.score(x), two.score(x), atol=1e-6)
