"""Every stage of the pipeline against a plain account of what it must do to its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowgauge.llm import mixing, packing, quality, support
from tests.llm.helpers import words
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark):
    docs = support.table(spark, SF, "documents")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = support.stored(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_are_named_in_order_and_return_documents(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert kept[name].columns == COLUMNS


def test_rejected_documents_go_and_good_ones_stay(spark, kept):
    docs = kept["documents"]
    model = quality.fitted(docs, support.table(spark, SF, "labels"))
    stay = {r.doc_id for r in quality.scored(docs, model).where(F.col("score") >= 0.3).collect()}
    assert sorted(rows(kept["quality"])) == sorted(r for r in rows(docs) if r[0] in stay)
    marks = {r.doc_id: r.quality for r in support.table(spark, SF, "labels").collect()}
    assert sum(i in stay for i, q in marks.items() if q == 1) >= 0.98 * sum(marks.values())


def test_one_row_of_each_text_stays(kept):
    best = {}
    for i, t in rows(kept["quality"]):
        best[t or ""] = max(best.get(t or "", i), i)
    assert sorted(rows(kept["exact_dedup"])) == sorted((i, t) for t, i in best.items())


def test_one_row_of_each_near_group_stays(kept):
    before = rows(kept["exact_dedup"])
    want = brute(before)
    assert sorted(rows(kept["near_dedup"])) == sorted(r for r in before if want[r[0]][1] == r[0])


def test_mix_holds_every_document_and_repeats_within_the_limit(kept):
    before, after = rows(kept["near_dedup"]), rows(kept["mixing"])
    assert set(after) == set(before)
    assert max(after.count(r) for r in set(after)) <= corpus_pipeline.EPOCHS
    sizes = {}
    for r in kept["mixing"].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    first = {}
    for r in kept["near_dedup"].collect():
        first[r.source] = first.get(r.source, 0) + len(words(r.text))
    assert max(sizes.values()) / min(sizes.values()) <= max(first.values()) / min(first.values())
    assert mixing.GRID > 0


def test_sequences_hold_every_token(kept):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_tokenizer("word_bpe_49k.json"))
    tokens = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows(kept["mixing"]))
    got = kept["packing"].collect()
    assert sum(r.length for r in got) == tokens
    held = {}
    for r in got:
        held[r.sequence_id] = held.get(r.sequence_id, 0) + r.length
    assert max(held.values()) <= packing.CAPACITY and len(held) <= -(-tokens // packing.CAPACITY) + 1


def test_run_applies_all_stages(spark, kept):
    order = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select(*order).collect())
    assert got == sorted(tuple(r) for r in kept["packing"].select(*order).collect())
