import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from flowgauge.llm import packing, support
from tests.llm.helpers import documents, prose

PATH = packing.public_tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


TEXTS = ["", " \n\t", "Hello, world. It's 12-34!", "a<|endoftext|>b", "<|ENDOFTEXT|> x", "don't I'LL we've 's", "é É́", "x\x1cy\x85z",
         "q r s", "İſK", "çé,à;ü! ß.", "́abc ...", "a.b.c $$$ %%", "a÷b c÷, ×d", "日本語 text. 🙂🙂", "Σας ΟΔΟΣ", prose(3, 500), "w" * 3000]


def test_ids_are_those_of_whole_texts(tokenizer):
    encoder = packing.Encoder(PATH)
    for _ in range(2):  # the second time from known words
        for text, ids in zip([*TEXTS, None], encoder.encode(pa.array([*TEXTS, None])), strict=True):
            assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_ids_of_random_texts(tokenizer):
    rng = random.Random(4)
    signs = list("abcXYZ  \n\t.,!'$&019éÉßñ´`́ —…<|>sStTmMdD")
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(800)]
    encoder = packing.Encoder(PATH)
    for text, ids in zip(texts, encoder.encode(pa.array(texts).slice(0)), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_few_known_words_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    monkeypatch.setattr(packing, "PART", 50)
    monkeypatch.setattr("flowgauge.llm.shingles.PART", 50)
    for text, ids in zip(TEXTS, packing.Encoder(PATH).encode(pa.array(TEXTS)), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(40))
def test_bins_hold_everything_and_few_are_used(seed):
    rng = random.Random(seed)
    lengths = np.array([rng.randint(1, 100) for _ in range(rng.randint(0, 80))], np.int64)
    bins = packing.fill_bins(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= 100 for b in bins)
    assert len(bins) <= 11 / 9 * -(-int(lengths.sum()) // 100) + len(lengths) / 8 + 1


def started(sizes, bins, capacity):
    search = packing.SwapSearch(sizes, capacity)
    for held in bins:
        search.add(held)
    return search


def start(sizes, bins, capacity):
    return started(sizes, bins, capacity).run()


def test_moves_empty_bins():
    assert sorted(map(sorted, start([5, 5, 5, 5], [[0], [1], [2], [3]], 10))) in ([[0, 1], [2, 3]], [[0, 2], [1, 3]], [[0, 3], [1, 2]])


def test_one_for_one_and_two_for_one_exchanges_empty_bins():
    # 6+3 and 5+4 leave one each; the last bin's 2 only goes once 4 and 3 change places with larger ones
    sizes = [6, 3, 5, 4, 2]
    found = start(sizes, [[0, 1], [2, 3], [4]], 10)
    assert len(found) == 2 and all(sum(sizes[i] for i in b) <= 10 for b in found)
    taker, out, back = started([3, 3, 4, 5], [[0, 1], [2, 3]], 11).best_step(0)  # both threes for the four
    assert (taker, sorted(out), back) == (1, [0, 1], 2)


@pytest.mark.parametrize("seed", range(10))
def test_every_step_raises_the_sum_of_squares(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 60) for _ in range(150)]
    search = packing.SwapSearch(sizes, 100)
    for i in range(len(sizes)):
        search.place(i)
    before, apply = len(search.bins), search.apply

    def checked(giver, taker, out, back):
        old = search.free[giver], search.free[taker]
        apply(giver, taker, out, back)
        assert min(search.free[giver], search.free[taker]) >= 0 and search.free[giver] > old[0] >= old[1] > search.free[taker]
        assert all(search.free[b] == 100 - sum(sizes[i] for i in held) for b, held in enumerate(search.bins))

    search.apply = checked
    left = search.run()
    assert sorted(i for b in left for i in b) == list(range(150)) and len(left) == before - search.steps["emptied"]
    assert all(search.best_step(b) is None for b, held in enumerate(search.bins) if held and search.free[b])


def test_the_search_packs_real_lengths(spark):
    """Pieces of the test documents as they come: the search empties most of the bins that arrival order wastes."""
    docs = support.table(spark, "/root/testdata/sf0.01", "documents")
    lengths = [r.length for r in packing.pieces(docs, PATH).where("length < 2048").orderBy("doc_id", "piece").collect()]
    search = packing.SwapSearch(lengths, 2048)
    for i in range(len(lengths)):
        search.place(i)
    first, least = len(search.bins), -(-sum(lengths) // 2048)
    found = search.run()
    assert all(sum(lengths[i] for i in b) <= 2048 for b in found) and sum(map(len, found)) == len(lengths)
    assert min(search.steps["one"], search.steps["two"], search.steps["move"]) > 0
    assert len(found) == first - search.steps["emptied"] <= least * 1.01 and first > least * 1.01


def test_packing_round_trip(spark, tokenizer):
    rows = [(i, prose(i, 3 + i * 7 % 300)) for i in range(120)] + [(200, None), (201, ""), (202, prose(9, 9000)), (203, "same"), (203, "same"), (None, "x y")]
    rows += list(enumerate(TEXTS, 300))
    got = packing.packed(documents(spark, rows, 4), PATH, capacity=256, shard=50, with_ids=True).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) // 4 <= 256 and r.ids_crc32 == zlib.crc32(r.ids) and r.start == 256 * r.piece
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    texts = {}
    for r in sorted(got, key=lambda r: r.piece):
        texts.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        mine = texts[doc_id]
        copies = 2 if doc_id == 203 else 1
        assert len(mine) == copies * -(-len(ids) // 256)
        if copies == 1:
            assert np.frombuffer(b"".join(r.ids for r in mine), "<u4").tolist() == ids
    tokens = sum(r.length for r in got)
    assert len(sequences) <= tokens / 256 * 1.02 + 6


def test_nothing_in_nothing_out(spark):
    assert packing.packed(documents(spark, [(1, "x")]).limit(0), PATH).count() == 0
