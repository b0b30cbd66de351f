import itertools
import random
import re
import zlib
from collections import Counter

from flowgauge.llm import spelling, support
from tests.llm.helpers import documents, prose


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = max(a, b, key=len), min(a, b, key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    """The contract, every pair of words compared."""
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def got(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def edits(word, rng, letters="abcéÀz"):
    i, kind = rng.randrange(len(word) + 1), rng.randrange(3)
    return word[:i] + ("" if kind == 2 else rng.choice(letters)) + word[i + (kind > 0) :]


def test_variants_of_made_up_texts(spark):
    rng = random.Random(3)
    rows = [(None, "Äußerung " * 7), (1, None), (1, ""), (2, "naïvely " * 5 + "NAÏVELY " * 30), (2, "naïvely " * 5), (3, "short " * 50)]
    for i in range(10, 40):
        words = []
        for base in ("colour", "colours", "aaaaaa", "ababab", "organisé", "ÀÀÀÀÀÀb"):
            word = base
            for steps in range(4):
                words += [word] * (5 ** (3 - steps))
                word = edits(word, rng)
        rows.append((i, " ".join(rng.sample(words, len(words))) + ", " + prose(i, 60)))
    rows.append((50, prose(1, 40_000)))
    want = plain(rows)
    assert any(form is not None and root != form for _, form, root, *_ in want)
    assert got(spelling.variants(documents(spark, rows))) == want


def test_all_near_pairs_of_few_letters_are_met(spark):
    """Words of two letters have prefixes full of equal bigrams, and edits at every place."""
    words = ["".join(x) for x in itertools.product("ab", repeat=6)] + ["".join(x) for x in itertools.product("ab", repeat=7)]
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    pairs = {tuple(r) for r in spelling.near_pairs(df).collect()}
    assert pairs == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_all_near_pairs_of_random_words_are_met(spark):
    rng = random.Random(9)
    words = {"".join(rng.choices("aeéstrn", k=rng.randint(6, 11))) for _ in range(150)}
    for w in sorted(words):
        words |= {x for x in (edits(w, rng, "aeéÿ") for _ in range(6)) if len(x) >= 6}
    words = sorted(words)
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    pairs = [tuple(r) for r in spelling.near_pairs(df).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_pivots_are_disjoint_and_rarest():
    rng = random.Random(1)
    for _ in range(2_000):
        order = [rng.randrange(rng.choice((3, 30))) for _ in range(rng.randint(5, 14))]
        places = spelling.prefix(order)
        assert len(places) >= 3
        a, b = spelling.pivots(order, places)
        assert b - a >= 2 and {a, b} <= set(places)
        assert order[a] + order[b] == min(order[i] + order[j] for i in places for j in places if j - i >= 2)


def test_words_that_meet_share_much(spark):
    """A bigram that all words hold does not bring them all together."""
    rng = random.Random(5)
    words = sorted({"qu" + "".join(rng.choices("abcdefghijklm", k=8)) for _ in range(3_000)})
    keys = spelling._keys(spark.createDataFrame([(w,) for w in words], "word string"), spelling.gram_ranks(
        spark.createDataFrame([(w, 5) for w in words], "word string, n long")))
    index, asked = keys.where("pivot"), keys.where("not pivot").withColumnRenamed("word", "other")
    assert index.join(asked, "key").count() < 20 * len(words)


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(21)] + [("x", "w3")]
    got_roots = {tuple(r) for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got_roots == {(w, "w21") for w, _ in chain}


def test_no_rows_and_no_words(spark):
    docs = documents(spark, [(1, "a few short words")])
    assert spelling.variants(docs).collect() == [] and spelling.variants(docs.where("false")).collect() == []


def test_the_query_reads_whole_tables(spark):
    rows = support.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    assert got(support.QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001")) == plain([tuple(r) for r in rows])
