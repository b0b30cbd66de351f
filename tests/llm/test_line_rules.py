import re

from flowgauge.llm import line_rules, support
from tests.llm.helpers import documents, prose

GOOD = ". ".join(prose(i, 12).capitalize() for i in range(6)) + "."
TEXTS = [None, "", " \n\t", GOOD, GOOD + "\nAll rights reserved.\n" + prose(9, 30).capitalize() + ".", "\n".join([GOOD, GOOD]),
         "home  Login\nmenu | about | help\n" + GOOD, "no mark here\n" + GOOD, "YES!! " * 60, "a b c " * 40 + ".", "x\x0by\x0cz\r\n\r\n" + GOOD,
         "é" * 200, "Ein Satz weiter hier. " + GOOD, "\n".join(f"item {i}" for i in range(80)), "#*$%&|<> " * 3 + GOOD,
         "\n".join(prose(i, 15) + "." for i in range(3_000)), "a a a a", "a a a", "Accept COOKIES now.\nACCEPT cookies.\n" + GOOD]


def plain(text):
    """The contract's counts, spelt out."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    places = {}
    for i, w in enumerate(windows):
        places.setdefault(w, []).append(i)
    inside = {i + d for found in places.values() if len(found) > 1 for i in found for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 500 else 0
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(inside)


def query(spark, docs):
    docs.write.parquet(path := support.scratch_dir(spark, "line-test") + "/documents.parquet")
    return support.QUERIES["op13_line_rules"](spark, path.rsplit("/", 1)[0])


def test_counts_are_those_of_the_definition(spark):
    rows = [*enumerate(TEXTS), (3, GOOD), (None, GOOD)]
    got = query(spark, documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(GOOD if r.doc_id is None else TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_failing_lines_go_and_their_rule_is_told(spark):
    got = {r.doc_id: r for r in line_rules.cleaned(documents(spark, list(enumerate(TEXTS)))).collect()}

    def rules(i):
        return [x.rule for x in got[i].removed]

    assert rules(3) == [] and got[3].kept and got[3].clean == GOOD
    assert rules(4) == ["boilerplate"] and got[4].kept and "reserved" not in got[4].clean
    assert rules(5) == ["repeated"] and got[5].clean == GOOD
    assert rules(6) == ["navigation", "navigation"] and got[6].clean == GOOD and got[6].kept
    assert rules(7) == ["punctuation"] and got[7].clean == GOOD
    assert rules(13) == ["punctuation"] * 80 and got[13].clean == "" and not got[13].kept
    assert rules(18) == ["boilerplate", "boilerplate"]
    for i, text in enumerate(TEXTS):
        left, last = [], 0
        for x in got[i].removed:
            assert text[x.start : x.end] in text.split("\n")
            left += text[last : x.start].split("\n")[:-1] if x.start else []
            last = x.end + 1
        left += (text or "")[last:].split("\n") if last <= len(text or "") else []
        assert got[i].clean == "\n".join(left)


def test_a_text_that_loses_too_much_goes(spark):
    half = "\n".join(["click here " + prose(i, 20) for i in range(3)])
    rows = [(1, GOOD + "\n" + half[:100]), (2, half + "\n" + half.replace("click", "Click ")), (3, GOOD)]
    got = {r.doc_id: r for r in line_rules.survivors(documents(spark, rows)).collect()}
    assert set(got) == {1, 3} and got[3].text == GOOD
    strict = line_rules.cleaned(documents(spark, rows), line_rules.Limits(lost=0)).collect()
    assert {r.doc_id for r in strict if r.kept} == {3}


def test_no_rows(spark):
    assert query(spark, documents(spark, [(1, "a")]).where("false")).collect() == []


def test_documents_of_the_check_data_that_are_marked_good_stay(spark):
    sf = "/root/testdata/sf0.01"
    told = support.QUERIES["op13_line_rules"](spark, sf).join(support.table(spark, sf, "labels"), "doc_id").where("not base_failed")
    counts = {(r.quality, r.kept): r["count"] for r in told.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) == 0 and counts[1, True] > 100
    assert counts.get((0, True), 0) <= counts[0, False]
