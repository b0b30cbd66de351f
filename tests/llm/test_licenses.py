import random

import pytest

from flowgauge.llm import licenses
from tests.llm.helpers import documents, prose


def cleaned(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    import re

    return [w for w in (licenses.clean(x) for x in re.findall(r"[^\x20\x09-\x0D]+", lower)) if w]


def brute(text, templates=licenses.TEMPLATES):
    """Every window against every template."""
    words = cleaned(text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    out = {}
    for number, (_, template) in enumerate(templates):
        t = cleaned(template)
        own = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        step = 1 << (len(own) - 1).bit_length()
        for at in range(0, len(runs), step):
            window = runs[at : at + 2 * step]
            found = len(own & set(window))
            if 100 * found >= 75 * len(own) and found > out.get(number, (0,))[0]:
                hit = [i for i, x in enumerate(window) if x in own]
                out[number] = (found, len(own), at + hit[0], at + hit[-1] + 5)
    return out


def varied(template, rng):
    words = template.split()
    for _ in range(rng.randint(0, 2)):
        words[rng.randrange(len(words))] = "changed"
    return " ".join(words).upper() if rng.random() < 0.3 else " ".join(words)


def test_matches_are_those_of_all_windows(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        parts = [prose(i * 10 + k, rng.randint(0, 60)) for k in range(3)]
        for k in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), varied(rng.choice(licenses.TEMPLATES)[1], rng))
        rows.append((i, "\n".join(parts)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "... -- !!"), (204, prose(4, 40_000) + licenses.TEMPLATES[5][1]),
             (205, licenses.TEMPLATES[0][1] * 1), (205, licenses.TEMPLATES[0][1] * 1), (None, licenses.TEMPLATES[3][1])]
    got = licenses.scanned(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    hits = 0
    for r in got:
        want = brute(texts[r.doc_id])
        assert {m.template: (m.found, m.shingles, m.start, m.end) for m in r.matches} == want
        hits += len(want)
    assert hits > 80


def test_bands_make_a_miss_unlikely():
    for group in licenses.Index(licenses.TEMPLATES).groups:
        for _, own, need in group.templates:
            similarity = need / (2 * group.step + len(own) - need)
            assert group.bands <= 256 and (1 - similarity) ** group.bands <= licenses.MISS


def test_templates_below_the_shingle_width_are_refused():
    with pytest.raises(ValueError):
        licenses.Index((("X", "too short"),))


def test_nothing_in_nothing_out(spark):
    assert licenses.scanned(documents(spark, [(1, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize("number", range(len(licenses.TEMPLATES)))
def test_every_occurrence_is_returned(spark, tmp_path, number):
    from flowgauge.llm import support

    template = licenses.TEMPLATES[number][1]
    size = len(cleaned(template))
    rows = [(1, f"{template} {prose(1, 300)} {template}"), (2, f"{template} {template}\n{template}"),
            (3, prose(2, 40) + " " + template + " " + prose(3, 10) + " " + template.upper()), (4, prose(4, 50))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in support.QUERIES["op8_license_scan"](spark, str(tmp_path)).collect()}
    mine = {i: [tuple(map(int, x.split(":")[3:])) for x in r.spans.split(",") if x.split(":")[0] == str(number)] for i, r in got.items()}
    gap = [len(cleaned(prose(s, n))) for s, n in ((1, 300), (2, 40), (3, 10))]
    assert mine[1] == [(0, size), (size + gap[0], 2 * size + gap[0])]
    assert mine[2] == [(0, size), (size, 2 * size), (2 * size, 3 * size)]
    assert mine[3] == [(gap[1], gap[1] + size), (gap[1] + size + gap[2], gap[1] + 2 * size + gap[2])]
    assert mine[4] == [] and got[1].n_matches == len(got[1].spans.split(","))
