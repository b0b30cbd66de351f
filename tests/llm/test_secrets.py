import hashlib
import random
import re

import numpy as np
import pytest

from flowgauge.llm import secrets, support
from tests.llm.helpers import documents, prose

TEXTS = ["", None, "password = hunter22", "PassWord:'abc'", "token=token: abcdefgh", 'API_KEY":  "A1b2c3d4', "apikey=xxxxxx secret:yyyyyyy", "ſecret=abcdefg",
         "toKen=abcdefgh", "AKIA" + "A" * 15, "AKIA" + "Z9" * 8, "xAKIAAKIA" + "B" * 16, "0123456789abcdef01234567", "g" + "a" * 23, "é" * 5 + "a" * 30 + "Z" + "b" * 24,
         "passwd==abcdef", "secret = \"=ab", "api-key=abcdefgh", "akia" + "a" * 20, prose(1, 50_000) + " token=abcdef123 " + prose(2, 10),
         "-----BEGIN RSA PRIVATE KEY-----", "eyJ" + "a" * 20 + "." + "b" * 20 + "." + "c" * 20, "http://user:pw@host/x", "token=token=token=abcdef"]


def base_spans(text):
    """The contract's definition, spelt out rule by rule."""
    out = []
    word = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end(), "assign")] if len(m[1]) >= 6 else []
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def check(spark, rows):
    docs = documents(spark, rows)
    docs.write.mode("overwrite").parquet(path := support.scratch_dir(spark, "secret-test") + "/documents.parquet")
    got = support.QUERIES["op10_secret_scan"](spark, path.rsplit("/", 1)[0]).collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    assert len(got) == len(rows)
    for r in got:
        want = base_spans(texts[r.doc_id] or "")
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for k, _, _ in want) for n in ("assign", "access", "hex")], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        kinds = {"assign", "access", "hex"}
        assert [s for s in r.spans.split(",") if s.split(":")[0] in kinds] == [f"{k}:{s}:{e}" for k, s, e in want]
    return got


def test_spans_are_those_of_the_definition(spark):
    got = check(spark, [*enumerate(TEXTS), (3, TEXTS[3]), (None, "token=abcdef12")])
    found = {s.split(":")[0] for r in got for s in r.spans.split(",")}
    assert {"pem", "jwt", "url_login"} <= found


def test_random_texts(spark, monkeypatch):
    monkeypatch.setattr(secrets, "SEGMENT", 300)
    rng = random.Random(3)
    bits = ["token", "Secret", "api_key", "passwd", "AKIA", "deadbeef", "0123", "=", ":", " ", "'", '"', "XYZ09", "-", "é", "\n", "abcdef"]
    check(spark, [(i, "".join(rng.choices(bits, k=rng.randint(0, 30)))) for i in range(400)])


def test_nothing_in_nothing_out(spark):
    assert secrets.scanned(documents(spark, [(1, "x")]).limit(0)).count() == 0


PATTERNS = [("abc(de|fg)h+i?jkl", False, ["abcdehjkl", "abcfghhijkl"]), ("x{2,3}yz", False, ["xxyz", "xxxyz"]), ("a.c", False, ["abc"]),
            ("(foo|ba[rz])+qux", True, ["fooBAZqux", "BARQUX"]), ("(ab)?cde", False, ["cde", "abcde"]), ("^start.*end$", False, ["start7end"]),
            ("[a-z]+word[0-9]", True, ["aWORD7"]), ("(?:ab|c)(?:d|efg)hij*", False, ["cdhi", "abefghijj"])]


@pytest.mark.parametrize("pattern, any_case, examples", PATTERNS)
def test_every_match_satisfies_its_trigram_query(pattern, any_case, examples):
    rule = secrets.Rule("r", pattern, any_case=any_case)
    query, expression = secrets.trigram_query(rule), rule.compiled()
    rng = random.Random(pattern)
    bits = ["a", "b", "c", "de", "h", "jkl", "x", "yz", "foo", "bar", "QUX", "cde", "start", "end", "word", "7", "i"]
    texts = examples + ["".join(rng.choices(bits, k=rng.randint(0, 6))) + ("" if pattern[0] == "^" else rng.choice([*examples, ""])) + rng.choice(bits)
                        for _ in range(1000)]
    lists = secrets.postings([t.encode().lower() for t in texts], secrets.trigrams(query))
    passed = set(secrets.candidates(query, lists, len(texts)).tolist())
    matching = {i for i, t in enumerate(texts) if expression.search(t)}
    assert set(range(len(examples))) <= matching <= passed


def test_queries_of_the_rules():
    asked = {r.kind: secrets.trigram_query(r) for r in secrets.BASE}
    assert asked["hex"] is True and secrets.trigrams(asked["access"]) == {b"aki", b"kia"}
    lists = secrets.postings([b"my secret", b"nothing here", b"a token", b"se cret"], secrets.trigrams(asked["assign"]))
    assert np.array_equal(secrets.candidates(asked["assign"], lists, 4), [0, 2])
