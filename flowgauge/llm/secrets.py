"""Secret scans behind a trigram index.

Every rule is a regular expression. From its parse tree follows a Boolean query over trigrams of lower-cased text that
every match must satisfy; a rule whose matches need no trigram reads all texts. A task indexes each segment of texts that
it reads: for every trigram that some rule asks for, the posting list of the texts that hold it. Posting lists are
intersected and united as the query says, and only the candidates are scanned with the expression itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, types as T

from flowgauge.llm import support

try:
    from re import _constants as _c, _parser
except ImportError:  # before Python 3.11
    import sre_constants as _c
    import sre_parse as _parser

#: Sets of literal strings larger than this are no longer spelled out in a query.
_MOST_STRINGS = 64
#: Bytes of text that one segment of the index covers.
SEGMENT = 4 << 20


@dataclass(frozen=True)
class Rule:
    """``least``: characters that a match needs, in the whole match or in ``group``; shorter matches are dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The three kinds that are counted; fixed values.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Public token shapes that are reported beside them.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("url_login", r"[a-z]+://[^\s:/@]+:[^\s:/@]+@", 12),
)

# A query is True (all texts), a trigram, or ("and" | "or", queries).


def _all(parts: list) -> object:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_string(text: str) -> object:
    data = text.lower().encode()
    return _all([data[i : i + 3] for i in range(len(data) - 2)])


def _of_strings(strings: set[str]) -> object:
    return _any([_of_string(s) for s in sorted(strings)])


def _strings(node: tuple) -> set[str] | None:
    """All strings that a part of the pattern matches, lower-cased, if they are few; else None."""
    op, value = node
    if op is _c.LITERAL:
        return {chr(value).lower()} if value < 128 else {chr(value)}
    if op is _c.SUBPATTERN:
        return _sequence_strings(value[3])
    if op is _c.BRANCH:
        found = [_sequence_strings(x) for x in value[1]]
        return None if None in found else set().union(*found)
    if op is _c.IN and all(x[0] is _c.LITERAL for x in value) and len(value) <= 8:
        return {chr(x[1]).lower() for x in value}
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and value[1] <= 2:
        once, out = _sequence_strings(value[2]), {""} if value[0] == 0 else set()
        if once is None:
            return None
        grown = {""}
        for count in range(1, int(value[1]) + 1):
            grown = {a + b for a in grown for b in once}
            out |= grown if count >= value[0] else set()
        return out
    if op is _c.AT:
        return {""}
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        found = _strings(node)
        if found is None or len(out) * len(found) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in found}
    return out


def _of_nodes(nodes) -> object:
    parts, run = [], {""}
    for node in nodes:
        found = _strings(node)
        if found is not None and len(run) * len(found) <= _MOST_STRINGS:
            run = {a + b for a in run for b in found}
            continue
        parts.append(_of_strings(run))
        run = {""} if found is None else found
        op, value = node
        if found is None and op is _c.SUBPATTERN:
            parts.append(_of_nodes(value[3]))
        elif found is None and op is _c.BRANCH:
            parts.append(_any([_of_nodes(x) for x in value[1]]))
        elif found is None and op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and value[0] > 0:
            parts.append(_of_nodes(value[2]))
    return _all([*parts, _of_strings(run)])


def trigram_query(rule: Rule) -> object:
    """What the trigrams of a lower-cased text must satisfy if ``rule`` matches in it; True: nothing is known."""
    return _of_nodes(_parser.parse(rule.pattern))


def trigrams(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams(x) for x in query[1]))


_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _code(gram: bytes) -> int:
    return gram[0] << 16 | gram[1] << 8 | gram[2]


def postings(texts: list[bytes], wanted: set[bytes]) -> dict[bytes, np.ndarray]:
    """For each wanted trigram, the numbers of the texts that hold it, in order."""
    if not wanted:
        return {}
    ends = np.cumsum([len(t) + 2 for t in texts])
    joined = np.frombuffer(b"\0\0".join(texts) + b"\0\0", np.uint8).astype(np.uint32)
    codes = joined[:-2] << 16 | joined[1:-1] << 8 | joined[2:]
    asked = np.zeros(1 << 24, bool)
    asked[[_code(g) for g in wanted]] = True
    at = np.flatnonzero(asked[codes])
    owner, found = np.searchsorted(ends, at, side="right"), codes[at]
    return {g: np.unique(owner[found == _code(g)]) for g in wanted}


def candidates(query: object, lists: dict[bytes, np.ndarray], texts: int) -> np.ndarray:
    if query is True:
        return np.arange(texts)
    if isinstance(query, bytes):
        return lists[query]
    found = [candidates(x, lists, texts) for x in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(found))
    found.sort(key=len)
    out = found[0]
    for x in found[1:]:
        out = np.intersect1d(out, x, assume_unique=True)
    return out


def spans(rule: re.Pattern, least: int, group: int, text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that do not overlap; those that are too short are dropped after matching."""
    for match in rule.finditer(text):
        if len(match.group(group)) >= least:
            yield match.span()


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, kinds, starts, ends (arrays by start, then by order of the rules).

    Positions are code points, ends exclusive. Null and empty texts have no spans; a text may be of any length. Rows that
    repeat and rows without an id are scanned like others. Other columns are not read. No rows give no rows.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("kinds", T.ArrayType(T.StringType())),
        T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
    ])
    asked = [trigram_query(rule) for rule in rules]
    wanted = set().union(*(trigrams(q) for q in asked))

    def segments(texts: list[str]) -> Iterator[tuple[int, int]]:
        start = held = 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= SEGMENT:
                yield start, i + 1
                start, held = i + 1, 0
        if start < len(texts):
            yield start, len(texts)

    def run(batches):
        import pyarrow as pa

        expressions = [rule.compiled() for rule in rules]
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for first, last in segments(texts):
                part = texts[first:last]
                lists = postings([t.encode().translate(_LOWER) for t in part], wanted)
                for number, (rule, expression) in enumerate(zip(rules, expressions, strict=True)):
                    for i in candidates(asked[number], lists, len(part)).tolist():
                        found[first + i] += [(a, number, b) for a, b in spans(expression, rule.least, rule.group, part[i])]
            for hits in found:
                hits.sort()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([[rules[k].kind for _, k, _ in hits] for hits in found], pa.list_(pa.string())),
                pa.array([[a for a, _, _ in hits] for hits in found], pa.list_(pa.int64())),
                pa.array([[b for _, _, b in hits] for hits in found], pa.list_(pa.int64())),
            ], names=schema.names)

    return support.by_batch(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), run, schema)


def digest(hits: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(hits).encode()).hexdigest()


def joined(hits: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in hits)


def _is(kind: str):
    return lambda x: x == kind


@support.query("op10_secret_scan")
def op10(spark, sf_dir):
    from pyspark.sql import functions as F

    found = scanned(support.table(spark, sf_dir, "documents"))
    hits = F.transform(F.arrays_zip("kinds", "starts", "ends"),
                       lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string")))
    base = F.filter(hits, lambda x: F.substring_index(x, ":", 1).isin(*[r.kind for r in BASE]))
    counts = [F.size(F.filter("kinds", _is(rule.kind))).cast("long").alias(f"n_{rule.kind}") for rule in BASE]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                        F.array_join(hits, ",").alias("spans"))
