"""Quality rules, lines first: every line is judged by itself, failing lines go, and a text that loses too much goes whole.

A line without a word is neither judged nor counted. The first rule that a line fails names it:

* ``repeated``: the line equals an earlier line of its text;
* ``boilerplate``: it holds a stock phrase of web pages;
* ``navigation``: it is cut up by separators, or all its words are menu words;
* ``punctuation``: it is short and has no closing mark, or marks are a large part of its characters.

Beside the lines, texts are measured as a whole; texts that are short or repeat themselves fail whatever their lines say.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from flowgauge.llm import support

RULES = ("repeated", "boilerplate", "navigation", "punctuation")

#: Stock phrases of web pages and words of menus; fixed values.
PHRASES = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "terms and conditions", "cookie policy",
    "use of cookies", "uses cookies", "accept cookies", "enable javascript", "javascript is disabled", "lorem ipsum",
    "click here", "read more", "sign up for our newsletter", "subscribe to our", "follow us on", "share this",
    "skip to content", "back to top", "powered by wordpress", "page not found", "add to cart", "alle rechte vorbehalten",
    "tous droits réservés", "todos los derechos reservados",
)
MENU = (
    "home", "menu", "login", "logout", "register", "search", "contact", "about", "faq", "help", "sitemap", "archive",
    "next", "previous", "back", "print", "share", "tweet", "reply", "comments", "categories", "tags",
)
#: Marks that separate the entries of a menu or the cells of a table, and marks that may close a line.
SEPARATORS, CLOSING = "|»›•·→", ".!?:;)]\"'”’»…。！？"
#: What is no letter, digit or white space in ASCII.
_MARKS = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
_WORD = rf"[^{support.SPACES}]+"


@dataclass(frozen=True)
class Limits:
    """``short``: a line of fewer words must end in a closing mark. ``marks``: percent of a line's characters that may be
    marks. ``separators``: as many make a line navigation. ``lost``: percent of its characters in words that a text may lose.
    ``least_words`` and ``repeated`` (percent of words in repeated windows of three) judge texts as a whole."""

    short: int = 10
    marks: int = 20
    separators: int = 2
    lost: int = 50
    least_words: int = 50
    repeated: int = 50


def _any_phrase() -> str:
    return "|".join(re.escape(p).replace(r"\ ", " ") for p in PHRASES)


def _only_menu() -> str:
    word = f"(?:{'|'.join(MENU)})"
    return rf"^[{support.SPACES}]*{word}(?:[{support.SPACES}]+{word})*[{support.SPACES}]*$"


def _lower(text: str) -> str:
    """A-Z in lower case, nothing else."""
    return text.encode().translate(support.LOWER).decode()


class Judge:
    """The rules with their expressions ready."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self._phrase, self._menu = re.compile(_any_phrase()), re.compile(_only_menu())
        self._marks, self._separators = re.compile(_MARKS), re.compile(f"[{re.escape(SEPARATORS)}]")

    def rule(self, line: str, words: int, repeated: bool) -> str | None:
        """The rule that ``line`` fails, which has ``words`` words; None if it stays."""
        if repeated:
            return "repeated"
        lower = _lower(line)
        if self._phrase.search(lower):
            return "boilerplate"
        if len(self._separators.findall(line)) >= self.limits.separators or self._menu.match(lower):
            return "navigation"
        if words < self.limits.short and line.rstrip(support.SPACE_MARKS)[-1] not in CLOSING:
            return "punctuation"
        if 100 * len(self._marks.findall(line)) > self.limits.marks * support.word_chars(line):
            return "punctuation"
        return None

    def text(self, text: str) -> dict:
        """What ``cleaned`` tells of one text."""
        seen: set[str] = set()
        kept, spans, words, failed = [], [], [], dict.fromkeys(RULES, 0)
        at = lost = lines = 0
        for line in text.split("\n"):
            start, at = at, at + len(line) + 1
            own = line.encode().split()  # a line feed is white space, so lines hold the words of their text
            words += own
            if own:
                lines += 1
                broken = self.rule(line, len(own), line in seen)
                seen.add(line)
                if broken:
                    failed[broken] += 1
                    lost += support.word_chars(line)
                    spans.append({"start": start, "end": start + len(line), "rule": broken})
                    continue
            kept.append(line)
        repeats, chars = repeated_words(words), support.word_chars(text)
        short = len(words) < self.limits.least_words or 100 * repeats > self.limits.repeated * len(words)
        return {
            "n_words": len(words), "word_chars": chars, "n_symbols": sum(map(text.count, "#*$%&|<>")),
            "n_dup_lines": failed["repeated"], "n_repeat_words": repeats, "n_lines": lines, "lost_chars": lost,
            **{f"n_{rule}": failed[rule] for rule in RULES[1:]}, "base_failed": short,
            "kept": not short and 100 * lost <= self.limits.lost * chars, "clean": "\n".join(kept), "removed": spans,
        }


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur at least twice, the first occurrence included."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, window, times = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    held = times[window] > 1
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : shift + len(held)] |= held
    return int(inside.sum())


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "lost_chars",
           *(f"n_{rule}" for rule in RULES[1:]))


def cleaned(docs: DataFrame, limits: Limits = Limits(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, the counts, base_failed, kept, clean (the text without its failing lines) and
    removed, an array of (start, end, rule) in code points.

    Null and empty texts have no words, so they fail, and their clean text is empty. A text of any length is read whole.
    Lines are told apart by ``\\n`` alone and compared as they stand. Rows that repeat and rows without an id are judged like
    others. Other columns are not read. No rows give no rows.
    """
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("rule", T.StringType())])
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), *[T.StructField(name, T.LongType()) for name in _COUNTS],
        T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
        T.StructField("clean", T.StringType()), T.StructField("removed", T.ArrayType(span)),
    ])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        judge, kinds = Judge(limits), [f.type for f in to_arrow_schema(schema)]
        for whole in batches:
            for batch in support.slices(whole):
                told = [judge.text(x.as_py() or "") for x in batch.column(1)]
                columns = [pa.array([t[name] for t in told], kind) for name, kind in zip(schema.names[1:], kinds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return support.by_batch(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), run, schema)


def survivors(docs: DataFrame, limits: Limits = Limits(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and clean text of the rows that ``cleaned`` keeps; what it says of nulls, repeats and no rows holds here too."""
    return cleaned(docs, limits, text, doc_id).where("kept").select("doc_id", F.col("clean").alias("text"))


def _twin(limits: Limits = Limits()) -> str:
    def quoted(x: str) -> str:
        return x.replace("'", "''")

    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    spaces = support.SPACES
    any_space = f"[{spaces}]"
    return rf"""
    with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
    words as (select r, unnest(w) as word, generate_subscripts(w, 1) as pos from
              (select r, regexp_extract_all(text, '{_WORD}') as w from docs)),
    windows as (select r, pos, count(*) over (partition by r, word, second, third) as times from
                (select r, pos, word, lead(word) over o as second, lead(word, 2) over o as third from words
                 window o as (partition by r order by pos)) where third is not null),
    inside as (select distinct r, pos + shift as pos from windows, (select unnest([0, 1, 2]) as shift) where times > 1),
    repeats as (select r, count(*) as n from inside group by r),
    split as (select r, unnest(l) as line, generate_subscripts(l, 1) as pos from (select r, string_split(text, chr(10)) as l from docs)),
    lines as (select *, row_number() over (partition by r, line order by pos) > 1 as again,
                     len(regexp_extract_all(line, '{_WORD}')) as words, length(regexp_replace(line, '{any_space}', '', 'g')) as chars,
                     translate(line, '{upper}', '{lower}') as low
              from split where regexp_matches(line, '{_WORD}')),
    judged as (select r, chars, again,
                      again or regexp_matches(low, '{quoted(_any_phrase())}')
                      or length(regexp_replace(line, '[^{SEPARATORS}]', '', 'g')) >= {limits.separators}
                      or regexp_matches(low, '{_only_menu()}')
                      or (words < {limits.short} and not contains('{quoted(CLOSING)}', right(regexp_replace(line, '{any_space}+$', ''), 1)))
                      or 100 * len(regexp_extract_all(line, '{_MARKS}')) > {limits.marks} * chars as fails
               from lines),
    losses as (select r, count(*) filter (where again) as dup, coalesce(sum(chars) filter (where fails), 0) as lost, count(*) as n_lines,
                      count(*) filter (where fails) as n_failed from judged group by r),
    facts as (select doc_id, len(regexp_extract_all(text, '{_WORD}')) as n_words,
                     length(regexp_replace(text, '{any_space}', '', 'g')) as word_chars,
                     len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(dup, 0) as n_dup_lines,
                     coalesce(n, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(n_failed, 0) as n_failed_lines,
                     coalesce(lost, 0)::bigint as lost_chars
              from docs left join repeats using (r) left join losses using (r)),
    failed as (select *, n_words < {limits.least_words} or 100 * n_repeat_words > {limits.repeated} * n_words as base_failed from facts)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_failed_lines, lost_chars, base_failed,
           not base_failed and 100 * lost_chars <= {limits.lost} * word_chars as kept
    from failed"""


@support.query("op13_line_rules", _twin())
def op13(spark, sf_dir):
    told = cleaned(support.table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
                       F.size("removed").cast("long").alias("n_failed_lines"), "lost_chars", "base_failed", "kept")
