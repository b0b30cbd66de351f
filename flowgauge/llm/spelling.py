"""Spelling variants: words that differ by one code point, found by pivotal grams, and the common form that each goes back to.

A word's bigrams are ordered from the rarest to the commonest over all words; its prefix are the three rarest and all that are
the same as the third. Of the prefix two disjoint pivots are chosen by dynamic programming, the rarest together. One edit
spoils one pivot at most, and of two near words the one whose prefix ends first has its whole pivot in the other's prefix.

An edit lies wholly behind or wholly before the pivot that it spares. So the pivot stands in both words at the same distance
from the front, and all before it is equal, or at the same distance from the end, and all behind it is equal. What is left of
the word, cut in two, keeps one half. Pivots are indexed by side, distance, length and those equal parts; the prefixes of
other words look them up for each length that one edit allows. So words that meet agree in half of their code points at least,
however common a bigram is. Each pair that meets is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from flowgauge.llm import support

#: Code points and occurrences that a word needs, and how many times as frequent its form must be.
LENGTH, OCCURRENCES, FACTOR = 6, 5, 5
#: Runs whose checksum this divides lose a code point.
DELETIONS = 199
#: Different words that a task counts before it passes them on, and words whose keys one task makes.
HELD, WORDS = 200_000, 1 << 14
RUN = "[A-Za-zÀ-ÿ]+"


def words_of(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """word, n: the runs of letters of all texts, some short of a code point, that are long and frequent enough."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches):
        import re
        import zlib
        from collections import Counter

        import pyarrow as pa

        runs = re.compile(RUN)
        held: Counter[str] = Counter()

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=schema.names)
            held.clear()
            return rows

        for whole in batches:
            for batch in support.slices(whole):
                for number, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    start = zlib.crc32(f"{number}:".encode())
                    lower = body.encode().translate(support.LOWER).decode()
                    for word, n in Counter(runs.findall(lower)).items():
                        check = zlib.crc32(word.encode(), start)
                        if check % DELETIONS == 0:
                            cut = check % len(word)
                            word = word[:cut] + word[cut + 1 :]
                        if len(word) >= LENGTH:
                            held[word] += n
                    if len(held) >= HELD:
                        yield flush()
        if held:
            yield flush()

    read = docs.select(F.coalesce(docs[doc_id].cast("string"), F.lit("")).alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return support.by_batch(read, run, schema).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def grams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Bigrams from the rarest to the commonest. Words are made of 90 different code points, so there are 8,100 at most."""
    found = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    counts = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["gram"]: i for i, r in enumerate(sorted(counts, key=lambda r: (r["n"], r["gram"])))}


def prefix(order: list[int]) -> list[int]:
    """Places of the three rarest bigrams (``order`` has each place's rank) and of all that equal the third, in place order."""
    last = sorted(order)[2]
    return [i for i, rank in enumerate(order) if rank <= last]


def pivots(order: list[int], places: list[int]) -> tuple[int, int]:
    """The two disjoint places of the prefix whose ranks have the least sum."""
    best: list[tuple[int, int]] = []  # the rarest of the places so far, as (rank, place)
    chosen = None
    for at, place in enumerate(places):
        best.append(min((order[place], place), best[-1]) if best else (order[place], place))
        before = at - 1
        while before >= 0 and places[before] > place - 2:
            before -= 1
        if before >= 0:
            rank, other = best[before]
            chosen = min(chosen or (rank + order[place] + 1, 0, 0), (rank + order[place], other, place))
    return chosen[1], chosen[2]


def entries(word: str, place: int, length: int) -> Iterator[tuple[int, int, str, str]]:
    """What a word of ``length`` code points near to ``word``, or ``word`` itself, may share with it if the bigram at ``place``
    is spared: (case, distance, what is equal on the pivot's side, what is equal of the rest).

    The rest of the word of ``length`` is halved; so the parts of its own entries, which have its own length, are found by all
    words near to it. Parts that ``word`` is too short for are left out.
    """
    size = len(word)
    rest = length - place - 2  # behind the pivot: all up to it is equal
    half, own = rest // 2, size - place - 2
    if rest >= 0:
        if half <= own:
            yield 0, place, word[: place + 2], word[place + 2 : place + 2 + half]
        if rest - half <= own:
            yield 1, place, word[: place + 2], word[size - (rest - half) :]
    end = size - place  # before the pivot: all from it on is equal
    rest = length - end
    half = rest // 2
    if rest >= 0:
        if half <= place:
            yield 2, end, word[place:], word[:half]
        if rest - half <= place:
            yield 3, end, word[place:], word[place - (rest - half) : place]


def _keys(words: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """key, word, last (rank of the prefix's end), pivot: true for entries of the index, false for look-ups."""
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("word", T.StringType()),
                           T.StructField("last", T.IntegerType()), T.StructField("pivot", T.BooleanType())])

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                rows: list[tuple[bytes, str, int, bool]] = []
                for word in batch.column(0).slice(first, 1024).to_pylist():
                    order = [ranks[g] for g in grams(word)]
                    places = prefix(order)
                    last = max(order[i] for i in places)
                    for pivot, some, lengths in ((True, set(pivots(order, places)), (0,)), (False, places, (-1, 0, 1))):
                        keys = {(len(word) + more, *entry) for i in some for more in lengths for entry in entries(word, i, len(word) + more)}
                        rows += [(xxhash.xxh3_128_digest("\0".join(map(str, k)).encode()), word, last, pivot) for k in sorted(keys)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.string(), pa.int32(), pa.bool_()))],
                    names=schema.names)

    parts = -(-words.count() // WORDS) or 1
    return support.by_batch(words.select("word").repartition(parts, "word"), run, schema)


def near_pairs(words: DataFrame) -> DataFrame:
    """All (a, b) of ``words`` that differ by one inserted, deleted or replaced code point, in both orders."""
    keys = support.stored(_keys(words, gram_ranks(words)), "spelling-keys")
    index = keys.where("pivot").select("key", F.col("word").alias("a"), F.col("last").alias("last_a"))
    asked = keys.where(~F.col("pivot")).select("key", F.col("word").alias("b"), F.col("last").alias("last_b"))
    met = asked.join(index, "key").where("last_a <= last_b and a <> b")
    near = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = support.stored(near.where(F.levenshtein("a", "b", 1) == 1), "spelling-near")
    return near.union(near.select("b", "a"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) with the last word that forms lead to as root. Every round doubles the steps taken, and a form
    is FACTOR times as frequent as its word, so there are few."""
    reached = support.stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = support.stored(reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "spelling-roots")
        if further.where("next is not null").isEmpty():
            return reached
        reached = further.drop("next")


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each word of ``docs``: word, n, n_near (words that differ from it by one code point), form (the most frequent
    of those, if it is FACTOR times as frequent), form_n, root (where following forms ends; the word itself without a form).

    Null and empty texts have no words; a text of any length is read whole. Rows that repeat count again; a missing id is
    empty text in the checksum. Of equally frequent near words the smallest in code-point order is the form. Other columns
    are not read. No rows, or none with words long and frequent enough, give no rows.
    """
    words = support.stored(words_of(docs, text, doc_id), "spelling-words")
    near = near_pairs(words).join(words.select(F.col("word").alias("b"), F.col("n").alias("n_other")), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("minus"), "b")).alias("best"))
    known = words.join(best, "word", "left")
    is_form = F.coalesce(-F.col("best.minus") >= FACTOR * F.col("n"), F.lit(False))
    known = support.stored(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.b")).alias("form"),
        F.when(is_form, -F.col("best.minus")).alias("form_n")), "spelling-forms")
    led = roots(known.where("form is not null"))
    return known.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _twin() -> str:
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    # every code point of an id or a run is ASCII or one of U+00C0 to U+00FF
    as_bytes = ("flatten(list_transform(string_split(concat(doc_id, ':', run), ''), "
                "lambda c: case when unicode(c) < 128 then [unicode(c)] else [195, unicode(c) - 64] end))")
    step = "list_reduce(list_concat([4294967295::bigint], codes), lambda c, x: xor(c >> 8, remainders[(xor(c, x::bigint) & 255) + 1]))"
    bit = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    return rf"""
    with recursive bits(b, i, c) as (
        select range, 0, range::bigint from range(256) union all select b, i + 1, {bit} from bits where i < 8),
    checks as (select list(c order by b) as remainders from bits where i = 8),
    found as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{upper}', '{lower}') as run from documents),
    runs as (select doc_id, run, count(*) as n, {as_bytes} as codes from found group by doc_id, run),
    hashed as (select run, n, xor({step}, 4294967295) as h from runs, checks),
    cut as (select n, case when h % {DELETIONS} = 0 then concat(left(run, (h % length(run))::int), substring(run, (h % length(run))::int + 2)) else run end as word
            from hashed),
    words as (select word, sum(n)::bigint as n from cut where length(word) >= {LENGTH} group by word having sum(n) >= {OCCURRENCES}),
    -- two words one edit apart are equal with a code point of one, or of both, left out
    less as (select distinct word, n, i, concat(left(word, i), substring(word, i + 2)) as left_out
             from words, unnest(range(length(word))) as u(i)),
    near as (select a.word, b.word as other, b.n as n_other from less a join less b on a.left_out = b.left_out and a.i = b.i and a.word <> b.word
             union select a.word, b.word, b.n from less a join words b on a.left_out = b.word
             union select b.word, a.word, a.n from less a join words b on a.left_out = b.word),
    best as (select word, count(*) as n_near, first(other order by n_other desc, other) as other, max(n_other) as n_other from near group by word),
    forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when n_other >= {FACTOR} * w.n then other end as form,
                     case when n_other >= {FACTOR} * w.n then n_other end as form_n from words w left join best using (word)),
    led(word, root) as (select word, word from forms union all select led.word, f.form from led join forms f on f.word = led.root where f.form is not null),
    ends as (select led.word, led.root from led join forms f on f.word = led.root where f.form is null)
    select word, form, root, n, n_near, form_n from forms join ends using (word)"""


@support.query("op12_spelling_variants", _twin())
def op12(spark, sf_dir):
    return variants(support.table(spark, sf_dir, "documents"))
