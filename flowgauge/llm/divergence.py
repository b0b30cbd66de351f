"""Divergence of sources: how far the word use of each source of a language lies from every other's, and by which terms.

Every language numbers its terms: by the power of two below their count, and hashed into blocks of some BLOCK terms, so terms
of a block are about equally frequent. The numbers of a block are the leaves of a segment tree for each source, whose nodes
stand for the counts below them. Nodes are hash-consed over all trees of a block: equal runs of counts, the many without any
occurrence above all, are one node. Two trees are walked together from their roots. A pair of nodes that several places
reach is one entry with a number of places, so what lies below is walked, and at the end priced, once.

The trees above the blocks are sums, which Spark's grouping forms. A task holds the trees of two tiles of some TILE sources
over one block, whatever the number of sources and terms.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from flowgauge.llm import support

#: Terms must occur in so many documents of their language; probabilities are in parts of SCALE, smoothed by ALPHA.
DOCUMENTS, SCALE, ALPHA = 3, 1_000_000_000, 1
#: Expected terms of a block and sources of a tile; node pairs that are walked at a time; ranks of terms.
BLOCK, TILE, PAIRS, RANKS = 2_048, 32, 1 << 19, 200
#: Different (source, term) that a task counts before it passes them on.
HELD = 200_000
#: Bytes of terms (letters and whatever is not ASCII, A-Z in lower case), spaces for all others.
_TERMS = bytes(32 if c < 65 or 90 < c < 97 or 122 < c < 128 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term (bytes), n (its occurrences), docs (documents that hold it), in parts that tasks have counted."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("term", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("docs", T.LongType())])

    def run(batches):
        import pyarrow as pa

        held: dict[tuple[str, str, bytes], list[int]] = {}

        def flush():
            keys = list(held)
            columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.binary()))]
            counts = [pa.array([v[i] for v in held.values()], pa.int64()) for i in range(2)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns + counts, names=schema.names)

        for whole in batches:
            for batch in support.slices(whole, 2):
                for name, group, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own: dict[bytes, int] = {}
                    for term in body.encode().translate(_TERMS).split(b" "):
                        own[term] = own.get(term, 0) + 1
                    own.pop(b"", None)
                    for term, n in own.items():
                        entry = held.setdefault((name, group, term), [0, 0])
                        entry[0] += n
                        entry[1] += 1
                    if len(held) >= HELD:
                        yield flush()
        if held:
            yield flush()

    columns = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))]
    return support.by_batch(docs.select(*columns), run, schema)


class Trees:
    """The segment trees of several sources over the terms of one block, hash-consed level by level.

    ``levels[0]`` are the different counts; every other level has the (left, right) nodes of the level below that its nodes
    stand for. ``roots`` has each source's node of the last level. ``shared`` tells by level which nodes stand at several
    places of some tree.
    """

    def __init__(self, counts: np.ndarray):
        sources, terms = counts.shape
        width = 1 << max(terms - 1, 0).bit_length()
        # what fills the width up is the count -1, which costs nothing
        full = np.full((sources, width), -1, np.int64)
        full[:, :terms] = counts
        values, nodes = np.unique(full, return_inverse=True)
        nodes = nodes.reshape(sources, width)
        self.levels, self.shared = [values], [_several(nodes, len(values))]
        while nodes.shape[1] > 1:
            below = len(self.levels[-1])
            pairs, joined = np.unique(nodes[:, ::2] * below + nodes[:, 1::2], return_inverse=True)
            nodes = joined.reshape(sources, -1)
            self.levels.append(np.stack([pairs // below, pairs % below], axis=1))
            self.shared.append(_several(nodes, len(pairs)))
        self.roots = nodes[:, 0]

    def met(self, left: np.ndarray, right: np.ndarray):
        """(pair, count on the left, count on the right, places) of the different leaves that meet when the trees of the
        sources left[i] and right[i] are walked together."""
        pair, x, y = np.arange(len(left)), self.roots[left], self.roots[right]
        places = np.ones(len(left), np.int64)
        for depth in range(len(self.levels) - 1, 0, -1):
            children = self.levels[depth]
            x, y = children[x].T.ravel(), children[y].T.ravel()
            pair, places = np.concatenate([pair, pair]), np.concatenate([places, places])
            pair, x, y, places = _once(pair, x, y, places, len(self.levels[depth - 1]), self.shared[depth - 1])
        values = self.levels[0]
        real = values[x] >= 0
        return pair[real], values[x[real]], values[y[real]], places[real]


def _several(nodes: np.ndarray, count: int) -> np.ndarray:
    """Which of ``count`` nodes stand at several places of a row."""
    ordered = np.sort(nodes, axis=1)
    out = np.zeros(count, bool)
    out[ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]]] = True
    return out


def _once(pair, x, y, places, count, shared):
    """Entries with the places of equal ones added up. Only two nodes that both stand at several places can meet twice."""
    again = shared[x] & shared[y]
    code = (pair[again] * count + x[again]) * count + y[again]
    if not len(code):
        return pair, x, y, places
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    summed, code, rest = np.add.reduceat(places[again][order], first), code[first], ~again
    return (np.concatenate([pair[rest], code // (count * count)]), np.concatenate([x[rest], code // count % count]),
            np.concatenate([y[rest], code % count]), np.concatenate([places[rest], summed]))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + ALPHA) / total) without overflow; ``totals`` are occurrences and ALPHA for every term."""
    if len(counts) and int(counts.max()) >= (1 << 62) // SCALE:
        counts, totals = counts.astype(object), totals.astype(object)
    return (1 + SCALE * (counts + ALPHA) // totals).astype(np.int64)


def prices(trees: Trees, totals: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of sources the divergence of the left from the right and of the right from the left."""
    pair, counts, others, places = trees.met(left, right)
    p, q = shares(counts, totals[left][pair]), shares(others, totals[right][pair])
    square = (p - q) * (p - q)
    order = np.argsort(pair, kind="stable")
    first = np.searchsorted(pair[order], np.arange(len(left)))
    there, back = (np.add.reduceat((square // other * places)[order], first) for other in (q, p))
    return there, back


def _block_prices(leaves, groups):
    """One block and one or two tiles of a language: the prices of all pairs of sources between them (or within the one)."""
    import pyarrow as pa

    facts = groups.to_pydict()
    sources, totals, tiles = facts["source"], np.array(facts["total"], np.int64), np.array(facts["tile"])
    size, place = facts["terms"][0], {source: i for i, source in enumerate(sources)}
    one, two = np.triu_indices(len(sources), 1)
    if facts["tile_a"][0] != facts["tile_b"][0]:
        across = tiles[one] != tiles[two]
        one, two = one[across], two[across]
    there = back = np.zeros(len(one), np.int64)
    if size and len(one):
        counts = np.zeros((len(sources), size), np.int64)
        # terms that no source here has are the places that nothing is put into
        owner, term = (leaves[c].combine_chunks().dictionary_encode() for c in ("source", "term"))
        rows = np.array([place[x] for x in owner.dictionary.to_pylist()], np.int64)[owner.indices.to_numpy()]
        counts[rows, term.indices.to_numpy()] = leaves["n"].to_numpy()
        trees, step = Trees(counts), max(1, PAIRS // size)
        parts = [prices(trees, totals, one[i : i + step], two[i : i + step]) for i in range(0, len(one), step)]
        there, back = (np.concatenate(x) for x in zip(*parts, strict=True))
    names = pa.array(sources, pa.string())
    return pa.table({
        "lang": pa.array([facts["lang"][0]] * (2 * len(one)), pa.string()),
        "source": names.take(pa.array(np.concatenate([one, two]))), "item": names.take(pa.array(np.concatenate([two, one]))),
        "value": pa.array(np.concatenate([there, back]))})


def _leaves(counts: DataFrame) -> DataFrame:
    """lang, term, source, n, total (of the language) and once (true for one row of each term), for the kept terms.

    One exchange by language and term serves the sums by source, the totals and the number of documents.
    """
    summed = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    known = summed.select("*", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("held"),
                          (F.row_number().over(term.orderBy("source")) == 1).alias("once"))
    return support.stored(known.where(F.col("held") >= DOCUMENTS).drop("docs", "held"), "divergence-leaves")


def _pair_values(leaves: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item, value for every two sources of a language."""
    kind = F.concat_ws("\0", "lang", "class")
    classed = leaves.withColumn("class", F.floor(F.log2("total"))).withColumn("kind", kind)
    sizes = classed.where("once").groupBy("lang", "class", "kind").agg(F.count(F.lit(1)).alias("size"))
    sizes = support.stored(sizes.join(langs.select("lang", "tiles"), "lang"), "divergence-classes")
    count = F.ceil(F.col("size") / BLOCK)
    dealt = support.with_few_facts(classed, "kind", sizes.select("kind", "size", "tiles"), "size").select(
        "lang", (F.col("class") * F.lit(1 << 40) + F.pmod(F.xxhash64("term"), count)).alias("block"), "source", "term", "n", "once",
        F.pmod(F.xxhash64("source"), "tiles").alias("tile"), "tiles")
    dealt = support.stored(dealt, "divergence-blocks")

    def faced(rows: DataFrame) -> DataFrame:
        """Every row once for each tile that its own meets."""
        each = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        return each.withColumns({"tile_a": F.least("tile", "other"), "tile_b": F.greatest("tile", "other")}).drop("other", "tiles")

    blocks = dealt.where("once").groupBy("lang", "block").agg(F.count(F.lit(1)).cast("int").alias("terms"))
    bare = langs.where("terms = 0").select("lang", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("terms"))
    grid = blocks.union(bare).join(groups.select("lang", "source", "total", "tile", "tiles"), "lang")
    grid = support.stored(grid, "divergence-grid")
    key = ["lang", "block", "tile_a", "tile_b"]
    support.ship(leaves.sparkSession)
    found = faced(dealt.drop("once")).groupBy(*key).cogroup(faced(grid).groupBy(*key)).applyInArrow(
        _block_prices, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _term_values(leaves: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for the terms of a source that it uses more than its language does."""

    def key() -> Column:
        return F.concat(F.length("lang").cast("string"), F.lit(":"), "lang", "source")

    facts = groups.where("size > 0").select(key().alias("group"), F.col("total").alias("own"), "whole", "size")
    known = support.with_few_facts(leaves.select("lang", "source", "term", "n", "total", key().alias("group")), "group", facts, "size")
    # counts beyond what a long holds SCALE times over are divided as decimals
    share = (f"1 + if({{0}} < {(1 << 62) // SCALE}L, ({SCALE}L * ({{0}} + {ALPHA})) div {{1}},"
             f" (cast({{0}} + {ALPHA} as decimal(25,0)) * {SCALE}) div cast({{1}} as decimal(25,0)))")
    known = known.withColumn("p", F.expr(share.format("n", "own"))).withColumn("q", F.expr(share.format("total", "whole"))).where("p > q")
    return known.select("lang", "source", F.col("term").cast("string").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))


def audited(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: for every source of every language, its divergence from each other source (part
    ``pair``) and the terms that it uses more than its language does, up to ``ranks`` (part ``term``).

    A null text, lang or source counts as empty text; an empty lang or source is one like any other. A text of any length is
    counted whole, a row that repeats is a document again. A source without terms has the same share for every term; a
    language without kept terms has pairs of value 0. Ties go to the item that is smaller in UTF-8. Other columns are not
    read. No rows give no rows.
    """
    leaves = _leaves(term_counts(docs, text, lang, source))
    named = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))])
    sums = leaves.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count(F.lit(1)).alias("size"))
    groups = support.stored(named.distinct().join(sums, ["lang", "source"], "left"), "divergence-groups")
    kept = leaves.where("once").groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("whole"))
    langs = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles")).join(kept, "lang", "left")
    langs = support.stored(langs.na.fill(0, ["terms", "whole"]), "divergence-langs")
    smooth = ALPHA * F.col("terms")
    groups = groups.na.fill(0, ["own", "size"]).join(langs, "lang").select(
        "lang", "source", "size", (F.col("own") + smooth).alias("total"), (F.col("whole") + smooth).alias("whole"),
        F.pmod(F.xxhash64("source"), "tiles").alias("tile"), "tiles")
    groups = support.stored(groups, "divergence-totals")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    top = ranked(_term_values(leaves, groups), "term").where(F.col("rank") <= ranks)
    return ranked(_pair_values(leaves, groups, langs), "pair").unionByName(top)


def _twin() -> str:
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    share = "1 + ({s}::hugeint * ({n} + {a})) // ({t} + {a} * v)"

    def p(n: str, t: str) -> str:
        return share.format(s=SCALE, n=n, a=ALPHA, t=t)

    return rf"""
    with docs as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                         translate(coalesce(text, ''), '{upper}', '{lower}') as text from documents),
    found as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
    terms as (select lang, term, count(*) as total from found group by lang, term having count(distinct r) >= {DOCUMENTS}),
    grps as (select distinct lang, source from docs),
    counts as (select lang, source, term, count(*) as n from found join terms using (lang, term) group by all),
    sums as (select lang, source, sum(n) as own from counts group by all),
    vocab as (select lang, count(*) as v, sum(total) as whole from terms group by lang),
    g as (select lang, source, coalesce(own, 0) as own, coalesce(v, 0) as v, coalesce(whole, 0) as whole
          from grps left join sums using (lang, source) left join vocab using (lang)),
    dense as (select g.lang, g.source, t.term, coalesce(n, 0) as n, {p('coalesce(n, 0)', 'own')} as p, {p('t.total', 'whole')} as q
              from g join terms t using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = t.term),
    summed as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
               from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
              from grps a join grps b on a.lang = b.lang and a.source <> b.source
              left join summed s on s.lang = a.lang and s.source = a.source and s.item = b.source),
    tops as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from dense where n > 0 and p > q)
    select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
    from (select * from pairs union all select * from tops) qualify part = 'pair' or rank <= {RANKS}"""


@support.query("op11_source_divergence", _twin())
def op11(spark, sf_dir):
    return audited(support.table(spark, sf_dir, "documents"))
