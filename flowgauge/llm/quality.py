"""A quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few dozen figures about its form. The model is a sum of look-up tables: one for each figure, cut into
bins at quantiles, and one for each of the strongest pairs of figures. Tables are learnt by cyclic boosting: in every round
each figure in turn gets a shallow tree fitted to what is still unexplained, whose leaves are added to its table at a small
rate; the pairs follow in the same way. A score is a sum of table entries, found for a whole batch at once, as a probability.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from flowgauge.llm import support

FIGURES = (
    "log_chars", "log_words", "mean_word", "long_words", "distinct_words", "top_word", "upper", "digits", "spaces", "lines",
    "full_stops", "commas", "bars", "loud_marks", "other_marks", "high_bytes", "capital_words", "repeated_lines",
    "marked_words", "top_byte", "entropy", "next_same",
)
#: Labelled ids that training reads at most; a hash of the id picks them.
SAMPLE = 20_000
#: Different texts (by their figures) of one labelled id that go to the driver; they stand for all of the id's rows.
TEXTS = 8
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.1
#: A text is predicted good from this score on.
THRESHOLD = 0.3

_KIND = np.zeros((256, 8), np.int64)  # upper, digits, spaces, full stops, commas, bars, loud marks, high bytes
for _column, _bytes in enumerate((range(65, 91), range(48, 58), [*range(9, 14), 32], b".", b",", b"|", b"!?", range(128, 256))):
    _KIND[list(_bytes), _column] = 1
_OTHER = [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,|!?"]
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def figures(text: str | None) -> list[float]:
    """The figures of one text, in the order of FIGURES; null and empty texts have zeros."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FIGURES)
    raw = np.frombuffer(data, np.uint8)
    counts = np.bincount(raw, minlength=256)
    size, number = len(data), len(words)
    upper, digits, spaces, stops, commas, bars, loud, high = (counts @ _KIND).tolist()
    lengths = np.fromiter(map(len, words), np.int64, number)
    seen = Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    marked = sum(n for w, n in seen.items() if w[-1:] in _ENDS)
    capital = sum(n for w, n in seen.items() if w[:1].isupper())
    share = counts[counts > 0] / size
    letters = counts.copy()
    letters[[32, 10, 9, 13, 11, 12]] = 0
    same = sum(1 for a, b in zip(words, words[1:]) if a == b)
    return [
        float(np.log1p(size)), float(np.log1p(number)), float(lengths.mean()), float((lengths > 12).mean()), len(seen) / number,
        max(seen.values()) / number, upper / size, digits / size, spaces / size, len(lines) / number, stops / number,
        commas / number, bars / number, loud / number, float(counts[_OTHER].sum()) / number, high / size, capital / number,
        1 - len(set(lines)) / len(lines), marked / number, float(letters.max()) / size, float(-(share * np.log(share)).sum()),
        same / number,
    ]


_ENDS = {bytes([b]) for b in _MARKS}


@dataclass
class Model:
    """``cuts`` by figure, ``tables`` by figure, and for each pair its two figures, coarse cuts and table."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of figures."""
        total = np.full(len(x), self.base)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, f], side="right")]
        for f, g, cut_f, cut_g, table in self.pairs:
            total += table[np.searchsorted(cut_f, x[:, f], side="right"), np.searchsorted(cut_g, x[:, g], side="right")]
        return 1 / (1 + np.exp(-total))


def _cuts(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Quantiles of values that occur ``weights`` times each."""
    order = np.argsort(values, kind="stable")
    values, upto = values[order], np.cumsum(weights[order])
    at = np.arange(1, bins) / bins * (upto[-1] - 1)
    low, high = (values[np.minimum(np.searchsorted(upto, k, side="right"), len(values) - 1)] for k in (np.floor(at), np.ceil(at)))
    return np.unique(low + (high - low) * (at - np.floor(at)))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Where to split bins 0..n so that both sides fit best: the gain and the first bin of the right side."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values by bin of a tree over one figure's bins, grown by its best splits."""
    spans, out = [(0, len(g))], np.zeros(len(g))
    while len(spans) < leaves:
        gain, at, span = max((*_best_split(g[a:b], h[a:b]), (a, b)) for a, b in spans)
        if gain <= 1e-9:
            break
        spans.remove(span)
        spans += [(span[0], span[0] + at), (span[0] + at, span[1])]
    for a, b in spans:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree of depth two over a grid of bins: a split of one figure, and one of the other on either side."""
    best, whole = (0.0, np.zeros_like(g)), _gain(g.sum(), h.sum())
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            out, gain = np.zeros_like(a), -whole
            for rows in (slice(0, cut), slice(cut, None)):
                side_g, side_h = a[rows].sum(axis=0), b[rows].sum(axis=0)
                at = _best_split(side_g, side_h)[1]
                for columns in (slice(0, at), slice(at, None)):
                    if side_g[columns].size:
                        gain += _gain(side_g[columns].sum(), side_h[columns].sum())
                        out[rows, columns] = _leaf(side_g[columns].sum(), side_h[columns].sum())
            if gain > best[0]:
                best = (float(gain), out.T if turned else out)
    return best


def train(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> Model:
    """The model of rows that occur ``weights`` times each, or once.

    Without rows of both labels the model answers with the share of label 1, or one half if there is none.
    """
    weights = np.ones(len(y)) if weights is None else weights
    share = ((weights * y).sum() + 0.5) / (weights.sum() + 1)
    model = Model(float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    margin = np.full(len(y), model.base)
    model.cuts = [_cuts(column, weights, BINS) for column in x.T]
    binned = [np.searchsorted(cut, column, side="right") for cut, column in zip(model.cuts, x.T, strict=True)]
    model.tables = [np.zeros(len(cut) + 1) for cut in model.cuts]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return weights * (y - p), weights * (p * (1 - p))

    for _ in range(ROUNDS):
        for bins, table in zip(binned, model.tables, strict=True):
            g, h = slopes()
            step = RATE * _shallow_tree(np.bincount(bins, g, len(table)), np.bincount(bins, h, len(table)))
            table += step
            margin += step[bins]

    coarse = [_cuts(column, weights, PAIR_BINS) for column in x.T]
    place = [np.searchsorted(cut, column, side="right") for cut, column in zip(coarse, x.T, strict=True)]

    def grid(f: int, k: int, values: np.ndarray) -> np.ndarray:
        shape = (len(coarse[f]) + 1, len(coarse[k]) + 1)
        return np.bincount(place[f] * shape[1] + place[k], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    strength = [(_pair_tree(grid(f, k, g), grid(f, k, h))[0], f, k) for f in range(x.shape[1]) for k in range(f)]
    for _, f, k in sorted(strength, reverse=True)[:PAIRS]:
        model.pairs.append((f, k, coarse[f], coarse[k], np.zeros((len(coarse[f]) + 1, len(coarse[k]) + 1))))
    for _ in range(PAIR_ROUNDS):
        for f, k, _, _, table in model.pairs:
            g, h = slopes()
            step = RATE * _pair_tree(grid(f, k, g), grid(f, k, h))[1]
            table += step
            margin += step[place[f], place[k]]
    return model


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> Model:
    """The model learnt from ``labels`` (doc_id, quality) whose crc32(doc_id as text) mod 5 is not 0.

    At most ``sample`` labels (different pairs of id and quality) are used, the first by a hash of the id. Labels that are
    null or whose text is missing from ``docs`` teach nothing; a label or a text that repeats counts as often as it occurs,
    as a weight. An id with more than TEXTS different texts is told by so many of them, which a hash of their figures picks
    and which share the weight of all its rows. So no label and no id crowds out another, however often it occurs.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & (support.crc_rest(F.col("doc_id"), 5) != 0))
    chosen = usable.select(F.col("doc_id").alias("_labelled"), F.col("quality").cast("double").alias("_label"))
    chosen = chosen.groupBy("_labelled", "_label").agg(F.count(F.lit(1)).alias("_times"))
    chosen = chosen.orderBy(F.xxhash64("_labelled"), "_labelled", "_label").limit(sample)
    names = F.broadcast(support.stored(chosen, "quality-labels"))  # no more than `sample` rows of three numbers
    ids = names.select("_labelled").distinct()
    known = docs.select(docs[doc_id].alias("_id"), docs[text].alias("_text")).join(
        F.broadcast(ids), F.col("_id") == F.col("_labelled"), "left_semi")
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("figures", T.ArrayType(T.DoubleType()))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [figures(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=schema.names)

    different = support.by_batch(known, run, schema).groupBy("id", "figures").agg(F.count(F.lit(1)).alias("rows"))
    different = support.stored(different, "quality-figures")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("figures"), "figures"))
    some = different.withColumn("place", place).where(F.col("place") <= TEXTS).drop("place")
    every = different.groupBy(F.col("id").alias("of")).agg(F.sum("rows").alias("every"))
    rows = some.join(names, F.col("id") == F.col("_labelled")).join(every, F.col("id") == F.col("of"))
    rows = rows.select("id", F.col("_label").alias("label"), "figures", "rows", "every", "_times").toPandas()
    held = rows.groupby("id")["rows"].transform("sum") / rows.groupby("id")["label"].transform("nunique")
    rows["weight"] = rows["rows"] * rows["_times"] * (rows["every"] / held)
    rows["figures"] = rows["figures"].map(tuple)
    rows = rows.sort_values(["label", "figures", "weight"])  # sums of numbers depend on their order
    x = np.array(rows["figures"].tolist(), float).reshape(len(rows), len(FIGURES))
    return train(x, rows["label"].to_numpy(float), rows["weight"].to_numpy(float))


def scored(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, score (0 to 1; null texts count as empty, and empty ones are scored too).

    A text of any length is read whole. Rows that repeat get equal scores. Other columns are not read. No rows give no rows.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1)))], names=schema.names)

    return support.by_batch(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), run, schema)


def _scores(model: Model, texts) -> np.ndarray:
    return model.score(np.array([figures(t.as_py()) for t in texts], float).reshape(len(texts), len(FIGURES)))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with all their columns."""
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(at)) >= threshold))

    return support.by_batch(docs, run, docs.schema)


@support.query("op3_quality_model")
def op3(spark, sf_dir):
    docs = support.table(spark, sf_dir, "documents")
    found = scored(docs, fitted(docs, support.table(spark, sf_dir, "labels")))
    return found.select("doc_id", (support.crc_rest(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
