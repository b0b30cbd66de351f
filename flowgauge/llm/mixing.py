"""Mixing sources to target weights: a tempered share for each source, realised as budgeted permutations of blocks.

A source's weight is its token share to the power of an exponent, normalised. The exponent is bisected on a grid of
2^-20 between 0 (all sources alike) and 1 (as they are). A budget of tokens then gives every source a quota. A quota
above a source's size repeats it in whole epochs; the rest is a prefix of a permutation. Documents are hashed to blocks of
about equal tokens and each epoch permutes the blocks, so no task ever orders a whole source: running sums go over
slices of a permutation, and documents are put in order only inside the one block in which a quota ends.
All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowgauge.llm import support

GRID = 1 << 20
#: Levels of the bisection that one job decides.
LEVELS = 5


def words(text: Column) -> Column:
    """How many words a text has: maximal runs without spaces; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{support.SPACES}]+")).cast("long")


def _weight(alpha: Column) -> Column:
    return F.when(F.col("tokens") > 0, F.pow(F.col("share"), alpha)).otherwise(0.0)


def _bisect(totals: DataFrame, holds: Column, low: int = 0, high: int = GRID) -> int:
    """The largest grid step in [low, high] for which ``holds`` (an aggregate over ``w``) is true, given that low's is."""
    while high > low:
        probes = min((1 << LEVELS) - 1, high - low)
        steps = sorted({low + -(-(high - low) * (i + 1) // (probes + 1)) for i in range(probes)})
        probed = totals.select("tokens", "share", F.explode(F.array(*[F.lit(step) for step in steps])).alias("step"))
        probed = probed.withColumn("w", _weight(F.col("step") / GRID)).groupBy("step").agg(holds.alias("holds"))
        held = {row["step"]: row["holds"] for row in probed.collect()}  # one row for each probe
        low = max((step for step in steps if held.get(step, True)), default=low)
        high = min((step - 1 for step in steps if step > low), default=high)
    return low


def temperature(totals: DataFrame, entropy: float | None = None, epochs: float | None = None,
                budget: int | None = None) -> float:
    """The exponent in [0, 1] for ``totals`` (source, tokens, share).

    ``entropy``: the mix must have this part of the largest entropy (the logarithm of the number of sources); the largest
    exponent that reaches it is taken, 0 if none does. ``epochs``: no source may be repeated more often, where ``budget``
    tokens are drawn (None: as many as it takes to use every source whole at least once); the smallest exponent that keeps
    to it is taken, 1 if none does. With both, the repetition limit wins.
    """
    w, used = F.col("w"), F.col("tokens") > 0
    spread = F.log(F.sum(w)) - F.sum(F.when(w > 0, w * F.log(w)).otherwise(0.0)) / F.sum(w)
    step = GRID
    if entropy is not None:
        enough = spread >= entropy * F.log(F.sum(F.when(used, 1).otherwise(0)))
        step = _bisect(totals, F.coalesce(enough, F.lit(True)))
    if epochs is not None:
        each = w / F.when(used, F.col("tokens"))
        most = F.max(each) / F.min(each) if budget is None else F.max(each) * F.lit(float(budget)) / F.sum(w)
        over = F.coalesce(most > epochs, F.lit(False))  # true while the exponent is too small
        at_zero = totals.withColumn("w", _weight(F.lit(0.0))).agg(over).first()[0]
        least = min(GRID, _bisect(totals, over) + 1) if at_zero else 0
        step = max(step, least) if entropy is not None else least
    return step / GRID


def quotas(totals: DataFrame, alpha: float, budget: int | None) -> DataFrame:
    """``totals`` with each source's weight, quota of tokens, whole epochs and what is left for a part of an epoch.

    A source without words is one whole epoch if there is no budget.
    """
    z = totals.agg(F.sum(_weight(F.lit(alpha))).alias("z")).first()[0] or 1.0
    rows = totals.withColumn("weight", _weight(F.lit(alpha)) / F.lit(z))
    if budget is None:  # the least budget that holds every source whole
        need = rows.agg(F.max(F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight")))).first()[0] or 0.0
        quota = F.greatest(F.floor(F.col("weight") * F.lit(need)), F.col("tokens"))
    else:
        quota = F.floor(F.col("weight") * F.lit(float(budget)))
    rows = rows.withColumn("quota", quota.cast("long"))
    whole = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(0 if budget is not None else 1)
    return rows.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens"))


def _hex_number(text: Column) -> Column:
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("long")


def mixed(docs: DataFrame, entropy: float | None = None, epochs: float | None = None, budget: int | None | str = "corpus",
          block_tokens: int = 1 << 16, seed: int = 7, text: str = "text", source: str = "source",
          doc_id: str = "doc_id") -> DataFrame:
    """One row for each use of a document: row (its columns), tokens, quota (its source's), epoch, block, block_start.

    ``budget``: tokens to draw; "corpus": as many as there are; None: the least that uses every source whole. A source is
    read block after block, epoch after epoch; block_start is a block's first token in that stream. Documents of the block
    in which the quota ends are taken in hashed order as long as they fit, so a source never exceeds its quota.
    A null text counts as empty; a document without words is used whenever its block is. A missing source is a source of
    its own. A source without any words gets no weight; it is used once if ``budget`` is None, and else not at all. Sources of equal size get equal weights; rows that
    repeat are documents of their own. Clashing names of other columns are kept inside ``row``. No rows give no rows.
    """
    known = F.when(docs[source].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), docs[source].cast("string")))
    name = F.coalesce(docs[doc_id].cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), known.alias("source"),
        words(docs[text]).alias("tokens"), F.md5(F.concat(F.lit(f"{seed}|"), name).cast("binary")).alias("place"),
    )
    slim = rows.select("source", "tokens", "place")
    totals = support.stored(slim.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-totals")
    all_tokens = totals.agg(F.sum("tokens")).first()[0] or 0
    totals = totals.withColumn("share", F.col("tokens") / F.lit(max(all_tokens, 1)))
    budget = all_tokens if budget == "corpus" else budget
    alpha = temperature(totals, entropy, epochs, budget)
    plan = quotas(totals, alpha, budget).select(
        F.col("source").alias("s"), F.col("tokens").alias("size"), "quota", "whole", "rest",
        F.expr(f"greatest(1, (tokens + {block_tokens - 1}) div {block_tokens})").alias("blocks"),
    )

    def in_blocks(part: DataFrame) -> DataFrame:
        return part.join(plan, F.col("source") == F.col("s")).withColumn("block", _hex_number(F.col("place")) % F.col("blocks"))

    blocks = in_blocks(slim).groupBy("source", "block", "size", "quota", "whole", "rest").agg(F.sum("tokens").alias("held"))
    uses = blocks.withColumn("epoch", F.explode(F.expr("sequence(0L, whole - if(rest > 0, 0L, 1L))"))).where(
        "epoch >= 0 and (epoch < whole or epoch * size < quota)"
    )
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "epoch", "source", "block").cast("binary"))
    uses = uses.withColumn("order", order).withColumn("slice", F.substring("order", 1, 2))
    slices = uses.groupBy("source", "epoch", "slice").agg(F.sum("held").alias("slice_held"))
    before = Window.partitionBy("source", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("slice_start", F.coalesce(F.sum("slice_held").over(before), F.lit(0))).drop("slice_held")
    inside = Window.partitionBy("source", "epoch", "slice").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    uses = uses.withColumn("inner", F.coalesce(F.sum("held").over(inside), F.lit(0))).join(slices, ["source", "epoch", "slice"])
    uses = uses.withColumn("since", F.col("slice_start") + F.col("inner")).where("epoch < whole or since < rest")
    uses = uses.select(
        F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "quota",
        (F.col("epoch") * F.col("size") + F.col("since")).alias("block_start"),
        F.when((F.col("epoch") == F.col("whole")) & (F.col("since") + F.col("held") > F.col("rest")),
               F.col("rest") - F.col("since")).alias("room"),
    )
    uses = support.stored(uses, "mix-blocks")
    placed = in_blocks(rows).select("row", "source", "tokens", "place", "block")
    used = placed.join(uses, (F.col("source") == F.col("s")) & (F.col("block") == F.col("b")))
    columns = ["row", "tokens", "quota", "epoch", "block", "block_start"]
    ordered = Window.partitionBy("s", "b").orderBy("place", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = used.where("room is not null").withColumn("upto", F.sum("tokens").over(ordered)).where("upto <= room")
    return used.where("room is null").select(*columns).unionByName(last.select(*columns))


#: Part of the largest entropy that the mix has to reach, and how often a source may be repeated.
ENTROPY, EPOCHS = 0.95, 4.0

SQL = f"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens,
         md5('7|' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents
), t AS (
  SELECT s, sum(tokens)::BIGINT AS size, sum(tokens) / sum(sum(tokens)) OVER () AS share,
         sum(sum(tokens)) OVER ()::DOUBLE AS budget
  FROM d GROUP BY s
), coarse AS (
  SELECT max(k) AS k FROM (
    SELECT k, ln(sum(pow(share, k / {GRID}.0))) - sum(pow(share, k / {GRID}.0) * ln(pow(share, k / {GRID}.0)))
              / sum(pow(share, k / {GRID}.0)) >= {ENTROPY} * ln(count(*)) AS ok
    FROM t, range(0, {GRID} + 1, 1024) g(k) WHERE size > 0 GROUP BY k) WHERE ok
), fine AS (
  SELECT max(k) AS k FROM (
    SELECT k, ln(sum(pow(share, k / {GRID}.0))) - sum(pow(share, k / {GRID}.0) * ln(pow(share, k / {GRID}.0)))
              / sum(pow(share, k / {GRID}.0)) >= {ENTROPY} * ln(count(*)) AS ok
    FROM t, (SELECT DISTINCT least(coalesce(c.k, 0) + i, {GRID}) AS k FROM coarse c, range(0, 1024) r(i)) g
    WHERE size > 0 GROUP BY k) WHERE ok
), rough AS (
  SELECT min(k) AS k FROM (
    SELECT k, max(pow(share, k / {GRID}.0) / size) * max(budget) / sum(pow(share, k / {GRID}.0)) > {EPOCHS} AS much
    FROM t, range(0, {GRID} + 1, 64) g(k) WHERE size > 0 GROUP BY k) WHERE NOT much
), near AS (
  SELECT min(k) AS k FROM (
    SELECT k, max(pow(share, k / {GRID}.0) / size) * max(budget) / sum(pow(share, k / {GRID}.0)) > {EPOCHS} AS much
    FROM t, (SELECT DISTINCT greatest(o.k - i, 0) AS k FROM rough o, range(0, 64) r(i)) g
    WHERE size > 0 GROUP BY k) WHERE NOT much
), a AS (
  SELECT greatest(coalesce((SELECT k FROM fine), 0), coalesce((SELECT k FROM near), {GRID})) / {GRID}.0 AS alpha
), q AS (
  SELECT s, size, quota, CASE WHEN size > 0 THEN quota // size ELSE 0 END AS whole,
         CASE WHEN size > 0 THEN quota % size ELSE quota END AS rest, greatest(1, (size + 65535) // 65536) AS blocks
  FROM (SELECT s, size, floor(CASE WHEN size > 0 THEN pow(share, alpha) ELSE 0 END
               / sum(CASE WHEN size > 0 THEN pow(share, alpha) ELSE 0 END) OVER () * budget)::BIGINT AS quota FROM t, a)
), placed AS (
  SELECT d.*, q.* EXCLUDE (s), ('0x' || substr(place, 1, 15))::BIGINT % blocks AS block FROM d JOIN q USING (s)
), b AS (
  SELECT s, block, size, quota, whole, rest, sum(tokens)::BIGINT AS held FROM placed GROUP BY ALL
), e AS (
  SELECT *, unnest(range(0, whole + 1)) AS epoch FROM b
), o AS (
  SELECT *, coalesce(sum(held) OVER (PARTITION BY s, epoch
                     ORDER BY md5('7|' || epoch || '|' || s || '|' || block), block
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS since
  FROM e WHERE epoch < whole OR rest > 0
), u AS (
  SELECT p.doc_id, p.source, p.tokens, p.quota, o.epoch, p.block, (o.epoch * o.size + since)::BIGINT AS block_start,
         CASE WHEN o.epoch = o.whole AND since + held > o.rest THEN o.rest - since END AS room,
         sum(p.tokens) OVER (PARTITION BY o.epoch, p.s, p.block ORDER BY p.place, p.tokens
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM placed p JOIN o ON p.s = o.s AND p.block = o.block
  WHERE o.epoch < o.whole OR since < o.rest
)
SELECT doc_id, source, tokens, quota, epoch::BIGINT AS epoch, block::BIGINT AS block, block_start
FROM u WHERE room IS NULL OR upto <= room
"""


@support.query("op1_source_mixing", SQL)
def op1(spark, sf_dir):
    uses = mixed(support.table(spark, sf_dir, "documents"), entropy=ENTROPY, epochs=EPOCHS)
    return uses.select("row.doc_id", "row.source", "tokens", "quota", "epoch", "block", "block_start")
