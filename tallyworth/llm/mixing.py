"""Mix sources to target weights.

Source shares of tokens are raised to an exponent, which is bisected until the weights have a target entropy or no
source is repeated too often. The weights times a token budget are then filled from block permutations: every source
is dealt into blocks in a random but fixed order, anew in every pass; whole passes go through all blocks, the last pass stops
at the budget.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworth.llm.common import WHITE, text_or_empty, written

# Blocks per source: their totals are the only rows that one task orders.
BLOCKS = 4096
# The list of sources comes to the driver; more of them raise.
MOST_SOURCES = 100_000
BISECTIONS = 60


@dataclass(frozen=True)
class Target:
    """What the exponent has to meet, and the budget as a multiple of all tokens.

    `entropy` is the share of the greatest possible entropy that the weights must reach; `repeats` is the number of passes
    over a source that may not be exceeded. The largest exponent in [0, 1] is taken that reaches the entropy; if a
    source is then repeated too often, the exponent is raised until none is (or it is 1, the natural mix). Without a
    `budget` it is the smallest one that passes over every source once, so that no document is left out.
    """

    entropy: float = 0.97
    repeats: float = 4.0
    budget: float | None = None


def weights_at(exponent: float, shares: list[float]) -> list[float]:
    powers = [s**exponent if s > 0 else 0.0 for s in shares]
    total = math.fsum(powers)
    return [p / total for p in powers]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def _bisect(holds) -> float:
    """The largest exponent in [0, 1] for which `holds`, which is true at 0 and turns false once."""
    if holds(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(BISECTIONS):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def budget_at(weights: list[float], shares: list[float], target: Target) -> float:
    return target.budget if target.budget is not None else max(s / w for s, w in zip(shares, weights))


def mixing_weights(tokens: dict[str, int], target: Target = Target()) -> dict[str, float]:
    """Weight per source with tokens; they sum to 1."""
    names = sorted(n for n, t in tokens.items() if t > 0)
    total = sum(tokens[n] for n in names)
    if not names:
        return {}
    shares = [tokens[n] / total for n in names]
    goal = target.entropy * math.log(len(names))
    exponent = _bisect(lambda a: entropy(weights_at(a, shares)) >= goal) if len(names) > 1 else 1.0

    def too_often(a: float) -> bool:
        weights = weights_at(a, shares)
        return max(w / s for w, s in zip(weights, shares)) * budget_at(weights, shares, target) > target.repeats

    if too_often(exponent):
        low, high = exponent, 1.0
        for _ in range(BISECTIONS):
            middle = (low + high) / 2
            low, high = (middle, high) if too_often(middle) else (low, middle)
        exponent = high
    return dict(zip(names, weights_at(exponent, shares)))


def mixing_plan(tokens: dict[str, int], target: Target = Target()) -> list[tuple[str, float, int, int]]:
    """Per source with tokens: name, weight, whole passes, and the tokens left for the last pass."""
    weights = mixing_weights(tokens, target)
    total = sum(tokens[n] for n in weights)
    if not total:
        return []
    budget = total * budget_at(list(weights.values()), [tokens[n] / total for n in weights], target)
    return [(name, weight, *divmod(int(budget * weight + 0.5), tokens[name])) for name, weight in weights.items()]


def n_tokens(column: str = "text"):
    """Words of the text; null has none."""
    spaced = F.trim(F.regexp_replace(text_or_empty(column), f"{WHITE}+", " "))
    return F.when(spaced == "", 0).otherwise(F.size(F.split(spaced, " "))).cast("long")


def _block(seed: int, epoch: Column) -> Column:
    """The block of a document in a pass: every pass deals the documents anew."""
    return F.pmod(F.xxhash64(F.lit(seed), epoch.cast("long"), F.col("doc_id")), F.lit(BLOCKS)).cast("int")


def _spot(seed: int, epoch: Column) -> Column:
    """The place of a document within its block in a pass."""
    return F.xxhash64(F.lit(seed + 1), epoch.cast("long"), F.col("doc_id"))


def _numbered(docs: DataFrame, carry: bool) -> DataFrame:
    """The rows with tokens, numbered: written, so that the numbers are fixed facts."""
    return written(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            n_tokens().alias("tokens"),
            F.monotonically_increasing_id().alias("_row"),
            *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")] if carry else []),
        ).filter("tokens > 0"),
        "mixing-rows",
    )


def _draws(numbered: DataFrame, target: Target, seed: int) -> DataFrame:
    spark = numbered.sparkSession
    rows = numbered.select("doc_id", "source", "tokens", "_row")
    found = rows.groupBy("source").agg(F.sum("tokens").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals = {(r["source"] is None, r["source"] or ""): r["n"] for r in found}
    plan = [(None if key[0] else key[1], *rest) for key, *rest in mixing_plan(totals, target)]
    plans = F.broadcast(spark.createDataFrame(plan, "_source string, weight double, passes long, rest long"))  # at most MOST_SOURCES rows
    planned = rows.join(plans, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # Whole passes take every document; only the last one is cut, in the order that it has.
    last_pass = planned.withColumn("block", _block(seed, F.col("passes"))).withColumn("place", _spot(seed, F.col("passes")))
    blocks = written(last_pass.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("n")), "mixing-blocks")

    # At most BLOCKS rows of a source meet in a task, whatever the size of the source.
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.coalesce(F.sum("n").over(earlier), F.lit(0))
    cuts = written(blocks.select("source", "block", "n", room.alias("_room")), "mixing-cuts")
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.block") == F.col("b.block"))
    # Only the block in which the budget of a source ends is looked at row by row.
    edge = last_pass.alias("a").join(cuts.filter("_room > 0 AND _room < n").alias("b"), same).select("a.*", "_room")
    running = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("place", "doc_id", "_row"))
    last = edge.withColumn("_sum", running).filter("_sum <= _room").select("_row", F.lit(1).alias("_last"))
    extra = F.when(F.col("_room") >= F.col("n"), 1).otherwise(F.coalesce("_last", F.lit(0)))
    times = (F.col("passes") + extra).cast("int")
    # The cuts have a row per block, so they may be large: Spark picks the joins by measured sizes.
    cut = last_pass.alias("a").join(cuts.alias("b"), same).select("a.*", "n", "_room")
    drawn = cut.join(last, "_row", "left").withColumn("_times", times).filter("_times > 0")
    each = drawn.select("doc_id", "source", "tokens", "weight", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("epoch"), "_row")
    return each.select("doc_id", "source", "tokens", "weight", "epoch", _block(seed, F.col("epoch")).alias("block"), _spot(seed, F.col("epoch")).alias("place"), "_row")


def mix(docs: DataFrame, target: Target = Target(), seed: int = 42) -> DataFrame:
    """Every draw of a document: doc_id, source, tokens, weight, epoch, block, place.

    Needs doc_id, source and text. A null source is a source of its own. Documents without tokens are not drawn. The
    budget of a source is rounded to tokens, and a pass stops before the first document of its last block that would
    exceed it. Order and choice depend on id, pass and seed only; repeated rows are drawn each for itself. An empty
    table gives an empty result.
    """
    return _draws(_numbered(docs, False), target, seed).drop("_row")


def mixed(docs: DataFrame, target: Target = Target(), seed: int = 42) -> DataFrame:
    """The drawn documents with the columns of `docs`; a document drawn twice is there twice."""
    numbered = _numbered(docs, True)
    return numbered.select("_doc", "_row").join(_draws(numbered, target, seed).select("_row"), "_row").select("_doc.*")
