"""Exact quantiles per group without collecting a group into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworth.session import materialise

_ACCURACY = 10_000
_MARGIN = 5 / _ACCURACY
# Rows below which a group is one bracket.
_SMALL = _ACCURACY
# Rows of a bracket above which it is narrowed by further passes, and the parts into which each of these cuts it.
MOST_ROWS, PARTS = 200_000, 64


def _same(groups: Sequence[str], left: str, right: str) -> Column:
    return reduce(Column.__and__, (F.col(f"{left}.{g}").eqNullSafe(F.col(f"{right}.{g}")) for g in groups), F.lit(True))


def _within(df: DataFrame, bounds: DataFrame, groups: list[str]) -> DataFrame:
    """Each value beside the brackets of its group."""
    both = df.alias("v").join(bounds.alias("b"), _same(groups, "v", "b"))
    return both.select(*(f"v.{g}" for g in groups), "_total", "_value", F.inline("_brackets"))


def _place(probabilities: Sequence[float], slot: Column) -> Column:
    """Position of a quantile among the values of its group, as a number with a fraction."""
    return (F.col("_total") - 1).cast("double") * F.get(F.array(*(F.lit(p) for p in probabilities)), F.floor(slot / 2).cast("int"))


def _rank(probabilities: Sequence[float]) -> Column:
    """The rank that a slot looks for: even slots the one at or below the quantile's place, odd ones that at or above it."""
    place = _place(probabilities, F.col("_slot"))
    return F.when(F.col("_slot") % 2 == 0, F.floor(place)).otherwise(F.ceil(place))


def _narrowed(df: DataFrame, bounds: DataFrame, groups: list[str], probabilities: Sequence[float]) -> DataFrame:
    """Brackets that keep the rank of each slot but hold only the part in which it lies.

    Pivots cut a bracket into parts of about equal numbers of rows; a pivot's own rows are a part by themselves. So a
    part either has one value, and is done, or holds about a PARTS-th of the bracket's rows: the passes end after as
    many as it takes to divide the rows of the largest group by PARTS down to `most_rows`, whatever values are heavy.
    """
    keys = [*groups, "_total", "_slot", "_low", "_high"]
    inside = (F.col("_value") >= F.col("_low")) & (F.col("_value") <= F.col("_high"))
    at = F.array(*(F.lit(i / PARTS) for i in range(1, PARTS)))
    open_ = _within(df, bounds, groups).filter(inside & (F.col("_low") < F.col("_high")))
    pivots = open_.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_value", at, F.lit(_ACCURACY))).alias("_pivots"))
    brackets = bounds.select(*groups, "_total", F.inline("_brackets"))
    cut = brackets.alias("a").join(pivots.alias("b"), _same([*groups, "_slot"], "a", "b"), "left").select("a.*", "_pivots")
    bracket = F.struct("_slot", "_low", "_high", "_pivots")
    cut = materialise(cut.groupBy(*groups, "_total").agg(F.collect_list(bracket).alias("_brackets")), "quantile-pivots")
    above = F.size(F.filter("_pivots", lambda x: x < F.col("_value")))
    part = F.when(F.col("_pivots").isNull(), 0).otherwise(2 * above + F.array_contains("_pivots", F.col("_value")).cast("int"))
    parts = (
        _within(df, cut, groups)
        .filter(F.col("_value") <= F.col("_high"))
        .groupBy(*keys, F.when(inside, part).otherwise(-1).alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_value").alias("_from"), F.max("_value").alias("_to"))
    )
    counted = parts.withColumn("_after", F.sum("_rows").over(Window.partitionBy(*groups, "_slot").orderBy("_part")))
    rank = _rank(probabilities)
    kept = counted.filter((F.col("_part") >= 0) & (F.col("_after") > rank) & (F.col("_after") - F.col("_rows") <= rank))
    bracket = F.struct("_slot", F.col("_from").alias("_low"), F.col("_to").alias("_high"))
    return kept.groupBy(*groups, "_total").agg(F.collect_list(bracket).alias("_brackets"))


def quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    *aggregates: Column,
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """Quantiles with linear interpolation between neighbours, one named column each, beside any further
    `aggregates`; one row per group.

    A first pass takes the aggregates and, from approximate percentiles, a bracket around each of the two ranks that a
    quantile lies between. Brackets of more than `most_rows` rows are cut into parts and narrowed, pass by pass, until
    they hold fewer or one value only. A last pass counts, inside the scan tasks, the rows below each bracket as one
    number and the rows within it by value. So a task sorts at most `most_rows` values, however large a group is and
    however its values repeat. A rank outside its bracket stops the job. A group without values has null quantiles.
    """
    groups = list(groups)
    number = F.col(value).cast("double")
    asked = list(probabilities.values())
    edges = [0.0, 1.0, *(edge for p in asked for edge in (max(p - _MARGIN, 0.0), min(p + _MARGIN, 1.0)))]
    near = F.percentile_approx(number, F.array(*(F.lit(e) for e in edges)), F.lit(_ACCURACY))
    first_pass = materialise(
        df.groupBy(*groups).agg(*aggregates, F.count(number).alias("_total"), near.alias("_near")), "quantile-brackets"
    )
    # In small groups the margin is less than a rank; their bracket is all they have.
    small = F.col("_total") < _SMALL

    def edge(slot: int, side: int) -> Column:
        return F.get("_near", F.when(small, side).otherwise(2 + slot // 2 * 2 + side))

    brackets = [F.struct(F.lit(slot).alias("_slot"), edge(slot, 0).alias("_low"), edge(slot, 1).alias("_high")) for slot in range(2 * len(asked))]
    values = df.select(*groups, number.alias("_value")).filter(F.col("_value").isNotNull())
    bounds = first_pass.select(*groups, "_total", F.array(*brackets).alias("_brackets"))
    # A bracket holds about 2 x _MARGIN of a large group; only brackets of groups beyond that are looked at again.
    held = F.when(small, F.col("_total")).otherwise(F.col("_total") * (2 * _MARGIN))
    largest = first_pass.agg(F.max(held)).first()[0] or 0
    while largest > most_rows:
        bounds = materialise(_narrowed(values, bounds, groups, asked), "quantile-brackets")
        inside = (F.col("_value") >= F.col("_low")) & (F.col("_value") <= F.col("_high")) & (F.col("_low") < F.col("_high"))
        counts = _within(values, bounds, groups).filter(inside).groupBy(*groups, "_slot").agg(F.count(F.lit(1)).alias("_rows"))
        largest = counts.agg(F.max("_rows")).first()[0] or 0

    within = (F.col("_value") >= F.col("_low")) & (F.col("_value") <= F.col("_high"))
    counted = (
        _within(values, bounds, groups)
        .filter(F.col("_value") <= F.col("_high"))
        .groupBy(*groups, "_total", "_slot", F.when(within, F.col("_value")).alias("_key"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    ranked = counted.withColumn("_after", F.sum("_rows").over(Window.partitionBy(*groups, "_slot").orderBy("_key")))  # null: below
    rank = _rank(asked)
    here = F.col("_key").isNotNull() & (F.col("_after") > rank) & (F.col("_after") - F.col("_rows") <= rank)
    found = ranked.groupBy(*groups, "_total", "_slot").agg(F.max(F.when(here, F.col("_key"))).alias("_exact"))

    def of(slot: int) -> Column:
        return F.max(F.when(F.col("_slot") == slot, F.col("_exact")))

    outside = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")

    def between(slot: int) -> Column:
        place = _place(asked, F.lit(2 * slot))
        exact = of(2 * slot) + (of(2 * slot + 1) - of(2 * slot)) * (place - F.floor(place))
        return F.when(exact.isNotNull(), exact).otherwise(outside)

    wide = found.groupBy(*groups, "_total").agg(*(between(slot).alias(name) for slot, name in enumerate(probabilities)))
    joined = first_pass.drop("_total", "_near").alias("a").join(wide.alias("b"), _same(groups, "a", "b"), "left")
    return joined.select("a.*", *(f"b.{name}" for name in probabilities))
