"""One-dimensional k-means over per-user measures, with ordered labels.

Several measures ("axes") and several k are fitted together: each round is one small aggregation over the
distinct values, whatever the number of fits. Values are whole units (cents for money), so sums are exact
and centres do not depend on the order in which tasks finish.
"""

from __future__ import annotations

import warnings
from bisect import bisect_right
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from itertools import accumulate
from math import inf

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

from tallyworth.functions.means import exact_mean
from tallyworth.session import hold, materialise

MAX_ITER = 300
ELBOW_ITER = 1000
TOLERANCE = 1e-4
BINS = 1024
BLOCK = 32
_ENDLESS = "double('infinity')"


@dataclass(frozen=True)
class Fit:
    """Ascending centres of one axis, in units; `scale` decimal places make one unit of the column.

    `used` lists the clusters that own at least one row.
    """

    axis: str
    k: int
    centres: tuple[float, ...]
    scale: int = 0
    rounds: int = 0
    settled: bool = False
    used: tuple[int, ...] = ()

    def borders(self) -> list[float]:
        """Midpoints between neighbouring centres; a value on a border belongs to the lower cluster."""
        return [(a + b) / 2 for a, b in zip(self.centres, self.centres[1:])]


def _scale(df: DataFrame, column: str) -> int | None:
    kind = df.schema[column].dataType
    if isinstance(kind, (DoubleType, FloatType)):
        return None
    return kind.scale if isinstance(kind, DecimalType) else 0


def _units(column: str, scale: int | None) -> Column:
    if scale is None:
        return F.col(column).cast("double")
    value = F.col(column)
    return (value * F.lit(10**scale) if scale else value).cast("bigint")


def axis_counts(df: DataFrame, axes: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """Distinct values of each axis with their number of rows, held for the rounds of a fit.

    Recency and frequency repeat heavily, so every round reads few rows for them. `df` should be a written
    table, as `customer_base` returns: a lost executor then costs one aggregation of it.
    """
    scales = {axis: _scale(df, axis) for axis in axes}
    exact = all(s is not None for s in scales.values())
    units = [F.struct(F.lit(a).alias("axis"), _units(a, s if exact else None).alias("value")) for a, s in scales.items()]
    counts = (
        df.select(F.inline(F.array(*units)))
        .filter(F.col("value").isNotNull())
        .groupBy("axis", "value")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    return hold(counts), {a: (s or 0) if exact else 0 for a, s in scales.items()}


def _cluster(value: str, borders: Sequence[float]) -> str:
    """SQL for the number of borders below a value, which is the index of its nearest centre.

    Text, because building some hundred Column objects per round from Python costs more than the round.
    """
    steps = [f"int(double({value}) > {border!r}D)" for border in borders]
    return " + ".join(steps) if steps else f"CASE WHEN {value} IS NOT NULL THEN 0 END"


def _array(values: Sequence[float]) -> str:
    return f"array({', '.join(_ENDLESS if value == inf else f'{value!r}D' for value in values)})"


def _by_axis(expressions: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{axis}' THEN {text}" for axis, text in expressions.items())
    return f"CASE axis {cases} END"


def _per_cluster(counts: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    """Every distinct value with its cluster in each fit of its axis."""
    by_axis: dict[str, list[str]] = {}
    for number, fit in enumerate(fits):
        by_axis.setdefault(fit.axis, []).append(f"struct({number} AS fit, {_cluster('value', fit.borders())} AS cluster)")
    arrays = {axis: f"array({', '.join(rows)})" for axis, rows in by_axis.items()}
    labels = F.expr(f"inline({_by_axis(arrays)})")
    return counts.filter(F.col("axis").isin(list(by_axis))).select("value", "weight", labels)


def _sums(counts: DataFrame, fits: Sequence[Fit]) -> dict[tuple[int, int], tuple[float, int]]:
    """Sum and weight of each (fit, cluster); as many rows as there are centres come to the driver."""
    sums = _per_cluster(counts, fits).groupBy("fit", "cluster").agg(
        F.sum(F.col("value") * F.col("weight")).alias("total"), F.sum("weight").alias("weight")
    )
    return {(r["fit"], r["cluster"]): (float(r["total"]), r["weight"]) for r in sums.collect()}


def _advance(fit: Fit, sums: dict[int, tuple[float, int]], variance: float, tolerance: float) -> Fit:
    """Move every centre to the mean of its cluster; an empty cluster keeps its centre."""
    moved = tuple(
        sums[i][0] / sums[i][1] if i in sums else centre for i, centre in enumerate(fit.centres)
    )
    shift = sum((a - b) ** 2 for a, b in zip(moved, fit.centres))
    return replace(fit, centres=moved, rounds=fit.rounds + 1, settled=shift <= tolerance * variance)


def _in_buckets(counts: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Every distinct value with the number of its axis's cuts below it, as `bin`."""
    blocks = {axis: [values[i : i + BLOCK] for i in range(0, len(values), BLOCK)] for axis, values in cuts.items()}
    ends = {axis: _array([block[-1] for block in parts]) for axis, parts in blocks.items()}
    inner = {axis: f"array({', '.join(map(_array, [*parts, [inf]]))})" for axis, parts in blocks.items()}
    # First the block of cuts, then the place in it: some sixty comparisons instead of a thousand.
    block = f"size(filter({_by_axis(ends)}, c -> c < double(value)))"
    place = f"{BLOCK} * block + size(filter(get({_by_axis(inner)}, block), c -> c < double(value)))"
    return counts.withColumn("block", F.expr(block)).withColumn("bin", F.expr(place)).drop("block")


def _cut_values(counts: DataFrame, axes: Sequence[str]) -> dict[str, list[float]]:
    """The values at the ranks floor(j n / BINS) of all n rows of each axis, j = 1 .. BINS - 1, ascending, each once.

    Approximate percentiles only deal the distinct values out to tasks. The running weights, and so the cuts, are
    exact, whatever the dealing: the buckets' weights give each bucket's start, and each bucket counts on in order.
    """
    steps = F.array(*(F.lit(j / BINS) for j in range(1, BINS)))
    near = counts.filter(F.col("axis").isin(list(axes))).groupBy("axis").agg(F.percentile_approx(F.col("value").cast("double"), steps).alias("cuts"))
    dealt = {r["axis"]: sorted(set(r["cuts"])) for r in near.collect()}
    if not dealt:
        return {}
    rows = _in_buckets(counts.filter(F.col("axis").isin(list(dealt))), dealt)
    # At most BINS rows per axis.
    sizes = rows.groupBy("axis", "bin").agg(F.sum("weight").alias("rows")).collect()
    starts, totals = [], {}
    for axis in dealt:
        before = 0
        for size in sorted((r for r in sizes if r["axis"] == axis), key=lambda r: r["bin"]):
            starts.append((axis, size["bin"], before))
            before += size["rows"]
        totals[axis] = before
    offsets = counts.sparkSession.createDataFrame([(*s, totals[s[0]]) for s in starts], "axis string, bin int, start long, n long")
    running = F.sum("weight").over(Window.partitionBy("axis", "bin").orderBy("value"))
    upto = rows.withColumn("upto", running).join(F.broadcast(offsets), ["axis", "bin"]).withColumn("upto", F.col("start") + F.col("upto"))
    # Ranks floor(j n / BINS) below x: as many as there are j with j n / BINS < x.
    below = f"least({BINS} * {{}} + n - 1, {BINS} * n) div n - 1"
    holds = F.expr(f"({below.format('upto')}) > greatest({below.format('(upto - weight)')}, 0)")
    cuts: dict[str, list[float]] = {axis: [] for axis in dealt}
    for row in upto.filter(holds).select("axis", "value").collect():
        cuts[row["axis"]].append(float(row["value"]))
    return {axis: sorted(values) for axis, values in cuts.items()}


@dataclass(frozen=True)
class Summary:
    """Sums over the bins of one axis: running weights and totals, starting at 0, and the bins' means."""

    weights: tuple[int, ...]
    totals: tuple[float, ...]
    means: tuple[float, ...]
    variance: float

    def start(self, k: int) -> tuple[float, ...]:
        """For each cluster i of k, the mean of the bin that holds rank floor((2i + 1) n / 2k)."""
        ranks = ((2 * i + 1) * self.weights[-1] // (2 * k) for i in range(k))
        return tuple(self.means[bisect_right(self.weights, rank) - 1] for rank in ranks)

    def sums(self, borders: Sequence[float]) -> dict[int, tuple[float, int]]:
        """Total and weight per cluster, each bin standing at its mean."""
        edges = [0, *(bisect_right(self.means, border) for border in borders), len(self.means)]
        spans = enumerate(zip(edges, edges[1:]))
        return {i: (float(self.totals[b] - self.totals[a]), self.weights[b] - self.weights[a]) for i, (a, b) in spans if b > a}


def _summaries(counts: DataFrame, cuts: dict[str, list[float]]) -> dict[str, Summary]:
    """Weight, total and spread of each bin: at most 1,024 rows per axis, whatever the data's size.

    Squares are of the distance to the bin's own smallest value, so that values far from 0 keep their digits.
    """
    binned, value, weight = _in_buckets(counts, cuts), F.col("value"), F.col("weight")
    lows = binned.groupBy("axis", "bin").agg(F.min("value").alias("low"))
    distance = (value - F.col("low")).cast("double")
    rows = (
        # One row per bin: the planner sees how few they are.
        binned.join(lows, ["axis", "bin"])
        .groupBy("axis", "bin", "low")
        .agg(
            F.sum(value * weight).alias("total"),
            F.sum("weight").alias("weight"),
            F.sum(distance * weight).alias("beyond"),
            F.sum(distance * distance * weight).alias("squares"),
        )
        .collect()
    )
    out = {}
    for axis in cuts:
        bins = sorted((r for r in rows if r["axis"] == axis), key=lambda r: r["bin"])
        weights = tuple(accumulate((r["weight"] for r in bins), initial=0))
        totals = tuple(accumulate((r["total"] for r in bins), initial=0))
        means = tuple(float(r["total"]) / r["weight"] for r in bins)
        mean = float(totals[-1]) / weights[-1]
        within = sum(max(r["squares"] - r["beyond"] * r["beyond"] / r["weight"], 0.0) for r in bins)
        between = sum(r["weight"] * (m - mean) ** 2 for r, m in zip(bins, means))
        out[axis] = Summary(weights, totals, means, (within + between) / weights[-1])
    return out


def _start(axis: str, k: int, scale: int, summary: Summary, max_iter: int) -> Fit:
    """Rounds over the bins alone until nothing moves, to begin the exact rounds close to their end."""
    fit = Fit(axis, k, summary.start(k), scale)
    while fit.rounds < max_iter and not fit.settled:
        fit = _advance(fit, summary.sums(fit.borders()), summary.variance, 0.0)
    return replace(fit, rounds=0, settled=False)


def _again(fit: Fit | None, k: int, scale: int) -> Fit | None:
    """The centres of an earlier fit as a start, in the units of now; none if it had another number of clusters."""
    if fit is None or fit.k != k:
        return None
    unit = 10.0 ** (scale - fit.scale)
    return replace(fit, centres=tuple(c * unit for c in fit.centres), scale=scale, rounds=0, settled=False)


def fit_counts(
    counts: DataFrame,
    wanted: Sequence[tuple[str, int]],
    scales: dict[str, int],
    max_iter: int = MAX_ITER,
    tolerance: float = TOLERANCE,
    begin: Mapping[str, Fit] | None = None,
) -> list[Fit]:
    """Fit each (axis, k) on a table from `axis_counts`; an axis without values has no fit.

    An axis with a fit of as many clusters in `begin` starts from its centres, all others as follows.

    Centres start at quantiles and first settle on a summary of some thousand bins, which fits in a few
    kilobytes; then come rounds over all distinct values. Rounds end for a fit once the squared shift of
    its centres is at most `tolerance` times the variance; a fit that `max_iter` rounds do not settle warns.
    """
    cuts = _cut_values(counts, list(dict.fromkeys(axis for axis, _ in wanted)))
    summaries = _summaries(counts, cuts) if cuts else {}
    fits = [
        _again((begin or {}).get(axis), k, scales[axis]) or _start(axis, k, scales[axis], summaries[axis], max_iter)
        for axis, k in wanted
        if axis in summaries
    ]
    for _ in range(max_iter):
        moving = [n for n, fit in enumerate(fits) if not fit.settled]
        if not moving:
            break
        sums = _sums(counts, [fits[n] for n in moving])
        for place, n in enumerate(moving):
            own = {cluster: pair for (p, cluster), pair in sums.items() if p == place}
            fits[n] = _advance(fits[n], own, summaries[fits[n].axis].variance, tolerance)
    for fit in fits:
        if not fit.settled:
            warnings.warn(f"{fit.axis}, k={fit.k}: not settled after {fit.rounds} rounds", stacklevel=2)
    return _with_used(counts, fits)


def _with_used(counts: DataFrame, fits: Sequence[Fit]) -> list[Fit]:
    owned = sorted(_sums(counts, fits)) if fits else []
    return [replace(fit, used=tuple(c for n, c in owned if n == number)) for number, fit in enumerate(fits)]


def fit_kmeans(df: DataFrame, axes: dict[str, int], **limits) -> dict[str, Fit]:
    """Quantile-start k-means of each column on its own; {column: k} to {column: fit}."""
    counts, scales = axis_counts(df, list(axes))
    fits = fit_counts(counts, list(axes.items()), scales, **limits)
    counts.unpersist()
    return {fit.axis: fit for fit in fits}


def fit_kmeans_random(df: DataFrame, column: str, k: int, seed: int = 42, max_iter: int = MAX_ITER) -> Fit | None:
    """MLlib's k-means|| start instead, weighted by distinct value; centres come back ascending. None without values."""
    counts, scales = axis_counts(df, [column])
    if counts.isEmpty():
        counts.unpersist()
        return None
    rows = counts.select(F.col("value").cast("double").alias("value"), F.col("weight").cast("double").alias("weight"))
    points = VectorAssembler(inputCols=["value"], outputCol="point").transform(rows)
    model = KMeans(featuresCol="point", weightCol="weight", k=k, seed=seed, maxIter=max_iter).fit(points)
    centres = tuple(sorted(float(c[0]) for c in model.clusterCenters()))
    (fit,) = _with_used(counts, [Fit(column, len(centres), centres, scales[column], settled=True)])
    counts.unpersist()
    return fit


def assign(df: DataFrame, fit: Fit, label: str) -> DataFrame:
    """Add the cluster of each row; the centres are constants, so this needs neither join nor shuffle."""
    units = f"`{fit.axis}`"
    if _scale(df, fit.axis) is not None:
        units = f"bigint({units} * {10**fit.scale})" if fit.scale else f"bigint({units})"
    return df.withColumn(label, F.expr(_cluster(units, fit.borders())))


def assign_ordered(df: DataFrame, fit: Fit | None, label: str, ascending: bool = True) -> DataFrame:
    """Add the cluster's rank by its mean of the fitted column; without a fit, as of no values, a null label.

    Clusters are neighbouring intervals, so their means ascend with their numbers and the rank is the
    place among the clusters in use. `order_clusters` gives the same for this column with an aggregation
    and a join; it is the general form, for any other target.
    """
    if fit is None:
        return df.withColumn(label, F.lit(None).cast("int"))
    rank = {cluster: place for place, cluster in enumerate(fit.used)}
    last = len(fit.used) - 1
    out = assign(df, fit, label)
    if list(rank) != list(range(len(fit.centres))):
        cluster = F.col(label)
        out = out.withColumn(label, F.coalesce(*(F.when(cluster == c, F.lit(r)) for c, r in rank.items())))
    return out if ascending else out.withColumn(label, F.lit(last) - F.col(label))


def order_clusters(df: DataFrame, label: str, target: str, ascending: bool = True) -> DataFrame:
    """Renumber clusters 0, 1, ... by their mean of `target`; equal means keep the lower old label first.

    Rows without a label keep none, as they belong to no cluster.
    """
    means = df.filter(F.col(label).isNotNull()).groupBy(label).agg(exact_mean(df, target).alias("_mean"))
    mean = F.col("_mean").asc_nulls_last() if ascending else F.col("_mean").desc_nulls_last()
    # One row per cluster: k rows, whatever the size of the table. The planner sees their measured size.
    ranks = materialise(means.select(label, (F.row_number().over(Window.orderBy(mean, label)) - 1).alias("_rank")), "ranks")
    return df.join(ranks, label, "left").drop(label).withColumnRenamed("_rank", label)


def elbow_curve(df: DataFrame, axes: Sequence[str], most: int = 9, max_iter: int = ELBOW_ITER, **limits) -> DataFrame:
    """Sum of squared distances to the nearest centre for k = 1..most, each axis on its own.

    All fits of all axes share their rounds, so the curve costs little more than its slowest fit.
    """
    counts, scales = axis_counts(df, axes)
    fits = fit_counts(counts, [(a, k) for a in axes for k in range(1, most + 1)], scales, max_iter, **limits)
    arrays = " ".join(f"WHEN {n} THEN {_array(f.centres)}" for n, f in enumerate(fits))
    centres = F.expr(f"get(CASE fit {arrays} END, cluster)")
    names = df.sparkSession.createDataFrame(
        [(n, f.axis, f.k, float(10 ** (2 * f.scale))) for n, f in enumerate(fits)],
        "fit int, axis string, k int, unit double",
    )
    distance = F.col("value").cast("double") - centres
    inertia = _per_cluster(counts, fits).groupBy("fit").agg(F.sum(distance * distance * F.col("weight")).alias("sum"))
    inertia = materialise(inertia, "inertia")
    counts.unpersist()
    return inertia.join(F.broadcast(names), "fit").select("axis", "k", (F.col("sum") / F.col("unit")).alias("inertia"))


def cluster_k(df: DataFrame, column: str, label: str, k: int, ascending: bool = True, **limits) -> DataFrame:
    """Fit, assign and order one column."""
    return assign_ordered(df, fit_kmeans(df, {column: k}, **limits)[column], label, ascending)
