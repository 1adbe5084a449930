"""Group summaries and contingency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworth.functions.means import exact_mean
from tallyworth.operators.quantiles import quantiles

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe_by_group(df: DataFrame, groups: str | Sequence[str], value: str, exact: bool = True) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of `value` per group.

    Exact quartiles come from `quantiles`, which never puts a whole group into one task; with
    `exact=False` they are approximate and cost no further pass.
    """
    groups = [groups] if isinstance(groups, str) else list(groups)
    rows = df.select(*groups, value).dropna(subset=groups)
    number = F.col(value).cast("double")
    moments = [
        F.count(value).alias("count"),
        exact_mean(rows, value).alias("mean"),
        F.stddev_samp(number).alias("std"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
    ]
    if not exact:
        near = [F.percentile_approx(number, p).alias(name) for name, p in QUARTILES.items()]
        return rows.groupBy(*groups).agg(*moments, *near)
    return quantiles(rows, groups, value, QUARTILES, *moments)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence | None = None) -> DataFrame:
    """Counts of each pair of values, one row per `row` value and one column per `column` value."""
    present = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    return present.groupBy(row).pivot(column, list(values) if values is not None else None).count().na.fill(0)
