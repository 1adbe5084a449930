"""Scaling and one-hot columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardise(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population deviation per column; a column without spread becomes 0.

    All means and deviations come from one aggregation, read as one scalar subquery.
    """
    parts = []
    for c in columns:
        number = F.col(c).cast("double")
        spread = F.when(F.min(number) < F.max(number), F.stddev_pop(number)).otherwise(0.0)
        parts += [F.avg(number).alias(f"{c}_mean"), spread.alias(f"{c}_std")]
    stats = df.agg(F.struct(*parts).alias("stats")).scalar()
    scaled = {}
    for c in columns:
        distance = F.col(c).cast("double") - stats[f"{c}_mean"]
        spread = stats[f"{c}_std"]
        scaled[c + suffix] = F.when(F.col(c).isNotNull(), F.when(spread > 0, F.try_divide(distance, spread)).otherwise(0.0))
    return df.withColumns(scaled)


def one_hot(df: DataFrame, column: str, values: Sequence[str] | None = None, most_values: int = 1000) -> DataFrame:
    """Replace a column by one 0/1 column `<column>_<value>` per value, in sorted order.

    Without `values` those present are looked up; more than `most_values` are refused, as each becomes a column.
    """
    if values is None:
        found = df.select(column).distinct().filter(F.col(column).isNotNull()).limit(most_values + 1).collect()
        if len(found) > most_values:
            raise ValueError(f"{column} has more than {most_values} values")
        values = [r[0] for r in found]
    flags = {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in sorted(values)}
    return df.withColumns(flags).drop(column)
