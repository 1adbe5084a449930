"""Pearson correlation of every pair of columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tallyworth.session import materialise

# Below this share of the sum of squares a spread is what rounding leaves of a constant.
_ROUNDING = 1e-13


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def _sums(x: DataFrame, full: Sequence[bool]) -> dict[str, float]:
    """All sums that the correlations need, by what they are the sum of, in one aggregation inside the JVM.

    `xi` is a column, `xi*xj` a product, and `xi|j` is column i over the rows where j is present. A column without nulls
    takes part in no sum of its own for that, so a table without nulls needs one sum a column, square and pair.
    """
    wanted: dict[str, str] = {}
    for i in range(len(full)):
        for j in range(len(full)):
            wanted[_sum_of(i, j, full)] = f"sum({_over(f'x{i}', i, j, full)})"
            wanted[_square_of(i, j, full)] = f"sum({_over(f'x{i} * x{i}', i, j, full)})"
            if i <= j:
                wanted[f"x{i}*x{j}"] = f"sum(x{i} * x{j})"
                wanted[_rows_of(i, j, full)] = f"CAST(count(CASE WHEN x{i} IS NOT NULL AND x{j} IS NOT NULL THEN 1 END) AS DOUBLE)"
    names = list(wanted)
    row = x.selectExpr(*(f"{wanted[name]} AS s{k}" for k, name in enumerate(names))).first()
    return {name: 0.0 if v is None else v for name, v in zip(names, row)}


def _over(value: str, i: int, j: int, full: Sequence[bool]) -> str:
    return value if full[j] or i == j else f"CASE WHEN x{j} IS NOT NULL THEN {value} END"


def _sum_of(i: int, j: int, full: Sequence[bool]) -> str:
    return f"x{i}" if full[j] or i == j else f"x{i}|{j}"


def _square_of(i: int, j: int, full: Sequence[bool]) -> str:
    return f"x{i}*x{i}" if full[j] or i == j else f"x{i}*x{i}|{j}"


def _rows_of(i: int, j: int, full: Sequence[bool]) -> str:
    """Rows where both are present; one count for all pairs that only miss the rows of one column, or none."""
    partial = sorted({k for k in (i, j) if not full[k]})
    return "rows" + "".join(f"&{k}" for k in partial)


def correlations(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Matrix of the correlations, each over the rows where both columns are present; nan where one is constant.

    The columns are written once, as doubles (nan counts as null). A first pass over them finds a value of each column,
    from which all others are taken, so that large ones keep their digits, and which columns have nulls; a second one
    adds up all sums. Both are plain aggregations: each task sends one row of sums.
    """
    k = len(names)
    if not k:
        return np.zeros((0, 0))
    plain = (F.col(f"`{c}`").cast("double") for c in names)
    numbers = materialise(df.select(*(F.when(~F.isnan(c), c).alias(f"c{i}") for i, c in enumerate(plain))), "correlation-columns")
    about = numbers.agg(F.count("*"), *(F.count(c) for c in numbers.columns), *(F.first(c, ignorenulls=True) for c in numbers.columns)).first()
    full = [n == about[0] for n in about[1 : k + 1]]
    shifted = numbers.select(*((F.col(c) - F.lit(0.0 if v is None else v)).alias(f"x{i}") for i, (c, v) in enumerate(zip(numbers.columns, about[k + 1 :]))))
    found = _sums(shifted, full)

    def matrix(name) -> np.ndarray:
        return np.array([[found[name(i, j, full)] for j in range(k)] for i in range(k)])

    n, x, xx = matrix(_rows_of), matrix(_sum_of), matrix(_square_of)
    xy = np.array([[found[f"x{min(i, j)}*x{max(i, j)}"] for j in range(k)] for i in range(k)])
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = xx - x * x / n  # of the row's column, where the column is present
        spread = np.where(spread > _ROUNDING * xx, spread, np.nan)
        r = (xy - x * x.T / n) / np.sqrt(spread * spread.T)
    return np.clip(r, -1.0, 1.0)


def _value(r: float) -> float | None:
    return None if np.isnan(r) else float(r)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (a, b, r) for all ordered pairs of columns, each over the rows where both are present; null
    where one of them is constant there."""
    names = list(columns if columns is not None else numeric_columns(df))
    found = correlations(df, names)
    rows = [(a, b, _value(found[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def target_correlation(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation of each column with one target, largest first."""
    names = list(columns if columns is not None else numeric_columns(df))
    found = correlations(df, names)[names.index(target)]
    rows = [(name, _value(r)) for name, r in zip(names, found)]
    each = df.sparkSession.createDataFrame(rows, "variable string, r double")
    return each.orderBy(F.col("r").desc_nulls_last(), "variable")
