"""Upper tail probabilities of the F and chi-square distributions, for result rows (dozens, not data)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_STEPS = 500
_TINY = 1e-300
_CLOSE = 1e-15


def _continued(terms) -> float:
    """Value of b0 + a1/(b1 + a2/(b2 + ...)) by the modified Lentz method; `terms` yields (a, b)."""
    value = upper = next(terms)[1] or _TINY
    lower = 0.0
    for a, b in terms:
        lower = 1.0 / ((b + a * lower) or _TINY)
        upper = (b + a / upper) or _TINY
        change = upper * lower
        value *= change
        if abs(change - 1.0) < _CLOSE:
            break
    return value


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_share(b, a, 1.0 - x)

    def terms():
        yield 0.0, 1.0
        for m in range(_STEPS):
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(front) / (a * _continued(terms()))


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        for n in range(1, 100 * _STEPS):
            term *= x / (a + n)
            total += term
            if term < total * _CLOSE:
                break
        return 1.0 - front * total

    def terms():
        yield 0.0, x + 1.0 - a
        for n in range(1, 100 * _STEPS):
            yield n * (a - n), x + 2 * n + 1.0 - a

    return front / _continued(terms())


def f_tail_value(f: float, between: float, within: float) -> float:
    return beta_share(within / 2.0, between / 2.0, within / (within + between * f))


def chi_square_tail_value(x: float, freedom: float) -> float:
    return gamma_tail(freedom / 2.0, x / 2.0)


@F.pandas_udf(DoubleType())
def f_tail_any(f: pd.Series, between: pd.Series, within: pd.Series) -> pd.Series:
    rows = zip(f, between, within)
    return pd.Series([None if pd.isna(v) else f_tail_value(v, b, w) for v, b, w in rows], dtype="float64")


@F.pandas_udf(DoubleType())
def chi_square_tail_any(x: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else chi_square_tail_value(v, d) for v, d in zip(x, freedom)], dtype="float64")


def f_tail_three_groups(f: Column, within: Column) -> Column:
    """Closed form for two degrees of freedom between groups."""
    within = within.cast("double")
    return F.pow(1.0 + 2.0 * f / within, -within / 2.0)


def chi_square_tail_even(x: Column, freedom: Column) -> Column:
    """Closed form for even degrees of freedom: a sum of freedom/2 Poisson terms, added by logarithm so that
    a large statistic gives a small number rather than 0 * infinity."""
    half = x / 2.0
    first = F.struct((-half).alias("log"), F.exp(-half).alias("total"))

    def add(state: Column, i: Column) -> Column:
        log = state["log"] + F.ln(half) - F.ln(i.cast("double"))
        return F.struct(log.alias("log"), (state["total"] + F.exp(log)).alias("total"))

    last = (freedom / 2).cast("int") - 1
    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.when(half <= 0, F.lit(1.0)).otherwise(F.aggregate(steps, first, add, lambda s: s["total"]))
