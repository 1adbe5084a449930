"""Means that do not depend on the order of summing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType


def exact_mean(df: DataFrame, column: str) -> Column:
    """Mean as double. Whole numbers and decimals are summed exactly and divided once, so that the last digit
    does not change with the partitioning; other types have the usual average."""
    if isinstance(df.schema[column].dataType, (DecimalType, IntegralType)):
        return F.try_divide(F.sum(column).cast("double"), F.count(column).cast("double"))
    return F.avg(F.col(column).cast("double"))
