"""Recency, frequency and revenue per user.

One groupBy per question: Spark aggregates inside each scan task first, so what is shuffled is at most one
row per user and task, and a user with a third of all transactions costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworth.operators.cleaning import in_years, is_valid, valid_transactions, within_years


def _last_date() -> Column:
    return F.max("date").alias("last_date")


def _frequency() -> Column:
    return F.count("year").alias("frequency")


def _revenue() -> Column:
    return F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(28,2)").alias("revenue")


def _per_user(df: DataFrame, *aggregates: Column) -> DataFrame:
    return df.filter(F.col("user").isNotNull()).groupBy("user").agg(*aggregates)


def with_recency(per_user: DataFrame, last_day: Column) -> DataFrame:
    """Days from each user's last date to `last_day`."""
    return per_user.withColumn("recency", F.datediff(last_day, F.col("last_date"))).drop("last_date")


def last_day(df: DataFrame, column: str = "date") -> Column:
    """The latest date of the table as a scalar subquery; it reads the date columns only."""
    return df.agg(F.max(column)).scalar()


def recency(df: DataFrame) -> DataFrame:
    return with_recency(_per_user(df, _last_date()), last_day(df.filter(F.col("user").isNotNull())))


def last_activity(df: DataFrame) -> DataFrame:
    return _per_user(df, _last_date())


def frequency(df: DataFrame) -> DataFrame:
    return _per_user(df, _frequency())


def revenue(df: DataFrame) -> DataFrame:
    return _per_user(df, _revenue())


def user_activity(df: DataFrame, years: tuple[int, int] | None = None, valid_only: bool = False) -> DataFrame:
    """Last date, frequency and revenue per user from one scan and one shuffle.

    With `years` also the revenue of valid transactions inside that range (null for a user without one), as
    conditional sums in the same pass instead of a second scan and a join.
    """
    if valid_only:
        df = valid_transactions(df)
    aggregates = [_last_date(), _frequency(), _revenue()]
    if years:
        counted = is_valid() & in_years(*years)
        aggregates += [
            F.sum(F.when(counted, F.col("amount"))).cast("decimal(28,2)").alias("window_revenue"),
            F.count_if(counted).alias("window_transactions"),
        ]
    return _per_user(df, *aggregates)


def rfm(df: DataFrame, valid_only: bool = False) -> DataFrame:
    """Recency, frequency and revenue per user."""
    source = valid_transactions(df) if valid_only else df
    return with_recency(user_activity(source), last_day(source.filter(F.col("user").isNotNull())))


def timeframe_revenue(df: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """Revenue per user from valid transactions of the given years, both ends included."""
    counted = within_years(valid_transactions(df), start_year, end_year)
    return _per_user(counted, F.round(F.sum("amount"), 2).cast("decimal(28,2)").alias("window_revenue"))
