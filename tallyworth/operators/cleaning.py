"""Raw transactions to typed ones, and the valid / fraudulent / failed split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworth.functions.dates import date_of, time_text, timestamp_of
from tallyworth.functions.money import parse_money

# The fraud flag's texts.
FRAUD = "Yes"
NOT_FRAUD = "No"


def clean_transactions(raw: DataFrame) -> DataFrame:
    """Parse amount, date and time. Unreadable values become null; `rejected_counts` counts them."""
    return raw.withColumns(
        {
            "date_time": timestamp_of("year", "month", "day", "time"),
            "date": date_of("year", "month", "day"),
            "time": time_text("time"),
            "amount": parse_money("amount"),
        }
    )


def rejected_counts(raw: DataFrame) -> DataFrame:
    """One row: how many amounts, dates and timestamps could not be read."""
    return clean_transactions(raw).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("amount").isNull()).alias("bad_amounts"),
        F.count_if(F.col("date").isNull()).alias("bad_dates"),
        F.count_if(F.col("date_time").isNull()).alias("bad_timestamps"),
    )


def is_valid() -> Column:
    return (F.col("is_fraud") == NOT_FRAUD) & F.col("errors").isNull()


def is_fraudulent() -> Column:
    return F.col("is_fraud") == FRAUD


def is_failed() -> Column:
    return F.col("errors").isNotNull()


def valid_transactions(df: DataFrame) -> DataFrame:
    return df.filter(is_valid())


def fraudulent_transactions(df: DataFrame) -> DataFrame:
    return df.filter(is_fraudulent())


def failed_transactions(df: DataFrame) -> DataFrame:
    return df.filter(is_failed())


def tag_transactions(df: DataFrame) -> DataFrame:
    """All three answers as columns. They are no partition: a fraudulent transaction may also have failed,
    and one without a fraud flag and without an error is in none."""
    no = F.lit(False)
    return df.withColumns(
        {
            "valid": F.coalesce(is_valid(), no),
            "fraudulent": F.coalesce(is_fraudulent(), no),
            "failed": is_failed(),
        }
    )


def split_summary(df: DataFrame) -> DataFrame:
    """Count and amount for each combination of the three answers, in one pass."""
    return (
        tag_transactions(df)
        .groupBy("valid", "fraudulent", "failed")
        .agg(F.count(F.lit(1)).alias("transactions"), F.sum("amount").alias("amount"))
    )


def in_years(start_year: int, end_year: int) -> Column:
    """Both ends included. Plain comparisons on the stored year reach the scan (and pick the folders of a
    table laid out by year), which year(date_time) would not."""
    return (F.col("year") >= start_year) & (F.col("year") <= end_year) & F.col("date_time").isNotNull()


def within_years(df: DataFrame, start_year: int, end_year: int) -> DataFrame:
    return df.filter(in_years(start_year, end_year))
