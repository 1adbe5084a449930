"""Fixed-size samples and top rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyworth.functions.buckets import HASH_RANGE, key_hash

_BINS = 1 << 16


def sample_rows(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """Exactly `rows` rows (all, if there are fewer), those with the smallest hash of a key unique by row.

    Which rows are drawn depends on the seed only. A histogram of the hash first finds the bin that holds
    the last wanted row; rows beyond it never reach the final sort, which else would get `rows` rows from
    every task.
    """
    width = HASH_RANGE // _BINS
    bins = df.groupBy(F.floor(key_hash(key, seed) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # At most 65,536 bins, so this window over all of them is bounded.
    before = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    needed = bins.select("bin", F.coalesce(before, F.lit(0)).alias("before")).filter(F.col("before") < rows)
    last_bin = needed.agg(F.max("bin")).scalar()
    drawn = df.withColumn("_hash", key_hash(key, seed))
    return (
        drawn.filter(F.floor(F.col("_hash") / width) <= last_bin).orderBy("_hash", key).limit(rows).drop("_hash")
    )


def top_customers(df: DataFrame, column: str, rows: int = 10) -> DataFrame:
    """The first rows by a column, largest first, ties by user."""
    return df.orderBy(F.col(column).desc_nulls_last(), "user").limit(rows)
