"""Hold-out and stratified fold splits that do not change with partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworth.functions.buckets import HASH_RANGE, key_bucket, key_hash
from tallyworth.session import materialise

_PARTS = 10_000
_BINS = 4096


def is_held_out(key: str, share: float, seed: int = 42) -> Column:
    """True for about `share` of the keys; which ones depends on key and seed only."""
    return key_bucket(key, _PARTS, seed) < round(share * _PARTS)


def holdout_split(df: DataFrame, key: str, share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rest, held out)."""
    return df.filter(~is_held_out(key, share, seed)), df.filter(is_held_out(key, share, seed))


def stratified_folds(
    df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Fold numbers 0..folds-1 whose sizes differ by at most one within each class.

    A class is numbered through in the order of its key's hash. It is cut into 4,096 hash bins, each numbered
    by its own task, and the bins' sizes give the offsets; so a class of any size is spread over many tasks.
    """
    rows = df.withColumn("_bin", F.floor(key_hash(key, seed) / (HASH_RANGE // _BINS)))
    sizes = rows.groupBy(label, "_bin").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(label).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    offsets = materialise(sizes.select(label, "_bin", before), "fold-offsets")
    place = F.row_number().over(Window.partitionBy(label, "_bin").orderBy(key)) - 1
    numbered = rows.withColumn("_place", place).join(offsets, [label, "_bin"])
    return numbered.withColumn(name, ((F.col("_before") + F.col("_place")) % folds).cast("int")).drop(
        "_bin", "_place", "_before"
    )
