"""Repeatable pseudo-random buckets of a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def key_hash(column: str | Column, seed: int) -> Column:
    """A number in [0, 2^32) that depends on the key and the seed only.

    Unlike rand(), it does not change with partitioning or a task's retry.
    """
    key = F.col(column) if isinstance(column, str) else column
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def key_bucket(column: str | Column, buckets: int, seed: int) -> Column:
    return key_hash(column, seed) % F.lit(buckets)
