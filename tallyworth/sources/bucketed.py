"""Tables kept in buckets by a key, so that joins and groups on it move no rows.

Rows are dealt to buckets and sorted within them once, when a table is written. Spark then joins tables with the same number
of buckets bucket by bucket, and groups by the key inside each, without an exchange. Worth it for tables that many
jobs join on one key; the key must have one type everywhere, as the bucket hangs on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> None:
    """Replace the catalog table `name` by the rows of `df` in `buckets` sorted files, one for each bucket.

    Rows without a key share a bucket. A key with very many rows makes its bucket long: this is for tables with about as
    many rows for each key, such as one per user.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def exchanges(df: DataFrame) -> int:
    """How many times the plan of `df` deals rows out anew."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" +-:*()0123456789").startswith("Exchange") for line in plan.splitlines())
