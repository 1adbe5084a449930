"""A contiguous 0..n-1 index over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyworth.session import materialise

# monotonically_increasing_id keeps the partition number above this many bits, the position below.
_POSITION_BITS = 33


def add_row_index(df: DataFrame, *order_by: str, name: str = "index", partitions: int | None = None) -> DataFrame:
    """Number the rows in the order of `order_by`, a key unique by row.

    Rows are range-sorted, each task numbers its own, and the small table of rows per partition gives the
    offsets. The sorted rows are written first: only then are partition and position fixed facts that a
    retried task cannot change.
    """
    ordered = df.repartitionByRange(*([partitions] if partitions else []), *order_by)
    place = F.monotonically_increasing_id()
    placed = materialise(ordered.sortWithinPartitions(*order_by).withColumn("_place", place), "row-index")
    part = F.shiftright("_place", _POSITION_BITS).alias("_part")
    position = F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    # One row per range partition: this window and the broadcast grow with the number of partitions only.
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(
        F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = sizes.select("_part", before.alias("_before"))
    return (
        placed.withColumn("_part", F.shiftright("_place", _POSITION_BITS))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + position)
        .drop("_part", "_place", "_before")
    )
