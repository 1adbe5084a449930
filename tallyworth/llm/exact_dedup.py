"""Exact duplicates by a content sort.

Sampled splitters cut the order of the normalised texts into ranges, every range is sorted by the whole normalised
text (Spark's sort spills to disk), and each row is compared in full with its neighbour. A run of equal texts that
crosses a splitter is stitched from the first and last run of every range.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworth.llm.common import WHITE, shuffle_partitions, text_or_empty, written

# Characters of a text at the head of the sort key. They bound the size of the splitters that the driver sees;
# texts that agree in them are told apart by their digest, and compared as a whole.
HEAD = 64
RANGES_PER_PARTITION = 4
SAMPLES_PER_RANGE = 16


def normalised(column: str = "text") -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(text_or_empty(column), f"{WHITE}+", "")


def _range_of(key: Column, splitters: list[str]) -> Column:
    """How many splitters are not above the key, by binary search."""
    if not splitters:
        return F.lit(0)
    found = F.from_json(F.lit(json.dumps(splitters)), "array<string>")
    steps = [1 << i for i in reversed(range(len(splitters).bit_length()))]
    return F.aggregate(
        F.array(*(F.lit(s) for s in steps)),
        F.lit(0),
        lambda at, step: F.when(F.get(found, at + step - F.lit(1)) <= key, at + step).otherwise(at),
    )


def _splitters(source: DataFrame, keyed: Callable[[DataFrame], DataFrame], ranges: int) -> list[str]:
    """Evenly spaced keys of a sample of at most about ranges x SAMPLES_PER_RANGE rows; only sampled rows are normalised."""
    rows = source.count()
    if rows <= ranges:
        return []
    share = min(1.0, ranges * SAMPLES_PER_RANGE / rows)
    sample = sorted(r[0] for r in keyed(source.sample(share, seed=7)).select("_key").collect())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def _keyed(source: DataFrame) -> DataFrame:
    """The rows with their normalised text, its digest and the sort key."""
    source = source.withColumn("_norm", normalised("_text")).withColumn("_size", F.length(text_or_empty("_text"))).drop("_text")
    named = source.withColumn("text_sha256", F.sha2("_norm", 256)).withColumn(
        "_content", F.concat(F.substring("_norm", 1, HEAD), F.lit("\0"), "text_sha256")
    )
    return named.withColumn("_key", F.concat("_content", F.lit("\0"), F.lpad(F.col("_row").cast("string"), 20, "0")))


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: bool = False, ranges: int | None = None
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256; with `carry` also `row`, the input row.

    Texts are equal if they agree in all but white space; null is empty. Of equal texts the longest original
    (code points) stays, then the smallest id; null ids come last; of repeated rows exactly one is kept. Other columns may have any name.
    An empty table gives an empty result. A group of any size is spread over ranges, as the id is part of the key.
    """
    spark = docs.sparkSession
    ranges = ranges or RANGES_PER_PARTITION * shuffle_partitions(spark)
    source = docs.select(
        F.col(f"`{id_column}`").alias("_id"),
        F.col(f"`{text_column}`").alias("_text"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []),
    ).withColumn("_row", F.monotonically_increasing_id())
    splitters = _splitters(source, _keyed, ranges)
    keyed = _keyed(source)
    carried = ["row"] if carry else []

    ranged = keyed.withColumn("_range", _range_of(F.col("_key"), splitters)).drop("_key")
    if carry:
        # The row holds its text already: the normalised one is made again behind the exchange.
        again = F.coalesce(F.col("row").getField(text_column), F.lit(""))
        ranged = ranged.drop("_norm").repartition("_range").withColumn("_norm", F.regexp_replace(again, f"{WHITE}+", ""))
    best_first = [F.col("_size").desc(), F.col("_id").asc_nulls_last(), F.col("_row")]
    in_order = Window.partitionBy("_range").orderBy("_content", "_norm", *best_first)
    starts = ~F.col("_norm").eqNullSafe(F.lag("_norm").over(in_order)) | (F.row_number().over(in_order) == 1)
    runs = ranged.withColumn("_starts", starts).withColumn("_run", F.sum(F.col("_starts").cast("int")).over(in_order))
    runs = runs.drop("_norm", "_content")
    run, whole = Window.partitionBy("_range", "_run"), Window.partitionBy("_range")
    best = F.struct(-F.col("_size"), F.col("_id").isNull(), F.col("_id").alias("id"), F.col("_row").alias("row"))
    local = runs.select(
        "_id", "_row", "text_sha256", "_range", "_run", "_starts", *carried,
        F.min(best).over(run).alias("_best"),
        F.count(F.lit(1)).over(run).alias("_count"),
        ((F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(whole))).alias("_edge"),
    )
    local = written(local, "content-runs")

    # At most two rows per range meet here, whatever the size of the table; so the result may be broadcast.
    edges = local.filter("_starts AND _edge").select("_range", "_run", "text_sha256", "_best", "_count")
    whole_runs = edges.groupBy("text_sha256").agg(
        F.min("_best").alias("_all_best"), F.sum("_count").alias("_all_count"), F.count(F.lit(1)).alias("_parts")
    )
    stitched = edges.join(whole_runs.filter("_parts > 1"), "text_sha256").select("_range", "_run", "_all_best", "_all_count")
    found = local.join(F.broadcast(stitched), ["_range", "_run"], "left")
    best_row = F.coalesce("_all_best", "_best")
    return found.select(
        F.col("_id").alias(id_column),
        best_row["id"].alias("keep_id"),
        F.coalesce("_all_count", "_count").alias("group_size"),
        (F.col("_row") == best_row["row"]).alias("kept"),
        "text_sha256",
        *carried,
    )


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    return exact_duplicates(docs, id_column, text_column, carry=True).filter("kept").select("row.*")
