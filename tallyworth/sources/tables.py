"""CSV, Parquet and catalog tables in and out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworth.schema import Field


# Distinct headers that a folder may have if `mixed_headers` is asked for.
MOST_HEADERS = 100


def _typed(raw: DataFrame, fields: Sequence[Field]) -> DataFrame:
    return raw.select([F.col(f"`{f.published}`").try_cast(f.type).alias(f.name) for f in fields])


def read_csv(
    spark: SparkSession, path: str, fields: Sequence[Field], delimiter: str = ",", mixed_headers: bool = False
) -> DataFrame:
    """The named columns of CSV files with headers, under inner names and declared types.

    No inference pass over the data: columns are found by name, files may hold others. A value that is not of its
    declared type becomes null. All files must have the same header, and a file with another one stops the job;
    with `mixed_headers` each file is read by its own header, which costs a pass over the text of the files.
    """
    options = {"header": "true", "delimiter": delimiter, "enforceSchema": "false"}
    if not mixed_headers:
        return _typed(spark.read.options(**options).csv(path), fields)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
        "value",
    )
    headers = lines.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    # One row per distinct header comes back with its files; the driver lists the files of a table in any case.
    found = headers.groupBy("header").agg(F.collect_list("file").alias("files")).limit(MOST_HEADERS + 1).collect()
    if len(found) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers")
    parts = [_typed(spark.read.options(**options).csv(row["files"]), fields) for row in found]
    if not parts:
        return spark.createDataFrame([], ", ".join(f"{f.name} {f.type}" for f in fields))
    return reduce(DataFrame.unionByName, parts)


def write_csv(df: DataFrame, path: str, fields: Sequence[Field], delimiter: str = ",") -> None:
    """Write the fields under their published names, one file per partition, each with a header."""
    df.select([F.col(f.name).alias(f.published) for f in fields]).write.option("header", True).option(
        "delimiter", delimiter
    ).csv(path)


def named(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """A table with published column names under inner names and declared types."""
    return df.select([F.col(f"`{f.published}`").cast(f.type).alias(f.name) for f in fields])


def read_table(spark: SparkSession, name: str, fields: Sequence[Field]) -> DataFrame:
    return named(spark.table(name), fields)


def read_parquet(spark: SparkSession, path: str, fields: Sequence[Field]) -> DataFrame:
    return named(spark.read.parquet(path), fields)


def write_table(df: DataFrame, name: str, path: str | None = None, partition_by: Sequence[str] = ()) -> None:
    """Replace a catalog table; with `path` the files live there."""
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def write_transactions(df: DataFrame, path: str) -> None:
    """Transactions laid out by year, so that a year range reads only its own folders.

    The rebalance hint groups rows by year to avoid one small file per task and year; adaptive execution
    then splits a large year over many tasks, whoever its customers are.
    """
    df.hint("rebalance", "year").write.partitionBy("year").parquet(path)
