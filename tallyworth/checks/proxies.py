"""The logical input tables, derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworth.operators.row_index import add_row_index

START_YEAR, END_YEAR = 1996, 2000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _digits(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Raw transactions as a file would hold them: money and time are text."""
    orders = table(spark, folder, "orders")
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    signed = F.when(key % 20 == 0, -price).otherwise(price)
    return orders.select(
        F.col("o_custkey").alias("user"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.day(day).alias("day"),
        F.concat(_digits(key % 24), F.lit(":"), _digits((key * 7) % 60)).alias("time"),
        F.concat(F.lit("$"), signed.cast("string")).alias("amount"),
        F.when(key % 50 == 0, "Yes").when(key % 101 == 1, None).otherwise("No").alias("is_fraud"),
        F.when(key % 33 == 0, "Bad PIN").alias("errors"),
        key.alias("row_id"),
    )


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Raw transactions from the event table."""
    events = table(spark, folder, "events").filter(F.col("event_type") == "purchase")
    ts = F.col("ts")
    return events.select(
        F.col("user_id").alias("user"),
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.day(ts).alias("day"),
        F.date_format(ts, "HH:mm").alias("time"),
        F.concat(F.lit("$"), F.col("value").cast("decimal(18,2)").cast("string")).alias("amount"),
        F.lit("No").alias("is_fraud"),
        F.lit(None).cast("string").alias("errors"),
    )


def _money(value: Column) -> Column:
    """Whole units as `$12,345`."""
    return F.concat(F.lit("$"), F.format_number(value.cast("bigint"), 0))


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Users without their key, in key order, as the file holds them; `order_key` stands for the order."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("order_key"),
        (18 + key % 70).cast("int").alias("current_age"),
        (60 + key % 11).cast("int").alias("retirement_age"),
        _money(20000 + 100 * F.col("c_nationkey")).alias("per_capita_income"),
        _money(F.floor(F.col("c_acctbal") + 1000)).alias("yearly_income"),
        _money(F.floor(F.abs("c_acctbal") * 10)).alias("total_debt"),
        (500 + (key * 13) % 351).cast("int").alias("fico_score"),
        (1 + key % 9).cast("int").alias("num_credit_cards"),
    )


def indexed_users(spark: SparkSession, folder: str) -> DataFrame:
    return add_row_index(users(spark, folder), "order_key").drop("order_key")


def _pick(values: list[str], position: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), position.cast("int"))


def cards(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return (
        table(spark, folder, "orders")
        .filter(key % 3 == 0)
        .select(
            F.col("o_custkey").alias("user"),
            key.alias("card_index"),
            _pick(["Amex", "Discover", "Mastercard", "Visa"], key % 4).alias("card_brand"),
            _pick(["Credit", "Debit", "Debit (Prepaid)"], F.floor(key / 3) % 3).alias("card_type"),
            F.when(F.col("o_orderstatus") != "P", "YES").otherwise("NO").alias("has_chip"),
            (1 + F.floor(key / 9) % 3).cast("int").alias("cards_issued"),
            _money(F.floor(F.col("o_totalprice") / 10)).alias("credit_limit"),
            F.when(key % 200 == 0, "Yes").otherwise("No").alias("on_dark_web"),
        )
    )
