"""Card and user attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworth.functions.money import parse_money, whole_units
from tallyworth.schema import CARD_BRANDS, CARD_TYPES


def flag_name(value: str) -> str:
    """`Debit (Prepaid)` to `debit_prepaid`."""
    return "_".join("".join(c if c.isalnum() else " " for c in value.lower()).split())


def _held(column: str, value: str) -> Column:
    held = F.max((F.col(column) == value).cast("int"))
    return F.coalesce(held, F.lit(0)).alias(flag_name(value))


def card_features(
    cards: DataFrame, brands: Sequence[str] = CARD_BRANDS, types: Sequence[str] = CARD_TYPES
) -> DataFrame:
    """Counts, sums and held brands and types per user, all in one aggregation."""
    limit = parse_money("credit_limit")
    return (
        cards.filter(F.col("user").isNotNull())
        .groupBy("user")
        .agg(
            F.count("card_index").alias("total_cards"),
            F.count_if(F.col("has_chip") == "YES").alias("total_cards_with_chips"),
            F.coalesce(F.sum("cards_issued"), F.lit(0)).alias("total_cards_issued"),
            F.try_divide(F.sum(limit).cast("double"), F.count(limit)).alias("average_credit_limit"),
            F.count_if(F.col("on_dark_web") == "Yes").alias("cards_on_dark_web"),
            *(_held("card_brand", b) for b in brands),
            *(_held("card_type", t) for t in types),
        )
    )


def card_lists(cards: DataFrame) -> DataFrame:
    """The distinct brands and types of each user, sorted."""
    return (
        cards.filter(F.col("user").isNotNull())
        .groupBy("user")
        .agg(
            F.sort_array(F.collect_set("card_brand")).alias("card_brands"),
            F.sort_array(F.collect_set("card_type")).alias("card_types"),
        )
    )


def list_values(lists: DataFrame, column: str) -> DataFrame:
    """One row per user and listed value."""
    return lists.select("user", F.explode(column).alias("value"))


def user_attributes(users: DataFrame) -> DataFrame:
    """Users with their money columns parsed."""
    money = ("per_capita_income", "yearly_income", "total_debt")
    return users.withColumns({c: parse_money(c).cast("double") for c in money})


def debt_and_income(users: DataFrame) -> DataFrame:
    """Index, yearly income and debt of each user in whole units."""
    return users.select(
        "index", whole_units("yearly_income").alias("yearly_income"), whole_units("total_debt").alias("total_debt")
    )
