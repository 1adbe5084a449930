"""Joins on the user key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def transactions_with_users(transactions: DataFrame, users: DataFrame) -> DataFrame:
    """Every transaction with its user's attributes; a user that the table holds twice joins twice.

    A plain join: Spark broadcasts the users if their measured size allows it, and else shuffles both sides and
    splits the partitions of users with very many transactions.
    """
    return transactions.join(users, "user")


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on every column name the two sides share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return left.join(right, shared)


def with_segments(window_revenue: DataFrame, segments: DataFrame) -> DataFrame:
    """Window revenue beside the segment columns; both sides hold one row per user."""
    return window_revenue.join(segments, "user")


def with_users(customers: DataFrame, users: DataFrame) -> DataFrame:
    """User attributes, whose key is the row index of the user table."""
    return customers.join(users, F.col("user") == F.col("index")).drop("index")


def with_cards(customers: DataFrame, card_features: DataFrame) -> DataFrame:
    """Card features; users without a card drop out."""
    return customers.join(card_features, "user")
