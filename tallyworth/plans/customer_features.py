"""Customers joined with user and card attributes, tested against the value label."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyworth.operators.cards import card_features, debt_and_income, user_attributes
from tallyworth.operators.joins import with_cards, with_users
from tallyworth.operators.significance import feature_tests, select_features

# The columns tested, and the card columns kept in any case.
CONTINUOUS = (
    "num_credit_cards",
    "total_cards_with_chips",
    "total_cards_issued",
    "average_credit_limit",
    "revenue",
    "recency",
    "frequency",
    "overall_score",
    "current_age",
    "retirement_age",
    "per_capita_income",
    "yearly_income",
    "total_debt",
    "fico_score",
)
CATEGORICAL = ("cards_on_dark_web", "amex", "discover", "mastercard", "visa", "credit", "debit", "debit_prepaid")
KEPT_CARDS = ("amex", "discover", "mastercard", "credit", "debit_prepaid")
DROPPED = ("window_revenue", "revenue_cluster", "recency_cluster", "frequency_cluster", "segment")


def customer_features(customers: DataFrame, users: DataFrame, cards: DataFrame) -> DataFrame:
    """One row per customer that has a card; `users` carries the row index as its key.

    Cards are aggregated per user before the join, so every join is one row to one row.
    """
    joined = with_users(customers.drop(*DROPPED), user_attributes(users))
    return with_cards(joined, card_features(cards)).drop("total_cards")


def tested_features(features: DataFrame, label: str = "ltv_cluster", classes: int | None = 3) -> DataFrame:
    return feature_tests(features, label, CONTINUOUS, CATEGORICAL, classes)


def selected_features(features: DataFrame, label: str = "ltv_cluster", classes: int | None = 3) -> DataFrame:
    return select_features(features, tested_features(features, label, classes), label, KEPT_CARDS)


def debt_income_merge(customers: DataFrame, users: DataFrame) -> DataFrame:
    """Customers with yearly income and debt in whole units."""
    return with_users(customers, debt_and_income(users))
