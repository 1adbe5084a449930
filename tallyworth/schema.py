"""Column names at the file edge, names inside, and types."""

from __future__ import annotations

from typing import NamedTuple


class Field(NamedTuple):
    published: str
    name: str
    type: str


# Published column names of the input and output tables.
TRANSACTIONS = (
    Field("User", "user", "bigint"),
    Field("Year", "year", "int"),
    Field("Month", "month", "int"),
    Field("Day", "day", "int"),
    Field("Time", "time", "string"),
    Field("Amount", "amount", "string"),
    Field("Is Fraud?", "is_fraud", "string"),
    Field("Errors?", "errors", "string"),
)
USERS = (
    Field("Current Age", "current_age", "int"),
    Field("Retirement Age", "retirement_age", "int"),
    Field("Per Capita Income - Zipcode", "per_capita_income", "string"),
    Field("Yearly Income - Person", "yearly_income", "string"),
    Field("Total Debt", "total_debt", "string"),
    Field("FICO Score", "fico_score", "int"),
    Field("Num Credit Cards", "num_credit_cards", "int"),
)
CARDS = (
    Field("User", "user", "bigint"),
    Field("CARD INDEX", "card_index", "bigint"),
    Field("Card Brand", "card_brand", "string"),
    Field("Card Type", "card_type", "string"),
    Field("Has Chip", "has_chip", "string"),
    Field("Cards Issued", "cards_issued", "int"),
    Field("Credit Limit", "credit_limit", "string"),
    Field("Card on Dark Web", "on_dark_web", "string"),
)
SEGMENTS = (
    Field("User", "user", "bigint"),
    Field("Revenue", "revenue", "decimal(28,2)"),
    Field("RevenueCluster", "revenue_cluster", "int"),
    Field("Recency", "recency", "int"),
    Field("RecencyCluster", "recency_cluster", "int"),
    Field("Frequency", "frequency", "bigint"),
    Field("FrequencyCluster", "frequency_cluster", "int"),
    Field("overall_score", "overall_score", "int"),
    Field("Segment", "segment", "string"),
)
LIFETIME_VALUE = (
    Field("User", "user", "bigint"),
    Field("9 Year Revenue", "window_revenue", "decimal(28,2)"),
    *SEGMENTS[1:],
    Field("LTV Cluster", "ltv_cluster", "int"),
)
CARD_BRANDS = ("Amex", "Discover", "Mastercard", "Visa")
CARD_TYPES = ("Credit", "Debit", "Debit (Prepaid)")
