"""Keep the customers' totals as a table, and fold new transactions into it.

The state has one row per user: the last day, counts and exact sums, for all years and for a range of years. Two states add
up column by column, so the state of all transactions is that of the old ones and that of the new ones together: a run
reads the new transactions only. Nothing of it depends on the order or number of the parts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworth.operators.activity import last_day, user_activity, with_recency
from tallyworth.operators.cleaning import clean_transactions
from tallyworth.operators.clusters import Fit, fit_kmeans
from tallyworth.plans.customer_segments import AXES, DEFAULTS, Settings, label_customers
from tallyworth.session import materialise

# How each column of two states becomes one; a user without revenue in the range has null there, and sums skip it.
_MERGED = {"last_date": F.max, "frequency": F.sum, "revenue": F.sum, "window_revenue": F.sum, "window_transactions": F.sum}


def customer_state(raw: DataFrame, start_year: int, end_year: int, valid_only: bool = False) -> DataFrame:
    """The state of some transactions; no transactions give an empty state."""
    return user_activity(clean_transactions(raw), (start_year, end_year), valid_only)


def folded(state: DataFrame, newer: DataFrame) -> DataFrame:
    """One state of two, with the column types of the first. Users of either are in the result."""
    both = state.unionByName(newer)
    merged = both.groupBy("user").agg(*(how(c).alias(c) for c, how in _MERGED.items()))
    return merged.select("user", *(F.col(c).cast(state.schema[c].dataType).alias(c) for c in _MERGED))


def customers_of(state: DataFrame) -> DataFrame:
    """Recency, frequency, revenue and window revenue per user, as one run over all transactions gives them."""
    return with_recency(state, last_day(state, "last_date"))


def label_state(state: DataFrame, settings: Settings = DEFAULTS, begin: Mapping[str, Fit] | None = None) -> tuple[DataFrame, dict[str, Fit]]:
    """Scored and labelled customers of a state, and the fits; `begin`, the fits of an earlier run, gives the first centres.

    Without `begin` the result is that of a full run.
    """
    base = materialise(customers_of(state), "state-customers")
    wanted = {**dict.fromkeys(AXES, settings.clusters), "window_revenue": settings.value_clusters}
    fits = fit_kmeans(base, wanted, max_iter=settings.max_iter, tolerance=settings.tolerance, begin=begin)
    return label_customers(base, fits, settings), fits
