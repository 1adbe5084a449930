"""Raw transactions to scored, segmented and value-labelled customers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworth.functions.segments import LOW_UP_TO, MID_UP_TO, SEGMENTS
from tallyworth.operators.activity import last_day, timeframe_revenue, user_activity, with_recency
from tallyworth.operators.clusters import (
    MAX_ITER,
    TOLERANCE,
    Fit,
    assign_ordered,
    fit_kmeans,
    fit_kmeans_random,
)
from tallyworth.operators.cleaning import clean_transactions
from tallyworth.operators.encoding import one_hot, standardise
from tallyworth.operators.joins import with_segments
from tallyworth.operators.scoring import overall_score, with_segment
from tallyworth.session import materialise

# Clusters per axis, and whether a larger value ranks higher.
AXES = {"recency": False, "frequency": True, "revenue": True}
AXIS_CLUSTERS = 6
VALUE_CLUSTERS = 3
# The columns that are published standardised.
SCALED = ("revenue", "recency", "frequency", "window_revenue")


@dataclass(frozen=True)
class Settings:
    clusters: int = AXIS_CLUSTERS
    value_clusters: int = VALUE_CLUSTERS
    low_up_to: int = LOW_UP_TO
    mid_up_to: int = MID_UP_TO
    max_iter: int = MAX_ITER
    tolerance: float = TOLERANCE
    valid_only: bool = False
    random_start: bool = False
    seed: int = 42


DEFAULTS = Settings()


def customer_base(raw: DataFrame, years: tuple[int, int] | None = None, valid_only: bool = False) -> DataFrame:
    """One row per user with recency, frequency and revenue, written to the shared folder.

    This is the only read of the transactions; everything after it works on one row per user.
    """
    activity = materialise(user_activity(clean_transactions(raw), years, valid_only), "activity")
    return with_recency(activity, last_day(activity, "last_date"))


def _fits(customers: DataFrame, wanted: dict[str, int], settings: Settings) -> dict[str, Fit]:
    if settings.random_start:
        fits = {a: fit_kmeans_random(customers, a, k, settings.seed, settings.max_iter) for a, k in wanted.items()}
        return {axis: fit for axis, fit in fits.items() if fit}
    return fit_kmeans(customers, wanted, max_iter=settings.max_iter, tolerance=settings.tolerance)


def _scored(customers: DataFrame, fits: dict[str, Fit], settings: Settings) -> DataFrame:
    for axis, larger_is_higher in AXES.items():
        customers = assign_ordered(customers, fits.get(axis), f"{axis}_cluster", larger_is_higher)
    return with_segment(overall_score(customers), settings.low_up_to, settings.mid_up_to)


def score_customers(customers: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Cluster the three axes of one row per user, add score and segment."""
    return _scored(customers, _fits(customers, dict.fromkeys(AXES, settings.clusters), settings), settings)


def segment_customers(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Recency, frequency and revenue clusters, their sum and the segment of every user."""
    return score_customers(customer_base(raw, valid_only=settings.valid_only), settings)


def label_lifetime_value(
    raw: DataFrame, start_year: int, end_year: int, settings: Settings = DEFAULTS
) -> DataFrame:
    """Segmented customers with the revenue of the given years and its cluster, 0 for the lowest.

    One scan and one shuffle of the transactions serve both: the window revenue is a conditional sum of the
    same aggregation, and its clusters are fitted in the same rounds as the scores. Users without a valid
    transaction in the window take part in scoring, then drop out.

    Scaling one column does not change which centre is nearest, so the fit runs on exact cents; the scaled
    column is made by `standardise` where it is wanted.
    """
    base = customer_base(raw, (start_year, end_year), settings.valid_only)
    wanted = {**dict.fromkeys(AXES, settings.clusters), "window_revenue": settings.value_clusters}
    return label_customers(base, _fits(base, wanted, settings), settings)


def label_customers(base: DataFrame, fits: dict[str, Fit], settings: Settings = DEFAULTS) -> DataFrame:
    """The customers of `base` with transactions in the window, scored and labelled by fits of all four columns."""
    in_window = base.filter(F.col("window_transactions") > 0).drop("window_transactions")
    return assign_ordered(_scored(in_window, fits, settings), fits.get("window_revenue"), "ltv_cluster")


def label_segmented(
    raw: DataFrame, segments: DataFrame, start_year: int, end_year: int, settings: Settings = DEFAULTS
) -> DataFrame:
    """The same from segments scored earlier: window revenue joined to them, then clustered."""
    window = timeframe_revenue(clean_transactions(raw), start_year, end_year)
    joined = materialise(with_segments(window, segments), "window-segments")
    fits = _fits(joined, {"window_revenue": settings.value_clusters}, settings)
    return assign_ordered(joined, fits.get("window_revenue"), "ltv_cluster")


def preprocess(labelled: DataFrame) -> DataFrame:
    """The published model input: measures standardised, the segment as 0/1 columns."""
    return one_hot(standardise(labelled, SCALED), "segment", SEGMENTS)
