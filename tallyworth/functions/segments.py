"""Scores to named value segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The segment names and the highest scores of the first two.
LOW_VALUE = "Low-Value"
MID_VALUE = "Mid-Value"
HIGH_VALUE = "High-Value"
LOW_UP_TO = 3
MID_UP_TO = 6
SEGMENTS = (HIGH_VALUE, LOW_VALUE, MID_VALUE)


def value_segment(score: str | Column, low_up_to: int = LOW_UP_TO, mid_up_to: int = MID_UP_TO) -> Column:
    """Segment name of a score; a null score has no segment."""
    value = F.col(score) if isinstance(score, str) else score
    return F.when(value > mid_up_to, HIGH_VALUE).when(value > low_up_to, MID_VALUE).when(value.isNotNull(), LOW_VALUE)
