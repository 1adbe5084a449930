"""Scores and segments from ordered clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworth.functions.means import exact_mean
from tallyworth.functions.segments import LOW_UP_TO, MID_UP_TO, value_segment


def overall_score(df: DataFrame) -> DataFrame:
    total = F.col("recency_cluster") + F.col("frequency_cluster") + F.col("revenue_cluster")
    return df.withColumn("overall_score", total)


def with_segment(df: DataFrame, low_up_to: int = LOW_UP_TO, mid_up_to: int = MID_UP_TO) -> DataFrame:
    return df.withColumn("segment", value_segment("overall_score", low_up_to, mid_up_to))


def score_profile(df: DataFrame) -> DataFrame:
    """Mean recency, frequency and revenue per score."""
    means = (exact_mean(df, c).alias(f"mean_{c}") for c in ("recency", "frequency", "revenue"))
    return df.groupBy("overall_score").agg(F.count(F.lit(1)).alias("customers"), *means)
