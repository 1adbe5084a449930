"""Classification metrics from counts of (label, prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworth.session import materialise

METRICS = ("accuracy", "precision", "recall", "f1_score")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Rows per (label, prediction), nulls included; everything else is computed from these few cells."""
    classes = (F.col(c).cast("int").alias(n) for c, n in ((label, "label"), (prediction, "prediction")))
    return df.groupBy(*by, *classes).agg(F.count(F.lit(1)).alias("n"))


def unscored(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many rows lack a label or a prediction, and so count in no metric."""
    known = F.col("label").isNotNull() & F.col("prediction").isNotNull()
    return cells.groupBy(*by).agg(F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unscored_rows"))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def per_class(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where a class was never predicted or never present."""
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(zero)
    as_label = F.struct(F.col("label").alias("class"), n.alias("present"), zero.alias("predicted"), hit.alias("hits"))
    as_prediction = F.struct(F.col("prediction").alias("class"), zero.alias("present"), n.alias("predicted"), zero.alias("hits"))
    counts = (
        cells.dropna(subset=["label", "prediction"])
        .select(*by, F.inline(F.array(as_label, as_prediction)))
        .groupBy(*by, "class")
        .agg(F.sum("present").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    )
    hits, predicted, support = F.col("hits"), F.col("predicted"), F.col("support")
    return counts.withColumns(
        {
            "precision": _share(hits, predicted),
            "recall": _share(hits, support),
            "f1_score": _share(2 * hits, predicted + support),
        }
    )


def weighted_metrics(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, support-weighted precision, recall and F1, and the rows that count in none, one row per group."""
    support = F.col("support")
    means = (_share(F.sum(F.col(m) * support), F.sum("support")).alias(m) for m in METRICS[1:])
    keys = [*by, "_all"]
    cells = cells.withColumn("_all", F.lit(0))
    found = per_class(cells, keys).groupBy(*keys).agg(_share(F.sum("hits"), F.sum("support")).alias("accuracy"), *means)
    return unscored(cells, keys).join(found, keys, "left").select(*by, *METRICS, "unscored_rows")


def classification_report(cells: DataFrame) -> DataFrame:
    """One row per class, then accuracy, the plain and the support-weighted averages."""
    # A row per class, written because four parts of the report read it and the counts come from all the data.
    classes = materialise(per_class(cells), "classes")
    scores = METRICS[1:]
    rows = classes.select(F.col("class").cast("string").alias("class"), *scores, "support")
    total = F.sum("support").alias("support")
    accuracy = classes.agg(_share(F.sum("hits"), F.sum("support")).alias("f1_score"), total).select(
        F.lit("accuracy").alias("class"), *(F.lit(None).cast("double").alias(s) for s in scores[:2]), "f1_score", "support"
    )
    macro = classes.agg(*(F.avg(s).alias(s) for s in scores), total)
    weighted = classes.agg(*(_share(F.sum(F.col(s) * F.col("support")), F.sum("support")).alias(s) for s in scores), total)
    averages = [d.select(F.lit(name).alias("class"), *scores, "support") for name, d in (("macro avg", macro), ("weighted avg", weighted))]
    return rows.unionByName(accuracy).unionByName(averages[0]).unionByName(averages[1])


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Mean of each metric over the rows of a fold table."""
    return metrics.agg(*(F.avg(m).alias(f"mean_{m}") for m in METRICS))
