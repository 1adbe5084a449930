"""Classifiers of the lifetime-value label: boosted trees of this library, and MLlib's."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import cached_property, reduce
from multiprocessing.pool import ThreadPool
from typing import Protocol

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import Bucketizer, ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworth.functions.buckets import key_bucket
from tallyworth.functions.segments import SEGMENTS
from tallyworth.operators import boosting, rules
from tallyworth.operators.boosting import Boosting
from tallyworth.operators.encoding import one_hot
from tallyworth.operators.rules import Rules

MEASURES = ("revenue", "recency", "frequency")
CLUSTERS = ("recency_cluster", "frequency_cluster", "revenue_cluster", "overall_score")
FLAGS = tuple(f"segment_{s}" for s in sorted(SEGMENTS))
FEATURES = (*MEASURES, *CLUSTERS, *FLAGS)


class Model(Protocol):
    def transform(self, df: DataFrame) -> DataFrame: ...


Trainer = Callable[[DataFrame], Model]


# A tuned set and a plain set of boosting settings.
TUNED = Boosting(6, 1.3405182654493213, 56, 0.6114907939145026, 0.6510163553874492, 18, 280790652)
PLAIN = Boosting(5, 0.1, 100)

# Thresholds of a tree: quantiles of each measure in steps of 1/TREE_BINS, MLlib's own number. As many values of three measures and
# a few clusters bound the nodes, which live on the driver, whatever the rows are.
TREE_BINS = 32
# Of percentile_approx: exact up to so many rows, and off by so small a share beyond.
_ACCURACY = 100_000
# Up to the square of this number MLlib looks at all rows for its thresholds; a larger one overflows there.
_MOST_BINS = 46_340
_PARTS = 1 << 20


def model_frame(labelled: DataFrame) -> DataFrame:
    """User, label and features of every customer. The window revenue is left out: the label is made from it."""
    numbers = (F.col(c).cast("double").alias(c) for c in (*MEASURES, *CLUSTERS))
    frame = labelled.select("user", F.col("ltv_cluster").cast("double").alias("label"), *numbers, "segment")
    return one_hot(frame, "segment", SEGMENTS)


def trainable(frame: DataFrame) -> DataFrame:
    """The rows that have a label and all features; a customer without a readable date, for one, has no recency."""
    return frame.dropna(subset=["label", *FEATURES])


def _preparation() -> list:
    """Scale the measures and gather all features into one vector.

    The scaler is part of the model, so that new customers are scaled as the training rows were. It divides by the
    sample deviation, which differs from the population deviation by a factor that is the same for all rows.
    """
    return [
        VectorAssembler(inputCols=list(MEASURES), outputCol="measures", handleInvalid="keep"),
        StandardScaler(inputCol="measures", outputCol="scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["scaled", *CLUSTERS, *FLAGS], outputCol="features", handleInvalid="keep"),
    ]


def _pipeline(classifier: type, **params) -> Trainer:
    return lambda train: Pipeline(stages=[*_preparation(), classifier(**params)]).fit(trainable(train))


def _splits(rows: DataFrame) -> list[list[float]]:
    """Of each measure, where the bins begin: just above its quantiles, so that a bin ends with the quantile itself."""
    at = F.array(*(F.lit(i / TREE_BINS) for i in range(1, TREE_BINS)))
    found = rows.agg(*(F.percentile_approx(F.col(m).cast("double"), at, F.lit(_ACCURACY)).alias(m) for m in MEASURES)).first()
    return [[-math.inf, *sorted({math.nextafter(x, math.inf) for x in found[m] or [0.0]}), math.inf] for m in MEASURES]


def _binned_pipeline(classifier: type, **params) -> Trainer:
    """As `_pipeline`, for trees: the measures come in bins, and thresholds are taken from all rows.

    MLlib looks for thresholds in a sample of maxBins squared rows, 10,000 at least. With few values a column and maxBins as
    high as the root of the rows it looks at all of them, and has as many bins as there are values.
    """

    def fit(train: DataFrame) -> Model:
        rows = trainable(train)
        count = rows.count()
        if count > _MOST_BINS**2:
            raise ValueError(f"trees are fitted on at most {_MOST_BINS**2} rows, not on {count}")
        binned = [f"binned_{m}" for m in MEASURES]
        bins = Bucketizer(splitsArray=_splits(rows), inputCols=list(MEASURES), outputCols=binned, handleInvalid="keep")
        together = VectorAssembler(inputCols=binned, outputCol="bins", handleInvalid="keep")
        numbers = ElementwiseProduct(inputCol="bins", outputCol="numbers", scalingVec=Vectors.dense([1.0] * len(binned)))  # bins in order, no longer mere names
        gathered = VectorAssembler(inputCols=["numbers", *CLUSTERS, *FLAGS], outputCol="features", handleInvalid="keep")
        most = max(TREE_BINS, math.isqrt(max(count - 1, 0)) + 1)
        return Pipeline(stages=[bins, together, numbers, gathered, classifier(maxBins=most, **params)]).fit(rows)

    return fit


def _bounded(train: DataFrame, most_rows: int) -> DataFrame:
    """All rows, or a sample by the user's hash of about `most_rows` where there are more."""
    rows = train.count()
    if rows <= most_rows:
        return train
    return train.filter(key_bucket("user", _PARTS, 7) < int(_PARTS * most_rows / rows))


def logistic(regularisation: float | None = None, max_iter: int = 100) -> Trainer:
    """Multinomial logistic regression; the default penalty is 1/n, that is C = 1 on the sum of losses."""

    def fit(train: DataFrame) -> Model:
        penalty = regularisation if regularisation is not None else 1.0 / max(trainable(train).count(), 1)
        settings = {"family": "multinomial", "standardization": False, "regParam": penalty, "maxIter": max_iter}
        return _pipeline(LogisticRegression, **settings)(train)

    return fit


def tree(depth: int = 30, seed: int = 42, most_rows: int | None = None) -> Trainer:
    """A single tree, fitted on all rows, or on at most `most_rows` for a caller that asks for a sample."""
    fit = _binned_pipeline(DecisionTreeClassifier, impurity="gini", maxDepth=depth, seed=seed)
    return fit if most_rows is None else lambda train: fit(_bounded(train, most_rows))


def forest(trees: int = 50, depth: int = 10, seed: int = 42) -> Trainer:
    """A random forest on all rows: each tree draws them anew, with repeats; thresholds are those of all rows."""
    return _binned_pipeline(RandomForestClassifier, numTrees=trees, maxDepth=depth, seed=seed)


class BoostedModel:
    """Boosted trees by round and class; the class with the highest score wins, the lowest number on a tie."""

    def __init__(self, trees: list[list[list[dict]]], classes: int):
        self.trees = trees
        self.classes = classes

    @cached_property
    def rules(self) -> Rules:
        return rules.of_boosted(self.trees, FEATURES, self.classes)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", boosting.prediction(self.trees, FEATURES, self.classes))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The trees as a table: round, class, node, feature, threshold (at most: low), low, high, value."""
        rows = [(r, k, *(n[c] for c in _NODE)) for r, own in enumerate(self.trees) for k, tree in enumerate(own) for n in tree]
        return spark.createDataFrame(rows, "round int, class int, node int, feature string, threshold double, low int, high int, value double")

    def save(self, path: str, spark: SparkSession) -> None:
        self.nodes(spark).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str, classes: int, spark: SparkSession) -> BoostedModel:
        trees: list[list[list[dict]]] = []
        for r in spark.read.parquet(path).toArrow().sort_by([("round", "ascending"), ("class", "ascending")]).to_pylist():
            while len(trees) <= r["round"]:
                trees.append([[] for _ in range(classes)])
            trees[r["round"]][r["class"]].append({c: r[c] for c in _NODE})
        for own in trees:
            for k, tree in enumerate(own):
                own[k] = _from_root(tree)
        return BoostedModel(trees, classes)


_NODE = ("node", "feature", "threshold", "low", "high", "value")


def _from_root(nodes: list[dict]) -> list[dict]:
    """The nodes in the order of their numbers: in heap order a child stands after its parent."""
    return sorted(nodes, key=lambda n: n["node"])


class BoostedTrainer:
    """Fits boosted trees on a frame, or one model for each fold in the same passes."""

    def __init__(self, settings: Boosting = TUNED, classes: int = 3):
        self.settings, self.classes = settings, classes

    def __call__(self, train: DataFrame) -> BoostedModel:
        rows = trainable(train).withColumn("model", F.lit(0))
        return BoostedModel(boosting.fit(rows, FEATURES, self.classes, self.settings)[0], self.classes)

    def folds(self, folded: DataFrame, folds: int) -> list[BoostedModel]:
        """The model of every fold, fitted on the rows of all others."""
        others = F.array_remove(F.array(*(F.lit(i) for i in range(folds))), F.col("fold"))
        rows = trainable(folded).withColumn("model", F.explode(others))
        return [BoostedModel(trees, self.classes) for trees in boosting.fit(rows, FEATURES, self.classes, self.settings, folds)]


def boosted(settings: Boosting = TUNED, classes: int = 3) -> BoostedTrainer:
    """Boosted trees of all classes, grown together."""
    return BoostedTrainer(settings, classes)


def rules_of(model: Model) -> Rules:
    """A fitted model as rules: `prediction()` scores a row as a column expression, `table(spark)` is for publication."""
    return model.rules if isinstance(model, BoostedModel) else rules.of_pipeline(model)


def run_parallel(session: SparkSession, job: Callable, items: Sequence, parallelism: int) -> list:
    """Submit several Spark jobs at once, as MLlib's own tuning does; the work itself stays on the cluster.

    The session is handed in, as worker threads have none of their own; so a job may run further jobs in this way.
    """
    if parallelism <= 1:
        return [job(item) for item in items]
    in_session = inheritable_thread_target(session)
    pool = ThreadPool(parallelism)
    try:
        return pool.map(in_session(job), items, chunksize=1)
    finally:
        pool.close()


def predict(model: Model, df: DataFrame) -> DataFrame:
    """Every row with its predicted class; a row that lacks a feature has none."""
    known = reduce(Column.__and__, (F.col(f"`{c}`").isNotNull() for c in FEATURES))
    prediction = F.when(known, F.col("prediction")).alias("prediction")
    return model.transform(df).select(*(f"`{c}`" for c in df.columns), prediction)
