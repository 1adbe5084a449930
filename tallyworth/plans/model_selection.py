"""Cross-validation, model search and batch scoring."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworth.operators.boosting import Boosting
from tallyworth.operators.metrics import METRICS, confusion, weighted_metrics
from tallyworth.operators.models import (
    FEATURES,
    PLAIN,
    TUNED,
    BoostedModel,
    BoostedTrainer,
    Model,
    Trainer,
    boosted,
    forest,
    logistic,
    predict,
    rules_of,
    run_parallel,
    tree,
)
from tallyworth.operators.splits import holdout_split, stratified_folds
from tallyworth.session import materialise

# Shares of the two splits and the number of folds.
HELD_OUT = 0.05
VALIDATION = 0.2
FOLDS = 5


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def fold_predictions(
    frame: DataFrame, trainer: Trainer, folds: int = FOLDS, seed: int = 42, share: float = HELD_OUT, parallelism: int = 2
) -> DataFrame:
    """Every row of every stratified fold with the prediction of the model fitted on the other folds.

    The held-out share is removed before the folds are made.
    """
    rest, _ = holdout_split(frame, "user", share, seed)
    folded = materialise(stratified_folds(rest, "label", "user", folds, seed), "folds")

    # Boosted trees of all folds grow in the same passes over the rows.
    together = trainer.folds(folded, folds) if isinstance(trainer, BoostedTrainer) else None

    def tested(fold: int) -> DataFrame:
        model = together[fold] if together else trainer(folded.filter(F.col("fold") != fold).drop("fold"))
        return predict(model, folded.filter(F.col("fold") == fold))

    return materialise(_union(run_parallel(frame.sparkSession, tested, range(folds), parallelism)), "fold-predictions")


def cross_validate(frame: DataFrame, trainer: Trainer, folds: int = FOLDS, seed: int = 42, parallelism: int = 2) -> DataFrame:
    """Accuracy and weighted precision, recall and F1 of each stratified fold, with the rows that have no prediction."""
    predicted = fold_predictions(frame, trainer, folds, seed, parallelism=parallelism)
    return weighted_metrics(confusion(predicted, by=["fold"]), ["fold"])


def train_and_test(
    frame: DataFrame, trainer: Trainer, share: float = HELD_OUT, seed: int = 42
) -> tuple[Model, DataFrame, DataFrame]:
    """Fit on all but a held-out share; the model, and the training and the held-out rows with their predictions."""
    rows = materialise(frame, "training")
    train, test = holdout_split(rows, "user", share, seed)
    model = trainer(train)
    return model, predict(model, train), predict(model, test)


def default_candidates(plain: Boosting = PLAIN, tuned: Boosting = TUNED) -> dict[str, Trainer]:
    """Ten candidates from four families, the slowest first."""
    return {
        "boosted_plain": boosted(plain),
        "boosted_tuned": boosted(tuned),
        "tree_30": tree(30),
        "forest_50": forest(50, 10),
        "forest_20": forest(20, 8),
        "tree_10": tree(10),
        "tree_5": tree(5),
        "logistic": logistic(),
        "logistic_light": logistic(1e-4),
        "logistic_strong": logistic(1e-1),
    }


def compare_models(models: Mapping[str, Model], test: DataFrame) -> DataFrame:
    """The four metrics of each model on the same rows, which are read once and scored by all models in one pass."""
    scored = test.select("label", *(f"`{c}`" for c in FEATURES))
    for i, model in enumerate(models.values()):
        scored = predict(model, scored).withColumnRenamed("prediction", f"_by_{i}")
    found = (F.struct(F.lit(name).alias("model"), F.col(f"_by_{i}").alias("prediction")) for i, name in enumerate(models))
    rows = scored.select("label", F.inline(F.array(*found)))
    # A few cells a model, written as the metrics read them twice.
    return weighted_metrics(materialise(confusion(rows, by=["model"]), "cells"), ["model"])


def search_models(
    frame: DataFrame,
    candidates: Mapping[str, Trainer],
    share: float = VALIDATION,
    seed: int = 42,
    most_models: int = 10,
    parallelism: int = 2,
) -> tuple[DataFrame, Model, DataFrame]:
    """Fit the candidates on one split, rank them on the other.

    Returns the leaderboard, the leader and the leader's predictions for the validation rows.
    """
    if len(candidates) > most_models:
        raise ValueError(f"more than {most_models} candidates")
    train, valid = holdout_split(materialise(frame, "search"), "user", share, seed)
    names = list(candidates)
    fits = run_parallel(frame.sparkSession, lambda name: candidates[name](train), names, parallelism)
    fitted = dict(zip(names, fits))
    best_first = Window.orderBy(*(F.col(m).desc() for m in ("accuracy", "f1_score")), "model")
    # One row per candidate, so the unpartitioned rank is over at most ten rows.
    board = materialise(compare_models(fitted, valid).withColumn("rank", F.row_number().over(best_first)), "leaderboard")
    leader = fitted[board.filter(F.col("rank") == 1).first()["model"]]
    return board.select("rank", "model", *METRICS), leader, predict(leader, valid)


def save_model(model: Model, path: str, spark: SparkSession) -> None:
    """Store any model, with its kind and number of classes beside it."""
    if isinstance(model, BoostedModel):
        kind, classes = "boosted", model.classes
        model.save(f"{path}/model", spark)
    else:
        kind, classes = "pipeline", 0
        model.write().overwrite().save(f"{path}/model")
    about = spark.createDataFrame([(kind, classes)], "kind string, classes int")
    about.write.mode("overwrite").parquet(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> Model:
    """Any stored model."""
    about = spark.read.schema("kind string, classes int").parquet(f"{path}/about").first()
    if about["kind"] == "boosted":
        return BoostedModel.load(f"{path}/model", about["classes"], spark)
    return PipelineModel.load(f"{path}/model")


def score_batch(model: Model, frame: DataFrame, path: str) -> None:
    """Write user and predicted class of every row, by the model's rules: one projection, no Python, no vectors."""
    scored = frame.select("user", rules_of(model).prediction().cast("int").alias("ltv_cluster"))
    scored.write.mode("overwrite").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user bigint, ltv_cluster int").parquet(path)
