"""Any fitted classifier as plain rules: a table to publish, and a column expression that scores rows.

A model is a list of trees whose leaves hold a number for each class, or one weight a feature and class. The class with the
largest sum wins, the lowest one of equals. Inputs are shifted and scaled as the fitted model did, operation by operation,
so the expression gives the class that the model gives, without Python and without vector columns; and any other engine
can score from the table alone.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworth.session import discard, scratch_path

SCHEMA = """kind string, tree int, node int, feature string, shift double, factor double, threshold double, low int,
    high int, class_values array<double>"""
_TREE = "struct<f:array<int>,t:array<double>,l:array<int>,h:array<int>,v:array<array<double>>,d:int>"


@dataclass(frozen=True)
class Node:
    """A node asks whether an input is at most `threshold` (then `low`, else `high`); a leaf has feature -1."""

    feature: int
    threshold: float
    low: int
    high: int
    values: tuple[float, ...]


@dataclass(frozen=True)
class Rules:
    """`inputs`: column, shift, factor of each feature, used as (column - shift) * factor. Node 0 of a tree is its root."""

    classes: int
    inputs: tuple[tuple[str, float, float], ...]
    trees: tuple[tuple[Node, ...], ...] = ()
    weights: tuple[tuple[float, ...], ...] = ()
    intercepts: tuple[float, ...] = ()

    def scores(self) -> str:
        """SQL of an array with the score of every class."""
        x = f"array({', '.join(f'(CAST(`{name}` AS DOUBLE) - {shift!r}D) * {factor!r}D' for name, shift, factor in self.inputs)})"
        if self.weights:
            kind = "array<struct<w:array<double>,b:double>>"
            linear = _literal([{"w": w, "b": b} for w, b in zip(self.weights, self.intercepts)], kind)
            dot = "aggregate(zip_with(x, c.w, (a, b) -> a * b), 0D, (s, y) -> s + y) + c.b"
            return f"get(transform(array({x}), x -> transform({linear}, c -> {dot})), 0)"
        asked = "get(tree.f, n)"
        step = f"if({asked} < 0, n, if(get(x, {asked}) <= get(tree.t, n), get(tree.l, n), get(tree.h, n)))"
        leaf = f"aggregate(sequence(1, tree.d), 0, (n, i) -> {step})"
        total = f"aggregate({_literal([_arrays(t) for t in self.trees], f'array<{_TREE}>')}, array_repeat(0D, {self.classes}), (s, tree) -> zip_with(s, get(tree.v, {leaf}), (a, b) -> a + b))"
        return f"get(transform(array({x}), x -> {total}), 0)"

    def prediction(self) -> Column:
        """The class of a row, as a double; null where an input is null."""
        found = f"get(transform(array({self.scores()}), s -> CAST(array_position(s, array_max(s)) - 1 AS DOUBLE)), 0)"
        missing = " OR ".join(f"`{name}` IS NULL" for name, _, _ in self.inputs)
        return F.expr(f"CASE WHEN NOT ({missing}) THEN {found} END")

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows of kind tree (nodes, with class_values at leaves), weight (one a feature) or intercept."""
        rows: list[tuple] = []
        for t, tree in enumerate(self.trees):
            for n, node in enumerate(tree):
                if node.feature < 0:
                    rows.append(("tree", t, n, None, None, None, None, None, None, list(node.values)))
                else:
                    rows.append(("tree", t, n, *self.inputs[node.feature], node.threshold, node.low, node.high, None))
        if self.weights:
            rows += [("weight", None, None, *given, None, None, None, [w[i] for w in self.weights]) for i, given in enumerate(self.inputs)]
            rows.append(("intercept", None, None, None, None, None, None, None, None, list(self.intercepts)))
        return spark.createDataFrame(rows, SCHEMA)


def _literal(value: list, kind: str) -> str:
    return f"from_json('{json.dumps(value)}', '{kind}')"


def _arrays(tree: Sequence[Node]) -> dict:
    depths = [0] * len(tree)
    for n, node in enumerate(tree):  # a child stands after its parent
        if node.feature >= 0:
            depths[node.low] = depths[node.high] = depths[n] + 1
    return {
        "f": [n.feature for n in tree],
        "t": [n.threshold for n in tree],
        "l": [n.low for n in tree],
        "h": [n.high for n in tree],
        "v": [n.values if n.feature < 0 else [] for n in tree],
        "d": max(1, max(depths)),
    }


def of_boosted(trees: Sequence[Sequence[Sequence[dict]]], features: Sequence[str], classes: int) -> Rules:
    """Rules of boosted trees: `trees` by round and class, each a list of nodes from its root on."""
    found = []
    for round_ in trees:
        for k, nodes in enumerate(round_):
            place = {n["node"]: i for i, n in enumerate(nodes)}
            own = []
            for n in nodes:
                if n["feature"] is None:
                    own.append(Node(-1, 0.0, 0, 0, tuple(n["value"] if c == k else 0.0 for c in range(classes))))
                else:
                    own.append(Node(features.index(n["feature"]), n["threshold"], place[n["low"]], place[n["high"]], ()))
            found.append(tuple(own))
    return Rules(classes, tuple((f, 0.0, 1.0) for f in features), tuple(found))


def of_pipeline(model: PipelineModel) -> Rules:
    """Rules of a fitted pipeline: measures, scaled or in bins, an assembler and a linear or tree classifier."""
    first, *_, gathered, classifier = model.stages
    if isinstance(first, Bucketizer):
        splits, inputs = first.getSplitsArray(), [(name, 0.0, 1.0) for name in first.getInputCols()]
    else:
        splits, scaler = [], model.stages[1]
        inputs = [(name, float(m), 1.0 / float(s) if s else 0.0) for name, m, s in zip(first.getInputCols(), scaler.mean, scaler.std)]
    inputs += [(name, 0.0, 1.0) for name in gathered.getInputCols()[1:]]
    classes = classifier.numClasses
    if isinstance(classifier, LogisticRegressionModel):
        weights = classifier.coefficientMatrix.toArray()
        return Rules(classes, tuple(inputs), weights=tuple(map(tuple, weights.tolist())), intercepts=tuple(classifier.interceptVector.toArray().tolist()))
    spark = SparkSession.active()
    path = scratch_path(spark, "rules")
    classifier.write().save(path)
    many = isinstance(classifier, RandomForestClassificationModel)
    stored = spark.read.parquet(f"{path}/data")
    nodes = stored.select("treeID", "nodeData.*") if many else stored.select(F.lit(0).alias("treeID"), "*")
    by_tree: dict[int, dict[int, Node]] = {}
    for r in nodes.select("treeID", "id", "impurityStats", "leftChild", "rightChild", "split").toArrow().to_pylist():
        total = sum(r["impurityStats"]) if many else 1.0
        leaf = r["leftChild"] < 0
        values = tuple(v / total if total else 0.0 for v in r["impurityStats"]) if leaf else ()
        asked = -1 if leaf else r["split"]["featureIndex"]
        threshold = 0.0 if leaf else r["split"]["leftCategoriesOrThreshold"][0]
        if 0 <= asked < len(splits):  # up to the bin of this number: up to the last value before the next one begins
            threshold = math.nextafter(splits[asked][math.floor(threshold) + 1], -math.inf)
        by_tree.setdefault(r["treeID"], {})[r["id"]] = Node(asked, threshold, max(0, r["leftChild"]), max(0, r["rightChild"]), values)
    discard(spark, path)
    return Rules(classes, tuple(inputs), tuple(tuple(own[i] for i in range(len(own))) for _, own in sorted(by_tree.items())))
