import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyworth.operators import clusters

MONEY = "user int, v decimal(28,2)"


def _frame(spark, values, kind="v int"):
    return spark.createDataFrame(list(enumerate(values)), f"user int, {kind}")


@pytest.fixture(scope="module")
def skewed(spark):
    draw = random.Random(7)
    values = [Decimal(round(draw.lognormvariate(5, 1.5), 2)).quantize(Decimal("0.01")) for _ in range(3000)]
    values += [Decimal("33.33")] * 1500 + [Decimal("-12.50")] * 10
    return spark.createDataFrame(list(enumerate(values)), MONEY), [float(v) for v in values]


def _nearest(value, centres):
    return min(range(len(centres)), key=lambda i: (abs(value - centres[i]), i))


def test_labels_are_nearest_and_centres_are_means(spark, skewed):
    frame, values = skewed
    fit = clusters.fit_kmeans(frame, {"v": 6}, tolerance=0.0)["v"]
    centres = [c / 100 for c in fit.centres]
    assert centres == sorted(centres) and fit.settled
    labels = {r["user"]: r["c"] for r in clusters.assign(frame, fit, "c").collect()}
    assert all(labels[i] == _nearest(v, centres) for i, v in enumerate(values))
    for c in range(6):
        own = [v for i, v in enumerate(values) if labels[i] == c]
        assert sum(own) / len(own) == pytest.approx(centres[c], rel=1e-9)


def test_fit_does_not_depend_on_partitions(spark, skewed):
    frame, _ = skewed
    fits = [clusters.fit_kmeans(frame.repartition(n), {"v": 5})["v"].centres for n in (1, 8)]
    assert fits[0] == fits[1]


def test_more_values_than_bins(spark):
    frame = spark.range(20000).select(F.col("id").cast("int").alias("user"), (F.col("id") * F.col("id") % 100003).alias("v"))
    fit = clusters.fit_kmeans(frame, {"v": 4}, tolerance=0.0)["v"]
    means = clusters.assign(frame, fit, "c").groupBy("c").agg(F.avg("v")).orderBy("c").collect()
    assert [m[1] for m in means] == pytest.approx(list(fit.centres), rel=1e-12)


def test_several_axes_are_fitted_as_each_alone(spark):
    frame = spark.range(500).select("id", (F.col("id") % 37).alias("a"), (F.col("id") * 3 % 101).alias("b"))
    together = clusters.fit_kmeans(frame, {"a": 3, "b": 4})
    assert together["a"] == clusters.fit_kmeans(frame, {"a": 3})["a"]
    assert together["b"] == clusters.fit_kmeans(frame, {"b": 4})["b"]


def test_fewer_values_than_clusters(spark):
    frame = _frame(spark, [1, 1, 5, 5, 9, None])
    out = clusters.cluster_k(frame, "v", "c", 6, ascending=False)
    got = {(r["v"], r["c"]) for r in out.collect()}
    assert got == {(9, 0), (5, 1), (1, 2), (None, None)}


def test_no_values(spark):
    assert clusters.fit_kmeans(_frame(spark, [None, None]), {"v": 3}) == {}


def test_doubles(spark):
    fit = clusters.fit_kmeans(_frame(spark, [0.1, 0.2, 0.3, 10.0, 11.0], "v double"), {"v": 2})["v"]
    assert fit.centres == pytest.approx((0.2, 10.5))


def test_random_start_gives_ascending_centres(spark, skewed):
    frame, values = skewed
    fit = clusters.fit_kmeans_random(frame, "v", 4)
    assert list(fit.centres) == sorted(fit.centres) and fit.used == tuple(range(len(fit.centres)))
    labels = {r["user"]: r["c"] for r in clusters.assign(frame, fit, "c").collect()}
    centres = [c / 100 for c in fit.centres]
    assert sum(labels[i] != _nearest(v, centres) for i, v in enumerate(values)) == 0


def test_order_clusters_agrees_with_assign_ordered(spark, skewed):
    frame, _ = skewed
    fit = clusters.fit_kmeans(frame, {"v": 5})["v"]
    for ascending in (True, False):
        general = clusters.order_clusters(clusters.assign(frame, fit, "c"), "c", "v", ascending)
        direct = clusters.assign_ordered(frame, fit, "c", ascending)
        assert set(map(tuple, general.select("user", "c").collect())) == set(map(tuple, direct.select("user", "c").collect()))


def test_order_clusters_breaks_ties_by_old_label(spark):
    frame = spark.createDataFrame([(7, 2.0), (3, 2.0), (5, 1.0), (None, 4.0)], "c int, t double")
    got = clusters.order_clusters(frame, "c", "t").select("t", "c").collect()
    assert sorted((t, -1 if c is None else c) for t, c in got) == [(1.0, 0), (2.0, 1), (2.0, 2), (4.0, -1)]
    means = [r["m"] for r in clusters.order_clusters(frame, "c", "t", False).groupBy("c").agg(F.avg("t").alias("m")).orderBy(F.col("c").asc_nulls_last()).collect()]
    assert means[:3] == [2.0, 2.0, 1.0]


def test_elbow(spark, skewed):
    frame, values = skewed
    curve = {r["k"]: r["inertia"] for r in clusters.elbow_curve(frame, ["v"]).collect()}
    mean = sum(values) / len(values)
    assert curve[1] == pytest.approx(sum((v - mean) ** 2 for v in values), rel=1e-9)
    assert set(curve) == set(range(1, 10)) and curve[9] < curve[3] < curve[1]
