import math

import pytest
from pyspark.sql import functions as F

from tallyworth import schema
from tallyworth.checks import proxies
from tallyworth.operators import metrics, models, splits, summaries
from tallyworth.plans import customer_segments as cs
from tallyworth.plans import model_selection as ms
from tallyworth.operators import cleaning
from tallyworth.session import clear_scratch, materialise, scratch_root, written_once
from tallyworth.sources import tables


@pytest.fixture(scope="module")
def labelled(spark, folder):
    raw = proxies.transactions(spark, folder)
    return materialise(cs.label_lifetime_value(raw, proxies.START_YEAR, proxies.END_YEAR), "labelled")


@pytest.fixture(scope="module")
def frame(labelled):
    return models.model_frame(labelled)


def test_partitioning_does_not_change_segments(spark, folder):
    raw = proxies.transactions(spark, folder)
    one, eight = (set(map(tuple, cs.segment_customers(raw.repartition(n)).collect())) for n in (1, 8))
    assert one == eight


def test_one_user_with_a_third_of_all_rows(spark, folder):
    raw = proxies.transactions(spark, folder)
    hot = raw.withColumn("user", F.when(F.col("row_id") % 3 == 0, F.lit(5)).otherwise(F.col("user")))
    out = {r["user"]: r for r in cs.segment_customers(hot).collect()}
    top = max(out.values(), key=lambda r: r["frequency"])
    assert top["user"] == 5 and top["frequency_cluster"] == 5
    assert sum(r["frequency"] for r in out.values()) == raw.count()


def test_results_survive_the_loss_of_held_tables(spark, folder):
    rows = cs.segment_customers(proxies.transactions(spark, folder))
    profile = summaries.describe_by_group(rows, "revenue_cluster", "revenue")
    folds = splits.stratified_folds(rows, "segment", "user")
    frames = (rows, profile, folds)
    before = [set(map(tuple, f.collect())) for f in frames]
    spark.catalog.clearCache()
    assert [set(map(tuple, f.collect())) for f in frames] == before


def test_thresholds_and_random_start(spark, folder):
    raw = proxies.transactions(spark, folder)
    strict = cs.segment_customers(raw, cs.Settings(low_up_to=15, mid_up_to=15))
    assert {r[0] for r in strict.select("segment").distinct().collect()} == {"Low-Value"}
    random_start = cs.segment_customers(raw, cs.Settings(random_start=True))
    means = random_start.groupBy("recency_cluster").agg(F.avg("recency")).orderBy("recency_cluster").collect()
    assert [m[1] for m in means] == sorted((m[1] for m in means), reverse=True)


def test_label_means_ascend(labelled):
    means = [r[1] for r in labelled.groupBy("ltv_cluster").agg(F.avg("window_revenue")).orderBy("ltv_cluster").collect()]
    assert len(means) == 3 and means == sorted(means)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "tx.csv").write_text(
        "Merchant,Amount,User,Year,Month,Day,Time,Is Fraud?,Errors?\n"
        'Shop,"$1,234.50",7,2015,1,2,06:30,No,\nShop,$5,x,2015,1,2,06:30,No,Bad PIN\n'
    )
    rows = tables.read_csv(spark, str(tmp_path / "tx.csv"), schema.TRANSACTIONS)
    assert [(f.name, f.type) for f in schema.TRANSACTIONS] == rows.dtypes
    assert [tuple(r) for r in rows.collect()] == [
        (7, 2015, 1, 2, "06:30", "$1,234.50", "No", None),
        (None, 2015, 1, 2, "06:30", "$5", "No", "Bad PIN"),
    ]


def test_catalog_table(spark, labelled, tmp_path):
    published = labelled.select([F.col(f.name).alias(f.published) for f in schema.LIFETIME_VALUE])
    tables.write_table(published.withColumnsRenamed({c: c.replace(" ", "_") for c in published.columns}), "lifetime_value_test", f"{tmp_path}/t")
    fields = [f._replace(published=f.published.replace(" ", "_")) for f in schema.LIFETIME_VALUE]
    back = tables.read_table(spark, "lifetime_value_test", fields)
    assert set(map(tuple, back.collect())) == set(map(tuple, labelled.select(*back.columns).collect()))
    assert set(map(tuple, tables.read_parquet(spark, f"{tmp_path}/t", fields).collect())) == set(map(tuple, back.collect()))
    spark.sql("DROP TABLE lifetime_value_test")


def test_leak_is_left_out(frame):
    assert "window_revenue" not in frame.columns and {"label", "user", "segment_Low-Value"} <= set(frame.columns)


@pytest.mark.parametrize(
    "trainer",
    [models.logistic(max_iter=10), models.tree(5), models.forest(5, 4), models.boosted(models.Boosting(3, 0.3, 3))],
    ids=["logistic", "tree", "forest", "boosted"],
)
def test_models_beat_guessing(frame, trainer):
    model = trainer(frame)
    scored = ms.predict(model, frame)
    assert set(scored.columns) >= {"user", "label", "prediction"} and "features" not in scored.columns
    result = metrics.weighted_metrics(metrics.confusion(scored)).first()
    most_common = frame.groupBy("label").count().agg(F.max("count")).first()[0] / frame.count()
    assert result["accuracy"] > most_common


def test_customers_without_a_feature_are_kept_without_a_class(frame):
    holes = frame.withColumn("recency", F.when(F.col("user") % 10 != 0, F.col("recency")))
    for trainer in (models.logistic(max_iter=3), models.tree(3), models.boosted(models.Boosting(2, 0.3, 1))):
        scored = ms.predict(trainer(holes), holes)
        assert scored.count() == frame.count()
        assert scored.filter(F.col("prediction").isNull() != F.col("recency").isNull()).isEmpty()
        unscored = metrics.weighted_metrics(metrics.confusion(scored)).first()["unscored_rows"]
        assert unscored == holes.count() - holes.dropna().count()


@pytest.mark.parametrize("trainer", [models.boosted(models.Boosting(3, 0.3, 2)), models.boosted(models.Boosting(2, 0.3, 1), classes=2), models.tree(4)])
def test_models_survive_storage(spark, frame, tmp_path, trainer):
    model = trainer(frame)
    ms.save_model(model, f"{tmp_path}/m", spark)
    ms.score_batch(ms.load_model(spark, f"{tmp_path}/m"), frame, f"{tmp_path}/scores")
    direct = {(r["user"], int(r["prediction"])) for r in ms.predict(model, frame).collect()}
    assert set(map(tuple, ms.read_scores(spark, f"{tmp_path}/scores").collect())) == direct


def test_cross_validation_covers_all_folds(frame):
    folds = ms.cross_validate(frame, models.tree(3), folds=3)
    assert sorted(r["fold"] for r in folds.collect()) == [0, 1, 2]


def test_search_ranks_and_returns_the_leader(frame):
    board, leader, scored = ms.search_models(frame, {"deep": models.tree(8), "stump": models.tree(1)})
    rows = board.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2] and rows[0]["accuracy"] >= rows[1]["accuracy"]
    accuracy = metrics.weighted_metrics(metrics.confusion(scored)).first()["accuracy"]
    assert accuracy == pytest.approx(rows[0]["accuracy"])
    with pytest.raises(ValueError):
        ms.search_models(frame, {str(i): models.tree(1) for i in range(11)})


def test_candidates_are_compared_in_one_pass(frame, monkeypatch):
    test = materialise(frame.withColumn("recency", F.when(F.col("user") % 10 != 0, F.col("recency"))), "holes")
    fitted = {"tree": models.tree(3)(frame), "boosted": models.boosted(models.Boosting(2, 0.3, 1))(frame), "stump": models.tree(1)(frame)}
    written, one = [], ms.materialise
    monkeypatch.setattr(ms, "materialise", lambda df, label: written.append(df) or one(df, label))
    found = {r["model"]: r for r in ms.compare_models(fitted, test).collect()}
    (cells,) = written
    assert cells._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert set(found) == set(fitted)
    for name, model in fitted.items():
        alone = metrics.weighted_metrics(metrics.confusion(ms.predict(model, test))).first()
        assert all(found[name][m] == pytest.approx(alone[m]) for m in (*metrics.METRICS, "unscored_rows"))


def test_search_nests_boosted_candidates(frame):
    small = models.Boosting(2, 0.5, 2)
    candidates = {f"boosted_{i}": models.boosted(small) for i in range(3)} | {"tree": models.tree(3)}
    board, _, scored = ms.search_models(frame, candidates, parallelism=4)
    assert {r["model"] for r in board.collect()} == set(candidates) and scored.filter("prediction IS NULL").isEmpty()


def test_rates_that_are_not_above_zero_are_refused():
    assert models.TUNED.rate > 1
    for rate in (0.0, -1.0):
        with pytest.raises(ValueError):
            models.Boosting(3, rate, 2)


def test_a_tree_is_fitted_on_a_bounded_sample(frame):
    model = models.tree(3, most_rows=frame.count() // 2)(frame)
    assert ms.predict(model, frame).count() == frame.count()


def _few_of_their_kind(spark, rows, few):
    """Rows of class 0 with constant features, but for a few of class 1, which alone have another score and revenue."""
    alone = F.col("id") < few
    numbers = [F.lit(1.0).alias(c) for c in models.FEATURES if c not in ("revenue", "overall_score")]
    return spark.range(rows).select(
        F.col("id").alias("user"), alone.cast("double").alias("label"), (F.col("id") % 7 + F.when(alone, 50).otherwise(0)).cast("double").alias("revenue"),
        alone.cast("double").alias("overall_score"), *numbers,
    )


def test_a_tree_learns_from_every_row(spark):
    rows = materialise(_few_of_their_kind(spark, 1_100_000, 1), "one-of-its-kind")
    scored = ms.predict(models.tree(2)(rows), rows)
    assert scored.filter("label <> prediction").isEmpty()


def test_candidates_of_trees_take_thresholds_from_every_row(spark):
    rows = materialise(_few_of_their_kind(spark, 1_100_000, 5), "few-of-their-kind")
    trainers = {"forest": models.forest(10, 3), "tree_5": ms.default_candidates()["tree_5"]}
    for trainer in trainers.values():
        asked = {(node.feature, node.threshold) for tree in models.rules_of(trainer(rows)).trees for node in tree if node.feature >= 0}
        assert asked & {(models.FEATURES.index("overall_score"), 0.5), (models.FEATURES.index("revenue"), 6.0)}


def test_bins_end_with_a_quantile_of_all_rows(spark, frame):
    rows = models.trainable(frame)
    for measure, found in zip(models.MEASURES, models._splits(rows)):
        values = sorted(r[0] for r in rows.select(F.col(f"`{measure}`").cast("double")).collect())
        quantiles = {values[max(0, math.ceil(i * len(values) / models.TREE_BINS) - 1)] for i in range(1, models.TREE_BINS)}
        assert found == [-math.inf, *sorted(math.nextafter(x, math.inf) for x in quantiles), math.inf]


def test_no_transactions_and_no_window(spark, folder):
    raw = proxies.transactions(spark, folder)
    nothing = cs.segment_customers(raw.limit(0))
    assert nothing.collect() == [] and nothing.schema["recency_cluster"].dataType.simpleString() == "int"
    assert cs.label_lifetime_value(raw, 1900, 1901).collect() == []
    assert cs.segment_customers(raw.limit(0), cs.Settings(random_start=True)).collect() == []


def test_folders_with_two_orders_of_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("User,Year,Month,Day,Time,Amount,Is Fraud?,Errors?\n1,2016,1,2,06:30,$1,No,\n")
    (tmp_path / "b.csv").write_text("User,Month,Year,Day,Time,Amount,Errors?,Is Fraud?\n2,1,2016,2,06:30,$1,,Yes\n")
    with pytest.raises(Exception, match="header|CSV"):
        tables.read_csv(spark, str(tmp_path), schema.TRANSACTIONS).collect()
    rows = tables.read_csv(spark, str(tmp_path), schema.TRANSACTIONS, mixed_headers=True).orderBy("user").collect()
    assert [(r["year"], r["month"], r["is_fraud"]) for r in rows] == [(2016, 1, "No"), (2016, 1, "Yes")]


def test_year_range_picks_folders(spark, folder, tmp_path):
    path = f"{tmp_path}/by-year"
    tables.write_transactions(cleaning.clean_transactions(proxies.transactions(spark, folder)), path)
    picked = cleaning.within_years(spark.read.parquet(path), 1996, 1997)
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(year" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert {r["year"] for r in picked.select("year").distinct().collect()} == {1996, 1997}


def test_scratch_is_the_folder_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert scratch_root(spark) == named
    kept = materialise(spark.range(5), "kept")
    assert scratch_root(spark).removeprefix("file:") in kept.inputFiles()[0] and kept.count() == 5


def test_a_table_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert written_once(spark, f"{tmp_path}/once", build).count() == 3
    assert built == [1]


def test_zz_clear_scratch_removes_only_this_application(spark):
    kept = materialise(spark.range(5), "kept")
    assert kept.count() == 5 and clear_scratch(spark)
    assert not clear_scratch(spark)
