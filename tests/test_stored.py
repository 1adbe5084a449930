"""Stored tables that notice changes, the folded state, and rules beside the models they come from."""

import uuid

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tallyworth.checks import proxies
from tallyworth.checks import queries as registered
from tallyworth.functions.buckets import HASH_RANGE, key_hash
from tallyworth.operators import boosting, models
from tallyworth.plans import customer_features as cf
from tallyworth.plans import customer_segments as cs
from tallyworth.plans import incremental as inc
from tallyworth.plans import model_selection as ms
from tallyworth.session import materialise
from tallyworth.sources import inferred
from tallyworth.sources.bucketed import exchanges, write_bucketed
from tallyworth.sources.stored import fingerprint, stored


def test_a_stored_table_is_built_again_when_plan_or_input_change(spark, tmp_path):
    source, path = str(tmp_path / "source"), str(tmp_path / "stored")
    spark.range(10).write.parquet(source)

    def ask(condition="id >= 0"):
        rows, built = stored(spark.read.parquet(source).where(condition).select("id"), path)
        return rows.count(), built

    assert ask() == (10, True) and ask() == (10, False)
    assert ask("id >= 5") == (5, True) and ask("id >= 5") == (5, False) and ask() == (10, True)
    spark.range(3).write.mode("append").parquet(source)
    assert ask() == (13, True) and ask() == (13, False)
    assert len([p for p in (tmp_path / "stored").iterdir() if p.is_dir()]) == 1


def test_a_torn_table_is_seen(spark, tmp_path):
    path, rows = tmp_path / "stored", spark.range(40).repartition(4)
    assert stored(rows, str(path))[1] and not stored(rows, str(path))[1]
    (folder,) = (p for p in path.iterdir() if p.is_dir())
    part = next(folder.glob("part-*"))
    part.unlink()
    again, built = stored(rows, str(path))
    assert built and again.count() == 40
    (folder,) = (p for p in path.iterdir() if p.is_dir())
    next(folder.glob("part-*")).write_bytes(b"half")
    assert stored(rows, str(path))[1] and not stored(rows, str(path))[1]
    (path / "manifest.json").write_text("{")
    assert stored(rows, str(path))[1]
    (path / "manifest.json").unlink()
    assert stored(rows, str(path))[1] and stored(rows, str(path))[0].count() == 40


def test_fingerprints_tell_wide_plans_apart(spark):
    wide = spark.range(3).select(*(F.lit(i).alias(f"c{i}") for i in range(60)))
    other = spark.range(3).select(*(F.lit(i if i != 50 else -1).alias(f"c{i}") for i in range(60)))
    again = spark.range(3).select(*(F.lit(i).alias(f"c{i}") for i in range(60)))
    assert fingerprint(wide) == fingerprint(again) != fingerprint(other)


def test_tables_in_buckets_join_without_an_exchange(spark, folder, tmp_path):
    customers = materialise(cs.label_lifetime_value(proxies.transactions(spark, folder), 1996, 2000), "customers")
    plain = {"customers": customers, "users": proxies.indexed_users(spark, folder), "cards": proxies.cards(spark, folder)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, rows in plain.items():
            write_bucketed(rows, f"in_buckets_{name}", "index" if name == "users" else "user", 4, str(tmp_path / name))
            assert len(list((tmp_path / name).glob("part-*.parquet"))) <= 4
        found = cf.customer_features(*(spark.table(f"in_buckets_{name}") for name in plain))
        usual = cf.customer_features(*plain.values())
        assert exchanges(found) == 0 and exchanges(usual) > 0
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, usual.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in plain:
            spark.sql(f"DROP TABLE IF EXISTS in_buckets_{name}")


def test_types_are_the_narrowest_that_all_values_have(spark, tmp_path):
    columns = {
        "small": ["1", "-7", ""],
        "large": ["1", "30000000000", "2"],
        "real": ["1", "2.5", "1e3"],
        "flag": ["true", "FALSE", "true"],
        "day": ["2024-01-31", "", "1999-12-01"],
        "moment": ["2024-01-31", "2024-01-31 10:20", "2024-01-31T10:20:30.5"],
        "clock": ["06:30", "23:59", "00:00"],
        "zeros": ["007", "12", "3"],
        "no day": ["2024-02-30", "2024-01-01", "2024-01-02"],
        "mixed": ["1", "true", "x"],
        "empty": ["", "", ""],
    }
    lines = [",".join(columns), *(",".join(row) for row in zip(*columns.values())), "1,2", ",".join("x" * 20), "1,2"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    texts = inferred.read_texts(spark, str(tmp_path))
    found = {f.name: f.type for f in inferred.inferred(texts)}
    assert list(found.values()) == ["int", "bigint", "double", "boolean", "date", "timestamp", *["string"] * 5] and list(found) == list(columns)
    assert {(r["line"], r["times"]) for r in inferred.broken_lines(texts).collect()} == {("1,2", 2), (",".join("x" * 20), 1)}
    rows = inferred.typed(texts, inferred.inferred(texts))
    assert rows.count() == 3 and rows.agg(F.sum("large")).first()[0] == 30000000003
    (tmp_path / "b.csv").write_text("other,header\n1,2\n")
    with pytest.raises(Exception, match="header|CSV"):
        inferred.read_texts(spark, str(tmp_path)).collect()


def test_state_in_any_order_of_parts(spark, folder):
    raw = proxies.transactions(spark, folder)
    whole = sorted(map(tuple, inc.customer_state(raw, 1996, 2000).collect()))
    parts = [inc.customer_state(raw.where(F.col("row_id") % 4 == i), 1996, 2000) for i in range(4)]
    left = inc.folded(inc.folded(parts[0], parts[1]), inc.folded(parts[2], parts[3]))
    right = inc.folded(parts[3], inc.folded(parts[2], inc.folded(parts[1], parts[0])))
    assert left.dtypes == parts[0].dtypes
    assert sorted(map(tuple, left.collect())) == whole == sorted(map(tuple, right.collect()))
    nothing = inc.customer_state(raw.limit(0), 1996, 2000)
    assert sorted(map(tuple, inc.folded(nothing, inc.folded(parts[0], nothing)).collect())) == sorted(map(tuple, parts[0].collect()))


def test_centres_begin_from_the_last_fit(spark, folder):
    raw = proxies.transactions(spark, folder)
    state = materialise(inc.customer_state(raw, 1996, 2000), "state")
    labelled, fits = inc.label_state(state)
    assert sorted(map(tuple, labelled.collect()), key=repr) == sorted(map(tuple, cs.label_lifetime_value(raw, 1996, 2000).select(*labelled.columns).collect()), key=repr)
    _, again = inc.label_state(state, begin=fits)
    assert all(again[a].centres == pytest.approx(fits[a].centres, rel=1e-2) for a in fits)
    assert all(again[a].rounds <= fits[a].rounds for a in fits)


@pytest.fixture(scope="module")
def frame(spark, folder):
    return materialise(registered._frame(spark, folder), "frame")


WALK = """
WITH RECURSIVE walk AS (
    SELECT "user", tree, 0 AS node FROM (SELECT DISTINCT "user" FROM inputs), (SELECT DISTINCT tree FROM rules WHERE kind = 'tree')
    UNION ALL
    SELECT w."user", w.tree, CASE WHEN (i.value - r.shift) * r.factor <= r.threshold THEN r.low ELSE r.high END
    FROM walk w JOIN rules r ON r.tree = w.tree AND r.node = w.node AND r.feature IS NOT NULL
    JOIN inputs i ON i."user" = w."user" AND i.feature = r.feature),
ends AS (SELECT "user", w.tree, class_values FROM walk w JOIN rules r ON r.tree = w.tree AND r.node = w.node AND r.feature IS NULL),
added AS (
    SELECT "user", k, list_reduce(list_prepend(0.0::DOUBLE, list(class_values[k + 1] ORDER BY tree)), lambda x, y: x + y) AS s
    FROM ends, (SELECT unnest([0, 1, 2]) AS k) GROUP BY "user", k
    UNION ALL
    SELECT i."user", k, sum((i.value - r.shift) * r.factor * r.class_values[k + 1]) + any_value(b.class_values[k + 1])
    FROM inputs i JOIN rules r ON r.feature = i.feature AND r.kind = 'weight', rules b, (SELECT unnest([0, 1, 2]) AS k)
    WHERE b.kind = 'intercept' GROUP BY i."user", k)
SELECT "user", arg_min(k, (-s, k)) AS class FROM added GROUP BY "user" """

TRAINERS = {
    "boosted": models.boosted(boosting.Boosting(4, 1.34, 5, 0.6, 0.65, 2)),
    "tree": models.tree(30),
    "forest": models.forest(7, 6),
    "logistic": models.logistic(max_iter=20),
}


@pytest.mark.parametrize("name", list(TRAINERS))
def test_published_rules_give_the_classes_of_the_model(spark, frame, tmp_path, name):
    model = TRAINERS[name](frame)
    rules = models.rules_of(model)
    scored = models.trainable(frame).select("user", rules.prediction().cast("int").alias("class"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "UDF" not in plan and "vector" not in plan.lower()
    found = {r["user"]: r["class"] for r in scored.collect()}
    assert found == {r["user"]: int(r["prediction"]) for r in ms.predict(model, models.trainable(frame)).collect()}
    rules.table(spark).coalesce(1).write.parquet(str(tmp_path / "rules"))
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in models.FEATURES)))
    models.trainable(frame).select("user", values.alias("v")).select("user", "v.*").coalesce(1).write.parquet(str(tmp_path / "inputs"))
    con = duckdb.connect()
    for table in ("rules", "inputs"):
        (file,) = (tmp_path / table).glob("part-*.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{file}'")
    assert dict(con.execute(WALK).fetchall()) == found


def plain_first_splits(rows, settings, classes=3):
    """The root of the first tree of each class, from all rows and all thresholds in plain Python."""
    out = []
    for k in range(classes):
        slopes = [(1 / classes - (y == k), 2 / classes * (1 - 1 / classes)) for _, y in rows]
        whole = [sum(s[i] for s in slopes) for i in (0, 1)]
        best = (1e-6, None, None)
        for f in range(len(rows[0][0])):
            for cut in sorted({x[f] for x, _ in rows})[:-1]:
                left = [sum(s[i] for s, (x, _) in zip(slopes, rows) if x[f] <= cut) for i in (0, 1)]
                right = [w - a for w, a in zip(whole, left)]
                if min(left[1], right[1]) < settings.least_weight:
                    continue
                gain = sum(g * g / (h + 1) for g, h in (left, right)) - whole[0] ** 2 / (whole[1] + 1)
                if gain > best[0] + 1e-6:
                    best = (gain, f, cut, left, right)
        out.append(best)
    return out


def test_first_splits_and_leaves_equal_plain_python(spark):
    import random

    rng = random.Random(3)
    data = [((rng.randint(0, 9), rng.random(), rng.choice([0, 1])), rng.choice([0, 1, 2])) for _ in range(150)]
    data = [(x, 2 if x[1] > 0.7 else 1 if x[0] > 6 else y) for x, y in data]
    settings = boosting.Boosting(1, 1.5, 1, least_weight=4)
    names = ["a", "b b", "c"]
    rows = spark.createDataFrame([(0, i, y, *map(float, x)) for i, (x, y) in enumerate(data)], "model int, user long, label int, a double, `b b` double, c double")
    (trees,) = boosting.fit(rows.repartition(5), names, 3, settings)
    for k, (_, feature, cut, left, right) in enumerate(plain_first_splits(data, settings)):
        root, low, high = trees[0][k]
        assert (root["feature"], root["threshold"]) == (names[feature], cut)
        assert low["value"] == pytest.approx(-left[0] / (left[1] + 1) * 1.5, abs=1e-6)
        assert high["value"] == pytest.approx(-right[0] / (right[1] + 1) * 1.5, abs=1e-6)


def test_trees_do_not_depend_on_partitions_and_empty_models_are_roots(spark, frame):
    settings = boosting.Boosting(3, 0.4, 3, 0.7, 0.5, 2)
    rows = models.trainable(frame).withColumn("model", F.lit(1))
    one = boosting.fit(rows.repartition(1), models.FEATURES, 3, settings, 2)
    many = boosting.fit(rows.repartition(7, "revenue"), models.FEATURES, 3, settings, 2)
    assert one == many
    assert all(len(tree) == 1 and tree[0]["value"] == 0.0 for round_ in one[0] for tree in round_)


def jobs(spark, work):
    """What `work` returns, and how many jobs it takes."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, "counted")
    try:
        return work(), len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("folds", [1, 4])
def test_a_round_of_few_rows_is_one_job_and_equals_passes_by_level(spark, frame, monkeypatch, folds):
    own = F.array(*(F.lit(i) for i in range(folds)))
    rows = materialise(models.trainable(frame).withColumn("model", F.explode(own)).where((F.col("user") % 4 != F.col("model")) | (folds == 1)), "rows")
    settings = boosting.Boosting(4, 0.4, 18, 0.7, 0.5, 2)
    few, taken = jobs(spark, lambda: boosting.fit(rows, models.FEATURES, 3, settings, folds))
    assert taken < 2 * settings.rounds
    monkeypatch.setattr(boosting, "TASK_ROWS", 40)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 15)
    passes, one_level = [], boosting._level
    monkeypatch.setattr(boosting, "_level", lambda state, *a: passes.append((state.getNumPartitions(), one_level(state, *a))) or passes[-1][1])
    assert boosting.fit(rows, models.FEATURES, 3, settings, folds) == few
    assert all(1 < tasks <= -(-rows.count() // 40) for tasks, _ in passes)
    assert all(len(found) <= folds * 3 << 3 for _, found in passes)  # one row a node comes back, not one a bin


@pytest.mark.parametrize("folds", [1, 3])
def test_more_rounds_of_few_rows_take_no_more_jobs(spark, frame, folds):
    own = F.array(*(F.lit(i) for i in range(folds)))
    rows = materialise(models.trainable(frame).withColumn("model", F.explode(own)), "rows")
    taken = [jobs(spark, lambda n=n: boosting.fit(rows, models.FEATURES, 3, boosting.Boosting(3, 0.4, n, 0.7), folds))[1] for n in (1, 12)]
    assert taken[0] == taken[1]


def test_several_larger_models_keep_a_task_each_up_to_a_bound(spark, frame, monkeypatch):
    folds = spark.sparkContext.defaultParallelism
    rows = models.trainable(frame).withColumn("model", F.explode(F.array(*(F.lit(i) for i in range(folds)))))
    rows = materialise(rows.where((F.col("user") % folds != F.col("model"))), "rows")
    monkeypatch.setattr(boosting, "TASK_ROWS", 40)
    passes, one_level, found = [], boosting._level, []
    monkeypatch.setattr(boosting, "_level", lambda *a: passes.append(1) or one_level(*a))
    for bound in (1_000, 50):  # the second is less than a model has
        monkeypatch.setattr(boosting, "MODEL_ROWS", bound)
        found.append((boosting.fit(rows, models.FEATURES, 3, boosting.Boosting(3, 0.4, 3, 0.7), folds), len(passes)))
    assert found[0][0] == found[1][0] and found[0][1] == 0 < found[1][1]


def test_a_user_is_hashed_once_for_all_models(monkeypatch):
    settings, hashed, one = boosting.Boosting(2, 0.1, 2, rows_share=0.5), [], boosting._drawn
    monkeypatch.setattr(boosting, "_drawn", lambda users, s: hashed.append(users.nunique()) or one(users, s))
    rows = pd.DataFrame({"model": [0, 1, 2] * 40, "user": [str(i // 3) for i in range(120)], "label": 0, "x0": np.arange(120.0)})
    borders = [[np.array([30.0, 60.0])]] * 3
    (packed,) = boosting._packed([rows], borders, settings, True)
    assert hashed == [40] and packed["rows"].tolist() == [40, 40, 40]
    for i, block in packed.iterrows():
        own = rows[rows["model"] == i]
        assert block["drawn"] == one(own["user"], settings).tobytes()
        assert block["bins"] == np.searchsorted(borders[i][0], own["x0"]).astype(np.uint8).tobytes()


def test_draws_equal_the_hash_of_the_key(spark):
    users = spark.range(500).selectExpr("id AS user")
    settings = boosting.Boosting(2, 0.1, 11, rows_share=0.3)
    found = np.unpackbits(boosting._drawn(pd.Series([str(i) for i in range(500)]), settings), axis=0)
    for round_ in (0, 7, 8, 10):
        expected = users.orderBy("user").select(key_hash("user", f"42:{round_}") < int(0.3 * HASH_RANGE)).collect()
        assert found[round_].astype(bool).tolist() == [r[0] for r in expected]


def test_boosted_predictions_equal_the_rules(spark, frame):
    model = models.boosted(boosting.Boosting(4, 1.34, 6, 0.6, 0.65, 2))(frame)
    gaps = frame.withColumn("recency", F.when(F.col("user") % 5 > 0, F.col("recency")))
    both = gaps.select(boosting.prediction(model.trees, models.FEATURES, 3).alias("a"), model.rules.prediction().alias("b")).collect()
    assert [r["a"] for r in both] == [r["b"] for r in both]
    assert {None, 0.0, 1.0} <= {r["a"] for r in both}
