import datetime as dt
import random
import statistics
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyworth import schema
from tallyworth.operators import (
    activity,
    cards,
    cleaning,
    correlation,
    encoding,
    joins,
    metrics,
    quantiles,
    row_index,
    sampling,
    scoring,
    significance,
    splits,
    summaries,
)

TX = "user bigint, year int, month int, day int, time string, amount string, is_fraud string, errors string"


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (1, 2015, 1, 5, "10:00", "$10.50", "No", None),
        (1, 2016, 2, 30, "10:00", "$1.00", "No", None),  # no such day
        (1, 2016, 3, 1, "9:30", "$-4.25", "No", None),  # refund
        (2, 2017, 12, 31, "23:59", "$1,000.00", "Yes", "Bad PIN"),  # fraudulent and failed
        (2, 2012, 6, 1, "00:00", "", "No", "Bad PIN"),
        (3, 2017, 6, 1, "00:00", "$7", None, None),  # in none of the three
        (4, 2016, 13, 1, "00:00", "$9", "No", None),  # no such month
        (None, 2018, 1, 1, "00:00", "$1", "No", None),
    ]
    return spark.createDataFrame(rows, TX)


def test_rejected_counts(raw):
    assert tuple(cleaning.rejected_counts(raw).first()) == (8, 1, 2, 2)


def test_split_obeys_inclusion_and_exclusion(raw):
    clean = cleaning.clean_transactions(raw)
    kinds = [f(clean).count() for f in (cleaning.valid_transactions, cleaning.fraudulent_transactions, cleaning.failed_transactions)]
    summary = {tuple(r)[:3]: r["transactions"] for r in cleaning.split_summary(clean).collect()}
    assert kinds == [5, 1, 2]
    assert summary == {(True, False, False): 5, (False, True, True): 1, (False, False, True): 1, (False, False, False): 1}
    assert sum(kinds) - summary[False, True, True] + summary[False, False, False] == clean.count()


def test_activity(raw):
    clean = cleaning.clean_transactions(raw)
    got = {r["user"]: (r["recency"], r["frequency"], r["revenue"]) for r in activity.rfm(clean).collect()}
    assert got == {
        1: ((dt.date(2017, 12, 31) - dt.date(2016, 3, 1)).days, 3, Decimal("7.25")),
        2: (0, 2, Decimal("1000.00")),
        3: ((dt.date(2017, 12, 31) - dt.date(2017, 6, 1)).days, 1, Decimal("7.00")),
        4: (None, 1, Decimal("9.00")),
    }
    separate = [activity.recency(clean), activity.frequency(clean), activity.revenue(clean)]
    joined = separate[0].join(separate[1], "user").join(separate[2], "user")
    assert {r["user"]: (r["recency"], r["frequency"], r["revenue"]) for r in joined.collect()} == got


def test_window_revenue_is_the_conditional_sum(raw):
    clean = cleaning.clean_transactions(raw)
    alone = {tuple(r) for r in activity.timeframe_revenue(clean, 2015, 2016).collect()}
    folded = activity.user_activity(clean, (2015, 2016)).filter("window_transactions > 0")
    assert alone == {(1, Decimal("6.25"))}
    assert {(r["user"], r["window_revenue"]) for r in folded.collect()} == alone


def test_year_range_reaches_the_scan(spark, raw, tmp_path):
    from tallyworth.sources.tables import write_transactions

    write_transactions(cleaning.clean_transactions(raw), f"{tmp_path}/tx")
    rows = cleaning.within_years(spark.read.parquet(f"{tmp_path}/tx"), 2016, 2017)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "2016" in plan
    assert {r["year"] for r in rows.collect()} == {2016, 2017}


def test_join_keeps_every_transaction_of_a_known_user(spark):
    facts = spark.createDataFrame([(7, i) for i in range(500)] + [(i, i) for i in range(20)] + [(None, 1)], "user bigint, row bigint")
    users = spark.createDataFrame([(i, i * 10) for i in range(15)], "user bigint, x bigint")
    joined = joins.transactions_with_users(facts, users)
    assert Counter(r["user"] for r in joined.collect()) == Counter([7] * 500 + list(range(15)))
    twice = joins.transactions_with_users(facts, spark.createDataFrame([(3, 1), (3, 2)], "user bigint, x int"))
    assert twice.count() == 2


def test_natural_join_needs_a_shared_column(spark):
    left = spark.createDataFrame([(1, 2, 3), (1, 5, 4)], "a int, b int, c int")
    right = spark.createDataFrame([(1, 2, 9)], "a int, b int, d int")
    assert [tuple(r) for r in joins.natural_join(left, right).collect()] == [(1, 2, 3, 9)]
    with pytest.raises(ValueError):
        joins.natural_join(left, right.select("d"))


@pytest.mark.parametrize("partitions", [1, 8])
def test_row_index_is_contiguous(spark, partitions):
    rows = spark.range(1000).select((F.col("id") * 7 % 1009).alias("key")).repartition(partitions)
    got = [tuple(r) for r in row_index.add_row_index(rows, "key", partitions=5).orderBy("key").collect()]
    assert [i for _, i in got] == list(range(1000)) and [k for k, _ in got] == sorted(k for k, _ in got)


def test_cards(spark):
    rows = [
        (1, 10, "Visa", "Credit", "YES", 2, "$1,000", "No"),
        (1, 11, "Amex", "Debit (Prepaid)", "NO", 1, "$2,000", "Yes"),
        (1, 12, "Visa", "Credit", "YES", None, "", None),
        (2, 13, None, "Debit", "NO", 1, "", "No"),
        (None, 14, "Visa", "Credit", "YES", 1, "$5", "No"),
    ]
    frame = spark.createDataFrame(rows, [f.name for f in schema.CARDS])
    got = {r["user"]: r.asDict() for r in cards.card_features(frame).collect()}
    assert set(got) == {1, 2}
    assert got[1] == {
        "user": 1, "total_cards": 3, "total_cards_with_chips": 2, "total_cards_issued": 3, "average_credit_limit": 1500.0,
        "cards_on_dark_web": 1, "amex": 1, "discover": 0, "mastercard": 0, "visa": 1, "credit": 1, "debit": 0, "debit_prepaid": 1,
    }
    assert got[2]["average_credit_limit"] is None and got[2]["visa"] == 0
    lists = {r["user"]: (r["card_brands"], r["card_types"]) for r in cards.card_lists(frame).collect()}
    assert lists == {1: (["Amex", "Visa"], ["Credit", "Debit (Prepaid)"]), 2: ([], ["Debit"])}


@pytest.mark.parametrize("rows, partitions", [(10, 1), (10, 7), (5000, 4)])
def test_sample_is_exact_and_repeatable(spark, rows, partitions):
    data = spark.range(3000).repartition(partitions)
    drawn = [r["id"] for r in sampling.sample_rows(data, "id", rows, 5).collect()]
    again = [r["id"] for r in sampling.sample_rows(spark.range(3000), "id", rows, 5).collect()]
    assert len(set(drawn)) == min(rows, 3000) and set(drawn) == set(again)


def _quantile(values, p):
    place = (len(values) - 1) * p
    low = int(place)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (place - low)


@pytest.mark.parametrize("kind", ["spread", "copies", "few"])
def test_quantiles_by_brute_force(spark, kind):
    draw = random.Random(3)
    groups = defaultdict(list)
    for _ in range(4000):
        group = "big" if draw.random() < 0.9 else draw.choice("abc")
        value = {"spread": draw.lognormvariate(0, 3), "copies": 5.0 if draw.random() < 0.4 else draw.gauss(0, 9),
                 "few": float(draw.randint(1, 4))}[kind]
        groups[group].append(value)
    rows = [(g, v) for g, values in groups.items() for v in values] + [("big", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    out = {r["g"]: r.asDict() for r in summaries.describe_by_group(frame, "g", "v").collect()}
    for group, values in groups.items():
        values.sort()
        found = out[group]
        assert found["count"] == len(values) and found["min"] == values[0] and found["max"] == values[-1]
        assert found["mean"] == pytest.approx(statistics.fmean(values))
        assert found["std"] == pytest.approx(statistics.stdev(values))
        for name, p in summaries.QUARTILES.items():
            assert found[name] == pytest.approx(_quantile(values, p), rel=1e-12)
    near = summaries.describe_by_group(frame, "g", "v", exact=False)
    assert set(near.columns) == set(next(iter(out.values())))


@pytest.mark.parametrize(
    "values",
    [
        [1.0] * 3000 + [2.0] * 3000,
        [7.0] * 5000,
        [i / 1000 for i in range(3000)] + [1e9 + i for i in range(3000)],
        [2.0**-i for i in range(900)] * 7,
        [0.0] * 2999 + [1.0] * 3001 + [-1e300, 1e300],
    ],
    ids=["two heavy", "one", "two far clusters", "ever smaller", "heavy middle"],
)
def test_quantile_passes_end(spark, monkeypatch, values):
    passes = []
    plain = quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda *a: passes.append(1) or plain(*a))
    frame = spark.createDataFrame([("a", v) for v in values] + [(None, v) for v in values[::2]], "g string, v double").repartition(5)
    asked = {"low": 0.25, "middle": 0.5, "high": 0.9}
    found = {r["g"]: r for r in quantiles.quantiles(frame, ["g"], "v", asked, most_rows=5).collect()}
    assert len(passes) <= 4
    for group, own in (("a", values), (None, values[::2])):
        for name, p in asked.items():
            assert found[group][name] == pytest.approx(_quantile(sorted(own), p), rel=1e-12)


@pytest.mark.parametrize("kind", ["spread", "copies"])
@pytest.mark.parametrize("most_rows", [200_000, 40, 3])
def test_quantiles_do_not_depend_on_the_rows_a_task_may_sort(spark, kind, most_rows):
    draw = random.Random(8)
    values = [5.0 if kind == "copies" and i % 3 else round(draw.lognormvariate(2, 2), 4) for i in range(60000)]
    frame = spark.createDataFrame([("big" if i % 50 else "small", v) for i, v in enumerate(values)], "g string, v double")
    probabilities = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    found = {r["g"]: r for r in quantiles.quantiles(frame.repartition(6), ["g"], "v", probabilities, most_rows=most_rows).collect()}
    for group in ("big", "small"):
        own = sorted(v for i, v in enumerate(values) if ("big" if i % 50 else "small") == group)
        for name, p in probabilities.items():
            assert found[group][name] == pytest.approx(_quantile(own, p), rel=1e-12)


def test_crosstab_finds_values_itself(spark):
    frame = spark.createDataFrame([("x", 0), ("x", 1), ("y", 1), ("y", None), (None, 1)], "a string, b int")
    assert sorted(map(tuple, summaries.crosstab(frame, "a", "b").collect())) == [("x", 1, 1), ("y", 0, 1)]


def test_standardise(spark):
    frame = spark.createDataFrame([(1.0, 5), (2.0, 5), (3.0, 5), (None, 5)], "a double, b int")
    got = [tuple(r) for r in encoding.standardise(frame, ["a", "b"]).collect()]
    spread = statistics.pstdev([1, 2, 3])
    assert got == [(pytest.approx(-1 / spread), 0), (0, 0), (pytest.approx(1 / spread), 0), (None, 0)]


def test_one_hot(spark):
    frame = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "s string")
    out = encoding.one_hot(frame, "s")
    assert out.columns == ["s_a", "s_b"] and [tuple(r) for r in out.collect()] == [(0, 1), (1, 0), (0, 0), (0, 1)]
    known = encoding.one_hot(frame.dropna(), "s", ["c", "b", "a"])
    assert {sum(r) for r in known.collect()} == {1} and known.columns == ["s_a", "s_b", "s_c"]


def test_correlation(spark):
    draw = random.Random(4)
    rows = [(x, 2 * x + draw.gauss(0, 1), 7.0, None if i % 5 == 0 else draw.gauss(0, 1) + 1e6) for i, x in enumerate(draw.choices(range(40), k=200))]
    frame = spark.createDataFrame([(float(a), b, c, d) for a, b, c, d in rows], "a double, b double, c double, d double")
    found = {(r["a"], r["b"]): r["r"] for r in correlation.correlation_matrix(frame).collect()}
    assert len(found) == 16 and all(found["c", x] is None and found[x, "c"] is None for x in "abcd")
    assert found["a", "a"] == pytest.approx(1) and found["a", "b"] == found["b", "a"]
    assert found["a", "b"] == pytest.approx(statistics.correlation([r[0] for r in rows], [r[1] for r in rows]))
    both = [(r[0], r[3]) for r in rows if r[3] is not None]
    assert found["a", "d"] == pytest.approx(statistics.correlation(*zip(*both)))
    target = [(r["variable"], r["r"]) for r in correlation.target_correlation(frame, "a").collect()]
    assert target[0] == ("a", pytest.approx(1)) and target[-1] == ("c", None)


def test_correlation_sums_inside_the_jvm(spark):
    frame = spark.range(50).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id * id AS DOUBLE) AS b", "IF(id % 7 = 0, NULL, CAST(id % 5 AS DOUBLE)) AS c", "IF(id = 3, CAST('NaN' AS DOUBLE), CAST(id AS DOUBLE)) AS d")
    x = frame.selectExpr("a AS x0", "b AS x1", "c AS x2")
    sums = correlation._sums(x, [True, True, False])
    assert len([n for n in sums if n.startswith("rows")]) == 2 and sums["rows&2"] == 42 and sums["x0|2"] == sum(i for i in range(50) if i % 7)
    found = {(r["a"], r["b"]): r["r"] for r in correlation.correlation_matrix(frame).collect()}
    assert found["a", "d"] == pytest.approx(1.0) and found["b", "a"] == found["a", "b"]


def test_correlation_of_large_and_of_empty_columns(spark):
    rows = [(1e15 + i, float(i % 7), 1e15, None) for i in range(100)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double")
    found = {(r["a"], r["b"]): r["r"] for r in correlation.correlation_matrix(frame.repartition(5)).collect()}
    assert found["a", "b"] == pytest.approx(statistics.correlation([r[0] - 1e15 for r in rows], [r[1] for r in rows]))
    assert all(found[c, x] is None for c in "cd" for x in "abcd")
    assert {r["r"] for r in correlation.correlation_matrix(frame.limit(0)).collect()} == {None}


def _f_statistic(groups):
    everything = [x for g in groups for x in g]
    grand = statistics.fmean(everything)
    between = sum(len(g) * (statistics.fmean(g) - grand) ** 2 for g in groups) / (len(groups) - 1)
    within = sum((x - statistics.fmean(g)) ** 2 for g in groups for x in g) / (len(everything) - len(groups))
    return between / within


@pytest.mark.parametrize("classes", [2, 3, 5])
def test_anova(spark, classes):
    draw = random.Random(classes)
    rows = [(i % classes, draw.gauss(i % classes, 3), 4.0, float(i % classes), None) for i in range(120)]
    frame = spark.createDataFrame(rows, "label int, x double, constant double, same double, missing double")
    tests = significance.anova_tests(frame, "label", ["x", "constant", "same", "missing"], 3 if classes == 3 else None)
    found = {r["variable"]: r for r in tests.collect()}
    f = _f_statistic([[r[1] for r in rows if r[0] == c] for c in range(classes)])
    assert found["x"]["statistic"] == pytest.approx(f)
    general = significance.anova_tests(frame, "label", ["x"]).first()["p_value"]
    assert found["x"]["p_value"] == pytest.approx(general, rel=1e-9)
    assert found["constant"]["p_value"] is None and found["same"]["p_value"] == 0.0
    assert "missing" not in found


def test_anova_with_wrong_class_count_fails(spark):
    frame = spark.createDataFrame([(i % 2, float(i)) for i in range(10)], "label int, x double")
    with pytest.raises(Exception, match="another number of classes"):
        significance.anova_tests(frame, "label", ["x"], classes=3).collect()


def _chi_square(pairs):
    cells, rows, columns = Counter(pairs), Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    expected = {(a, b): rows[a] * columns[b] / len(pairs) for a in rows for b in columns}
    half = (len(rows) - 1) * (len(columns) - 1) == 1
    return sum((abs(cells[k] - e) - (min(0.5, abs(cells[k] - e)) if half else 0)) ** 2 / e for k, e in expected.items())


@pytest.mark.parametrize("values, classes", [(2, 2), (2, 3), (5, 3), (4, 4)])
def test_chi_square(spark, values, classes):
    draw = random.Random(values * 10 + classes)
    pairs = [(draw.randrange(values), draw.randrange(classes)) for _ in range(150)]
    frame = spark.createDataFrame([(a, b, 1) for a, b in pairs], "x int, label int, one int")
    found = {r["variable"]: r for r in significance.chi_square_tests(frame, "label", ["x", "one"]).collect()}
    assert found["x"]["statistic"] == pytest.approx(_chi_square(pairs), abs=1e-9)
    assert (found["one"]["statistic"], found["one"]["p_value"]) == (0.0, 1.0)
    if classes == 3:
        closed = significance.chi_square_tests(frame, "label", ["x"], classes=3).first()
        assert closed["p_value"] == pytest.approx(found["x"]["p_value"], rel=1e-9)


def test_select_features_lists_each_column_once(spark):
    rows = [(i, i % 3, float(i % 3 + (i % 7) / 10), float(i % 11), 5.0) for i in range(200)]
    frame = spark.createDataFrame(rows, "user int, label int, good double, noise double, fixed double")
    tests = significance.feature_tests(frame, "label", ["good", "noise", "fixed"], ["fixed"])
    flags = {(r["variable"], r["test_used"]): r["significance"] for r in tests.collect()}
    assert flags["good", "ANOVA"] == "Significant" and flags["fixed", "ANOVA"] == "Not Significant"
    assert significance.select_features(frame, tests, "label", ["good", "fixed"]).columns == ["user", "label", "good", "fixed"]


@pytest.mark.parametrize("partitions", [1, 8])
def test_folds_are_balanced_in_every_class(spark, partitions):
    frame = spark.range(5003).select(F.col("id").alias("user"), (F.col("id") % 7 % 3).alias("label")).repartition(partitions)
    out = splits.stratified_folds(frame, "label", "user", 5).collect()
    assert len({r["user"] for r in out}) == 5003
    sizes = Counter((r["label"], r["fold"]) for r in out)
    for label in range(3):
        of_label = [sizes[label, f] for f in range(5)]
        assert max(of_label) - min(of_label) <= 1
    again = splits.stratified_folds(frame.repartition(3), "label", "user", 5).collect()
    assert set(map(tuple, again)) == set(map(tuple, out))


def test_holdout_parts_are_disjoint_and_complete(spark):
    rest, held = splits.holdout_split(spark.range(10000).withColumnRenamed("id", "user"), "user", 0.05)
    assert rest.count() + held.count() == 10000 and 400 < held.count() < 600 and rest.intersect(held).isEmpty()


def test_metrics(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 1)] * 4 + [(2, 0)]
    cells = metrics.confusion(spark.createDataFrame(pairs, "label int, prediction int"))
    report = {r["class"]: r.asDict() for r in metrics.classification_report(cells).collect()}
    assert report["2"]["precision"] == 0 and report["2"]["recall"] == 0 and report["2"]["f1_score"] == 0
    assert report["0"]["precision"] == pytest.approx(5 / 6) and report["0"]["recall"] == pytest.approx(5 / 7)
    assert report["1"]["f1_score"] == pytest.approx(2 * 3 / (9 + 3)) and report["1"]["support"] == 3
    assert report["accuracy"]["f1_score"] == pytest.approx(8 / 15) and report["accuracy"]["support"] == 15
    assert report["macro avg"]["recall"] == pytest.approx((5 / 7 + 1 + 0) / 3)
    weighted = metrics.weighted_metrics(cells).first()
    assert weighted["recall"] == pytest.approx(weighted["accuracy"], abs=1e-12)
    assert weighted["precision"] == pytest.approx((7 * 5 / 6 + 3 * 3 / 9) / 15)


def test_rows_without_a_prediction_are_counted(spark):
    cells = metrics.confusion(spark.createDataFrame([(0, 0), (1, None), (None, 1), (1, 1)], "label int, prediction int"))
    found = metrics.weighted_metrics(cells).first()
    assert found["unscored_rows"] == 2 and found["accuracy"] == 1.0
    by = metrics.weighted_metrics(cells.withColumn("fold", F.coalesce("label", F.lit(5))), ["fold"]).collect()
    assert {r["fold"]: r["unscored_rows"] for r in by} == {0: 0, 1: 1, 5: 1}


def test_scoring_keeps_null_scores(spark):
    frame = spark.createDataFrame([(5, 5, 5), (0, 1, 2), (None, 1, 1)], "recency_cluster int, frequency_cluster int, revenue_cluster int")
    got = [(r["overall_score"], r["segment"]) for r in scoring.with_segment(scoring.overall_score(frame)).collect()]
    assert got == [(15, "High-Value"), (3, "Low-Value"), (None, None)]
