"""One registered query per operator, each over whole tables, with its SQL where the result has one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworth import schema
from tallyworth.checks import proxies
from tallyworth.checks.proxies import END_YEAR, START_YEAR
from tallyworth.checks import sql as tables_of
from tallyworth.checks.sql import build
from tallyworth.functions import money
from tallyworth.functions.segments import SEGMENTS
from tallyworth.operators import (
    activity,
    cards,
    cleaning,
    clusters,
    correlation,
    encoding,
    joins,
    metrics,
    models,
    sampling,
    scoring,
    significance,
    splits,
    summaries,
)
from tallyworth.plans import customer_features as cf
from tallyworth.plans import customer_segments as cs
from tallyworth.plans import incremental as inc
from tallyworth.plans import model_selection as ms
from tallyworth.session import materialise, scratch_path, written_once
from tallyworth.sources import inferred, tables
from tallyworth.sources.bucketed import write_bucketed
from tallyworth.sources.stored import stored

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

def query(sql: str | None = None, *needed: str):
    """Register a query under its function's name."""

    def register(function: Query) -> Query:
        name = function.__name__
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = build(sql, *needed)
        return function

    return register


def _d(column: str) -> Column:
    """As double, so that both engines hand back the same type."""
    return F.col(column).cast("double").alias(column)


def _r(column: str, digits: int) -> Column:
    return F.round(F.col(column).cast("double"), digits).alias(column)


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_transactions(proxies.transactions(spark, folder))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return cs.segment_customers(proxies.transactions(spark, folder))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return cs.label_lifetime_value(proxies.transactions(spark, folder), START_YEAR, END_YEAR)


def _features(spark: SparkSession, folder: str) -> DataFrame:
    users, owned = proxies.indexed_users(spark, folder), proxies.cards(spark, folder)
    return cf.customer_features(_labelled(spark, folder), users, owned)


# ---- sources and sinks ----


_RAW = """usr AS "user", yr AS year, mon AS month, dy AS day, substr(tm, 1, 5) AS time,
    '$' || CAST(amount AS VARCHAR) AS amount, is_fraud, errors"""


@query(f"SELECT {_RAW} FROM tx", "tx")
def scan_transactions(spark, folder):
    """Even users lie in files with one order of columns, odd ones in files with another."""
    path = scratch_path(spark, "transactions-csv")
    rows = proxies.transactions(spark, folder)
    tables.write_csv(rows.filter("user % 2 = 0"), f"{path}/even", schema.TRANSACTIONS)
    tables.write_csv(rows.filter("user % 2 = 1"), f"{path}/odd", schema.TRANSACTIONS[::-1])
    return tables.read_csv(spark, f"{path}/*", schema.TRANSACTIONS, mixed_headers=True)


@query(
    """SELECT usr AS "user", CAST(revenue AS DOUBLE) AS revenue, recency, frequency, recency_cluster,
    frequency_cluster, revenue_cluster, overall_score, segment FROM scored""",
    "scored",
)
def write_segments(spark, folder):
    path = scratch_path(spark, "segments-csv")
    tables.write_csv(_scored(spark, folder), path, schema.SEGMENTS)
    back = tables.read_csv(spark, path, schema.SEGMENTS)
    return back.withColumn("revenue", _d("revenue"))


_LTV = """usr AS "user", CAST(window_revenue AS DOUBLE) AS window_revenue, CAST(revenue AS DOUBLE) AS revenue, recency,
    frequency, recency_cluster, frequency_cluster, revenue_cluster, overall_score, segment, ltv_cluster"""


@query(f"SELECT {_LTV} FROM ltv", "ltv")
def write_lifetime_value_table(spark, folder):
    path = scratch_path(spark, "lifetime-value")
    name = "lifetime_value_" + path.rsplit("-", 1)[1]
    published = _labelled(spark, folder).select(
        [F.col(f.name).alias(f.published.replace(" ", "_")) for f in schema.LIFETIME_VALUE]
    )
    tables.write_table(published, name, path)
    plain = [f._replace(published=f.published.replace(" ", "_")) for f in schema.LIFETIME_VALUE]
    back = tables.read_table(spark, name, plain)
    found = materialise(back.withColumns({"revenue": _d("revenue"), "window_revenue": _d("window_revenue")}), "read-back")
    spark.sql(f"DROP TABLE {name}")
    return found


def _by_year(spark: SparkSession, folder: str) -> DataFrame:
    """Typed transactions from a table laid out by year: a year range picks its folders."""
    path = scratch_path(spark, "transactions-by-year")
    tables.write_transactions(_clean(spark, folder), path)
    return spark.read.parquet(path)


@query(
    f"""SELECT yr AS year, count(*) AS transactions, CAST(sum(amount) AS DOUBLE) AS amount FROM tx
    WHERE yr BETWEEN {START_YEAR} AND {END_YEAR} GROUP BY yr""",
    "tx",
)
def scan_by_year(spark, folder):
    rows = cleaning.within_years(_by_year(spark, folder), START_YEAR, END_YEAR)
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("transactions"), F.sum("amount").cast("double").alias("amount"))


@query(
    """SELECT row_id, amount FROM (SELECT row_id, CAST(amount AS DOUBLE) AS amount,
    CAST('0x' || substr(md5('42:' || CAST(row_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM tx)
    ORDER BY h, row_id LIMIT 1000""",
    "tx",
)
def sample_n(spark, folder):
    return sampling.sample_rows(_clean(spark, folder), "row_id", 1000).select("row_id", _d("amount"))


# ---- cleaning and splitting ----


@query("SELECT row_id, CAST(amount AS DOUBLE) AS amount FROM tx", "tx")
def parse_money(spark, folder):
    return proxies.transactions(spark, folder).select("row_id", money.parse_money("amount").cast("double").alias("amount"))


@query(
    """SELECT row_id, strftime(dt, '%Y-%m-%d') AS date, strftime(dt, '%Y-%m-%d') || ' ' || tm AS date_time FROM tx""",
    "tx",
)
def build_timestamp(spark, folder):
    return _clean(spark, folder).select(
        "row_id",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.date_format("date_time", "yyyy-MM-dd HH:mm:ss").alias("date_time"),
    )


@query(
    """SELECT row_id, usr AS "user", yr AS year, mon AS month, dy AS day, tm AS time, CAST(amount AS DOUBLE) AS amount,
    is_fraud, errors, strftime(dt, '%Y-%m-%d') || ' ' || tm AS date_time FROM tx""",
    "tx",
)
def clean_transactions(spark, folder):
    return _clean(spark, folder).select(
        "row_id", "user", "year", "month", "day", "time", _d("amount"), "is_fraud", "errors",
        F.date_format("date_time", "yyyy-MM-dd HH:mm:ss").alias("date_time"),
    )


@query(
    """SELECT count(*) AS rows, count(*) FILTER (row_id % 97 = 0) AS bad_amounts,
    count(*) FILTER (row_id % 89 = 0) AS bad_dates,
    count(*) FILTER (row_id % 89 = 0 OR row_id % 83 = 0) AS bad_timestamps FROM tx""",
    "tx",
)
def rejected_counts(spark, folder):
    key = F.col("row_id")
    spoiled = proxies.transactions(spark, folder).withColumns(
        {
            "amount": F.when(key % 97 == 0, "").otherwise(F.col("amount")),
            "month": F.when(key % 89 == 0, 13).otherwise(F.col("month")),
            "time": F.when(key % 83 == 0, "25:00").otherwise(F.col("time")),
        }
    )
    return cleaning.rejected_counts(spoiled)


def _split(kind: str) -> str:
    return f'SELECT row_id, usr AS "user", CAST(amount AS DOUBLE) AS amount FROM tagged WHERE {kind}'


@query(_split("valid"), "tagged")
def split_valid(spark, folder):
    return cleaning.valid_transactions(_clean(spark, folder)).select("row_id", "user", _d("amount"))


@query(_split("fraudulent"), "tagged")
def split_fraud(spark, folder):
    return cleaning.fraudulent_transactions(_clean(spark, folder)).select("row_id", "user", _d("amount"))


@query(_split("failed"), "tagged")
def split_error(spark, folder):
    return cleaning.failed_transactions(_clean(spark, folder)).select("row_id", "user", _d("amount"))


@query(
    """SELECT valid, fraudulent, failed, count(*) AS transactions, CAST(sum(amount) AS DOUBLE) AS amount
    FROM tagged GROUP BY valid, fraudulent, failed""",
    "tagged",
)
def split_summary(spark, folder):
    return cleaning.split_summary(_clean(spark, folder)).withColumn("amount", _d("amount"))


@query(
    """SELECT count(*) AS transactions, CAST(sum(amount) AS DOUBLE) AS amount, CAST(1 AS BIGINT) AS builds
    FROM tagged WHERE valid""",
    "tagged",
)
def valid_written_once(spark, folder):
    """The valid transactions, asked for twice and written once."""
    path, builds = scratch_path(spark, "valid"), []

    def build() -> DataFrame:
        builds.append(path)
        return cleaning.valid_transactions(_clean(spark, folder)).select("row_id", "amount")

    for _ in range(2):
        rows = written_once(spark, path, build)
    total = F.sum("amount").cast("double").alias("amount")
    return rows.agg(F.count(F.lit(1)).alias("transactions"), total, F.lit(len(builds)).cast("bigint").alias("builds"))


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{f.name}', '{f.type}')" for f in schema.TRANSACTIONS if f.name != "errors")
    + ") t(name, type)",
)
def transaction_schema(spark, folder):
    """Names and types as read back from files without any type in them; only columns that hold a value are listed."""
    path = scratch_path(spark, "transactions-csv")
    tables.write_csv(proxies.transactions(spark, folder), path, schema.TRANSACTIONS)
    rows = tables.read_csv(spark, path, schema.TRANSACTIONS).drop("errors")
    kinds = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.col(n).cast("string").alias("value")) for n, t in rows.dtypes))
    return rows.select(F.inline(kinds)).filter("value IS NOT NULL").select("name", "type").distinct()


# The types that the proxies are declared with; the masked money and the time of day are text.
_INFERRED = {"User": "int", "Year": "int", "Month": "int", "Day": "int", "Time": "string", "Amount": "string", "Is Fraud?": "string", "Errors?": "string"}


@query(
    f"""SELECT name, type, n AS lines, broken FROM (VALUES {", ".join(f"('{n}', '{t}')" for n, t in _INFERRED.items())}) t(name, type),
    (SELECT count(*) FILTER (row_id % 97 <> 0) AS n, count(*) FILTER (row_id % 97 = 0) AS broken FROM tx)""",
    "tx",
)
def inferred_schema(spark, folder):
    """Types found in files without declared ones, some of whose lines lack their last fields."""
    raw, path = proxies.transactions(spark, folder), scratch_path(spark, "untyped")
    values = [F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in schema.TRANSACTIONS]
    line = F.when(F.col("row_id") % 97 == 0, F.concat_ws(",", *values[:5])).otherwise(F.concat_ws(",", *values))
    header = F.lit(",".join(f.published for f in schema.TRANSACTIONS))
    first = F.monotonically_increasing_id() % (1 << 33) == 0  # every file begins with the header
    raw.select(F.explode(F.when(first, F.array(header, line)).otherwise(F.array(line))).alias("value")).write.text(path)
    texts = inferred.read_texts(spark, path)
    fields = inferred.inferred(texts)
    lines, broken = inferred.typed(texts, fields).count(), inferred.broken_lines(texts).agg(F.sum("times")).first()[0]
    found = spark.createDataFrame([(f.published, f.type) for f in fields], "name string, type string")
    return found.select("name", "type", F.lit(lines).cast("bigint").alias("lines"), F.lit(broken or 0).cast("bigint").alias("broken"))


# ---- per-user activity ----


@query('SELECT usr AS "user", strftime(max(dt), \'%Y-%m-%d\') AS last_date FROM tx GROUP BY usr', "tx")
def last_activity(spark, folder):
    return activity.last_activity(_clean(spark, folder)).select("user", F.date_format("last_date", "yyyy-MM-dd").alias("last_date"))


@query('SELECT usr AS "user", recency FROM rfm', "rfm")
def recency(spark, folder):
    return activity.recency(_clean(spark, folder))


@query('SELECT usr AS "user", frequency FROM rfm', "rfm")
def frequency(spark, folder):
    return activity.frequency(_clean(spark, folder))


@query('SELECT usr AS "user", CAST(revenue AS DOUBLE) AS revenue FROM rfm', "rfm")
def revenue(spark, folder):
    return activity.revenue(_clean(spark, folder)).select("user", _d("revenue"))


@query('SELECT usr AS "user", recency, frequency, CAST(revenue AS DOUBLE) AS revenue FROM rfm', "rfm")
def rfm_raw(spark, folder):
    return activity.rfm(_clean(spark, folder)).withColumn("revenue", _d("revenue"))


@query('SELECT usr AS "user", recency, frequency, CAST(revenue AS DOUBLE) AS revenue FROM rfm', "rfm")
def rfm_joined(spark, folder):
    """The same from three aggregations, joined on the columns they share."""
    rows = _clean(spark, folder)
    parts = (activity.recency(rows), activity.frequency(rows), activity.revenue(rows))
    return reduce(joins.natural_join, parts).withColumn("revenue", _d("revenue"))


@query(
    """SELECT usr AS "user", date_diff('day', max(dt), (SELECT max(dt) FROM tagged WHERE valid)) AS recency,
    count(yr) AS frequency, CAST(sum(amount) AS DOUBLE) AS revenue FROM tagged WHERE valid GROUP BY usr""",
    "tagged",
)
def rfm_valid_only(spark, folder):
    return activity.rfm(_clean(spark, folder), valid_only=True).withColumn("revenue", _d("revenue"))


@query(
    f"""SELECT usr AS "user", CAST(sum(amount) AS DOUBLE) AS window_revenue FROM tagged
    WHERE valid AND yr BETWEEN {START_YEAR} AND {END_YEAR} GROUP BY usr""",
    "tagged",
)
def timeframe_revenue(spark, folder):
    return activity.timeframe_revenue(_by_year(spark, folder), START_YEAR, END_YEAR).withColumn("window_revenue", _d("window_revenue"))


# ---- joins, cards, features ----


@query(
    """SELECT t.row_id, t.usr AS "user", CAST(t.amount AS DOUBLE) AS amount, u.current_age, u.fico_score
    FROM tx t JOIN usr_rows u ON u.idx = t.usr""",
    "tx", "usr_rows",
)
def transactions_with_users(spark, folder):
    users = proxies.indexed_users(spark, folder).withColumnRenamed("index", "user")
    joined = joins.transactions_with_users(_clean(spark, folder), users)
    return joined.select("row_id", "user", _d("amount"), "current_age", "fico_score")


@query("SELECT idx AS index, current_age, fico_score, num_credit_cards FROM usr_rows", "usr_rows")
def row_index(spark, folder):
    return proxies.indexed_users(spark, folder).select("index", "current_age", "fico_score", "num_credit_cards")


_CARD = """usr AS "user", total_cards, total_cards_with_chips, total_cards_issued,
    average_credit_limit, cards_on_dark_web, amex, discover, mastercard, visa, credit, debit, debit_prepaid"""


@query(f"SELECT {_CARD} FROM card_stats", "card_stats")
def card_features(spark, folder):
    return cards.card_features(proxies.cards(spark, folder))


@query(
    """SELECT usr AS "user", array_to_string(list_sort(list(DISTINCT brand)), '|') AS card_brands,
    array_to_string(list_sort(list(DISTINCT type)), '|') AS card_types FROM card_rows GROUP BY usr""",
    "card_rows",
)
def card_lists(spark, folder):
    lists = cards.card_lists(proxies.cards(spark, folder))
    return lists.select("user", *(F.array_join(c, "|").alias(c) for c in ("card_brands", "card_types")))


@query('SELECT DISTINCT usr AS "user", brand AS value FROM card_rows', "card_rows")
def card_list_values(spark, folder):
    return cards.list_values(cards.card_lists(proxies.cards(spark, folder)), "card_brands")


_FEATURES = """usr AS "user", ltv_cluster, CAST(revenue AS DOUBLE) AS revenue, recency, frequency, overall_score,
    current_age, retirement_age, CAST(per_capita_income AS DOUBLE) AS per_capita_income,
    CAST(yearly_income AS DOUBLE) AS yearly_income, CAST(total_debt AS DOUBLE) AS total_debt, fico_score,
    num_credit_cards, total_cards_with_chips, total_cards_issued,
    average_credit_limit, cards_on_dark_web, amex, discover, mastercard, visa, credit, debit, debit_prepaid"""


@query(f"SELECT {_FEATURES} FROM features", "features")
def customer_features(spark, folder):
    return _features(spark, folder).withColumn("revenue", _d("revenue"))


@query(f"SELECT {_FEATURES} FROM features", "features")
def customer_features_bucketed(spark, folder):
    """The same from tables in buckets by user: customers, users and cards join without an exchange."""
    parts = {"customers": (_labelled(spark, folder), "user"), "users": (proxies.indexed_users(spark, folder), "index"), "cards": (proxies.cards(spark, folder), "user")}
    path, names = scratch_path(spark, "bucketed"), []
    for part, (rows, key) in parts.items():
        names.append(f"{part}_{path.rsplit('-', 1)[1]}")
        write_bucketed(rows, names[-1], key, 8, f"{path}/{part}")
    found = materialise(cf.customer_features(*map(spark.table, names)), "bucketed-features")
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    return found.withColumn("revenue", _d("revenue"))


@query(
    """SELECT l.usr AS "user", l.segment, l.ltv_cluster, u.yearly_income, u.total_debt
    FROM ltv l JOIN usr_rows u ON u.idx = l.usr""",
    "ltv", "usr_rows",
)
def debt_income_merge(spark, folder):
    customers = _labelled(spark, folder).select("user", "segment", "ltv_cluster")
    return cf.debt_income_merge(customers, proxies.indexed_users(spark, folder))


# ---- clusters, scores, segments ----


def _axis_sql(axis: str, direction: str, value: str) -> tuple[str, ...]:
    text = f"""SELECT r.usr AS "user", CAST(r.{axis} AS DOUBLE) AS {axis}, l.{direction} AS cluster
        FROM rfm r JOIN km_labels l ON l.axis = '{axis}' AND l.value = {value}"""
    return text, "rfm", "km_labels"


def _axis(spark, folder, axis: str, ascending: bool) -> DataFrame:
    rows = cs.customer_base(proxies.transactions(spark, folder))
    return clusters.cluster_k(rows, axis, "cluster", 6, ascending).select("user", _d(axis), "cluster")


@query(*_axis_sql("recency", "down", "r.recency"))
def kmeans_recency(spark, folder):
    return _axis(spark, folder, "recency", False)


@query(*_axis_sql("frequency", "up", "r.frequency"))
def kmeans_frequency(spark, folder):
    return _axis(spark, folder, "frequency", True)


@query(*_axis_sql("revenue", "up", "CAST(r.revenue * 100 AS BIGINT)"))
def kmeans_revenue(spark, folder):
    return _axis(spark, folder, "revenue", True)


def _fit_holds(rows: DataFrame, fit: clusters.Fit) -> DataFrame:
    """Per user: whether the label is that of a nearest centre, and whether that centre is the mean of its rows."""
    labelled = clusters.assign(rows.select("user", fit.axis), fit, "cluster").filter(F.col("cluster").isNotNull())
    centres = F.array(*(F.lit(c / 10**fit.scale) for c in fit.centres))
    value = F.col(fit.axis).cast("double")
    own = F.abs(value - F.get(centres, F.col("cluster")))
    nearest = own <= F.array_min(F.transform(centres, lambda c: F.abs(value - c))) + 1e-9
    means = labelled.groupBy("cluster").agg(F.avg(value).alias("mean"))
    spread = labelled.agg(F.stddev_pop(value)).scalar()
    settled = F.abs(F.get(centres, F.col("cluster")) - F.col("mean")) <= 0.02 * spread
    return labelled.join(means, "cluster").select("user", nearest.alias("nearest"), settled.alias("centre_is_mean"))


_HOLDS = 'SELECT usr AS "user", TRUE AS nearest, TRUE AS centre_is_mean FROM rfm'


@query(_HOLDS, "rfm")
def kmeans_random_start(spark, folder):
    rows = cs.customer_base(proxies.transactions(spark, folder))
    return _fit_holds(rows, clusters.fit_kmeans_random(rows, "revenue", 6))


@query(_HOLDS, "rfm")
def kmeans_quantile_start(spark, folder):
    rows = cs.customer_base(proxies.transactions(spark, folder))
    return _fit_holds(rows, clusters.fit_kmeans(rows, {"revenue": 6})["revenue"])


@query(
    """SELECT r.usr AS "user", o.place AS cluster FROM rfm r
    JOIN km_labels l ON l.axis = 'frequency' AND l.value = r.frequency
    JOIN (SELECT cl, row_number() OVER (ORDER BY avg(CAST(revenue AS DOUBLE)) DESC, cl) - 1 AS place FROM rfm
        JOIN km_labels ON axis = 'frequency' AND value = frequency GROUP BY cl) o ON o.cl = l.cl""",
    "rfm", "km_labels",
)
def ordered_clusters(spark, folder):
    """Frequency clusters renumbered by their mean revenue, largest first."""
    rows = cs.customer_base(proxies.transactions(spark, folder))
    fit = clusters.fit_kmeans(rows, {"frequency": 6})["frequency"]
    labelled = clusters.assign(rows, fit, "cluster")
    return clusters.order_clusters(labelled, "cluster", "revenue", ascending=False).select("user", "cluster")


@query(
    """SELECT axis, k, round(sqrt(sum((value - centre) * (value - centre) * weight) / sum(weight)), 4) AS distance
    FROM el_labels GROUP BY axis, k""",
    "el_labels",
)
def elbow_curve(spark, folder):
    """The root of the mean squared distance, in units, which rounds alike in both engines."""
    rows = cs.customer_base(proxies.transactions(spark, folder))
    curve = clusters.elbow_curve(rows, ["recency", "revenue"])
    unit = F.when(F.col("axis") == "revenue", 10000.0).otherwise(1.0)
    customers = rows.agg(F.count(F.lit(1))).scalar()
    return curve.select("axis", "k", F.round(F.sqrt(F.col("inertia") * unit / customers), 4).alias("distance"))


@query('SELECT usr AS "user", recency_cluster, frequency_cluster, revenue_cluster, overall_score FROM scored', "scored")
def rfm_scores(spark, folder):
    return _scored(spark, folder).select("user", *models.CLUSTERS)


@query(
    """SELECT usr AS "user", CAST(revenue AS DOUBLE) AS revenue, recency, frequency, recency_cluster,
    frequency_cluster, revenue_cluster, overall_score, segment FROM scored""",
    "scored",
)
def rfm_segments(spark, folder):
    names = [f.name for f in schema.SEGMENTS]
    return _scored(spark, folder).withColumn("revenue", _d("revenue")).select(*names)


@query(
    """SELECT usr AS "user", CAST(revenue AS DOUBLE) AS revenue, recency, frequency, recency_cluster,
    frequency_cluster, revenue_cluster, overall_score, segment FROM purchase_scored""",
    "purchase_scored",
)
def purchase_segments(spark, folder):
    """The flagship job over the other transaction source."""
    names = [f.name for f in schema.SEGMENTS]
    return cs.segment_customers(proxies.purchases(spark, folder)).withColumn("revenue", _d("revenue")).select(*names)


@query('SELECT usr AS "user", CAST(window_revenue AS DOUBLE) AS window_revenue, ltv_cluster FROM ltv', "ltv")
def ltv_clusters(spark, folder):
    return _labelled(spark, folder).select("user", _d("window_revenue"), "ltv_cluster")


@query(f"SELECT {_LTV} FROM ltv", "ltv")
def ltv_labelled(spark, folder):
    names = [f.name for f in schema.LIFETIME_VALUE]
    rows = _labelled(spark, folder).withColumns({"revenue": _d("revenue"), "window_revenue": _d("window_revenue")})
    return rows.select(*names)


def _parts(spark, folder) -> list[DataFrame]:
    """The transactions in three uneven parts, as they might come in one after the other."""
    raw = proxies.transactions(spark, folder)
    part = F.when(F.col("row_id") % 10 < 6, 0).when(F.col("row_id") % 10 < 9, 1).otherwise(2)
    return [raw.where(part == i) for i in range(3)]


def _state(spark, folder) -> DataFrame:
    """The state of the first part, with the others folded in one by one; each state is a written table."""
    first, *others = (inc.customer_state(part, START_YEAR, END_YEAR) for part in _parts(spark, folder))
    return reduce(lambda state, newer: materialise(inc.folded(state, newer), "customer-state"), others, materialise(first, "customer-state"))


@query(
    """SELECT usr AS "user", recency, frequency, CAST(revenue AS DOUBLE) AS revenue, CAST(window_revenue AS DOUBLE) AS window_revenue,
    window_transactions FROM rfm""",
    "rfm",
)
def rfm_from_state(spark, folder):
    """The totals of all transactions, from a state into which they were folded part by part."""
    found = inc.customers_of(_state(spark, folder))
    return found.select("user", "recency", "frequency", _d("revenue"), _d("window_revenue"), "window_transactions")


@query(f"SELECT {_LTV} FROM ltv", "ltv")
def ltv_from_state(spark, folder):
    """The labels of a full run, from the folded state."""
    labelled, _ = inc.label_state(_state(spark, folder))
    return labelled.withColumns({"revenue": _d("revenue"), "window_revenue": _d("window_revenue")}).select(*[f.name for f in schema.LIFETIME_VALUE])


@query(
    """SELECT usr AS "user", count(*) AS transactions, CAST(sum(amount) AS DOUBLE) AS amount, CAST(2 AS BIGINT) AS builds
    FROM tagged WHERE valid GROUP BY usr""",
    "tagged",
)
def totals_stored(spark, folder):
    """Totals per user, stored, asked for again, and once more after files were added to their input: two builds."""
    source, path, builds = scratch_path(spark, "source"), scratch_path(spark, "stored"), []
    *early, late = _parts(spark, folder)
    for parts in (early, [], [late], []):
        for part in parts:
            part.write.mode("append").parquet(source)
        valid = cleaning.valid_transactions(cleaning.clean_transactions(spark.read.parquet(source)))
        totals = valid.groupBy("user").agg(F.count("*").alias("transactions"), F.sum("amount").alias("amount"))
        rows, built = stored(totals, path)
        builds.append(built)
    return rows.select("user", "transactions", _d("amount"), F.lit(sum(builds)).cast("bigint").alias("builds"))


@query(f"SELECT {_LTV} FROM ltv WHERE FALSE", "ltv")
def ltv_empty_window(spark, folder):
    """A window before the first transaction: no rows, but typed ones."""
    names = [f.name for f in schema.LIFETIME_VALUE]
    rows = cs.label_lifetime_value(proxies.transactions(spark, folder), 1900, 1901)
    return rows.withColumns({"revenue": _d("revenue"), "window_revenue": _d("window_revenue")}).select(*names)


_SCALED = ", ".join(
    f"round((CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / stddev_pop(CAST({c} AS DOUBLE)) OVER (), 6) AS {c}"
    for c in cs.SCALED
)
_FLAGS = ", ".join(f"CAST(segment = '{v}' AS INT) AS segment_{v.split('-')[0].lower()}" for v in SEGMENTS)
_PREPROCESSED = f"""SELECT usr AS "user", ltv_cluster, recency_cluster, frequency_cluster, revenue_cluster, overall_score,
    {_SCALED}, {_FLAGS} FROM ltv"""


def _preprocessed(spark, folder) -> DataFrame:
    rows = cs.preprocess(_labelled(spark, folder))
    return rows.withColumnsRenamed({f"segment_{v}": f"segment_{v.split('-')[0].lower()}" for v in SEGMENTS})


@query(_PREPROCESSED, "ltv")
def preprocessed_customers(spark, folder):
    rows = _preprocessed(spark, folder)
    return rows.withColumns({c: _r(c, 6) for c in cs.SCALED}).drop("window_transactions")


@query(
    """SELECT usr AS "user", CAST(window_revenue AS DOUBLE) AS window_revenue, overall_score, segment FROM scored
    WHERE window_transactions > 0""",
    "scored",
)
def revenue_with_segments(spark, folder):
    window = activity.timeframe_revenue(_by_year(spark, folder), START_YEAR, END_YEAR)
    joined = joins.with_segments(window, _scored(spark, folder))
    return joined.select("user", _d("window_revenue"), "overall_score", "segment")


@query(f"SELECT {_LTV} FROM ltv", "ltv")
def ltv_from_segments(spark, folder):
    """Label customers whose segments were scored and stored earlier."""
    path = scratch_path(spark, "segments-csv")
    raw = proxies.transactions(spark, folder)
    tables.write_csv(cs.segment_customers(raw), path, schema.SEGMENTS)
    segments = tables.read_csv(spark, path, schema.SEGMENTS)
    rows = cs.label_segmented(raw, segments, START_YEAR, END_YEAR)
    names = [f.name for f in schema.LIFETIME_VALUE]
    return rows.withColumns({"revenue": _d("revenue"), "window_revenue": _d("window_revenue")}).select(*names)


# ---- summaries ----

_DESCRIBE = """count({x}) AS count, CAST(sum({x}) AS DOUBLE) / count({x}) AS mean,
    round(stddev_samp(CAST({x} AS DOUBLE)), 4) AS std, CAST(min({x}) AS DOUBLE) AS min,
    round(quantile_cont(CAST({x} AS DOUBLE), 0.25), 4) AS q25, round(quantile_cont(CAST({x} AS DOUBLE), 0.5), 4) AS q50,
    round(quantile_cont(CAST({x} AS DOUBLE), 0.75), 4) AS q75, CAST(max({x}) AS DOUBLE) AS max"""


def _describe(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    out = summaries.describe_by_group(df, groups, value)
    return out.select(*groups, "count", "mean", *(_r(c, 4) for c in ("std", "min", "q25", "q50", "q75", "max")))


@query(
    " UNION ALL ".join(
        f"SELECT '{axis}' AS axis, {axis}_cluster AS cluster, {_DESCRIBE.format(x=axis)} FROM scored GROUP BY {axis}_cluster"
        for axis in cs.AXES
    ),
    "scored",
)
def describe_by_group(spark, folder):
    """All three axes at once, with the axis as a second group key."""
    axes = (
        F.struct(F.lit(axis).alias("axis"), F.col(f"{axis}_cluster").alias("cluster"), F.col(axis).cast("decimal(28,2)").alias("value"))
        for axis in cs.AXES
    )
    rows = _scored(spark, folder).select(F.inline(F.array(*axes)))
    return _describe(rows, ["axis", "cluster"], "value")


@query(f"SELECT is_fraud, {_DESCRIBE.format(x='amount')} FROM tx WHERE is_fraud IS NOT NULL GROUP BY is_fraud", "tx")
def describe_amounts(spark, folder):
    return _describe(_clean(spark, folder), ["is_fraud"], "amount")


@query(
    """SELECT overall_score, count(*) AS customers, CAST(sum(recency) AS DOUBLE) / count(*) AS mean_recency,
    CAST(sum(frequency) AS DOUBLE) / count(*) AS mean_frequency, CAST(sum(revenue) AS DOUBLE) / count(*) AS mean_revenue
    FROM scored GROUP BY overall_score""",
    "scored",
)
def score_profile(spark, folder):
    return scoring.score_profile(_scored(spark, folder))


@query(
    """SELECT brand AS card_brand, count(*) FILTER (type = 'Credit') AS credit, count(*) FILTER (type = 'Debit') AS debit,
    count(*) FILTER (type = 'Debit (Prepaid)') AS debit_prepaid FROM card_rows GROUP BY brand""",
    "card_rows",
)
def crosstab(spark, folder):
    table = summaries.crosstab(proxies.cards(spark, folder), "card_brand", "card_type", schema.CARD_TYPES)
    return table.toDF("card_brand", *(cards.flag_name(t) for t in schema.CARD_TYPES))


@query('SELECT usr AS "user", CAST(revenue AS DOUBLE) AS revenue FROM rfm ORDER BY rfm.revenue DESC, usr LIMIT 10', "rfm")
def top_customers(spark, folder):
    return sampling.top_customers(activity.revenue(_clean(spark, folder)), "revenue").select("user", _d("revenue"))


# ---- encoding, correlation, tests ----


@query(
    """SELECT usr AS "user", """
    + ", ".join(
        f"round((CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / stddev_pop(CAST({c} AS DOUBLE)) OVER (), 6) AS {c}"
        for c in cs.AXES
    )
    + " FROM rfm",
    "rfm",
)
def standardise(spark, folder):
    rows = cs.customer_base(proxies.transactions(spark, folder))
    return encoding.standardise(rows, list(cs.AXES)).select("user", *(_r(c, 6) for c in cs.AXES))


@query(
    """SELECT usr AS "user", CAST(segment = 'High-Value' AS INT) AS segment_high, CAST(segment = 'Low-Value' AS INT)
    AS segment_low, CAST(segment = 'Mid-Value' AS INT) AS segment_mid FROM scored""",
    "scored",
)
def one_hot_segment(spark, folder):
    encoded = encoding.one_hot(_scored(spark, folder).select("user", "segment"), "segment", SEGMENTS)
    return encoded.toDF("user", "segment_high", "segment_low", "segment_mid")


_TESTED = (*cf.CONTINUOUS, *cf.CATEGORICAL)
_CORRELATED = ("ltv_cluster", *_TESTED)


def _pair(a: str, b: str) -> str:
    r = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
    return f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN isnan({r}) THEN NULL ELSE round({r}, 8) END AS r FROM features"


@query(" UNION ALL ".join(_pair(a, b) for a in _CORRELATED for b in _CORRELATED), "features")
def correlation_matrix(spark, folder):
    return correlation.correlation_matrix(_features(spark, folder), _CORRELATED).withColumn("r", _r("r", 8))


@query(" UNION ALL ".join(_pair(a, "ltv_cluster").replace(" AS a", " AS variable").replace(", 'ltv_cluster' AS b", "") for a in _CORRELATED), "features")
def target_correlation(spark, folder):
    return correlation.target_correlation(_features(spark, folder), "ltv_cluster", _CORRELATED).withColumn("r", _r("r", 8))


_LABELLED = (*cs.SCALED, *models.CLUSTERS, "ltv_cluster", *(f"segment_{v.split('-')[0].lower()}" for v in SEGMENTS))


def _labelled_pair(a: str, b: str) -> str:
    r = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
    return f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN isnan({r}) THEN NULL ELSE round({r}, 6) END AS r FROM pre"


_PRE = f"WITH pre AS MATERIALIZED (SELECT * EXCLUDE (window_revenue), CAST(window_revenue AS DOUBLE) AS window_revenue, {_FLAGS} FROM ltv)"


@query(f"SELECT * FROM ({_PRE} " + " UNION ALL ".join(_labelled_pair(a, b) for a in _LABELLED for b in _LABELLED) + ")", "ltv")
def labelled_correlation(spark, folder):
    """Correlations of the preprocessed, labelled frame; scaling does not change them."""
    return correlation.correlation_matrix(_preprocessed(spark, folder), _LABELLED).withColumn("r", _r("r", 6))


@query(
    f"SELECT a AS variable, r FROM ({_PRE} " + " UNION ALL ".join(_labelled_pair(a, "ltv_cluster") for a in _LABELLED) + ")", "ltv"
)
def labelled_target_correlation(spark, folder):
    return correlation.target_correlation(_preprocessed(spark, folder), "ltv_cluster", _LABELLED).withColumn("r", _r("r", 6))


_ANOVA = f"""
    SELECT variable, 'ANOVA' AS test_used, f AS statistic, used_rows, df_between, df_within,
        pow(1 + 2 * f / df_within, -df_within / 2.0) AS p_value FROM (
        SELECT variable, sum(n) AS used_rows, count(*) - 1 AS df_between, sum(n) - count(*) AS df_within,
            (sum(n * (mean - grand) ** 2) / (count(*) - 1)) / (sum(n * spread) / (sum(n) - count(*))) AS f FROM (
            SELECT *, sum(n * mean) OVER (PARTITION BY variable) / sum(n) OVER (PARTITION BY variable) AS grand FROM (
                SELECT variable, ltv_cluster, count(*) AS n, avg(x) AS mean, var_pop(x) AS spread FROM (
                    {" UNION ALL ".join(f"SELECT '{c}' AS variable, ltv_cluster, CAST({c} AS DOUBLE) AS x FROM features" for c in cf.CONTINUOUS)}
                ) GROUP BY variable, ltv_cluster))
        GROUP BY variable)"""

_CELLS = f"""
    SELECT variable, value, ltv_cluster, count(*) AS n FROM (
        {" UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS value, ltv_cluster FROM features" for c in cf.CATEGORICAL)}
    ) GROUP BY variable, value, ltv_cluster"""
_CHI = f"""
    SELECT variable, 'Chi-Square' AS test_used, x AS statistic, used_rows, df,
        CASE WHEN df = 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(CAST(df // 2 AS BIGINT)),
            lambda i: exp(-x / 2 + i * ln(greatest(x, 1e-300) / 2) - lgamma(i + 1)))) END AS p_value FROM (
        SELECT variable, CAST(sum(n) AS BIGINT) AS used_rows, (count(DISTINCT value) - 1) * (count(DISTINCT ltv_cluster) - 1) AS df,
            greatest(sum(n) * (sum(n * n / (v * l)) - 1), 0.0) AS x FROM (
            SELECT variable, value, ltv_cluster, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY variable, value) AS DOUBLE) AS v,
                CAST(sum(n) OVER (PARTITION BY variable, ltv_cluster) AS DOUBLE) AS l FROM ({_CELLS}))
        GROUP BY variable)""".replace("lgamma(i + 1))))", "lgamma(i + 1)))))")


@query(
    f"""SELECT variable, test_used, round(statistic, 4) AS statistic, round(p_value, 8) AS p_value,
    CAST(used_rows AS BIGINT) AS used_rows, df_between, CAST(df_within AS BIGINT) AS df_within FROM ({_ANOVA})""",
    "features",
)
def anova_tests(spark, folder):
    out = significance.anova_tests(_features(spark, folder), "ltv_cluster", cf.CONTINUOUS, classes=3)
    return out.withColumns({"statistic": _r("statistic", 4), "p_value": _r("p_value", 8)})


@query(
    f"SELECT variable, test_used, round(statistic, 4) AS statistic, round(p_value, 8) AS p_value, used_rows, df FROM ({_CHI})",
    "features",
)
def chi_square_tests(spark, folder):
    out = significance.chi_square_tests(_features(spark, folder), "ltv_cluster", cf.CATEGORICAL, classes=3)
    return out.withColumns({"statistic": _r("statistic", 4), "p_value": _r("p_value", 8)})


_BOTH = f"""SELECT variable, test_used, round(p_value, 8) AS p_value,
    CASE WHEN p_value < 0.05 THEN 'Significant' ELSE 'Not Significant' END AS significance FROM (
    SELECT variable, test_used, p_value FROM ({_ANOVA}) UNION ALL SELECT variable, test_used, p_value FROM ({_CHI}))"""


@query(_BOTH, "features")
def feature_tests(spark, folder):
    return cf.tested_features(materialise(_features(spark, folder), "features")).withColumn("p_value", _r("p_value", 8))


@query(
    f"""SELECT usr AS "user", ltv_cluster, f.name, f.value FROM (
    SELECT usr, ltv_cluster, unnest([{", ".join(f"{{'name': '{c}', 'value': CAST({c} AS DOUBLE)}}" for c in _TESTED)}]) AS f
    FROM features) WHERE f.name IN (SELECT variable FROM ({_BOTH}) WHERE significance = 'Significant')
    OR f.name IN ({", ".join(f"'{c}'" for c in cf.KEPT_CARDS)})""",
    "features",
)
def select_features(spark, folder):
    """In long form, as which columns there are depends on the data."""
    chosen = cf.selected_features(materialise(_features(spark, folder), "features"))
    names = [c for c in chosen.columns if c not in ("user", "ltv_cluster")]
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names))
    return chosen.select("user", "ltv_cluster", F.inline(pairs))


_CHOSEN = f"(SELECT variable FROM ({_BOTH}) WHERE significance = 'Significant' OR variable IN ({', '.join(repr(c) for c in cf.KEPT_CARDS)}) UNION ALL SELECT 'ltv_cluster')"


@query(
    f"SELECT a, b, r FROM ({' UNION ALL '.join(_pair(a, b) for a in _CORRELATED for b in _CORRELATED)}) WHERE a IN {_CHOSEN} AND b IN {_CHOSEN}",
    "features",
)
def selected_correlation(spark, folder):
    """Correlations of the label and the selected columns."""
    chosen = cf.selected_features(materialise(_features(spark, folder), "features")).drop("user")
    return correlation.correlation_matrix(chosen, chosen.columns).withColumn("r", _r("r", 8))


# ---- splits, metrics, models ----

_HASH = "CAST('0x' || substr(md5('42:' || CAST(usr AS VARCHAR)), 1, 8) AS BIGINT)"


@query(f"""SELECT usr AS "user", {_HASH} % 10000 < 500 AS held_out, {_HASH} % 10000 < 2000 AS validation FROM rfm""", "rfm")
def holdout_split(spark, folder):
    rows = activity.frequency(_clean(spark, folder))
    return rows.select(
        "user", splits.is_held_out("user", ms.HELD_OUT).alias("held_out"), splits.is_held_out("user", ms.VALIDATION).alias("validation")
    )


@query(
    f"""SELECT usr AS "user", label, (row_number() OVER (PARTITION BY label ORDER BY {_HASH} // 1048576, usr) - 1) % 5 AS fold
    FROM (SELECT usr, CASE WHEN frequency > 12 THEN 2 WHEN frequency > 8 THEN 1 ELSE 0 END AS label FROM rfm)""",
    "rfm",
)
def stratified_folds(spark, folder):
    many = F.col("frequency")
    rows = activity.frequency(_clean(spark, folder)).select(
        "user", F.when(many > 12, 2).when(many > 8, 1).otherwise(0).alias("label")
    )
    return splits.stratified_folds(rows, "label", "user").select("user", "label", "fold")


_PREDICTED = "(SELECT ltv_cluster AS y, CASE WHEN usr % 5 = 0 THEN (ltv_cluster + 1) % 3 ELSE ltv_cluster END AS p FROM ltv)"
_PER_CLASS = f"""(SELECT c AS class, count(*) FILTER (y = c) AS support,
    coalesce(count(*) FILTER (y = c AND p = c) / nullif(count(*) FILTER (p = c), 0), 0) AS precision,
    coalesce(count(*) FILTER (y = c AND p = c) / nullif(count(*) FILTER (y = c), 0), 0) AS recall,
    coalesce(2 * count(*) FILTER (y = c AND p = c) / nullif(count(*) FILTER (y = c) + count(*) FILTER (p = c), 0), 0) AS f1_score
    FROM {_PREDICTED}, range(3) t(c) GROUP BY c)"""


def _shifted(spark, folder) -> DataFrame:
    """Labels with predictions that are wrong for every fifth user."""
    label = F.col("ltv_cluster")
    return _labelled(spark, folder).select(
        label.alias("label"), F.when(F.col("user") % 5 == 0, (label + 1) % 3).otherwise(label).alias("prediction")
    )


def _weighted(metric: str) -> str:
    return f"round(sum({metric} * support) / sum(support), 10) AS {metric}"


@query(
    f"""SELECT 0 AS unscored_rows, (SELECT round(count(*) FILTER (y = p) / count(*), 10) FROM {_PREDICTED}) AS accuracy,
    {", ".join(_weighted(m) for m in metrics.METRICS[1:])} FROM {_PER_CLASS}""",
    "ltv",
)
def weighted_metrics(spark, folder):
    out = metrics.weighted_metrics(metrics.confusion(_shifted(spark, folder)))
    return out.select(*(_r(m, 10) for m in metrics.METRICS), "unscored_rows")


@query(
    f"""SELECT CAST(class AS VARCHAR) AS class, round(precision, 10) AS precision, round(recall, 10) AS recall,
    round(f1_score, 10) AS f1_score, support FROM {_PER_CLASS}
    UNION ALL SELECT 'accuracy', NULL, NULL, round(count(*) FILTER (y = p) / count(*), 10), count(*) FROM {_PREDICTED}
    UNION ALL SELECT 'macro avg', round(avg(precision), 10), round(avg(recall), 10), round(avg(f1_score), 10),
        CAST(sum(support) AS BIGINT) FROM {_PER_CLASS}
    UNION ALL SELECT 'weighted avg', {", ".join(_weighted(m) for m in metrics.METRICS[1:])},
        CAST(sum(support) AS BIGINT) FROM {_PER_CLASS}""",
    "ltv",
)
def classification_report(spark, folder):
    out = metrics.classification_report(metrics.confusion(_shifted(spark, folder)))
    return out.select("class", *(_r(m, 10) for m in metrics.METRICS[1:]), "support")


def _frame(spark, folder) -> DataFrame:
    return models.model_frame(_labelled(spark, folder))


# What SQL can state of a trained model: who is held out, that all are scored with known classes, and that the model
# is right more often than always naming the most frequent class; a constant in its place fails that.
_TRAINED = f"""SELECT usr AS "user", {_HASH} % 10000 < 500 AS held_out, TRUE AS known_class, TRUE AS beats_majority FROM ltv"""


def _right_share(df: DataFrame) -> Column:
    return df.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).scalar()


def _majority_share(df: DataFrame) -> float:
    return df.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]


def _trained(spark, folder, trainer: models.Trainer) -> DataFrame:
    _, train, test = ms.train_and_test(_frame(spark, folder), trainer)
    rows = train.withColumn("held_out", F.lit(False)).unionByName(test.withColumn("held_out", F.lit(True)))
    return _checked(materialise(rows, "trained"), "user", "held_out")


def _checked(rows: DataFrame, *columns: str) -> DataFrame:
    known = F.coalesce(F.col("prediction").isin(0.0, 1.0, 2.0), F.lit(False))
    better = _right_share(rows) > F.lit(_majority_share(rows))
    return rows.select(*columns, known.alias("known_class"), better.alias("beats_majority"))


@query(_TRAINED, "ltv")
def train_logistic(spark, folder):
    return _trained(spark, folder, models.logistic())


@query(_TRAINED, "ltv")
def train_tree(spark, folder):
    return _trained(spark, folder, models.tree())


_FEATURES = [*models.MEASURES, *models.CLUSTERS, *(f"CAST(segment = '{name}' AS INT)" for name in sorted(SEGMENTS))]
_ALL = ", ".join(f"{name} AS x{i}" for i, name in enumerate(_FEATURES))
_GROWN = [f"x{i}" for i in range(len(_FEATURES))]
_PARTED = f"SELECT 0 AS m, usr, ltv_cluster AS label, {_HASH} % 10000 >= 500 AS learns, {_ALL} FROM ltv"
tables_of.add({"bt_rows": (["ltv"], _PARTED), "bt_all": (["ltv"], f"SELECT 0 AS m, usr, ltv_cluster AS label, TRUE AS learns, {_ALL} FROM ltv")})
for _name, _rows, _settings in (("tuned", "bt_rows", models.TUNED), ("plain", "bt_rows", models.PLAIN), ("tuned_all", "bt_all", models.TUNED)):
    tables_of.add(tables_of.boosted(f"bt_{_name}", _rows, _settings, _GROWN))


def _classes(spark, folder, trainer: models.Trainer) -> DataFrame:
    _, train, test = ms.train_and_test(_frame(spark, folder), trainer)
    rows = train.withColumn("held_out", F.lit(False)).unionByName(test.withColumn("held_out", F.lit(True)))
    return rows.select("user", "held_out", F.col("prediction").cast("int").alias("class"))


@query(f'SELECT usr AS "user", {_HASH} % 10000 < 500 AS held_out, prediction AS class FROM bt_tuned_classes', "bt_tuned_classes")
def train_boosted(spark, folder):
    """The class that the tuned trees give every customer; the SQL grows the same trees."""
    return _classes(spark, folder, models.boosted(models.TUNED))


@query(f'SELECT usr AS "user", {_HASH} % 10000 < 500 AS held_out, prediction AS class FROM bt_plain_classes', "bt_plain_classes")
def train_boosted_plain(spark, folder):
    return _classes(spark, folder, models.boosted(models.PLAIN))


_SUPPORT = f"""SELECT part, CAST(ltv_cluster AS VARCHAR) AS class, count(*) AS support FROM (
    SELECT CASE WHEN {_HASH} % 10000 < 500 THEN 'test' ELSE 'train' END AS part, ltv_cluster FROM ltv) GROUP BY part, ltv_cluster"""


@query(f"SELECT part, class, support, TRUE AS in_range FROM ({_SUPPORT})", "ltv")
def model_report(spark, folder):
    """The class report of a model on the rows it was fitted on and on those held out."""
    _, train, test = ms.train_and_test(_frame(spark, folder), models.logistic())
    reports = []
    for part, rows in (("train", train), ("test", test)):
        report = metrics.classification_report(metrics.confusion(rows))
        reports.append(report.filter("support > 0 AND class IN ('0', '1', '2')").withColumn("part", F.lit(part)))
    inside = [F.col(m).between(0.0, 1.0) for m in metrics.METRICS[1:]]
    return reduce(DataFrame.unionByName, reports).select("part", "class", "support", reduce(Column.__and__, inside).alias("in_range"))


_REST = f"(SELECT usr, ltv_cluster AS label FROM ltv WHERE {_HASH} % 10000 >= 500)"
_FOLDED = f"""(SELECT usr, label, (row_number() OVER (PARTITION BY label ORDER BY {_HASH} // 1048576, usr) - 1) % 5 AS fold FROM {_REST})"""


tables_of.add(
    {
        "bt_folded": (["ltv"], f"SELECT usr, fold FROM {_FOLDED}"),
        "bt_folds": (
            ["ltv", "bt_folded"],
            f"""SELECT m, usr, ltv_cluster AS label, fold <> m AS learns, {_ALL} FROM ltv JOIN bt_folded USING (usr),
            (SELECT unnest(range(5)) AS m)""",
        ),
    }
)
tables_of.add(tables_of.boosted("bt_cv", "bt_folds", models.TUNED, _GROWN))
tables_of.add(
    {
        "bt_unseen": (
            ["bt_cv_classes", "bt_folds"],
            "SELECT usr, m AS fold, label, prediction FROM bt_cv_classes JOIN bt_folds USING (m, usr) WHERE NOT learns",
        ),
        "bt_scored": (
            ["bt_unseen"],
            """SELECT fold, sum(hits) / sum(support) AS accuracy, sum(support * hits / greatest(predicted, 1)) / sum(support) AS precision,
            sum(hits) / sum(support) AS recall, sum(support * 2 * hits / (predicted + support)) / sum(support) AS f1_score FROM (
                SELECT fold, c, count(*) FILTER (label = c AND prediction = c)::DOUBLE AS hits, count(*) FILTER (label = c)::DOUBLE AS support,
                    count(*) FILTER (prediction = c)::DOUBLE AS predicted
                FROM bt_unseen, (SELECT unnest([0, 1, 2]) AS c) GROUP BY fold, c) WHERE support > 0 GROUP BY fold""",
        ),
    }
)


def _tuned_folds(spark, folder) -> DataFrame:
    return ms.fold_predictions(_frame(spark, folder), models.boosted(models.TUNED))


@query('SELECT usr AS "user", fold, prediction AS class FROM bt_unseen', "bt_unseen")
def cv_metrics(spark, folder):
    """Five folds of the tuned trees, grown together; every row's class by the model that did not see it."""
    return _tuned_folds(spark, folder).select("user", "fold", F.col("prediction").cast("int").alias("class"))


@query(
    f"""SELECT count(*) AS folds, {', '.join(f'round(avg({m}), 10) AS mean_{m}' for m in metrics.METRICS)}, CAST(0 AS BIGINT) AS unscored_rows
    FROM bt_scored""",
    "bt_scored",
)
def cv_means(spark, folder):
    folds = materialise(metrics.weighted_metrics(metrics.confusion(_tuned_folds(spark, folder), by=["fold"]), ["fold"]), "fold-metrics")
    return metrics.mean_metrics(folds).select(
        folds.agg(F.count(F.lit(1))).scalar().alias("folds"),
        *(_r(f"mean_{m}", 10) for m in metrics.METRICS),
        folds.agg(F.sum("unscored_rows")).scalar().alias("unscored_rows"),
    )


_CANDIDATES = ", ".join(f"('{name}')" for name in ms.default_candidates())


@query(f"SELECT model, TRUE AS ranked, TRUE AS leader_beats_majority, TRUE AS leader_is_first FROM (VALUES {_CANDIDATES}) t(model)")
def model_leaderboard(spark, folder):
    """Ten candidates at their full settings: each once, in the order of their accuracy, and the leader's predictions."""
    board, _, predicted = ms.search_models(_frame(spark, folder), ms.default_candidates(), parallelism=4)
    predicted = materialise(predicted, "leader")
    above = F.max("accuracy").over(Window.orderBy("rank").rowsBetween(1, Window.unboundedFollowing))  # ten rows
    places = F.row_number().over(Window.orderBy("rank"))
    leader = _right_share(predicted)
    return board.select(
        "model",
        ((F.col("rank") == places) & (F.coalesce(above, F.lit(0.0)) <= F.col("accuracy"))).alias("ranked"),
        (leader > _majority_share(predicted)).alias("leader_beats_majority"),
        ((F.col("rank") > 1) | (F.abs(F.col("accuracy") - leader) < 1e-12)).alias("leader_is_first"),
    )


@query('SELECT usr AS "user", prediction AS boosted, TRUE AS known_class, TRUE AS as_before FROM bt_tuned_all_classes', "bt_tuned_all_classes")
def batch_scores(spark, folder):
    """Train the tuned trees and a full single tree, store them, load them and score every customer by their rules."""
    frame = materialise(_frame(spark, folder), "frame")
    trainers = {"tree": models.tree(), "boosted": models.boosted(models.TUNED)}
    found = frame.select("user")
    for name, trainer in trainers.items():
        model = trainer(frame)
        path, out = scratch_path(spark, "model"), scratch_path(spark, "scores")
        ms.save_model(model, path, spark)
        ms.score_batch(ms.load_model(spark, path), frame, out)
        before = models.predict(model, frame).select("user", F.col("prediction").cast("int").alias(f"{name}_before"))
        found = found.join(before, "user").join(ms.read_scores(spark, out).withColumnRenamed("ltv_cluster", name), "user")
    known = [F.coalesce(F.col(n).isin(0, 1, 2), F.lit(False)) for n in trainers]
    same = [F.col(n).eqNullSafe(F.col(f"{n}_before")) for n in trainers]
    return found.select("user", "boosted", reduce(Column.__and__, known).alias("known_class"), reduce(Column.__and__, same).alias("as_before"))
