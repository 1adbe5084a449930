"""The registered queries as SQL over the driver's tables, put together from shared common table expressions.

Written from the definition of each result, not from the Spark code: parsing, for one, is replaced by the
values the text was made from.
"""

from __future__ import annotations

from tallyworth.checks.proxies import END_YEAR, START_YEAR
from tallyworth.functions.buckets import HASH_RANGE
from tallyworth.operators import boosting
from tallyworth.operators.boosting import Boosting
from tallyworth.operators.clusters import BINS, ELBOW_ITER, MAX_ITER, TOLERANCE

_PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"
_AMOUNT = f"CAST(CASE WHEN o_orderkey % 20 = 0 THEN -{_PRICE} ELSE {_PRICE} END AS DECIMAL(18,2))"

_BASE = {
    "tx": (
        [],
        f"""SELECT o_orderkey AS row_id, o_custkey AS usr, year(o_orderdate) AS yr, month(o_orderdate) AS mon,
        day(o_orderdate) AS dy, CAST(o_orderdate AS DATE) AS dt, {_AMOUNT} AS amount,
        lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST((o_orderkey * 7) % 60 AS VARCHAR), 2, '0')
            || ':00' AS tm,
        CASE WHEN o_orderkey % 50 = 0 THEN 'Yes' WHEN o_orderkey % 101 = 1 THEN NULL ELSE 'No' END AS is_fraud,
        CASE WHEN o_orderkey % 33 = 0 THEN 'Bad PIN' END AS errors FROM orders""",
    ),
    "tagged": (
        ["tx"],
        """SELECT *, coalesce(is_fraud = 'No', FALSE) AND errors IS NULL AS valid,
        coalesce(is_fraud = 'Yes', FALSE) AS fraudulent, errors IS NOT NULL AS failed FROM tx""",
    ),
    "activity": (
        ["tagged"],
        f"""SELECT usr, max(dt) AS last_date, count(yr) AS frequency, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue,
        CAST(sum(amount) FILTER (valid AND yr BETWEEN {START_YEAR} AND {END_YEAR}) AS DECIMAL(18,2)) AS window_revenue,
        count(*) FILTER (valid AND yr BETWEEN {START_YEAR} AND {END_YEAR}) AS window_transactions
        FROM tagged GROUP BY usr""",
    ),
    "rfm": (
        ["activity"],
        """SELECT usr, revenue, frequency, window_revenue, window_transactions,
        date_diff('day', last_date, (SELECT max(last_date) FROM activity)) AS recency FROM activity""",
    ),
    "usr_rows": (
        [],
        """SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, 18 + c_custkey % 70 AS current_age,
        60 + c_custkey % 11 AS retirement_age, 500 + (c_custkey * 13) % 351 AS fico_score,
        1 + c_custkey % 9 AS num_credit_cards, CAST(20000 + 100 * c_nationkey AS BIGINT) AS per_capita_income,
        CAST(floor(c_acctbal + 1000) AS BIGINT) AS yearly_income, CAST(floor(abs(c_acctbal) * 10) AS BIGINT) AS total_debt
        FROM customer""",
    ),
    "card_rows": (
        [],
        """SELECT o_custkey AS usr, o_orderkey AS card_index,
        ['Amex', 'Discover', 'Mastercard', 'Visa'][CAST(o_orderkey % 4 AS INT) + 1] AS brand,
        ['Credit', 'Debit', 'Debit (Prepaid)'][CAST((o_orderkey // 3) % 3 AS INT) + 1] AS type,
        o_orderstatus <> 'P' AS chip, 1 + (o_orderkey // 9) % 3 AS issued,
        CAST(floor(o_totalprice / 10) AS BIGINT) AS credit_limit, o_orderkey % 200 = 0 AS dark
        FROM orders WHERE o_orderkey % 3 = 0""",
    ),
    "card_stats": (
        ["card_rows"],
        """SELECT usr, count(*) AS total_cards, count(*) FILTER (chip) AS total_cards_with_chips,
        CAST(sum(issued) AS BIGINT) AS total_cards_issued,
        CAST(sum(credit_limit) AS DOUBLE) / count(*) AS average_credit_limit,
        count(*) FILTER (dark) AS cards_on_dark_web,
        CAST(bool_or(brand = 'Amex') AS INT) AS amex, CAST(bool_or(brand = 'Discover') AS INT) AS discover,
        CAST(bool_or(brand = 'Mastercard') AS INT) AS mastercard, CAST(bool_or(brand = 'Visa') AS INT) AS visa,
        CAST(bool_or(type = 'Credit') AS INT) AS credit, CAST(bool_or(type = 'Debit') AS INT) AS debit,
        CAST(bool_or(type = 'Debit (Prepaid)') AS INT) AS debit_prepaid FROM card_rows GROUP BY usr""",
    ),
    "rfm_values": (
        ["rfm"],
        """SELECT axis, value, CAST(count(*) AS BIGINT) AS weight FROM (
        SELECT 'recency' AS axis, CAST(recency AS BIGINT) AS value FROM rfm
        UNION ALL SELECT 'frequency', CAST(frequency AS BIGINT) FROM rfm
        UNION ALL SELECT 'revenue', CAST(revenue * 100 AS BIGINT) FROM rfm) GROUP BY axis, value""",
    ),
    "window_values": (
        ["rfm"],
        """SELECT 'window_revenue' AS axis, CAST(window_revenue * 100 AS BIGINT) AS value, count(*) AS weight
        FROM rfm WHERE window_transactions > 0 GROUP BY value""",
    ),
    "purchase_tx": (
        [],
        """SELECT user_id AS usr, CAST(ts AS DATE) AS dt, CAST(value AS DECIMAL(18,2)) AS amount
        FROM events WHERE event_type = 'purchase'""",
    ),
    "purchase_rfm": (
        ["purchase_tx"],
        """SELECT usr, date_diff('day', max(dt), (SELECT max(dt) FROM purchase_tx)) AS recency,
        count(*) AS frequency, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue FROM purchase_tx GROUP BY usr""",
    ),
    "purchase_values": (
        ["purchase_rfm"],
        """SELECT axis, value, CAST(count(*) AS BIGINT) AS weight FROM (
        SELECT 'recency' AS axis, CAST(recency AS BIGINT) AS value FROM purchase_rfm
        UNION ALL SELECT 'frequency', CAST(frequency AS BIGINT) FROM purchase_rfm
        UNION ALL SELECT 'revenue', CAST(revenue * 100 AS BIGINT) FROM purchase_rfm) GROUP BY axis, value""",
    ),
}


def _rounds(name: str, source: str, start: str, spread: str, tolerance: float, most: int) -> str:
    """Recursive k-means rounds over (axis, value, total, weight); a fit stops once its shift is small."""
    return f"""
        SELECT axis, k, 0 AS it, cs, FALSE AS settled FROM {start}
        UNION ALL
        SELECT m.axis, k, it + 1, ncs, list_sum(list_transform(range(1, k + 1), lambda j: (ncs[j] - cs[j]) ** 2))
            <= {tolerance!r} * variance
        FROM (
            SELECT s.axis, s.k, s.it, s.cs,
                list(coalesce(CAST(c.total AS DOUBLE) / c.weight, s.cs[s.i + 1]) ORDER BY s.i) AS ncs
            FROM (SELECT axis, k, it, cs, unnest(range(k)) AS i FROM {name} WHERE NOT settled AND it < {most}) s
            LEFT JOIN (
                SELECT axis, k, cl, sum(total) AS total, sum(weight) AS weight FROM (
                    SELECT b.axis, b.k, v.total, v.weight, len(list_filter(b.borders, lambda x: x < v.value)) AS cl
                    FROM {source} v JOIN (SELECT axis, k, {_borders('cs', 'k')} AS borders FROM {name}
                        WHERE NOT settled AND it < {most}) b ON b.axis = v.axis
                ) GROUP BY axis, k, cl
            ) c ON c.axis = s.axis AND c.k = s.k AND c.cl = s.i
            GROUP BY s.axis, s.k, s.it, s.cs
        ) m JOIN {spread} USING (axis)"""


def _borders(centres: str, k: str) -> str:
    return f"list_transform(range(1, {k}), lambda j: ({centres}[j] + {centres}[j + 1]) / 2)"


def kmeans(prefix: str, values: str, wanted: list[tuple[str, int]], most: int = MAX_ITER) -> dict[str, tuple[list[str], str]]:
    """CTEs that fit each (axis, k) on `values` (axis, value, weight); the result is <prefix>_fit.

    Bins end at the plain weighted quantiles j / BINS of the axis.
    """
    p = prefix
    asked = ", ".join(f"('{axis}', {k})" for axis, k in wanted)
    return {
        f"{p}_cuts": (
            [values],
            f"""SELECT axis, list(CAST(value AS DOUBLE)) AS cuts FROM (
            SELECT axis, value, weight, sum(weight) OVER (PARTITION BY axis ORDER BY value) AS upto,
                sum(weight) OVER (PARTITION BY axis) AS n FROM {values})
            WHERE len(list_filter(range(1, {BINS}), lambda j: (j * n) // {BINS} >= upto - weight AND (j * n) // {BINS} < upto)) > 0
            GROUP BY axis""",
        ),
        f"{p}_bins": (
            [values, f"{p}_cuts"],
            f"""SELECT axis, sum(value * weight) AS total, sum(weight) AS weight,
            CAST(sum(value * weight) AS DOUBLE) / sum(weight) AS value FROM {values} v JOIN {p}_cuts c USING (axis)
            GROUP BY axis, len(list_filter(c.cuts, lambda x: x < v.value))""",
        ),
        f"{p}_spread": (
            [values],
            f"""SELECT axis, sum(weight * (value - mean) ** 2) / sum(weight) AS variance FROM (
            SELECT *, CAST(sum(value * weight) OVER (PARTITION BY axis) AS DOUBLE) / sum(weight) OVER (PARTITION BY axis) AS mean
            FROM {values}) GROUP BY axis""",
        ),
        f"{p}_start": (
            [f"{p}_bins"],
            f"""SELECT axis, k, list(value ORDER BY i) AS cs FROM (
            SELECT axis, value, weight, sum(weight) OVER (PARTITION BY axis ORDER BY value) AS upto,
                sum(weight) OVER (PARTITION BY axis) AS n FROM {p}_bins)
            JOIN (SELECT axis, k, unnest(range(k)) AS i FROM (VALUES {asked}) w(axis, k)) USING (axis)
            WHERE ((2 * i + 1) * n) // (2 * k) >= upto - weight AND ((2 * i + 1) * n) // (2 * k) < upto GROUP BY axis, k""",
        ),
        f"{p}_rough": (
            [f"{p}_bins", f"{p}_start", f"{p}_spread"],
            _rounds(f"{p}_rough", f"{p}_bins", f"{p}_start", f"{p}_spread", 0.0, most),
        ),
        f"{p}_begin": ([f"{p}_rough"], f"SELECT axis, k, arg_max(cs, it) AS cs FROM {p}_rough GROUP BY axis, k"),
        f"{p}_points": ([values], f"SELECT axis, value, value * weight AS total, weight FROM {values}"),
        f"{p}_fine": (
            [f"{p}_points", f"{p}_begin", f"{p}_spread"],
            _rounds(f"{p}_fine", f"{p}_points", f"{p}_begin", f"{p}_spread", TOLERANCE, most),
        ),
        f"{p}_fit": (
            [f"{p}_fine"],
            f"""SELECT axis, k, cs, {_borders('cs', 'k')} AS borders FROM (
            SELECT axis, k, arg_max(cs, it) AS cs FROM {p}_fine GROUP BY axis, k)""",
        ),
        f"{p}_labels": (
            [values, f"{p}_fit"],
            f"""SELECT axis, k, value, weight, cs[cl + 1] AS centre, cl,
            dense_rank() OVER (PARTITION BY axis, k ORDER BY cl) - 1 AS up,
            dense_rank() OVER (PARTITION BY axis, k ORDER BY cl DESC) - 1 AS down FROM (
            SELECT v.axis, f.k, v.value, v.weight, f.cs, len(list_filter(f.borders, lambda x: x < v.value)) AS cl
            FROM {values} v JOIN {p}_fit f USING (axis))""",
        ),
    }


_SEGMENT = "CASE WHEN overall_score <= 3 THEN 'Low-Value' WHEN overall_score <= 6 THEN 'Mid-Value' WHEN overall_score > 6 THEN 'High-Value' END"


def _scored(source: str, labels: str) -> tuple[list[str], str]:
    return (
        [source, labels],
        f"""SELECT *, {_SEGMENT} AS segment FROM (
        SELECT r.*, a.down AS recency_cluster, b.up AS frequency_cluster, c.up AS revenue_cluster,
            a.down + b.up + c.up AS overall_score
        FROM {source} r JOIN {labels} a ON a.axis = 'recency' AND a.value = r.recency
        JOIN {labels} b ON b.axis = 'frequency' AND b.value = r.frequency
        JOIN {labels} c ON c.axis = 'revenue' AND c.value = CAST(r.revenue * 100 AS BIGINT))""",
    )


_BASE |= kmeans("km", "rfm_values", [("recency", 6), ("frequency", 6), ("revenue", 6)])
_BASE["scored"] = _scored("rfm", "km_labels")
_BASE |= kmeans("lv", "window_values", [("window_revenue", 3)])
_BASE["ltv"] = (
    ["scored", "lv_labels"],
    """SELECT s.*, l.up AS ltv_cluster FROM scored s JOIN lv_labels l ON l.value = CAST(s.window_revenue * 100 AS BIGINT)
    WHERE s.window_transactions > 0""",
)
_BASE |= kmeans("el", "rfm_values", [(a, k) for a in ("recency", "revenue") for k in range(1, 10)], ELBOW_ITER)
_BASE |= kmeans("pu", "purchase_values", [("recency", 6), ("frequency", 6), ("revenue", 6)])
_BASE["purchase_scored"] = _scored("purchase_rfm", "pu_labels")
_BASE["features"] = (
    ["ltv", "usr_rows", "card_stats"],
    """SELECT l.usr, l.ltv_cluster, l.revenue, l.recency, l.frequency, l.overall_score, u.* EXCLUDE (idx),
    c.* EXCLUDE (usr, total_cards) FROM ltv l JOIN usr_rows u ON u.idx = l.usr JOIN card_stats c ON c.usr = l.usr""",
)


_ROUNDS_OF: dict[str, str] = {}


def boosted(prefix: str, rows: str, settings: Boosting, features: list[str]) -> dict[str, tuple[list[str], str]]:
    """CTEs that grow boosted trees on `rows` (m, usr, label, learns, features); the result is <prefix>_classes.

    One recursion step is one level of the trees of all models m and all three classes; it holds, for every user, the
    scores at the start of the round, those after it, and the node of each tree (-1: a leaf was reached).
    """
    p, depth, scale, lam = prefix, settings.depth, float(boosting.SCALE), f"{float(settings.penalty)!r}::DOUBLE"
    count = max(1, int(settings.columns_share * len(features)))
    least, rate = f"{float(settings.least_weight)!r}::DOUBLE", f"{settings.rate!r}::DOUBLE"
    values = " UNION ALL ".join(f"SELECT m, usr, learns, {i} AS i, CAST({name} AS DOUBLE) AS v FROM {rows}" for i, name in enumerate(features))
    sample = f"CAST('0x' || substr(md5('{settings.seed}:' || r || ':' || usr), 1, 8) AS BIGINT) < {int(settings.rows_share * HASH_RANGE)}"

    def leaf(g: str, h: str) -> str:
        return f"-({g}) / ({h} + {lam}) * {rate}"

    def placed(k: int) -> tuple[str, str]:
        """The score of a class after this level, and its node."""
        c = f"c{k}"
        low = f"bins[{c}.i + 1] <= {c}.b"
        value = f"CASE WHEN {c}.i IS NULL THEN {c}.value WHEN {low} THEN {c}.low ELSE {c}.high END"
        ends = f"{c}.node IS NOT NULL AND ({c}.i IS NULL OR last)"
        down = f"CASE WHEN {c}.i IS NULL THEN -1 ELSE 2 * n[{k + 1}] + CASE WHEN {low} THEN 1 ELSE 2 END END"
        return f"CASE WHEN {ends} THEN s[{k + 1}] + {value} ELSE t[{k + 1}] END", f"CASE WHEN {c}.node IS NULL THEN -1 ELSE {down} END"

    after = [placed(k) for k in range(3)]
    joins = " ".join(f"LEFT JOIN nodes c{k} ON c{k}.m = w.m AND c{k}.k = {k} AND c{k}.node = w.n[{k + 1}]" for k in range(3))
    _ROUNDS_OF[f"{p}_levels"] = "(m, usr, step, s, t, n)"
    return {
        f"{p}_values": ([rows], values),
        f"{p}_borders": (
            [f"{p}_values"],
            f"""SELECT m, i, list(DISTINCT v) AS borders FROM (
            SELECT m, i, v, row_number() OVER (PARTITION BY m, i ORDER BY v) AS place, count(*) OVER (PARTITION BY m, i) AS total
            FROM {p}_values WHERE learns) JOIN (SELECT unnest(range(1, {boosting.BINS})) AS j)
                ON place = (j * total + {boosting.BINS - 1}) // {boosting.BINS} GROUP BY m, i""",
        ),
        f"{p}_binned": (
            [rows, f"{p}_borders"],
            f"""SELECT m, usr, label, learns, bins FROM {rows} JOIN (
            SELECT m, usr, list(len(list_filter(borders, lambda x: x < v)) ORDER BY i) AS bins
            FROM {p}_values JOIN {p}_borders USING (m, i) GROUP BY m, usr) USING (m, usr)""",
        ),
        f"{p}_drawn": (
            [],
            f"""SELECT r, k, i FROM (
            SELECT r, k, i, row_number() OVER (PARTITION BY r, k ORDER BY md5('{settings.seed}:' || r || ':' || k || ':' || i)) AS place
            FROM (SELECT unnest(range({settings.rounds})) AS r), (SELECT unnest(range(3)) AS k), (SELECT unnest(range({len(features)})) AS i))
            WHERE place <= {count}""",
        ),
        f"{p}_levels": (
            [f"{p}_binned", f"{p}_drawn"],
            f"""SELECT m, usr, 0, [0, 0, 0]::DOUBLE[], [0, 0, 0]::DOUBLE[], [0, 0, 0] FROM {p}_binned
        UNION ALL
        SELECT m, usr, step + 1, CASE WHEN last THEN t2 ELSE s END, t2, CASE WHEN last THEN [0, 0, 0] ELSE n2 END FROM (
            WITH w AS (
                SELECT l.*, b.label, b.learns, b.bins, step // {depth} AS r, step % {depth} + 1 = {depth} AS last
                FROM {p}_levels l JOIN {p}_binned b ON b.m = l.m AND b.usr = l.usr WHERE step < {settings.rounds * depth}),
            raised AS (SELECT m, label, bins, n, r, list_transform(s, lambda x: exp(x - list_max(s))) AS e FROM w WHERE learns AND {sample}),
            shares AS (SELECT *, unnest([0, 1, 2]) AS k, 0.0::DOUBLE + e[1] + e[2] + e[3] AS total FROM raised),
            slopes AS (
                SELECT m, r, k, n[k + 1] AS node, bins,
                    CAST(floor((e[k + 1] / total - CASE WHEN label = k THEN 1 ELSE 0 END::DOUBLE) * {scale!r}::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS g,
                    CAST(floor(2 * (e[k + 1] / total) * (1 - e[k + 1] / total) * {scale!r}::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS h
                FROM shares WHERE n[k + 1] >= 0),
            cells AS (
                SELECT m, s.k, node, i, bins[i + 1] AS b, sum(g) AS g, sum(h) AS h, count(*) AS c
                FROM slopes s JOIN {p}_drawn d ON d.r = s.r AND d.k = s.k GROUP BY m, s.k, node, i, bins[i + 1]),
            upto AS (
                SELECT m, k, node, i, b, CAST(sum(g) OVER up AS DOUBLE) / {scale!r}::DOUBLE AS gl, CAST(sum(h) OVER up AS DOUBLE) / {scale!r}::DOUBLE AS hl,
                    sum(c) OVER up AS cl, CAST(sum(g) OVER whole AS DOUBLE) / {scale!r}::DOUBLE AS g,
                    CAST(sum(h) OVER whole AS DOUBLE) / {scale!r}::DOUBLE AS h, sum(c) OVER whole AS c
                FROM cells WINDOW up AS (PARTITION BY m, k, node, i ORDER BY b), whole AS (PARTITION BY m, k, node, i)),
            gains AS (
                SELECT *, gl * gl / (hl + {lam}) + (g - gl) * (g - gl) / ((h - hl) + {lam}) - g * g / (h + {lam}) AS gain FROM upto),
            chosen AS (
                SELECT m, k, node, i, b, gl, hl, row_number() OVER (PARTITION BY m, k, node ORDER BY gain DESC, i, b) AS place FROM gains
                WHERE cl < c AND hl >= {least} AND h - hl >= {least} AND gain > {boosting.LEAST_GAIN!r}::DOUBLE),
            sums AS (SELECT m, k, node, any_value(g) AS g, any_value(h) AS h FROM upto GROUP BY m, k, node),
            nodes AS (
                SELECT x.m, x.k, x.node, y.i, y.b, {leaf('g', 'h')} AS value, {leaf('gl', 'hl')} AS low, {leaf('g - gl', '(h - hl)')} AS high
                FROM sums x LEFT JOIN chosen y ON y.m = x.m AND y.k = x.k AND y.node = x.node AND place = 1)
            SELECT w.m, w.usr, w.step, w.s, w.last, [{', '.join(a for a, _ in after)}] AS t2, [{', '.join(b for _, b in after)}] AS n2
            FROM w {joins})""",
        ),
        f"{p}_classes": (
            [f"{p}_levels"],
            f"SELECT m, usr, list_position(s, list_max(s)) - 1 AS prediction FROM {p}_levels WHERE step = {settings.rounds * depth}",
        ),
    }


def add(tables: dict[str, tuple[list[str], str]]) -> None:
    """Make further table expressions known to `build`."""
    _BASE.update(tables)


def build(select: str, *needed: str) -> str:
    """The query with every table expression it needs, in order of dependence."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name not in _BASE:
            return
        for other in _BASE[name][0]:
            visit(other)
        order.append(name)

    for name in needed:
        visit(name)
    columns = "(axis, k, it, cs, settled)"
    parts = [
        f"{name}{_ROUNDS_OF[name]} AS ({_BASE[name][1]})" if name in _ROUNDS_OF
        else f"{name}{columns} AS ({_BASE[name][1]})" if "UNION ALL\n        SELECT m.axis" in _BASE[name][1]
        else f"{name} AS MATERIALIZED ({_BASE[name][1]})"
        for name in order
    ]
    return f"WITH RECURSIVE {', '.join(parts)} {select}" if parts else select
