import datetime as dt
import math
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyworth.functions import tails
from tallyworth.functions.buckets import key_bucket, key_hash
from tallyworth.functions.dates import date_of, time_text, timestamp_of
from tallyworth.functions.money import parse_money, whole_units
from tallyworth.functions.segments import value_segment


def _column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


@pytest.mark.parametrize(
    "text, value",
    [
        ("$134.09", "134.09"), ("$-38.48", "-38.48"), ("$-1,234.50", "-1234.50"), ("-$7", "-7.00"), ("", None),
        (None, None), ("abc", None), ("USD 12.5", "12.50"), ("$1e5", "15.00"), ("$ 1,000", "1000.00"), ("--5", None),
        ("$123456789012.34", "123456789012.34"), ("(4)", "4.00"),
    ],
)
def test_money(spark, text, value):
    assert _column(spark, [text], "string", parse_money("v")) == [None if value is None else Decimal(value)]


def test_whole_units_cut_towards_zero(spark):
    assert _column(spark, ["$1.70", "$-1.70", "$2,000", ""], "string", whole_units("v")) == [1, -1, 2000, None]


def test_dates_and_times(spark):
    rows = spark.createDataFrame(
        [(2001, 2, 3, "7:05"), (2001, 13, 1, "07:05"), (2001, 2, 30, "00:00"), (2000, 2, 29, "23:59:58"), (2001, 1, 1, "25:00"),
         (2001, 1, 1, None), (None, 1, 1, "01:00")],
        "y int, m int, d int, t string",
    )
    got = rows.select(date_of("y", "m", "d"), timestamp_of("y", "m", "d", "t"), time_text("t")).collect()
    assert [tuple(r) for r in got] == [
        (dt.date(2001, 2, 3), dt.datetime(2001, 2, 3, 7, 5), "07:05:00"),
        (None, None, "07:05:00"),
        (None, None, "00:00:00"),
        (dt.date(2000, 2, 29), dt.datetime(2000, 2, 29, 23, 59, 58), "23:59:58"),
        (dt.date(2001, 1, 1), None, None),
        (dt.date(2001, 1, 1), None, None),
        (None, None, "01:00:00"),
    ]


def test_segments(spark):
    names = _column(spark, [0, 3, 4, 6, 7, 15, None], "int", value_segment("v"))
    assert names == ["Low-Value"] * 2 + ["Mid-Value"] * 2 + ["High-Value"] * 2 + [None]
    assert _column(spark, [1, 2, 3], "int", value_segment("v", 1, 2)) == ["Low-Value", "Mid-Value", "High-Value"]


def test_hash_is_even_and_repeatable(spark):
    rows = spark.range(20000)
    shares = [r["count"] for r in rows.groupBy(key_bucket("id", 10, 42).alias("b")).count().collect()]
    assert len(shares) == 10 and min(shares) > 1800
    one, eight = (dict(rows.repartition(n).select("id", key_hash("id", 7)).collect()) for n in (1, 8))
    assert one == eight


@settings(max_examples=60, deadline=None)
@given(st.floats(0.01, 60), st.integers(1, 200))
def test_f_tail_agrees_with_closed_form(f, within):
    assert math.isclose(tails.f_tail_value(f, 2, within), (1 + 2 * f / within) ** (-within / 2), rel_tol=1e-8, abs_tol=1e-14)


@settings(max_examples=60, deadline=None)
@given(st.floats(0.01, 200), st.integers(1, 30))
def test_chi_square_tail_agrees_with_sum(x, half):
    total = sum(math.exp(-x / 2 + i * math.log(x / 2) - math.lgamma(i + 1)) for i in range(half))
    assert math.isclose(tails.chi_square_tail_value(x, 2 * half), total, rel_tol=1e-8, abs_tol=1e-13)


def test_tails_at_known_points():
    # Textbook 5 % points.
    assert tails.chi_square_tail_value(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert tails.f_tail_value(4.9646027437307145, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_tail_value(3.4780496907652281, 4, 10) == pytest.approx(0.05, abs=1e-9)


def test_even_chi_square_column(spark):
    points = [(0.0, 2), (3.0, 2), (50.0, 48), (3000.0, 4)]
    rows = spark.createDataFrame(points, "x double, df bigint")
    got = [r[0] for r in rows.select(tails.chi_square_tail_even(F.col("x"), F.col("df"))).collect()]
    assert got == pytest.approx([tails.chi_square_tail_value(x, d) for x, d in points], rel=1e-10, abs=1e-300)
