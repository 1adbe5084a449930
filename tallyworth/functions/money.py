"""Money text to decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def parse_money(column: str | Column) -> Column:
    """`$-1,234.50` to -1234.50; text that holds no number becomes null.

    Everything but digits, signs and the point is dropped. Nearly all values need only the marks `$` and
    `,` removed, which `translate` does far faster than a pattern; the pattern runs on the rest alone.
    (`e` goes as well, or `1e5` would be read as an exponent on one way and as 15 on the other.)
    """
    text = F.col(column) if isinstance(column, str) else column
    plain = F.translate(text, "$,eE", "").try_cast(MONEY)
    return F.coalesce(plain, F.regexp_replace(text, r"[^-+0-9.]", "").try_cast(MONEY))


def whole_units(column: str | Column) -> Column:
    """Whole currency units of money text, cut towards zero."""
    money = parse_money(column)
    return F.when(money < 0, F.ceil(money)).otherwise(F.floor(money)).cast("bigint")
