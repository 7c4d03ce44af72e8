"""Money in decimals: rounding, shares and validated parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, digits: int = 2) -> Column:
    return F.round(c, digits).cast(f"decimal(18,{digits})")


def half_even(c: Column, digits: int = 2) -> Column:
    return F.bround(c, digits).cast(f"decimal(18,{digits})")


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100 to two digits, half up; null where whole is 0."""
    return half_up(F.try_divide(part.cast("decimal(18,2)") * 100, whole.cast("decimal(18,2)")))


def average(total: Column, n: Column) -> Column:
    return half_up(F.try_divide(total.cast("decimal(28,2)"), n))


def parsed_date(c: Column) -> Column:
    """ISO dates only; null otherwise."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def parsed_quantity(c: Column) -> Column:
    """Whole numbers above 0; null otherwise."""
    n = F.trim(c).try_cast("int")
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$") & (n > 0), n)


def parsed_price(c: Column, most: str = "999999999999.99") -> Column:
    """Finite decimals from 0 up to `most` with at most two digits behind the point; null otherwise."""
    n = F.trim(c).try_cast("decimal(38,10)")
    return F.when((n >= 0) & (n <= F.lit(most).cast("decimal(38,10)")) & (n == F.round(n, 2)), n).cast("decimal(14,2)")


def parsed_currency(c: Column, default: str = "PKR") -> Column:
    """The default for blank text, and for its own name; null otherwise."""
    t = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t == "", default).when(t == default, t)
