"""Money, ratio and percent expressions.

Rules that keep results identical to an ANSI SQL oracle:
* money is summed as DECIMAL(18,2) (exact), then exposed as DOUBLE;
* a ratio is a DOUBLE division (IEEE, same bits in every engine), NULL on a
  zero or NULL divisor (``try_divide``; MySQL also yields NULL);
* rounding goes through DECIMAL(38,10) and HALF_UP, never ``round`` on a double
  (engines disagree on doubles such as 0.285).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(MONEY)


def as_double(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("double")


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as DOUBLE; NULL when den is 0 or NULL (no ANSI error)."""
    return F.try_divide(as_double(num), as_double(den))


def round_half_up(col: str | Column, digits: int) -> Column:
    """HALF_UP rounding through an exact decimal; result is DECIMAL(38, digits)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("decimal(38,10)"), digits).cast(f"decimal(38,{digits})")


def rounded_double(col: str | Column, digits: int) -> Column:
    return round_half_up(col, digits).cast("double")


def percent_text(num: str | Column, den: str | Column, digits: int, scale: float = 100.0) -> Column:
    """``concat(round(scale*num/den, digits), '%')`` with a pinned number of decimals."""
    value = round_half_up(ratio(num, den) * F.lit(scale), digits)
    return F.concat(value.cast("string"), F.lit("%"))


def thousands(col: str | Column) -> Column:
    """``format(x, 0)`` -- HALF_UP to an integer, then comma grouping."""
    c = F.col(col) if isinstance(col, str) else col
    return F.format_number(F.round(c.cast("decimal(38,2)"), 0), 0)


def cents(col: str | Column) -> Column:
    """Money as BIGINT cents, exact (through DECIMAL(18,2)): sums over it use a
    fixed-width hash-aggregate buffer instead of a wide DECIMAL one."""
    return (money(col) * F.lit(100)).cast("bigint")


def from_cents(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return (c.cast("decimal(20,0)") / F.lit(100)).cast("decimal(20,2)")


def money_sum(col: str | Column) -> Column:
    """Exact SUM of a money column (NULL when every input is NULL), as DECIMAL(20,2)."""
    return from_cents(F.sum(cents(col)))
