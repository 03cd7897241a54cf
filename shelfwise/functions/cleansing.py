"""Type-aware cleansing of text cells (T7) and rate parsing.

``clean_cast(col, type_name)`` builds one column expression per target type --
no UDF, evaluated inside whole-stage codegen. Every branch is a ``try_*``
function, so a bad cell becomes NULL instead of failing the job (ANSI mode).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six accepted date forms, in the order the reference tries them.
DATE_FORMS = (
    (r"^\d{1,2}-\w{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}-\w{3}-\d{2}$", "d-MMM-yy"),     # two-digit year -> 20yy
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
)
# Unsigned number followed by '%' (F17 / T7e).
PERCENT_RE = r"^([0-9]*\.?[0-9]+|[0-9]+\.?[0-9]*)%$"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_date(col: str | Column) -> Column:
    """First matching form wins; impossible days (31 Feb, month 13) -> NULL."""
    s = F.trim(_c(col))
    out = None
    for pattern, fmt in DATE_FORMS:
        if fmt == "d-MMM-yy":
            parsed = F.try_to_date(F.concat(F.regexp_extract(s, r"^(\d{1,2}-\w{3}-)", 1), F.lit("20"),
                                            F.regexp_extract(s, r"(\d{2})$", 1)), "d-MMM-yyyy")
        else:
            parsed = F.try_to_date(s, fmt)
        out = F.when(s.rlike(pattern), parsed) if out is None else out.when(s.rlike(pattern), parsed)
    return out


def parse_int(col: str | Column) -> Column:
    """T7d: whole number or NULL (' 5 ' and '+5' accepted, '5.7' rejected)."""
    return _c(col).try_cast("bigint")


def parse_number(col: str | Column) -> Column:
    """T7e: 'x%' -> x * 0.01 (unsigned only); else a number rounded to 10 places; else NULL."""
    s = F.trim(_c(col))
    pct = F.regexp_extract(s, PERCENT_RE, 1)
    plain = F.when(~s.contains("%"), s.try_cast("double"))
    return (F.when(pct != "", pct.try_cast("double") * F.lit(0.01))
            # Beyond the decimal's range there are no places to round: the double stands as it is.
            .otherwise(F.coalesce(F.round(plain.try_cast("decimal(38,12)"), 10).cast("double"), plain)))


def parse_decimal(col: str | Column, type_name: str) -> Column:
    """T7e for fixed-scale targets: the exact value, rounded half up to the scale, without a detour by a double;
    'x%' -> x / 100; out of range -> NULL."""
    s = F.trim(_c(col))
    pct = F.regexp_extract(s, PERCENT_RE, 1)
    share = (pct.try_cast("decimal(26,10)") * F.lit("0.01").cast("decimal(2,2)"))
    return F.when(pct != "", share.try_cast(type_name)).otherwise(F.when(~s.contains("%"), s.try_cast(type_name)))


def rate_value(col: str | Column) -> Column:
    """'50%' -> 0.5, '0.35' -> 0.35, anything else -> NULL (exact decimal)."""
    s = F.trim(_c(col))
    pct = F.regexp_extract(s, PERCENT_RE, 1)
    return (F.when(pct != "", pct.try_cast("decimal(18,6)") * F.lit(0.01).cast("decimal(3,2)"))
            .otherwise(s.try_cast("decimal(18,6)")).cast("decimal(18,6)"))


def clean_cast(col: str | Column, type_name: str) -> Column:
    """Dispatch on the target column's declared type.

    * char/varchar/text: value kept as is, '' stays '' (T7a);
    * any other type: '' -> NULL (T7b), then date (T7c), datetime/timestamp (T7f),
      integer family (T7d), exact decimal with a declared scale, or number (T7e).
    """
    t = type_name.lower()
    c = _c(col)
    if _is_text(t):
        return c
    v = F.nullif(c, F.lit(""))
    if "datetime" in t or "timestamp" in t:
        return F.try_to_timestamp(v)
    if t == "date":
        return parse_date(v)
    if "int" in t:
        return parse_int(v)
    exact = decimal_type(t)
    return parse_decimal(v, exact) if exact else parse_number(v)


def _is_text(t: str) -> bool:
    return "char" in t or "text" in t or t == "string"


def decimal_type(type_name: str) -> str | None:
    """``decimal(p,s)`` / ``numeric(p,s)`` as Spark's type; None for other types."""
    found = re.match(r"(?:decimal|numeric)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", type_name.lower())
    return f"decimal({found[1]},{found[2] or 0})" if found else None


def spark_type_for(type_name: str) -> str:
    t = type_name.lower()
    if _is_text(t):
        return "string"
    if "datetime" in t or "timestamp" in t:
        return "timestamp"
    if t == "date":
        return "date"
    if "int" in t:
        return "bigint"
    return decimal_type(t) or "double"
