"""Date rules (F8, F9, F10, F15, F21, F22, F28) as column expressions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def week_sunday(col: str | Column) -> Column:
    """``week(d)`` default mode -- weeks start on Sunday, days before the first
    Sunday of the year are week 0 (range 0-53). ``weekofyear`` is ISO and differs."""
    d = _c(col)
    return F.floor((F.dayofyear(d) + F.lit(6) - (F.dayofweek(d) - F.lit(1))) / F.lit(7)).cast("bigint")


def week_monday(col: str | Column) -> Column:
    """F28 helper: ``%W`` -- weeks start on Monday, days before the first Monday are week 0."""
    d = _c(col)
    monday_based = (F.dayofweek(d) + F.lit(5)) % F.lit(7)   # 0 = Monday
    return F.floor((F.dayofyear(d) + F.lit(6) - monday_based) / F.lit(7)).cast("bigint")


def week_stamp(col: str | Column) -> Column:
    """output name suffix ``<yyyy>wk<WW>`` (Monday weeks, two digits)."""
    d = _c(col)
    return F.concat(F.date_format(d, "yyyy"), F.lit("wk"), F.lpad(week_monday(d).cast("string"), 2, "0"))


def yyyymmdd(col: str | Column) -> Column:
    """F8: ``date_format(d, '%Y%m%d')``."""
    return F.date_format(_c(col), "yyyyMMdd")


def age_days(col: str | Column, as_of: str | _dt.date) -> Column:
    """``datediff(as_of, d)`` with an explicit as-of day (F10: runs are reproducible)."""
    return F.datediff(F.lit(as_of).cast("date") if isinstance(as_of, str) else F.lit(as_of), _c(col))


# F15 fixed values: the reference reads ``Mon, 3 Jul 2017 10:00:00`` style headers,
# ignores the zone offset and adds a fixed 8 hours.
RFC_DATE_PATTERN = r"\w+, (\d{1,2}) (\w+) (\d{4}) (\d{2}:\d{2}:\d{2})"
FIXED_SHIFT_HOURS = 8


def parse_message_date(header: str | Column, shift_hours: int = FIXED_SHIFT_HOURS) -> Column:
    """day-month-year time out of an RFC 2822 date header, offset ignored, + shift."""
    h = _c(header)
    parts = [F.regexp_extract(h, RFC_DATE_PATTERN, i) for i in (1, 2, 3, 4)]
    core = F.concat_ws(" ", *parts)
    ts = F.try_to_timestamp(F.when(parts[0] != "", core), F.lit("d MMM yyyy HH:mm:ss"))
    return ts + F.make_interval(hours=F.lit(shift_hours))


def infer_year_month_day(text: str | Column, as_of: str) -> Column:
    """``m/d`` gets the as-of year, or the next year when its month is more than
    six months away from the as-of month; ``m/d/yyyy`` is taken as written."""
    s = F.trim(_c(text))
    full = F.try_to_date(s, "M/d/yyyy")
    m = F.regexp_extract(s, r"^(\d{1,2})/(\d{1,2})$", 1)
    d = F.regexp_extract(s, r"^(\d{1,2})/(\d{1,2})$", 2)
    as_of_d = F.lit(as_of).cast("date")
    year = F.when(F.abs(m.cast("int") - F.month(as_of_d)) > 6, F.year(as_of_d) + 1).otherwise(F.year(as_of_d))
    short = F.when(m != "", F.try_to_date(F.concat_ws("-", year.cast("string"), m, d), "yyyy-M-d"))
    return F.coalesce(full, short)


def date_lit(text: str) -> Column:
    """A DATE literal from either spelling the reports use, ``2017-01-01`` or
    ``20170101`` (comparing a DATE column with ``'20170101'`` raises under ANSI)."""
    t = text.strip()
    if len(t) == 8 and t.isdigit():
        t = f"{t[:4]}-{t[4:6]}-{t[6:]}"
    return F.lit(_dt.date.fromisoformat(t))
