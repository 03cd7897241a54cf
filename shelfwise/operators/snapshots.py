"""Snapshot operators.

A snapshot table appends one copy of its rows per day/month; reports read the
latest copy, or compare it with the one before. The latest day is an
uncorrelated scalar subquery (one aggregate, evaluated once, its value
broadcast) -- never a collect to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_day(df: DataFrame, day_col: str) -> Column:
    return df.agg(F.max(day_col)).scalar()


def previous_day(df: DataFrame, day_col: str) -> Column:
    """The greatest day that is not the latest day."""
    return df.filter(F.col(day_col) < latest_day(df, day_col)).agg(F.max(day_col)).scalar()


def latest_snapshot(df: DataFrame, day_col: str) -> DataFrame:
    """Rows of the latest snapshot (``d = (select max(d) from t)``)."""
    return df.filter(F.col(day_col) == latest_day(df, day_col))


def previous_snapshot(df: DataFrame, day_col: str) -> DataFrame:
    return df.filter(F.col(day_col) == previous_day(df, day_col))


def new_vs_carried(latest: DataFrame, previous: DataFrame, key: str, flag_col: str = "new_flag") -> DataFrame:
    """Flag rows of ``latest`` whose key is absent from ``previous`` ('Y') or present ('N').

    One left join to the distinct previous keys replaces
    ``.. EXISTS .. 'N' UNION .. NOT EXISTS .. 'Y'`` (two passes plus a distinct).
    """
    prev_keys = previous.select(F.col(key).alias("_pk")).distinct()
    return (latest.join(prev_keys, latest[key] == prev_keys["_pk"], "left")
            .withColumn(flag_col, F.when(F.col("_pk").isNull(), F.lit("Y")).otherwise(F.lit("N")))
            .drop("_pk"))
