"""Grouping operators: mode per key (A10), total rows by grouping sets (A7/A8),
distinct lists (A6)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mode_per_key(df: DataFrame, key: str, value: str, count_col: str = "n") -> DataFrame:
    """A10: most frequent non-NULL ``value`` per ``key``; ties -> smallest value.

    Counting is a partial hash aggregate; the pick is ``min(struct(-count, value))``
    per key, again partial, so a key with many distinct values never meets in
    one window.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias(count_col))
    best = counted.groupBy(key).agg(F.min(F.struct((-F.col(count_col)).alias("_neg"), F.col(value).alias("_v"))).alias("_m"))
    return best.select(key, F.col("_m._v").alias(value), (-F.col("_m._neg")).alias(count_col))


def sorted_distinct_list(col: str | Column, sep: str = ",") -> Column:
    """A6 ``group_concat``: apply to rows already made distinct per (key, value)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.array_sort(F.collect_list(c)), sep)


def with_total_row(df: DataFrame, keys: Sequence[str], measures: dict[str, Column],
                   label_col: str, label: str = "Total") -> DataFrame:
    """Per-key aggregates plus one grand-total row in a single aggregation
    (``GROUPING SETS ((keys), ())``) instead of ``q UNION SELECT sum(..) FROM (q)``.

    Key columns of the total row are blank; ``label_col`` is ``label`` there and
    NULL on the per-key rows. (Use it where the total is the sum of the inputs;
    where the reference totals already-rounded group values, sum the groups.)
    """
    aggs = [m.alias(n) for n, m in measures.items()]
    full = (1 << len(keys)) - 1
    grouped = (df.rollup(*keys).agg(*aggs, F.grouping_id().alias("_gid"))
               .filter((F.col("_gid") == 0) | (F.col("_gid") == full)))
    is_total = F.col("_gid") == full
    out = grouped.select(
        *[F.when(is_total, F.lit("")).otherwise(F.col(k).cast("string")).alias(k) for k in keys],
        *measures.keys(),
        F.when(is_total, F.lit(label)).alias(label_col))
    return out
