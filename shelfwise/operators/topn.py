"""Top-N, running-share and latest-row operators.

All of them partition their windows by a group key, never a single global
window. Row-number filters of the form ``rn <= k`` let Catalyst insert a
``WindowGroupLimit`` below the shuffle, so each map task forwards at most k
rows per group and a hot group cannot flood one reducer.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ColLike = str | Column


def _cols(cols: Sequence[ColLike]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[ColLike], k: int,
                    rn_col: str = "rn") -> DataFrame:
    """Rows ranked 1..k per group under a total order (give ``order`` a unique tie-break)."""
    w = Window.partitionBy(*group).orderBy(*_cols(order))
    return df.withColumn(rn_col, F.row_number().over(w)).filter(F.col(rn_col) <= k)


def running_share_cut(df: DataFrame, group: Sequence[str], order: Sequence[ColLike],
                      share_col: str, threshold: float = 0.8, max_rows: int = 10,
                      rn_col: str = "rn", cum_col: str = "cum_share") -> DataFrame:
    """Keep rows in order until the running share passes ``threshold``.

    The row that crosses the threshold is kept; at most ``max_rows`` rows per
    group. Equivalent to: keep rows whose share sum over *earlier* rows is
    <= threshold. The limit is applied first (partial top-k before the shuffle),
    the running sum then only sees <= max_rows rows per group.
    """
    limited = top_k_per_group(df, group, order, max_rows, rn_col)
    w = Window.partitionBy(*group).orderBy(F.col(rn_col))
    prior = F.sum(share_col).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (limited
            .withColumn("_prior", F.coalesce(prior, F.lit(0).cast(limited.schema[share_col].dataType)))
            .filter(F.col("_prior") <= F.lit(threshold))
            .withColumn(cum_col, F.col("_prior") + F.col(share_col))
            .drop("_prior"))


def best_per_group(df: DataFrame, group: Sequence[str], value_col: str) -> DataFrame:
    """Rows holding the group maximum of ``value_col``, ties kept.

    Group max by hash aggregation (map-side partial), then an equi-join back on
    (group, value): no window has to hold a whole group.
    """
    mx = df.groupBy(*group).agg(F.max(value_col).alias("_best"))
    return (df.join(mx, [*group], "inner")
            .filter(F.col(value_col) == F.col("_best"))
            .drop("_best"))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The one row per key that is greatest under ``order`` (lexicographic).

    Implemented as ``max(struct(order..., rest...))`` in a hash aggregate: partial
    aggregation keeps one candidate per key per map task, so a key holding a third
    of all rows still ships only a handful of rows. Put a unique column last in
    ``order`` to make the pick deterministic.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])).alias("_w")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in [*order, *rest]])


def priority_first(df: DataFrame, keys: Sequence[str], priority_col: str,
                   tie_break: Sequence[str]) -> DataFrame:
    """One row per key from the highest-priority source (lowest number wins).

    Same aggregate trick as :func:`latest_per_key`, with ``min`` over
    struct(priority, tie_break...): the smallest priority, then earliest tie-break.
    """
    rest = [c for c in df.columns if c not in keys and c not in (priority_col, *tie_break)]
    # A missing priority ranks last (NULL would otherwise sort first in a struct minimum).
    rank = F.coalesce(F.col(priority_col).cast("bigint"), F.lit(2 ** 62).cast("bigint")).alias("_rank")
    packed = F.min(F.struct(rank, *[F.col(c) for c in tie_break], F.col(priority_col),
                            *[F.col(c) for c in rest])).alias("_w")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in [priority_col, *tie_break, *rest]])


def row_numbered(df: DataFrame, group: Sequence[str], order: Sequence[ColLike],
                 rn_col: str = "rn") -> DataFrame:
    """Row number in result order, per group (a report edge: bounded groups)."""
    w = Window.partitionBy(*group).orderBy(*_cols(order))
    return df.withColumn(rn_col, F.row_number().over(w))


def cap_rows(df: DataFrame, cap: int = 1000) -> tuple[DataFrame, bool]:
    """The reference replaces results over ``cap`` rows with a notice.

    Probes ``cap + 1`` rows only (a bounded ``limit``), never the full result.
    Returns (df, fits) where fits tells whether the inline rendering may be used.
    """
    fits = df.limit(cap + 1).count() <= cap
    return df, fits


def inline_or_notice(df: DataFrame, cap: int = 1000) -> DataFrame:
    """L7 as a frame: ``df`` with a null ``notice``; over ``cap`` rows a single row that only holds the notice."""
    probe = df.limit(cap + 1).agg(F.count(F.lit(1)).alias("_n"))
    shown = df.withColumn("notice", F.lit(None).cast("string")).filter(probe.scalar() <= cap)
    over = probe.filter(F.col("_n") > cap).select(F.lit(f"more than {cap} rows").alias("notice"))
    return shown.unionByName(over, allowMissingColumns=True)
