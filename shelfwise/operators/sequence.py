"""Gap-free sequence numbers per group, without one task per group.

``row_number()`` over ``partitionBy(group)`` sends a whole group to one task.
Here rows are range-partitioned on (group, order); each task numbers its own
slice of a group, and a small table of per-(group, slice) counts gives each
slice its offset. A range partition holds a bounded share of the data, so a
group holding a third of all rows is numbered by many tasks.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import cut_lineage


def group_sequence(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "seq",
                   num_partitions: int | None = None) -> DataFrame:
    """Number rows 1..n within each group in ``order`` (make ``order`` unique in a group); a NULL group is a group.

    The ranged rows are checkpointed: slices are counted and numbered on the same
    partitions, whatever bounds a second range shuffle would have sampled.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *[F.col(c) for c in (*group, *order)])
                         .withColumn("_slice", F.spark_partition_id()))
    w_local = Window.partitionBy(*group, "_slice").orderBy(*order)
    local = ranged.withColumn("_rn", F.row_number().over(w_local))
    # One row per (group, slice).
    counts = ranged.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_cnt"))
    w_off = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_slice").alias("_o_slice"), *[F.col(c).alias(f"_o_{c}") for c in group],
                            F.coalesce(F.sum("_cnt").over(w_off), F.lit(0)).alias("_off"))
    same = F.col("_slice") == F.col("_o_slice")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return (local.join(offsets, same).withColumn(out, (F.col("_rn") + F.col("_off")).cast("bigint"))
            .select(*df.columns, out))
