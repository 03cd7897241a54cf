"""Merge semantics of keyed loads (M1-M4, M6, M7, M9, M10) as DataFrame plans.

Parquet has no MERGE: every merge computes the new table version as a
DataFrame (join + union) and the caller writes it as a new version
(``write_version``), which readers find as the newest. Keys are joined, never collected.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align_insert(target: DataFrame, stage: DataFrame) -> DataFrame:
    """M1: insert-select with an explicit column list; absent columns take NULL."""
    cols = [F.col(c) if c in stage.columns else F.lit(None).cast(target.schema[c].dataType).alias(c)
            for c in target.columns]
    return stage.select(*cols)


def replace_by_key(target: DataFrame, stage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M2 (``txt``) / M6: delete target rows whose key is staged, insert the staged rows."""
    staged = align_insert(target, stage)
    kept = target.join(staged.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(staged)


def replace_by_key_once(target: DataFrame, stage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M6: the rows of ``replace_by_key`` for a stage that is costly to compute (tables parsed from messages).

    The anti join there computes the stage twice, for its keys and for its rows. Here target and stage rows meet in one shuffle
    by the key and a target row goes where its key holds a staged row. As in the join, a key with a NULL matches nothing."""
    rows = (target.withColumn("_staged", F.lit(False))
            .unionByName(align_insert(target, stage).withColumn("_staged", F.lit(True))))
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    replaced = F.max(F.col("_staged") & whole).over(Window.partitionBy(*keys))
    return rows.withColumn("_replaced", replaced).filter(F.col("_staged") | ~F.col("_replaced")).select(*target.columns)


def update_by_key(target: DataFrame, stage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M3 (``upd``): for matching keys, overwrite the non-key columns present in the stage
    (a NULL in the stage overwrites); unmatched stage rows are not inserted."""
    upd_cols = [c for c in stage.columns if c not in keys and c in target.columns]
    # One staged row per key (as an UPDATE ... JOIN touches each target row once): a key
    # staged twice must not duplicate target rows. Callers that know the line order
    # resolve duplicates first (last line wins); otherwise the pick is the max row.
    picked = stage.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in upd_cols])).alias("_v")) if upd_cols         else stage.select(*keys).distinct()
    s = (picked.select(*keys, *[F.col(f"_v.{c}").alias(f"_s_{c}") for c in upd_cols])
         .withColumn("_hit", F.lit(True)))
    joined = target.join(s, list(keys), "left")
    out = [F.when(F.col("_hit"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in upd_cols else F.col(c)
           for c in target.columns]
    return joined.select(*out)


def truncate_load(target: DataFrame, stage: DataFrame) -> DataFrame:
    """M4 (``trunc``): the table becomes exactly the staged rows."""
    return align_insert(target, stage)


def _null_as_empty(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def diff_merge(current: DataFrame, staged: DataFrame, key: str, compare: Sequence[str],
               src_col: str | None = None) -> DataFrame:
    """M7: staged rows identical to a current row on ``compare`` (NULL == '') are dropped;
    current rows of the remaining staged keys are deleted; the remainder is inserted.

    ``src_col`` (optional) marks each result row 'current' or 'staged'.
    """
    sig_cols = [key, *compare]
    cur_sig = current.select(*[_null_as_empty(c).alias(f"_c{i}") for i, c in enumerate(sig_cols)]).distinct()
    stg = staged.select(*current.columns)
    stg_sig = stg.select("*", *[_null_as_empty(c).alias(f"_c{i}") for i, c in enumerate(sig_cols)])
    changed = stg_sig.join(cur_sig, [f"_c{i}" for i in range(len(sig_cols))], "left_anti").select(*current.columns)
    kept = current.join(changed.select(key).distinct(), key, "left_anti")
    if src_col:
        return (kept.withColumn(src_col, F.lit("current"))
                .unionByName(changed.withColumn(src_col, F.lit("staged"))))
    return kept.unionByName(changed)


def update_from_group(dim: DataFrame, source: DataFrame, key: str, attr: str, source_attr: str) -> DataFrame:
    """M9: dimension attribute := max(non-empty source value) per key, else unchanged."""
    agg = (source.filter(F.col(source_attr).isNotNull() & (F.trim(F.col(source_attr)) != ""))
           .groupBy(F.col(key).alias("_k")).agg(F.max(source_attr).alias("_new")))
    return (dim.join(agg, dim[key] == agg["_k"], "left")
            .withColumn(attr, F.coalesce(F.col("_new"), F.col(attr))).drop("_k", "_new"))


def stamp(control: DataFrame, key: str, key_value, col: str, value: Column) -> DataFrame:
    """Set ``col`` on the control row(s) of ``key_value``."""
    return control.withColumn(col, F.when(F.col(key) == F.lit(key_value), value).otherwise(F.col(col)))


def apply_mode(target: DataFrame, stage: DataFrame, keys: Sequence[str], mode: str) -> DataFrame:
    """Dispatch by the drop-file mode: ``txt`` replace, ``upd`` update, ``trunc`` truncate."""
    if mode == "txt":
        return replace_by_key(target, stage, keys)
    if mode == "upd":
        return update_by_key(target, stage, keys)
    if mode == "trunc":
        return truncate_load(target, stage)
    raise ValueError(f"unknown load mode {mode}")


def write_version(df: DataFrame, table_dir: str, version: int, partition_by: Sequence[str] = (), load: str | None = None) -> str:
    """Write a merge result as ``<table_dir>/v=<version>[.load=<load>]``.

    Rows are written aside and the finished folder is renamed, so a version and the mark of the load that made it (a part of
    its name) appear in one step: after a crash either both are there or neither is."""
    from shelfwise.session import fs_exists, fs_rename

    spark = df.sparkSession
    base = table_dir.rstrip("/")
    path = f"{base}/v={version:08d}" + (f".load={load}" if load else "")
    aside = f"{base}/_writing/{uuid.uuid4().hex}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(aside)
    if fs_exists(spark, path) or not fs_rename(spark, aside, path):
        raise OSError(f"{path} cannot be written: another version has its place")
    return path


def _versions(spark, table_dir: str) -> list[str]:
    """Names of the completely written versions, oldest first (the folder is listed, nothing is read)."""
    from shelfwise.session import fs_exists, fs_list

    return [name for p in fs_list(spark, table_dir) if (name := p.rsplit("/", 1)[-1]).startswith("v=") and fs_exists(spark, p + "/_SUCCESS")]


def latest_version(spark, table_dir: str) -> str | None:
    """Path of the newest completely written version under ``table_dir``."""
    names = _versions(spark, table_dir)
    return f"{table_dir.rstrip('/')}/{names[-1]}" if names else None


def version_number(path: str) -> int:
    return int(path.rsplit("v=", 1)[1].split(".", 1)[0])


def version_of_load(spark, table_dir: str, load: str) -> str | None:
    """Path of the version that a load made, or None when it has not been committed."""
    found = [n for n in _versions(spark, table_dir) if n.endswith(f".load={load}")]
    return f"{table_dir.rstrip('/')}/{found[0]}" if found else None
