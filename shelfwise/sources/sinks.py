"""Report and table sinks.

Everything is a DataFrame writer; paths are partitioned so one run, one report
and one sheet land in their own folder and can be replaced alone.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import fs_delete, fs_list, fs_rename, fs_size


def run_stamp(now: _dt.datetime | None = None) -> str:
    """Output folder stamp ``%Y-%m-%d-%H%M``."""
    return (now or _dt.datetime.now(_dt.timezone.utc)).strftime("%Y-%m-%d-%H%M")


def sheet_ready(df: DataFrame) -> DataFrame:
    """NULL -> '' and dates/timestamps/numbers -> text, as a spreadsheet shows them."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


COMPRESS_ABOVE_BYTES = 5 * 1024 * 1024   # S20: the reference compresses outputs over 5 MB


def write_report(df: DataFrame, base: str, report: str, sheet: str, run: str, fmt: str = "csv",
                 compress: bool | str = "auto", partition_by: Sequence[str] = (),
                 compress_above: int = COMPRESS_ABOVE_BYTES) -> str:
    """``<base>/run_ts=<run>/report=<r>/sheet=<s>/``.

    ``partition_by`` gives one output folder per key (e.g. promotion and vendor, S22) from a single job instead of one query
    per key. ``compress="auto"`` gzips the CSV outputs that were written with more than ``compress_above`` bytes, each key's
    folder by its own size; the others stay as they are.
    """
    path = f"{base.rstrip('/')}/run_ts={run}/report={report}/sheet={sheet}"
    cells = [c for c in df.columns if c not in partition_by]
    # Keys name folders: they are not cells, and a NULL key keeps its own folder.
    out = sheet_ready(df.select(*cells, *[F.col(c).alias(f"_key_{k}") for k, c in enumerate(partition_by)])) if fmt == "csv" else df
    if fmt == "csv":
        out = out.select(*cells, *[F.nullif(f"_key_{k}", F.lit("")).alias(c) for k, c in enumerate(partition_by)])
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
        if compress is True:
            w = w.option("compression", "gzip")
        w.csv(path)
        if compress == "auto":
            compress_large(df.sparkSession, path, cells, partition_by, compress_above)
    else:
        w.parquet(path)
    return path


def compress_large(spark: SparkSession, path: str, cells: Sequence[str], partition_by: Sequence[str] = (),
                   above: int = COMPRESS_ABOVE_BYTES) -> list[str]:
    """Gzips the outputs under ``path`` (one folder per key, or ``path`` itself) whose files hold more than ``above`` bytes.

    Sizes are those of the written files. All large outputs are rewritten by one job beside ``path`` and then renamed into
    their places. Returns the folders that were compressed."""
    large = [leaf for leaf in _leaves(spark, path, len(partition_by)) if fs_size(spark, leaf) > above]
    if not large:
        return []
    schema = ", ".join(f"`{c}` string" for c in [*cells, *partition_by])
    # Cells hold no NULL (sheet_ready): nothing that was written reads as one.
    rows = (spark.read.schema(schema).option("header", True).option("multiLine", True).option("nullValue", "\u0000")
            .option("basePath", path).csv(large))
    aside = f"{path}-{uuid.uuid4().hex}"
    w = rows.write.option("header", True).option("compression", "gzip")
    (w.partitionBy(*partition_by) if partition_by else w).csv(aside)
    for leaf in large:
        new = aside + leaf[len(path):]
        fs_delete(spark, leaf)
        fs_rename(spark, new, leaf)
    fs_delete(spark, aside)
    return large


def _leaves(spark: SparkSession, path: str, depth: int) -> list[str]:
    """The folders ``depth`` levels below ``path`` (names only, nothing is read)."""
    level = [path]
    for _ in range(depth):
        level = [f"{folder}/{p.rsplit('/', 1)[-1]}" for folder in level for p in fs_list(spark, folder) if "=" in p.rsplit("/", 1)[-1]]
    return level


def append_audit(df: DataFrame, path: str) -> None:
    """Append rows to the audit log table."""
    df.write.mode("append").parquet(path)


def write_day_partition(df: DataFrame, path: str, day_col: str = "ss_day") -> None:
    """M8: idempotent daily history -- dynamic partition overwrite replaces only the days
    present in ``df``; re-running a day leaves the other days untouched."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(day_col).parquet(path))


def export_tables(tables: dict[str, DataFrame], base: str, day: str) -> list[str]:
    """Daily export of the listed tables to ``<base>/<table>/dt=<day>``."""
    out = []
    for name, df in tables.items():
        p = f"{base.rstrip('/')}/{name}/dt={day}"
        df.write.mode("overwrite").parquet(p)
        out.append(p)
    return out


def expired_exports(spark, base: str, table: str, as_of: str, keep_days: int = 7) -> list[str]:
    """S24 retention: ``dt=`` folders of ``table`` older than ``keep_days`` (listed, not read)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{table}")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    limit = _dt.date.fromisoformat(as_of) - _dt.timedelta(days=keep_days)
    old = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if name.startswith("dt=") and _dt.date.fromisoformat(name[3:]) < limit:
            old.append(st.getPath().toString())
    return old
