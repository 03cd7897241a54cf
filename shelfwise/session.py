"""Session construction and lineage helpers.

Cluster settings (shuffle partitions, executor memory, checkpoint folder) come
from the submitting environment: an existing session is used as it is, and a
new one only gets the defaults below. The same code runs under ``local[8]``
tests and on a cluster without edits.

Suggested cluster settings at 100 TB (not forced here): AQE on with
``spark.sql.adaptive.advisoryPartitionSizeInBytes`` around 256 MB and a high
initial ``spark.sql.shuffle.partitions`` that AQE coalesces;
``spark.sql.files.maxPartitionBytes`` 256-512 MB; ``spark.checkpoint.dir`` on the
shared file system.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. They are defaults: a value already present in
# the session (spark-submit --conf, cluster defaults) wins.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HTML bodies can be large: smaller Arrow batches bound the memory of mapInPandas parsing.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "shelfwise", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """The active session untouched (a cluster's own settings win), else a new one
    built with ``DEFAULT_CONF``."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; it is only set here when
    missing in local mode (tests), to a fresh scratch folder. On a cluster a folder
    of one machine is of no use to the others, so there a missing setting is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="shelfwise-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # some deployments refuse runtime changes of core settings
            pass
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fs_exists(spark: SparkSession, path: str) -> bool:
    """Existence check on any Hadoop file system (shared folders, not the local disk)."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def fs_write_text(spark: SparkSession, path: str, text: str) -> None:
    """Small marker / manifest file on the shared file system."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def fs_read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text; None where there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        return bytes(source.readAllBytes()).decode("utf-8")
    finally:
        source.close()


def fs_replace(spark: SparkSession, src: str, dst: str) -> bool:
    """Renames a file over whatever has the new name; False where the file is gone."""
    fs, p = _fs(spark, src)
    if not fs.exists(p):
        return False
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(dst)
    if fs.exists(target):
        fs.delete(target, False)
    return fs_rename(spark, src, dst)


def fs_delete(spark: SparkSession, path: str) -> bool:
    """Deletes a file or a folder with all that it holds."""
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def fs_delete_older(spark: SparkSession, path: str, before_ms: int) -> list[str]:
    """Deletes the files of a folder last changed before a time; returns their names."""
    fs, p = _fs(spark, path)
    gone = []
    if fs.exists(p):
        for status in fs.listStatus(p):
            if status.isFile() and status.getModificationTime() < before_ms and fs.delete(status.getPath(), False):
                gone.append(status.getPath().getName())
    return sorted(gone)


def fs_list(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(p))


def fs_rename(spark: SparkSession, src: str, dst: str) -> bool:
    fs, p = _fs(spark, src)
    jvm = spark.sparkContext._jvm
    d = jvm.org.apache.hadoop.fs.Path(dst)
    fs.mkdirs(d.getParent())
    return bool(fs.rename(p, d))


def fs_size(spark: SparkSession, path: str) -> int:
    """Total bytes under ``path`` (file or folder) on any Hadoop file system."""
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def spread(df: DataFrame) -> DataFrame:
    """Before CPU-heavy per-row work (tokenizing, regexes, text building): when the input
    has fewer partitions than the cluster has cores -- e.g. a table stored as one row
    group -- deal its rows round-robin over all cores. Inputs that are already split
    (any large table) are returned unchanged, so this adds no shuffle at scale."""
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # no RDD view (e.g. a remote session): leave the plan as it is
        return df
    return df.repartition(cores) if parts < cores else df
