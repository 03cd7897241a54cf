"""Drop-folder source (S1-S6, S12): tab-delimited text files named
``[<seq>.]<db>.<table>.<yyyymmdd>.<txt|trunc|upd>``.

Files are read with ``spark.read.text`` (splittable, one row per line) plus the
file metadata columns. Exact line numbers are computed without a per-file
window: within a file split the rows are contiguous and
``monotonically_increasing_id`` grows by one per row, so
``line = rows in earlier splits + (id - first id of the split) + 1``;
the per-split counts are a small aggregate.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value (S3): file name grammar.
FILE_NAME_RE = r"^(\d+\.)?(\w+)\.(\w+)\.(\d{8})\.(txt|trunc|upd)$"
PLAIN_NAME_RE = r"^([^.]+)\.txt$"
FALLBACK_CHARSET = "GBK"    # S2: charset of files whose head is not valid UTF-8
HEAD_LINES = 3              # S2: lines that a file's charset is judged by
QUIET_SECONDS = 60          # S4: a file must be unchanged this long before it is loaded
DONE_RETENTION_DAYS = 14    # S6: archived files are kept this long


def parse_file_name(name: str | Column) -> Column:
    """S3: struct(seq, db, table, snapshot_day, mode); NULL fields when the name does not
    match. A plain ``<stem>.txt`` falls back to table = stem, mode = txt."""
    n = F.col(name) if isinstance(name, str) else name
    ok = n.rlike(FILE_NAME_RE)
    g = lambda i: F.regexp_extract(n, FILE_NAME_RE, i)
    stem = F.regexp_extract(n, PLAIN_NAME_RE, 1)
    return F.struct(
        F.when(ok & (g(1) != ""), F.regexp_replace(g(1), r"\.", "").cast("bigint")).alias("seq"),
        F.when(ok, g(2)).alias("db"),
        F.when(ok, g(3)).when(stem != "", stem).alias("table"),
        F.when(ok, F.try_to_date(g(4), "yyyyMMdd")).alias("snapshot_day"),
        F.when(ok, g(5)).when(stem != "", F.lit("txt")).alias("mode"),
    )


def number_lines(raw: DataFrame, charset: str = "UTF-8") -> DataFrame:
    """Exact 1-based line numbers for rows (value, file_path, block, _id) of text files.

    Also decodes the lines, strips the CR of CRLF endings and a leading byte-order mark, and drops
    empty lines (after numbering, so numbers match the file).
    """
    with java_charsets(raw.sparkSession):
        return numbered_rows(raw).withColumn("value", clean_text(F.col("value"), charset)).filter(F.col("value") != "")


def numbered_rows(raw: DataFrame) -> DataFrame:
    """``raw`` (file_path, block, _id, others) with ``line_no``, the 1-based place of a row in its file."""
    splits = raw.groupBy("file_path", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    w = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return (raw.join(offsets, ["file_path", "block"])
            .withColumn("line_no", F.col("_off") + F.col("_id") - F.col("_first") + 1)
            .drop("_off", "_first", "_id", "block"))


@contextmanager
def java_charsets(spark: SparkSession):
    """While columns are built: ``decode`` takes any charset of the JVM, and gives U+FFFD for bytes that it cannot decode."""
    names = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "true")
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def clean_text(value: Column, charset: str = "UTF-8") -> Column:
    """The text of a line's bytes; bytes that the charset does not have are dropped (the reference decodes with
    errors ignored), then the CR of a CRLF ending and a leading byte-order mark go."""
    if charset.upper() == "UTF-8":
        valid = F.when(F.is_valid_utf8(value), value).otherwise(F.regexp_replace(F.make_valid_utf8(value), "\ufffd", ""))
    else:
        valid = F.regexp_replace(F.decode(value.cast("binary"), charset), "\ufffd", "")
    return F.regexp_replace(F.regexp_replace(valid, r"\r$", ""), "^\ufeff", "")


def with_file_columns(df: DataFrame) -> DataFrame:
    return (df.select(F.col("value"),
                      F.col("_metadata.file_path").alias("file_path"),
                      F.col("_metadata.file_name").alias("file_name"),
                      F.col("_metadata.file_modification_time").alias("mtime"),
                      F.col("_metadata.file_block_start").alias("block")))


def scan_lines(spark: SparkSession, path: str, quiet_before=None, fallback: str = FALLBACK_CHARSET) -> DataFrame:
    """Non-empty lines of every ready file under ``path`` with exact line numbers.

    Lines are cut as bytes; a file whose first ``HEAD_LINES`` lines are not valid UTF-8 but valid in ``fallback`` is decoded by that,
    any other as UTF-8 (stray bytes are dropped). ``quiet_before`` (timestamp) keeps only files last modified before it (S4).
    Output: value, file_path, file_name, mtime, line_no.
    """
    raw = with_file_columns(spark.read.text(path))
    if quiet_before is not None:
        raw = raw.filter(F.col("mtime") < F.lit(quiet_before).cast("timestamp"))
    lines = numbered_rows(raw.withColumn("_id", F.monotonically_increasing_id()))
    with java_charsets(spark):
        # One row per file; only the first lines of a file count.
        foreign = ~F.is_valid_utf8("value"), ~F.decode(F.col("value").cast("binary"), fallback).contains("\ufffd")
        heads = (lines.filter(F.col("line_no") <= HEAD_LINES).groupBy("file_path")
                 .agg((F.max(foreign[0]) & F.min(foreign[1])).alias("_foreign")))
        text = F.when(F.col("_foreign"), clean_text(F.col("value"), fallback)).otherwise(clean_text(F.col("value")))
        return lines.join(heads, "file_path").withColumn("value", text).filter(F.col("value") != "").drop("_foreign")


def headers(lines: DataFrame) -> DataFrame:
    """First line of every file (its header) -- one row per file."""
    first = lines.groupBy(F.col("file_path").alias("_fp")).agg(F.min("line_no").alias("_h"))
    return (lines.join(first, (F.col("file_path") == F.col("_fp")) & (F.col("line_no") == F.col("_h")))
            .select("file_path", "file_name", F.col("value").alias("header")))


def data_lines(lines: DataFrame) -> DataFrame:
    first = lines.groupBy(F.col("file_path").alias("_fp")).agg(F.min("line_no").alias("_h"))
    return (lines.join(first, (F.col("file_path") == F.col("_fp")) & (F.col("line_no") != F.col("_h")))
            .drop("_fp", "_h"))


def newest_file_of_newest_dir(files: DataFrame) -> DataFrame:
    """Among (file_path, mtime) rows, the newest file inside the newest sub-directory."""
    with_dir = files.withColumn("_dir", F.regexp_extract("file_path", r"^(.*)/[^/]+$", 1))
    newest_dir = with_dir.agg(F.max("_dir")).scalar()
    in_dir = with_dir.filter(F.col("_dir") == newest_dir)
    return in_dir.filter(F.col("mtime") == in_dir.agg(F.max("mtime")).scalar()).drop("_dir")


def retention_expired(day_col: str | Column, as_of: str, days: int) -> Column:
    """Rows (files, export partitions) older than the retention window."""
    d = F.col(day_col) if isinstance(day_col, str) else day_col
    return F.datediff(F.lit(as_of).cast("date"), d) > days
