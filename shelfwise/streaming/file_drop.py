"""The drop folder as a stream of files (``sources.drop_stream``), loaded into versioned tables.

A micro-batch is a list of quiet files with their heads (one row per file: metadata, the only thing collected).
Files are walked in sequence order; consecutive ones of the same table, mode, day, header and charset form one load,
whose lines Spark reads, cleanses and merges into the table's next version (replace / update / truncate by the mode;
duplicate keys: the last line wins).

States of a file (S6), all of them places in the folder, so they outlive the stream:

* new: in the folder. A file for a table that does not exist stays there and is looked at again by every poll; a
  ``create table`` proposed from it is written to ``_unknown/``.
* done: moved to ``done/`` after its load, deleted there after ``DONE_RETENTION_DAYS``.
* failed: noted in ``_failed/`` with its error and the number of attempts; after ``max_attempts`` it is renamed to
  ``<name>.err``. A corrected file of the same name is new.

A load happens once (X3). Its identity (files, times, sizes) is part of the name of the version it
makes, which appears in one rename: a batch that is run again finds either no version, and loads, or the
version, and only moves the files. How files were grouped is written down before the first load of a batch, so a
second run groups them alike although some have been moved.

Rows with a wrong field count go to the table's ``_rejects`` folder, rows without a key to ``_no_key``. Table
definitions are given as ``tables`` or come from the session catalog (S8); a catalog table is pointed to its new version after each load.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import time
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.cleansing import spark_type_for
from shelfwise.operators.ingest import clean_lines, ddl_text, infer_schema
from shelfwise.operators.merge import (align_insert, apply_mode, latest_version, version_number, version_of_load,
                                       write_version)
from shelfwise.operators.topn import latest_per_key
from shelfwise.session import fs_delete_older, fs_exists, fs_read_text, fs_replace, fs_write_text
from shelfwise.sources import drop_stream
from shelfwise.sources.dropfile import (DONE_RETENTION_DAYS, FALLBACK_CHARSET, QUIET_SECONDS, number_lines,
                                        parse_file_name, with_file_columns)
from shelfwise.sources.tables import table_spec

TableSpec = dict  # {"target": [(col, type), ...], "keys": [...], and "types": {col: stored type} of a catalog table}


def _spec(spark: SparkSession, tables: dict[str, TableSpec] | None, db: str | None, table: str) -> TableSpec | None:
    """The definition of a file's table: by database and name, else by name for every database; without definitions
    that of the catalog."""
    if tables is None:
        return table_spec(spark, db, table)
    return tables.get(f"{db}.{table}", tables.get(table))


def table_folder(table_root: str, db: str | None, table: str) -> str:
    """Each database has tables of its own."""
    return "/".join(p for p in (table_root.rstrip("/"), db, table) if p)


def _digest(files: list[dict]) -> str:
    """What a list of files is, by names, times and sizes."""
    return hashlib.sha256(json.dumps([[f["name"], f["mtime"], f["size"]] for f in files]).encode()).hexdigest()[:16]


def _first_line(head: bytes, fallback: str) -> tuple[str, str, int]:
    """Charset of a file, its first line that is not empty, and that line's number."""
    charset, text = "UTF-8", head.decode("utf-8-sig", "ignore")
    try:
        head.decode("utf-8")
    except UnicodeDecodeError:
        try:
            charset, text = fallback, head.decode(fallback)
        except UnicodeDecodeError:
            pass   # stray bytes in a UTF-8 file
    for n, line in enumerate(text.split("\n"), 1):
        if line.rstrip("\r"):
            return charset, line.rstrip("\r"), n
    return charset, "", 0


def _described(batch: DataFrame, fallback: str) -> list[dict]:
    """The files of a batch in sequence order, with what their names and heads say."""
    rows = (batch.withColumn("meta", parse_file_name("name"))
            .orderBy(F.col("meta.seq").asc_nulls_last(), "name").collect())
    files = []
    for r in rows:
        charset, header, header_no = _first_line(bytes(r["head"]), fallback) if r["head"] is not None else (None, None, 0)
        files.append({"path": r["path"], "name": r["name"], "mtime": r["mtime"], "size": r["size"], "there": r["head"] is not None,
                      "db": r["meta"]["db"], "table": r["meta"]["table"], "mode": r["meta"]["mode"],
                      "day": r["meta"]["snapshot_day"].isoformat() if r["meta"]["snapshot_day"] else None,
                      "charset": charset, "header": header, "header_no": header_no})
    return files


SIGNATURE = ("db", "table", "mode", "day", "charset", "header", "header_no")


def _grouped(files: list[dict]) -> list[dict]:
    """Loads: consecutive files that differ in nothing but their rows."""
    loads: list[dict] = []
    for f in files:
        signature = {k: f[k] for k in SIGNATURE}
        # Each truncating file replaces what the one before it loaded.
        if loads and loads[-1]["signature"] == signature and f["mode"] != "trunc":
            loads[-1]["files"].append(f)
        else:
            loads.append({"signature": signature, "files": [f]})
    for load in loads:
        load["id"] = _digest(load["files"])
    return loads


def _plan(spark: SparkSession, files: list[dict], known: list[dict], table_root: str) -> list[dict]:
    """The loads of a batch, as they were first grouped."""
    path = f"{table_root.rstrip('/')}/_plans/{_digest(files)}.json"
    text = fs_read_text(spark, path)
    if text:
        return json.loads(text)
    loads = _grouped([f for f in known if f["there"]])
    if loads:
        fs_write_text(spark, path + ".new", json.dumps(loads))
        fs_replace(spark, path + ".new", path)
    return loads


def _lines(spark: SparkSession, load: dict) -> DataFrame:
    """Data lines of a load's files: file_name, line_no, value."""
    raw = with_file_columns(spark.read.text([f["path"] for f in load["files"]])).withColumn("_id", F.monotonically_increasing_id())
    return (number_lines(raw, load["signature"]["charset"]).filter(F.col("line_no") > load["signature"]["header_no"])
            .select("file_name", "line_no", "value"))


def _propose(spark: SparkSession, f: dict, table_root: str) -> None:
    """The definition of a table that does not exist, inferred from a whole file in one aggregate."""
    path = f"{table_root.rstrip('/')}/_unknown/{f['name']}.sql"
    if not f["header"] or fs_exists(spark, path):
        return
    body = _lines(spark, {"files": [f], "signature": f}).select("value")
    rows = [r.asDict() for r in infer_schema(body, f["header"].split("\t")).collect()]
    name = f"{f['db']}.{f['table']}" if f["db"] else (f["table"] or f["name"])
    fs_write_text(spark, path, ddl_text(rows, name) + "\n")


def merge_load(spark: SparkSession, load: dict, spec: TableSpec, table_dir: str) -> str:
    """One load into the next version of its table; returns that version."""
    what = load["signature"]
    if not what["header"]:
        raise ValueError("file has no header")
    keys, mode = spec["keys"], what["mode"]
    if mode == "upd" and not keys:
        raise ValueError("an update needs a table with keys")
    res = clean_lines(_lines(spark, load), what["header"].split("\t"), spec["target"],
                      snapshot_day=what["day"].replace("-", "") if what["day"] else None)
    # Rows with a wrong field count go to the table's reject folder (with line numbers).
    res.rejects.write.mode("overwrite").parquet(f"{table_dir}/_rejects/load={load['id']}")
    # Last line wins across the load's files in sequence order (10 after 2), then by line.
    seq = F.coalesce(parse_file_name(F.col("file_name")).getField("seq"), F.lit(0).cast("bigint"))
    rows = res.rows.withColumn("_order", F.struct(seq.alias("s"), F.col("file_name"), F.col("line_no")))
    if keys:
        # A row whose key is missing or does not parse is set aside; it has no place in the table.
        no_key = " OR ".join(f"`{k}` IS NULL" for k in keys)
        res.rows.filter(no_key).write.mode("overwrite").parquet(f"{table_dir}/_no_key/load={load['id']}")
        rows = latest_per_key(rows.filter(f"NOT ({no_key})"), keys, ["_order"])
    # A value beyond the range of its stored type is NULL, like any other that does not parse.
    stored = spec.get("types") or {c: spark_type_for(t) for c, t in spec["target"]}
    stage = rows.select(*[F.col(c).try_cast(stored[c]).alias(c) for c, _ in spec["target"] if c in rows.columns])
    current = latest_version(spark, table_dir)
    # The table has the columns of its definition, whatever its first file had.
    columns = ", ".join(f"`{c}` {t}" for c, t in stored.items())
    if current is None:   # a new table: merge into an empty one (an 'upd' load inserts nothing)
        target, version = spark.createDataFrame([], columns), 1
    else:
        target, version = spark.read.schema(columns).parquet(current), version_number(current) + 1
    # A table without keys is appended to.
    merged = apply_mode(target, stage, keys, mode) if keys or mode == "trunc" else target.unionByName(align_insert(target, stage))
    return write_version(merged, table_dir, version, (), load["id"])


def _note_failure(spark: SparkSession, load: dict, error: Exception, table_root: str, max_attempts: int) -> None:
    note = f"{table_root.rstrip('/')}/_failed/{load['id']}.json"
    attempts = json.loads(fs_read_text(spark, note) or '{"attempts": 0}')["attempts"] + 1
    fs_write_text(spark, note, json.dumps({"files": [f["name"] for f in load["files"]], "error": str(error)[:2000], "attempts": attempts}))
    if attempts >= max_attempts:
        for f in load["files"]:
            fs_replace(spark, f["path"], f["path"] + ".err")


def load_batch(batch: DataFrame, tables: dict[str, TableSpec] | None, table_root: str, folder: str, max_attempts: int = 1,
               fallback: str = FALLBACK_CHARSET, session: SparkSession | None = None) -> list[str]:
    """Load one micro-batch of files; returns the versions written. ``session`` is the one whose readers are to see a catalog
    table's new version at once (a batch has a session of its own; any other needs a REFRESH TABLE)."""
    spark = batch.sparkSession
    files = _described(batch, fallback)
    known = []
    for f in files:
        if _spec(spark, tables, f["db"], f["table"]) is not None:
            known.append(f)
        elif f["there"]:
            _propose(spark, f, table_root)
    there = {f["path"] for f in files if f["there"]}
    written = []
    for load in _plan(spark, files, known, table_root):
        db, table = load["signature"]["db"], load["signature"]["table"]
        table_dir = table_folder(table_root, db, table)
        version = version_of_load(spark, table_dir, load["id"])
        if version is None:
            if any(f["path"] not in there for f in load["files"]):
                continue   # set aside by an earlier run of this batch
            try:
                version = merge_load(spark, load, _spec(spark, tables, db, table), table_dir)
                written.append(version)
            except (ValueError, AnalysisException) as error:
                # A bad file does not stop the folder. Anything else (a lost executor, a full disk) ends the batch,
                # which is then run again.
                _note_failure(spark, load, error, table_root, max_attempts)
                continue
        if tables is None:
            for each in (spark, session or spark):
                each.sql(f"ALTER TABLE `{db}`.`{table}` SET LOCATION '{latest_version(spark, table_dir)}'")
                each.catalog.refreshTable(f"`{db}`.`{table}`")
        for f in load["files"]:
            fs_replace(spark, f["path"], f"{folder.rstrip('/')}/done/{f['name']}")
    return written


def clean_done(spark: SparkSession, folder: str, days: int = DONE_RETENTION_DAYS, now: dt.datetime | None = None) -> list[str]:
    """Deletes done files last changed more than ``days`` ago; returns their names."""
    seconds = now.timestamp() if now else time.time()
    return fs_delete_older(spark, f"{folder.rstrip('/')}/done", int((seconds - days * 86_400) * 1000))


def run_drop_folder(spark: SparkSession, folder: str, table_root: str, checkpoint: str,
                    tables: dict[str, TableSpec] | None = None, available_now: bool = True,
                    processing_time: str = "180 seconds", max_files: int | None = 1_000,
                    quiet_seconds: float = QUIET_SECONDS, max_attempts: int = 1,
                    fallback: str = FALLBACK_CHARSET, done_days: int = DONE_RETENTION_DAYS):
    """Start the ingestion stream. ``availableNow`` loads the files that are ready (all of them, in one batch) and stops;
    otherwise the folder is polled every ``processing_time`` (the reference polls every 180 s), ``max_files`` at a time. Without
    ``tables`` definitions are read from the session catalog."""
    drop_stream.register(spark)

    def handle(batch: DataFrame, batch_id: int) -> None:
        load_batch(batch, tables, table_root, folder, max_attempts, fallback, spark)
        clean_done(spark, folder, done_days)

    handler: Callable[[DataFrame, int], None] = handle
    reader = spark.readStream.format("drop_folder").option("path", folder).option("quietSeconds", str(quiet_seconds))
    if max_files and not available_now:
        reader = reader.option("maxFiles", str(max_files))
    q = reader.load().writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime=processing_time)
    return q.start()
