"""Ingestion and merge reports over drop files derived from ``orders``.

The drop file of the analogue is built by Spark from the orders table: one
tab-delimited line per order with deterministic dirt (six date spellings, bad
dates, padded and fractional integers, percent and junk numbers, short rows,
repeated lines). The ingestion operators then read it back exactly as they read
a real drop file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import zero_padded
from shelfwise.functions.cleansing import DATE_FORMS, PERCENT_RE
from shelfwise.operators.ingest import FLOAT_RE, INT_RE, clean_lines, infer_schema, normalize_header
from shelfwise.operators.merge import diff_merge, replace_by_key, truncate_load, update_by_key
from shelfwise.plans.registry import report
from shelfwise.sources.tables import Tables

FILE_NAME = "shop.orders.19980101.txt"
HEADER = ("Order Key", "Kasin", "Cust-Key", "Order/Date", "Ship Date", "Total Price", "Rate", "Priority", "Note",
          "Extra")
TARGET = (("order_key", "bigint"), ("kasin", "char(11)"), ("cust_key", "int"), ("order_date", "date"),
          ("ship_date", "date"), ("total_price", "decimal(18,2)"), ("rate", "float"), ("priority", "varchar(15)"),
          ("note", "varchar(40)"), ("extra", "datetime"), ("snapshot_day", "date"))


def _date_text(d: Column, k: Column) -> Column:
    form = k % 6
    return (F.when(k % 17 == 0, F.lit("hello"))
            .when(k % 19 == 0, F.concat(F.date_format(d, "yyyy"), F.lit("-13-01")))
            .when(form == 0, F.date_format(d, "d-MMM-yyyy"))
            .when(form == 1, F.upper(F.date_format(d, "dd-MMM-yy")))
            .when(form == 2, F.date_format(d, "yyyy/M/d"))
            .when(form == 3, F.date_format(d, "yyyy-M-d"))
            .when(form == 4, F.date_format(d, "M/d/yyyy"))
            .otherwise(F.date_format(d, "yyyyMMdd")))


def drop_file_lines(t: Tables) -> DataFrame:
    """(file_name, line_no, value) of the analogue drop file; line 1 is the header."""
    from shelfwise.session import spread
    o = spread(t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority",
                               "o_orderstatus"))
    k = F.col("o_orderkey")
    d = F.col("o_orderdate").cast("date")
    cust = F.col("o_custkey").cast("string")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    fields = [
        k.cast("string"),
        F.concat(F.lit("B"), zero_padded(cust, 9)),
        F.when(k % 11 == 0, F.concat(F.lit(" "), cust, F.lit(" "))).when(k % 13 == 0, F.concat(cust, F.lit(".5")))
        .otherwise(cust),
        _date_text(d, k),
        F.date_format(F.date_add(d, 3), "yyyy-M-d"),
        F.when(k % 7 == 0, F.concat(F.round(price / 1000, 1).cast("decimal(18,1)").cast("string"), F.lit("%")))
        .when(k % 23 == 0, F.lit("abc")).otherwise(price.cast("string")),
        F.round(price * F.lit(0.00001).cast("decimal(6,5)"), 4).cast("decimal(18,4)").cast("string"),
        F.col("o_orderpriority"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("st="), F.col("o_orderstatus"))),
        F.when(k % 3 == 0, F.lit("x")).otherwise(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" "), zero_padded((k % 24).cast("string"), 2),
                                                          F.lit(":30:00"))),
    ]
    value = F.when(k % 29 == 0, F.concat_ws("\t", *fields[:8])).otherwise(F.concat_ws("\t", *fields))
    copies = F.when(k % 31 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return o.select(F.lit(FILE_NAME).alias("file_name"),
                    F.explode(copies).alias("_copy"), k.alias("_k"), value.alias("value")) \
        .select("file_name", (F.col("_k") * 2 + 2 + F.col("_copy")).alias("line_no"), "value")


def _clean(t: Tables):
    lines = drop_file_lines(t)
    return clean_lines(lines, HEADER, TARGET, snapshot_day=FILE_NAME.split(".")[2])


# ------------------------------------------------------------------ oracle SQL
_K = "o_orderkey"
_DATE_SQL = f"""CASE WHEN {_K} % 17 = 0 THEN 'hello'
  WHEN {_K} % 19 = 0 THEN strftime(o_orderdate, '%Y') || '-13-01'
  WHEN {_K} % 6 = 0 THEN strftime(o_orderdate, '%-d-%b-%Y')
  WHEN {_K} % 6 = 1 THEN upper(strftime(o_orderdate, '%d-%b-%y'))
  WHEN {_K} % 6 = 2 THEN strftime(o_orderdate, '%Y/%-m/%-d')
  WHEN {_K} % 6 = 3 THEN strftime(o_orderdate, '%Y-%-m-%-d')
  WHEN {_K} % 6 = 4 THEN strftime(o_orderdate, '%-m/%-d/%Y')
  ELSE strftime(o_orderdate, '%Y%m%d') END"""
_FIELDS_SQL = [
    f"CAST({_K} AS VARCHAR)",
    "'B' || (CASE WHEN length(CAST(o_custkey AS VARCHAR)) >= 9 THEN CAST(o_custkey AS VARCHAR) ELSE right(repeat('0', 9) || CAST(o_custkey AS VARCHAR), 9) END)",
    f"CASE WHEN {_K} % 11 = 0 THEN ' ' || CAST(o_custkey AS VARCHAR) || ' ' WHEN {_K} % 13 = 0 THEN CAST(o_custkey AS VARCHAR) || '.5' ELSE CAST(o_custkey AS VARCHAR) END",
    _DATE_SQL,
    "strftime(CAST(o_orderdate AS DATE) + INTERVAL 3 DAY, '%Y-%-m-%-d')",
    f"CASE WHEN {_K} % 7 = 0 THEN CAST(CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)) / 1000, 1) AS DECIMAL(18,1)) AS VARCHAR) || '%' WHEN {_K} % 23 = 0 THEN 'abc' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END",
    "CAST(CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.00001 AS DECIMAL(6,5)), 4) AS DECIMAL(18,4)) AS VARCHAR)",
    "o_orderpriority",
    f"CASE WHEN {_K} % 5 = 0 THEN '' ELSE 'st=' || o_orderstatus END",
    f"CASE WHEN {_K} % 3 = 0 THEN 'x' ELSE strftime(o_orderdate, '%Y-%m-%d') || ' ' || lpad(CAST({_K} % 24 AS VARCHAR), 2, '0') || ':30:00' END",
]
LINES_SQL = f"""raw AS (
  SELECT '{FILE_NAME}' AS file_name, {_K} * 2 + 2 + c AS line_no,
         CASE WHEN {_K} % 29 = 0 THEN concat_ws(chr(9), {', '.join(_FIELDS_SQL[:8])})
              ELSE concat_ws(chr(9), {', '.join(_FIELDS_SQL)}) END AS value
  FROM orders, (SELECT 0 AS c UNION ALL SELECT 1) copies
  WHERE c = 0 OR {_K} % 31 = 0),
lines AS (SELECT file_name, value, MIN(line_no) AS line_no FROM raw GROUP BY file_name, value),
split AS (SELECT *, string_split(value, chr(9)) AS f FROM lines)"""

_DATE_PARSE = []
for _pat, _fmt in DATE_FORMS:
    if _fmt == "d-MMM-yy":
        _DATE_PARSE.append(f"WHEN regexp_matches(s, '{_pat}') THEN CAST(try_strptime(regexp_extract(s, '^(\\d{{1,2}}-\\w{{3}}-)', 1) || '20' || right(s, 2), '%d-%b-%Y') AS DATE)")
    else:
        _py = {"d-MMM-yyyy": "%d-%b-%Y", "yyyy/M/d": "%Y/%m/%d", "yyyy-M-d": "%Y-%m-%d", "M/d/yyyy": "%m/%d/%Y",
               "yyyyMMdd": "%Y%m%d"}[_fmt]
        _DATE_PARSE.append(f"WHEN regexp_matches(s, '{_pat}') THEN CAST(try_strptime(s, '{_py}') AS DATE)")


def _sql_date(col: str) -> str:
    return "(SELECT CASE " + " ".join(_DATE_PARSE) + f" END FROM (SELECT trim(NULLIF({col}, '')) AS s))"


def _sql_int(col: str) -> str:
    return f"CASE WHEN regexp_matches(trim({col}), '^[+-]?[0-9]+$') THEN CAST(trim({col}) AS BIGINT) END"


def _sql_num(col: str) -> str:
    s = f"trim(NULLIF({col}, ''))"
    return (f"CASE WHEN regexp_matches({s}, '{PERCENT_RE}') THEN TRY_CAST(regexp_extract({s}, '{PERCENT_RE}', 1) AS DOUBLE) * 0.01 "
            f"WHEN NOT contains({s}, '%') THEN CAST(ROUND(CAST(TRY_CAST({s} AS DOUBLE) AS DECIMAL(38,12)), 10) AS DOUBLE) END")


def _sql_money(col: str) -> str:
    s = f"trim(NULLIF({col}, ''))"
    return (f"CASE WHEN regexp_matches({s}, '{PERCENT_RE}') "
            f"THEN CAST(ROUND(CAST(regexp_extract({s}, '{PERCENT_RE}', 1) AS DECIMAL(26,10)) * CAST(0.01 AS DECIMAL(2,2)), 2) AS DECIMAL(18,2)) "
            f"WHEN NOT contains({s}, '%') THEN TRY_CAST({s} AS DECIMAL(18,2)) END")


INGEST_CLEAN_SQL = f"""WITH {LINES_SQL}
SELECT file_name, line_no, {_sql_int('f[1]')} AS order_key, f[2] AS kasin, {_sql_int('f[3]')} AS cust_key,
       {_sql_date('f[4]')} AS order_date, {_sql_date('f[5]')} AS ship_date, {_sql_money('f[6]')} AS total_price,
       {_sql_num('f[7]')} AS rate, f[8] AS priority, f[9] AS note, TRY_CAST(f[10] AS TIMESTAMP) AS extra, DATE '1998-01-01' AS snapshot_day
FROM split WHERE len(f) = {len(HEADER)}
"""


@report("ingest_clean_cast", covers=("T1", "T2", "T7", "T7a", "T7b", "T7c", "T7d", "T7e", "T7f", "T9", "T10", "U4"),
        oracle=INGEST_CLEAN_SQL, tag=None)
def ingest_clean_cast(t: Tables):
    """Typed rows of the drop file: header bound by name, cells cleansed per target type,
    repeated lines dropped, snapshot day from the file name."""
    return _clean(t).rows


INGEST_REJECTS_SQL = f"""WITH {LINES_SQL}
SELECT file_name, line_no, value, CAST(len(f) AS INTEGER) AS n_fields, 'expected {len(HEADER)} fields' AS reason
FROM split WHERE len(f) <> {len(HEADER)}
"""


@report("ingest_rejects", covers=("T8",), oracle=INGEST_REJECTS_SQL, tag=None)
def ingest_rejects(t: Tables):
    """Lines whose field count differs from the header, with their line number."""
    return _clean(t).rejects


def _infer_sql() -> str:
    norm = [normalize_header(h) for h in HEADER]
    date_any = " OR ".join(f"regexp_matches(c, '{p}')" for p, _ in DATE_FORMS)
    parts = []
    key = next((k for k in ("asin", "kasin", "pasin", "pubcode", "digital_pubcode") if k in norm), None)
    for i, name in enumerate(norm):
        c = f"f[{i + 1}]"
        if name in ("asin", "kasin", "pasin"):
            typ, length = "'char'", "13"
        else:
            typ = (f"CASE WHEN COUNT(*) FILTER (WHERE {c} <> '') = 0 THEN 'varchar' "
                   f"WHEN COUNT(*) FILTER (WHERE {c} <> '' AND NOT regexp_matches({c}, '{INT_RE}')) = 0 THEN 'int' "
                   f"WHEN COUNT(*) FILTER (WHERE {c} <> '' AND NOT regexp_matches({c}, '{INT_RE}') "
                   f"AND NOT regexp_matches({c}, '{FLOAT_RE}')) = 0 THEN 'float' "
                   f"WHEN COUNT(*) FILTER (WHERE {c} <> '' AND NOT ({date_any.replace('(c,', '(' + c + ',')})) = 0 THEN 'date' "
                   f"ELSE 'varchar' END")
            ml = f"COALESCE(MAX(length({c})), 0)"
            length = f"CASE WHEN ({typ}) IN ('varchar', 'char') THEN CASE WHEN {ml} > 5 THEN {ml} + 2 ELSE {ml} END END"
        src = ("(SELECT 1) one" if name in ("asin", "kasin", "pasin")
               else f"raw_split WHERE len(f) = {len(HEADER)}")
        parts.append(f"SELECT CAST({i + 1} AS BIGINT) AS position, '{name}' AS column_name, {typ} AS inferred_type, "
                     f"CAST({length} AS BIGINT) AS length, {str(name == key).upper()} AS is_key FROM {src}")
    return (f"WITH {LINES_SQL.split(',' + chr(10) + 'lines AS')[0]},\n"
            "raw_split AS (SELECT string_split(value, chr(9)) AS f FROM raw)\n" + "\nUNION ALL\n".join(parts))


INFER_SCHEMA_SQL = _infer_sql()


@report("infer_schema", covers=("T3", "T4", "T5"), oracle=INFER_SCHEMA_SQL, tag=None)
def infer_schema_report(t: Tables):
    """Inferred type, length and key flag of every column of the drop file (one aggregate)."""
    return infer_schema(drop_file_lines(t), HEADER)


# ------------------------------------------------------------------ merges
MERGE_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def merge_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Target = orders before 1998; stage = orders from 1997 on, re-priced and re-statused
    (1997 overlaps), low-priority rows with a NULL priority (NULL overwrites on update)."""
    o = t.orders
    target = o.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).select(*MERGE_COLS)
    stage = (o.filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))
             .select("o_orderkey", "o_custkey", F.lit("U").alias("o_orderstatus"),
                     (F.col("o_totalprice").cast("decimal(18,2)") + 1).cast("double").alias("o_totalprice"),
                     F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("string"))
                     .otherwise(F.col("o_orderpriority")).alias("o_orderpriority")))
    return target, stage


_MERGE_INPUTS_SQL = """tgt AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
        WHERE o_orderdate < DATE '1998-01-01'),
stg AS (SELECT o_orderkey, o_custkey, 'U' AS o_orderstatus,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 1 AS DOUBLE) AS o_totalprice,
               CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM orders WHERE o_orderdate >= DATE '1997-01-01')"""

MERGE_REPLACE_SQL = f"""WITH {_MERGE_INPUTS_SQL}
SELECT * FROM tgt WHERE o_orderkey NOT IN (SELECT o_orderkey FROM stg)
UNION ALL SELECT * FROM stg
"""


@report("merge_replace", covers=("M1", "M2", "M6", "J22"), oracle=MERGE_REPLACE_SQL, tag=None)
def merge_replace(t: Tables):
    """``txt`` load: staged keys replace their target rows; new keys are inserted."""
    target, stage = merge_inputs(t)
    return replace_by_key(target, stage, ["o_orderkey"])


MERGE_UPDATE_SQL = f"""WITH {_MERGE_INPUTS_SQL}
SELECT t.o_orderkey,
       CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_custkey ELSE t.o_custkey END AS o_custkey,
       CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
       CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice,
       CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderpriority ELSE t.o_orderpriority END AS o_orderpriority
FROM tgt t LEFT JOIN stg s ON s.o_orderkey = t.o_orderkey
"""


@report("merge_update", covers=("M3", "J22"), oracle=MERGE_UPDATE_SQL, tag=None)
def merge_update(t: Tables):
    """``upd`` load: staged values (NULL included) overwrite matching keys; nothing inserted."""
    target, stage = merge_inputs(t)
    return update_by_key(target, stage, ["o_orderkey"])


MERGE_TRUNCATE_SQL = f"WITH {_MERGE_INPUTS_SQL}\nSELECT * FROM stg\n"


@report("merge_truncate", covers=("M4",), oracle=MERGE_TRUNCATE_SQL, tag=None)
def merge_truncate(t: Tables):
    """``trunc`` load: the table becomes the staged rows."""
    target, stage = merge_inputs(t)
    return truncate_load(target, stage)


MERGE_DIFF_SQL = """WITH cur AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
        WHERE o_orderdate < DATE '1998-01-01'),
stg AS (SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'U' ELSE o_orderstatus END AS o_orderstatus,
               o_totalprice, o_orderpriority
        FROM orders WHERE o_orderdate >= DATE '1997-01-01'),
changed AS (
  SELECT s.* FROM stg s WHERE NOT EXISTS (
    SELECT 1 FROM cur c WHERE COALESCE(CAST(c.o_orderkey AS VARCHAR), '') = COALESCE(CAST(s.o_orderkey AS VARCHAR), '')
      AND COALESCE(c.o_orderstatus, '') = COALESCE(s.o_orderstatus, '')
      AND COALESCE(c.o_orderpriority, '') = COALESCE(s.o_orderpriority, '')))
SELECT c.*, 'current' AS src FROM cur c WHERE c.o_orderkey NOT IN (SELECT o_orderkey FROM changed)
UNION ALL SELECT ch.*, 'staged' FROM changed ch
"""


@report("merge_diff", covers=("M7", "J11", "P15"), oracle=MERGE_DIFF_SQL, tag=None)
def merge_diff(t: Tables):
    """Checklist diff-merge: identical staged rows dropped (NULL = ''), the others replace
    their key's current rows; each row tagged with where it came from."""
    o = t.orders
    cur = o.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).select(*MERGE_COLS)
    stg = (o.filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))
           .select("o_orderkey", "o_custkey",
                   F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("U"))
                   .otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
                   "o_totalprice", "o_orderpriority"))
    return diff_merge(cur, stg, "o_orderkey", ["o_orderstatus", "o_orderpriority"], src_col="src")


# ------------------------------------------------------------------ S1, S2
@report("charset_lines", covers=("S1", "S2"), tag=None, oracle="""
SELECT p_partkey AS product, '书名 ' || p_name AS title FROM part""")
def charset_lines(t: Tables):
    """Titles dropped as two sets of files in one folder, one encoded in GBK and one in UTF-8: each file is read by
    the charset that its first lines show."""
    import uuid

    from shelfwise.session import scratch_path
    from shelfwise.sources.dropfile import java_charsets, scan_lines

    folder = scratch_path(t.spark, f"charset_lines-{uuid.uuid4().hex}")
    lines = t.part.select("p_partkey", F.concat(F.lit("书名 "), "p_name").alias("title"))
    for charset, odd in (("GBK", 1), ("UTF-8", 0)):
        part = lines.filter(F.col("p_partkey") % 2 == odd)
        with java_charsets(t.spark):
            part.write.option("sep", "\t").option("encoding", charset).csv(f"{folder}/{charset}")
    fields = F.split("value", "\t")
    return scan_lines(t.spark, f"{folder}/*").select(fields[0].cast("bigint").alias("product"), fields[1].alias("title"))


# ------------------------------------------------------------------ X1-X3
STREAM_COLUMNS = "o_orderkey bigint, o_custkey bigint, o_orderstatus varchar(1), o_totalprice decimal(18,2), o_orderpriority varchar(15)"


def write_drop_files(df: DataFrame, folder: str, db: str, table: str, day: str, mode: str, seq_start: int) -> int:
    """Write ``df`` as drop files, one per partition, each starting with its header line,
    named ``<seq>.<db>.<table>.<day>.<mode>``. Returns the next free sequence number."""
    import uuid

    import pandas as pd

    from shelfwise.session import fs_list, fs_rename

    header = "\t".join(df.columns)
    text = df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
                     .alias("value"))

    def with_header(batches):
        first = True
        for pdf in batches:
            if first and len(pdf):
                yield pd.DataFrame({"value": [header]})
                first = False
            yield pdf

    tmp = f"{folder.rstrip('/')}/../_staging_{uuid.uuid4().hex}"
    text.mapInPandas(with_header, "value string").write.mode("overwrite").text(tmp)
    seq = seq_start
    for part in fs_list(spark_of(df), tmp):
        name = part.rsplit("/", 1)[-1]
        if name.startswith("part-"):
            fs_rename(spark_of(df), part, f"{folder.rstrip('/')}/{seq}.{db}.{table}.{day}.{mode}")
            seq += 1
    return seq


def spark_of(df: DataFrame):
    return df.sparkSession


STREAM_SQL = """WITH tgt AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, o_orderpriority FROM orders
        WHERE o_orderdate < DATE '1998-01-01'),
stg AS (SELECT o_orderkey, o_custkey, 'U' AS o_orderstatus,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 1 AS DECIMAL(18,2)) AS o_totalprice,
               CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS o_orderpriority
        FROM orders WHERE o_orderdate >= DATE '1997-01-01')
SELECT * FROM tgt WHERE o_orderkey NOT IN (SELECT o_orderkey FROM stg)
UNION ALL SELECT * FROM stg
"""


@report("stream_file_drop", covers=("X1", "X3", "S1", "S3", "S4", "S5", "S6", "S8", "M2", "M5"), oracle=STREAM_SQL, tag=None)
def stream_file_drop(t: Tables):
    """Drop files (target half, then the staged half) ingested by an ``availableNow`` stream of files into a table that
    only the catalog defines, with a replace merge per load; returns the table as the catalog has it after the last load.
    (A staged NULL travels as an empty cell, which a text column keeps as ''.)"""
    import uuid

    from shelfwise.session import scratch_path
    from shelfwise.streaming.file_drop import run_drop_folder

    spark = t.spark
    run = uuid.uuid4().hex
    root, db = scratch_path(spark, f"stream_file_drop/{run}"), f"shop_{run}"
    folder, tables_root, ckpt = f"{root}/drop", f"{root}/tables", f"{root}/checkpoint"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{root}/warehouse'")
    spark.sql(f"CREATE TABLE {db}.orders ({STREAM_COLUMNS}) USING parquet TBLPROPERTIES ('key.primary' = 'o_orderkey')")
    target, stage = merge_inputs(t)
    nxt = write_drop_files(target, folder, db, "orders", "19971231", "txt", 1)
    write_drop_files(stage, folder, db, "orders", "19980101", "txt", nxt)
    # The files were renamed into the folder when they were whole: nothing to wait for.
    q = run_drop_folder(spark, folder, tables_root, ckpt, available_now=True, quiet_seconds=0)
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return spark.table(f"{db}.orders")


# ------------------------------------------------------------------ X2
def _code_re_sql() -> str:
    from shelfwise.functions.text import PRODUCT_CODE_RE
    return PRODUCT_CODE_RE


STREAM_MESSAGES_SQL = f"""
SELECT doc_id AS msgid, source AS fro, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS receive,
       string_split_regex(text, '\\r\\n|\\n')[1] AS subject,
       (SELECT {{route}} FROM (SELECT string_split_regex(text, '\\r\\n|\\n')[1] AS subject)) AS type,
       left(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{_code_re_sql()}', 1))), ','), 250)
         AS key_data
FROM documents
"""


def _stream_messages_sql() -> str:
    from shelfwise.plans.access_reports import _route_sql
    return STREAM_MESSAGES_SQL.replace("{route}", _route_sql())


@report("stream_messages", covers=("X2", "X3", "S17", "S23", "F29", "J24"), oracle=_stream_messages_sql(), tag=None)
def stream_messages(t: Tables):
    """Documents delivered as request messages, English ones twice; the message stream
    keeps each message id once, routes it and writes the audit log."""
    import uuid

    from shelfwise.session import scratch_path
    from shelfwise.streaming.messages import read_log, run_message_stream

    spark = t.spark
    root = scratch_path(spark, f"stream_messages/{uuid.uuid4().hex}")
    msgs = t.documents.select(
        F.col("doc_id").alias("msgid"), F.col("source").alias("sender"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("doc_id"))).alias("receive"),
        F.split(F.col("text"), r"\r\n|\n").getItem(0).alias("subject"), F.col("text").alias("body"), "lang")
    msgs.drop("lang").write.parquet(f"{root}/in/all")
    msgs.filter(F.col("lang") == "en").drop("lang").write.parquet(f"{root}/in/again")
    q = run_message_stream(spark, f"{root}/in/*", f"{root}/audit", f"{root}/checkpoint")
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return read_log(spark, f"{root}/audit")
