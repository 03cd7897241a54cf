"""Drop-file ingestion: header binding (T1/T2), field-count rejects (T8), typed
cleansing (T7), snapshot day (T9), duplicate lines (T10), schema inference (T3-T6).

Input is a DataFrame of lines ``(file_name, line_no, value)``: from
``sources.dropfile.scan_lines`` (text files) or derived from a table. Header
lines are metadata -- one per file -- and are the only thing brought to the
driver; the data lines stay distributed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.cleansing import DATE_FORMS, clean_cast, spark_type_for

# Type inference patterns and key candidates.
INT_RE = r"^[-+]?[0-9]+$"
FLOAT_RE = r"^[-+]?([0-9]*\.?[0-9]+|[0-9]+\.?[0-9]*)$"
KEY_CANDIDATES = ("asin", "kasin", "pasin", "pubcode", "digital_pubcode")
CODE_COLUMNS = ("asin", "kasin", "pasin")   # forced to char(11)
CODE_LENGTH = 11


def normalize_header(name: str) -> str:
    """``\\``, ``/``, ``-`` and space -> ``_``; lower case."""
    return re.sub(r"[\\/\- ]", "_", name.strip().lstrip("﻿")).lower()


def bind_columns(header: Sequence[str], target: Sequence[str]) -> dict[str, int]:
    """Target column -> 0-based field position, for columns present in both."""
    pos = {h: i for i, h in enumerate(header)}
    return {c: pos[c] for c in target if c in pos}


def fields(value: Column) -> Column:
    return F.split(value, "\t", -1)


def drop_duplicate_lines(lines: DataFrame) -> DataFrame:
    """Exact duplicate lines of a file are dropped, the first one kept
    (a partial aggregate on (file, value): a hot duplicate never meets in one task)."""
    return lines.groupBy("file_name", "value").agg(F.min("line_no").alias("line_no"))


@dataclass
class CleanResult:
    rows: DataFrame
    rejects: DataFrame
    bound: dict[str, int]


def clean_lines(lines: DataFrame, header: Sequence[str], target: Sequence[tuple[str, str]],
                snapshot_day: str | None = None, dedupe: bool = True) -> CleanResult:
    """Bind, validate and cast the data lines of files sharing one header.

    * rows whose field count differs from the header -> ``rejects`` (T8);
    * each bound column through ``clean_cast`` for its declared type (T7);
    * ``snapshot_day`` added when the target has it and the file lacks it (T9).
    """
    norm = [normalize_header(h) for h in header]
    names = [c for c, _ in target]
    bound = bind_columns(norm, names)
    if not bound:
        raise ValueError("file shares no column with the target table")
    src = drop_duplicate_lines(lines) if dedupe else lines
    arr = fields(F.col("value"))
    n = len(norm)
    tagged = src.withColumn("_f", arr).withColumn("_n", F.size("_f"))
    rejects = (tagged.filter(F.col("_n") != n)
               .select("file_name", "line_no", "value", F.col("_n").alias("n_fields"),
                       F.lit(f"expected {n} fields").alias("reason")))
    types = dict(target)
    cols = [clean_cast(F.col("_f")[idx], types[c]).cast(spark_type_for(types[c])).alias(c)
            for c, idx in bound.items()]
    rows = tagged.filter(F.col("_n") == n).select("file_name", "line_no", *cols)
    if snapshot_day and "snapshot_day" in names and "snapshot_day" not in bound:
        rows = rows.withColumn("snapshot_day", F.to_date(F.lit(snapshot_day), "yyyyMMdd"))
    return CleanResult(rows, rejects, bound)


# All six date forms as one pattern: one regex evaluation per cell instead of six.
ANY_DATE_RE = "^(?:" + "|".join(p.strip("^$") for p, _ in DATE_FORMS) + ")$"

#: What a cell is, as one bit each; a number that is also written like a date is a kind of its own.
EMPTY, INTEGER, DATED_INTEGER, FLOAT, DATE, TEXT = (1 << k for k in range(6))


def cell_kind(c: Column) -> Column:
    """The kind of a cell; most cells are told by one or two patterns."""
    return (F.when(c == "", EMPTY)
            .when(c.rlike(INT_RE), F.when(c.rlike(ANY_DATE_RE), DATED_INTEGER).otherwise(INTEGER))
            .when(c.rlike(FLOAT_RE), FLOAT).when(c.rlike(ANY_DATE_RE), DATE).otherwise(TEXT))


def infer_schema(lines: DataFrame, header: Sequence[str]) -> DataFrame:
    """T3-T5 in one aggregate over all data lines (rows with a wrong field count skipped).

    Each cell is classed once; a column is what its kinds of cells have in common: int when every non-empty value is an
    integer; float when every one is a number; date when every one is a date; varchar otherwise or when
    all values are empty. (Commutative: the result does not depend on row order.)
    Length: longest value, +2 when over 5; product-code columns are char(11).
    Output: one row per column (position, column, type, length, is_key).
    """
    norm = [normalize_header(h) for h in header]
    n = len(norm)
    f = fields(F.col("value"))
    data = lines.filter(F.size(f) == n).select(*[f[i].alias(f"c{i}") for i in range(n)])
    coded = [i for i, name in enumerate(norm) if name not in CODE_COLUMNS]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i in coded:
        c = F.col(f"c{i}")
        # Two fixed-width buffers a column.
        aggs += [F.bit_or(cell_kind(c)).alias(f"k{i}"), F.max(F.length(c)).alias(f"ml{i}")]
    stats = data.agg(*aggs)
    key = next((k for k in KEY_CANDIDATES if k in norm), None)
    per_col = []
    for i, name in enumerate(norm):
        if i not in coded:
            typ, length = F.lit("char"), F.lit(CODE_LENGTH)
        else:
            # Without rows there are no kinds: all values are empty.
            kinds = F.coalesce(F.col(f"k{i}"), F.lit(0)).bitwiseAND(~EMPTY)
            only = lambda allowed: kinds.bitwiseAND(~allowed) == 0
            typ = (F.when(kinds == 0, "varchar").when(only(INTEGER | DATED_INTEGER), "int").when(only(INTEGER | DATED_INTEGER | FLOAT), "float")
                   .when(only(DATED_INTEGER | DATE), "date").otherwise("varchar"))
            length = F.coalesce(F.col(f"ml{i}"), F.lit(0))
        length = F.when(typ.isin("varchar", "char"), F.when(length > 5, length + 2).otherwise(length))
        per_col.append(F.struct(F.lit(i + 1).cast("bigint").alias("position"), F.lit(name).alias("column_name"),
                                typ.alias("inferred_type"), length.cast("bigint").alias("length"),
                                F.lit(name == key).alias("is_key")))
    return stats.select(F.explode(F.array(*per_col)).alias("c")).select("c.*")


def ddl_text(schema_rows: list, table: str) -> str:
    """Create-table text from collected ``infer_schema`` rows (one row per column)."""
    cols = []
    key = None
    for r in sorted(schema_rows, key=lambda r: r["position"]):
        typ = r["inferred_type"]
        cols.append(f"  {r['column_name']} {typ}({r['length']})" if typ in ("varchar", "char")
                    else f"  {r['column_name']} {typ}")
        if r["is_key"]:
            key = r["column_name"]
    body = ",\n".join(cols + ([f"  primary key ({key})"] if key else []))
    return f"create table {table} (\n{body}\n)"


def ddl_frame(schema: DataFrame, table: str) -> DataFrame:
    """T6 as a frame: the create-table text of ``infer_schema`` rows (one per column of a file, so a short list)."""
    typed = F.col("inferred_type").isin("varchar", "char")
    line = F.concat(F.lit("  "), "column_name", F.lit(" "), "inferred_type",
                    F.when(typed, F.concat(F.lit("("), F.col("length").cast("string"), F.lit(")"))).otherwise(""))
    one = schema.agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("c"),
                     F.max(F.when(F.col("is_key"), F.col("column_name"))).alias("k"))
    key = F.coalesce(F.concat(F.lit(",\n  primary key ("), "k", F.lit(")")), F.lit(""))
    return one.select(F.concat(F.lit(f"create table {table} (\n"), F.array_join("c.line", ",\n"), key, F.lit("\n)")).alias("ddl"))
