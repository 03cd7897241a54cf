"""Sinks as reports: each is written to the shared folder and read back.

What is returned is what a later reader finds, so a cell lost on the way, a folder that was not replaced or
a day that was overwritten shows in the rows.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numeric import as_double, money_sum
from shelfwise.operators.topn import row_numbered, top_k_per_group
from shelfwise.plans.pricing import ADVICE_HISTORY_SQL, advice_history_rows
from shelfwise.plans.registry import report
from shelfwise.session import scratch_path
from shelfwise.sources.sinks import (
    COMPRESS_ABOVE_BYTES, append_audit, expired_exports, export_tables, run_stamp, write_day_partition, write_report,
)
from shelfwise.sources.tables import Tables

#: The run whose outputs are written.
RUN = _dt.datetime(1998, 8, 2, 6, 30)


def _folder(t: Tables, name: str) -> str:
    return scratch_path(t.spark, f"{name}-{uuid.uuid4().hex}")


# ---------------------------------------------------------------- S19, S21
def top_supplier_lines(t: Tables) -> DataFrame:
    """The three products of each supplier that sold most, numbered; some cells are NULL."""
    per = (t.lineitem.groupBy("l_suppkey", "l_partkey")
           .agg(money_sum("l_extendedprice").alias("sales"), F.max("l_shipdate").cast("date").alias("last_day"),
                F.max(F.when(F.col("l_returnflag") == "R", F.col("l_linestatus"))).alias("returned")))
    best = top_k_per_group(per, ["l_suppkey"], [F.col("sales").desc(), F.col("l_partkey")], 3)
    return row_numbered(best, ["l_suppkey"], [F.col("sales").desc(), F.col("l_partkey")])


@report("written_supplier_sheets", covers=("S19", "S21"), tag="SHEETS", oracle="""
WITH per AS (
  SELECT l_suppkey, l_partkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS sales, max(CAST(l_shipdate AS DATE)) AS last_day,
         max(CASE WHEN l_returnflag = 'R' THEN l_linestatus END) AS returned
  FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY sales DESC, l_partkey) AS rn FROM per)
SELECT '1998-08-02-0630' AS run, CAST(s_nationkey AS BIGINT) AS nation, CAST(l_suppkey AS VARCHAR) AS supplier,
       CAST(rn AS VARCHAR) AS rn, CAST(l_partkey AS VARCHAR) AS product,
       CAST(sales AS VARCHAR) AS sales, CAST(last_day AS VARCHAR) AS last_day, coalesce(returned, '') AS returned
FROM r JOIN supplier ON s_suppkey = l_suppkey WHERE rn <= 3""")
def written_supplier_sheets(t: Tables):
    """One folder of gzipped sheets per supplier nation from a single job, as a reader of the run's folder finds them."""
    base = _folder(t, "sheets")
    rows = (top_supplier_lines(t).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.col("s_nationkey").alias("nation"), F.col("l_suppkey").alias("supplier"), "rn",
                    F.col("l_partkey").alias("product"), "sales", "last_day", "returned"))
    write_report(rows, base, "top", "lines", run_stamp(RUN), compress=True, partition_by=("nation",))
    cells = ["supplier", "rn", "product", "sales", "last_day", "returned"]
    # An empty cell is an empty text: sheets hold no NULL.
    back = (t.spark.read.option("header", True).option("basePath", base).option("nullValue", "\u0000")
            .schema(", ".join(f"{c} string" for c in cells) + ", run_ts string, nation bigint")
            .csv(f"{base}/run_ts=*/report=top/sheet=lines"))
    return back.select(F.col("run_ts").alias("run"), "nation", *cells)


# ---------------------------------------------------------------- S18, S20, S22
PROMOTION_SHEETS_SQL = """
WITH lines AS (SELECT l_returnflag AS promotion, s_nationkey AS vendor, l_partkey, l_linestatus, l_quantity, l_extendedprice, l_shipdate
               FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT 'products' AS sheet, promotion, CAST(vendor AS VARCHAR) AS vendor, CAST(l_partkey AS VARCHAR) AS name,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS VARCHAR) AS units, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS VARCHAR) AS sales,
       coalesce(CAST(max(CASE WHEN l_linestatus = 'O' THEN CAST(l_shipdate AS DATE) END) AS VARCHAR), '') AS open_day
FROM lines GROUP BY promotion, vendor, l_partkey
UNION ALL
SELECT 'totals', promotion, CAST(vendor AS VARCHAR), 'Total', CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS VARCHAR),
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS VARCHAR),
       coalesce(CAST(max(CASE WHEN l_linestatus = 'O' THEN CAST(l_shipdate AS DATE) END) AS VARCHAR), '')
FROM lines GROUP BY promotion, vendor
"""


def promotion_sheets(t: Tables) -> dict[str, DataFrame]:
    """The two sheets of every promotion and vendor: its products, and their total (the products' own sums, added up)."""
    vendors = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("vendor"))
    # Sums by product and supplier first; the vendor joins the sums.
    per = (t.lineitem.groupBy(F.col("l_returnflag").alias("promotion"), "l_suppkey", "l_partkey")
           .agg(money_sum("l_quantity").alias("units"), money_sum("l_extendedprice").alias("sales"),
                F.max(F.when(F.col("l_linestatus") == "O", F.col("l_shipdate").cast("date"))).alias("open_day"))
           .join(vendors, F.col("l_suppkey") == F.col("s_suppkey")))
    sums = [F.sum("units").alias("units"), F.sum("sales").alias("sales"), F.max("open_day").alias("open_day")]
    products = per.groupBy("promotion", "vendor", "l_partkey").agg(*sums)
    money_cells = [F.col(c).cast("decimal(28,2)").alias(c) for c in ("units", "sales")]
    return {"products": products.select("promotion", "vendor", F.col("l_partkey").alias("name"), *money_cells, "open_day"),
            "totals": per.groupBy("promotion", "vendor").agg(*sums).select("promotion", "vendor", F.lit("Total").alias("name"), *money_cells, "open_day")}


def write_promotion_sheets(t: Tables, base: str, compress_above: int = COMPRESS_ABOVE_BYTES) -> dict[str, str]:
    """One folder for each sheet, promotion and vendor; one job per sheet."""
    # The rows of a folder come from as many tasks as they need: salted by product, files of one key stay few.
    return {name: write_report(df.repartition("promotion", "vendor", F.pmod(F.xxhash64("name"), F.lit(2))), base, "promotions", name, run_stamp(RUN),
                               partition_by=("promotion", "vendor"), compress_above=compress_above)
            for name, df in promotion_sheets(t).items()}


@report("written_promotion_sheets", covers=("S18", "S20", "S22"), tag="PROMOSHEETS", oracle=PROMOTION_SHEETS_SQL)
def written_promotion_sheets(t: Tables):
    """Two sheets for every promotion and vendor, each output compressed when more than 5 MB were written, as a reader finds them."""
    base = _folder(t, "promotions")
    write_promotion_sheets(t, base)
    return read_promotion_sheets(t, base)


def read_promotion_sheets(t: Tables, base: str) -> DataFrame:
    cells = ["name", "units", "sales", "open_day"]
    return (t.spark.read.option("header", True).option("basePath", base).option("nullValue", "\u0000")
            .schema(", ".join(f"{c} string" for c in cells) + ", run_ts string, report string, sheet string, promotion string, vendor string")
            .csv(f"{base}/run_ts=*/report=promotions/sheet=*").select("sheet", "promotion", "vendor", *cells))


# ---------------------------------------------------------------- M8, S23
@report("written_daily_history", covers=("M8",), tag="DAYHISTORY", oracle="""
WITH d AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ss_day, o_orderstatus, o_totalprice FROM orders),
split AS (SELECT max(ss_day) - 365 AS from_day FROM d)
SELECT ss_day, 'first' AS run, count(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM d, split
WHERE ss_day < from_day OR ss_day NOT IN (SELECT ss_day FROM d WHERE o_orderstatus <> 'F') GROUP BY ss_day
UNION ALL
SELECT ss_day, 'again', count(*), CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM d, split
WHERE ss_day >= from_day AND o_orderstatus <> 'F' GROUP BY ss_day""")
def written_daily_history(t: Tables):
    """Totals of every snapshot day (the first of a month) written once, then the last year's days again from the
    open orders: only days that the second run holds are replaced."""
    path = _folder(t, "history")
    days = t.orders.withColumn("ss_day", F.trunc("o_orderdate", "month"))

    def totals(df: DataFrame, run: str) -> DataFrame:
        per = df.groupBy("ss_day").agg(F.count(F.lit(1)).alias("n"), money_sum("o_totalprice").alias("total"))
        return per.select("ss_day", F.lit(run).alias("run"), "n", as_double("total").alias("total"))

    write_day_partition(totals(days, "first"), path)
    since = days.agg(F.date_sub(F.max("ss_day"), 365)).scalar()
    write_day_partition(totals(days.filter((F.col("ss_day") >= since) & (F.col("o_orderstatus") != "F")), "again"), path)
    return t.spark.read.schema("run string, n bigint, total double, ss_day date").parquet(path).select("ss_day", "run", "n", "total")


@report("written_advice_history", covers=("R18", "M8"), tag="ADVICEDAYS", oracle=f"""
WITH advice AS ({ADVICE_HISTORY_SQL})
SELECT * FROM advice
UNION ALL
SELECT * REPLACE (CAST(ss_day - INTERVAL 1 DAY AS DATE) AS ss_day) FROM advice WHERE dir = 'D'""")
def written_advice_history(t: Tables):
    """The advice of two days in the history by day: the day before (price-down rows alone), then the day itself by a run that ended
    after its price-raise rows, and again by a whole run, which replaces that day's rows only."""
    path = _folder(t, "advice")
    rows = advice_history_rows(t)
    before = F.date_sub("ss_day", 1)
    write_day_partition(rows.filter(F.col("dir") == "D").withColumn("ss_day", before), path)
    write_day_partition(rows.filter(F.col("dir") == "R"), path)
    write_day_partition(rows, path)
    return t.spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


@report("written_audit_log", covers=("S23",), tag="AUDIT", oracle="""
SELECT event_id, event_type AS report, CAST(value AS DOUBLE) AS value, 'run1' AS run FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, event_type, CAST(value AS DOUBLE), 'run2' FROM events WHERE event_type IS DISTINCT FROM 'error'""")
def written_audit_log(t: Tables):
    """Two runs appended to one audit log; the earlier rows stay."""
    path = _folder(t, "audit")
    ev = t.events.select("event_id", F.col("event_type").alias("report"), "value")
    is_error = F.col("report").eqNullSafe(F.lit("error"))
    append_audit(ev.filter(is_error).withColumn("run", F.lit("run1")), path)
    append_audit(ev.filter(~is_error).withColumn("run", F.lit("run2")), path)
    return t.spark.read.parquet(path).select("event_id", "report", as_double("value").alias("value"), "run")


# ---------------------------------------------------------------- S24
@report("written_exports", covers=("S24",), tag="EXPORTS", oracle="""
SELECT 'nation' AS table_name, CAST(n_nationkey AS BIGINT) AS key, d AS dt FROM nation, (SELECT unnest(['1998-07-27', '1998-08-02']) AS d)
UNION ALL
SELECT 'customer', CAST(c_custkey AS BIGINT), d FROM customer, (SELECT unnest(['1998-07-27', '1998-08-02']) AS d)""")
def written_exports(t: Tables):
    """Two tables exported on three days; days older than a week are left out by the retention."""
    base = _folder(t, "exports")
    tables = {"nation": t.nation.select(F.col("n_nationkey").cast("bigint").alias("key")),
              "customer": t.customer.select(F.col("c_custkey").cast("bigint").alias("key"))}
    for day in ("1998-07-01", "1998-07-27", "1998-08-02"):
        export_tables(tables, base, day)
    frames = []
    for name in tables:
        gone = [p.rsplit("=", 1)[1] for p in expired_exports(t.spark, base, name, "1998-08-02")]
        kept = t.spark.read.schema("key bigint, dt string").parquet(f"{base}/{name}").filter(~F.col("dt").isin(gone))
        frames.append(kept.select(F.lit(name).alias("table_name"), "key", "dt"))
    return frames[0].unionByName(frames[1])
