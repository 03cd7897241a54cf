"""Field rules and small operators as reports of their own: product fields (F13, F18, F23, F25), order day
fields (F21, F28), dimension and control updates (M9, M10), the newest drop (S12), inline results (L7, S19),
the proposed table of a drop file (T6), requested products (P14) and schedule sheets with loose headers (S10).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions.dates import infer_year_month_day, week_stamp
from shelfwise.functions.text import (
    PRODUCT_CODE_RE, PUBLISHER_CODE_RE, between_parentheses, first_publisher_code, link, product_codes, strip_number_text,
)
from shelfwise.functions.numeric import as_double
from shelfwise.operators.grouping import mode_per_key
from shelfwise.operators.ingest import ddl_frame, infer_schema
from shelfwise.operators.joins import lookup_with_fallback
from shelfwise.operators.merge import stamp, update_from_group
from shelfwise.operators.params import per_request
from shelfwise.operators.sheets import bind_sheet, resolve_columns
from shelfwise.operators.topn import inline_or_notice
from shelfwise.plans.ingest_reports import HEADER, INFER_SCHEMA_SQL, drop_file_lines
from shelfwise.plans.registry import report
from shelfwise.plans.views import (
    PRODUCT_CODE_SQL, PRODUCT_SALES_SQL, PRODUCTS_SQL, product_code, product_sales, products, with_sql,
)
from shelfwise.sources.dropfile import newest_file_of_newest_dir
from shelfwise.sources.tables import Tables

#: The market a publisher code is written for, after its three-character stem.
MARKET = "CN"


# ---------------------------------------------------------------- F13, F18, F23, F25
@report("product_fields", covers=("F13", "F18", "F23", "F25"), tag="FIELDS", oracle=with_sql(PRODUCTS_SQL, f"""
b AS (SELECT product, title, 'code x' || lower(right(publisher, 2)) || '{MARKET.lower()}, seen by ' || title AS note,
             CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) || '.0' ELSE CAST(p_size AS VARCHAR) END AS size_text,
             title || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' (' || category || '/' || publisher || ') rest' END AS shelf
      FROM products)""") + f"""
SELECT product, regexp_extract(upper(note), '{PUBLISHER_CODE_RE}', 1) AS publisher_code,
       CASE WHEN regexp_matches(size_text, '^[0-9]+\\.[0-9]*$') THEN string_split(size_text, '.')[1] ELSE size_text END AS size_text,
       regexp_extract_all(replace(shelf, '/', ''), '[^()]+')[2] AS shelf,
       'https://catalog.example/item/' || product || '#' || title AS link
FROM b""")
def product_fields(t: Tables):
    """Publisher code out of a note, size without a trailing '.0', shelf in parentheses, link."""
    p = products(t)
    size = F.col("p_size").cast("string")
    note = F.concat(F.lit("code x"), F.lower(F.right("publisher", F.lit(2))), F.lit(f"{MARKET.lower()}, seen by "), "title")
    shelf = F.concat("title", F.when(F.col("p_size") % 3 == 0, "").otherwise(
        F.concat(F.lit(" ("), "category", F.lit("/"), "publisher", F.lit(") rest"))))
    return p.select("product", first_publisher_code(note).alias("publisher_code"),
                    strip_number_text(F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit(".0"))).otherwise(size)).alias("size_text"),
                    between_parentheses(shelf).alias("shelf"), link("product", "title").alias("link"))


# ---------------------------------------------------------------- F21, F28
#: The day on which a bare month/day is read.
READ_ON = "1998-08-02"


@report("order_day_fields", covers=("F21", "F28"), tag="DAYS", oracle=f"""
WITH o AS (SELECT o_orderkey, o_orderdate, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderstatus FROM orders)
SELECT o_orderkey, strftime(o_orderdate, '%Ywk%W') AS week,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE)
            ELSE TRY_CAST(printf('%d-%02d-%02d', CASE WHEN abs(m - month(DATE '{READ_ON}')) > 6 THEN year(DATE '{READ_ON}') + 1
                                                      ELSE year(DATE '{READ_ON}') END, m, d) AS DATE) END AS day_read
FROM o""")
def order_day_fields(t: Tables):
    """Week stamp of each order's day, and the day read from its written form (finished orders
    name the year, others only month/day)."""
    written = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "M/d/yyyy")).otherwise(
        F.date_format("o_orderdate", "M/d"))
    return t.orders.select("o_orderkey", week_stamp("o_orderdate").alias("week"),
                           infer_year_month_day(written, READ_ON).alias("day_read"))


# ---------------------------------------------------------------- M9, M10
@report("customer_priority_update", covers=("M9",), tag="DIMUPDATE", oracle="""
SELECT c.c_custkey, coalesce(m.p, c.c_mktsegment) AS c_mktsegment
FROM customer c LEFT JOIN (
  SELECT o_custkey, max(CASE WHEN o_orderstatus = 'P' THEN ' ' WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END)
         FILTER (WHERE o_orderstatus NOT IN ('P', 'F')) AS p FROM orders GROUP BY o_custkey) m ON m.o_custkey = c.c_custkey""")
def customer_priority_update(t: Tables):
    """Customers take the largest non-empty priority of their orders; those without one keep their segment."""
    source = t.orders.select("o_custkey", F.when(F.col("o_orderstatus") == "P", " ")
                             .when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("priority"))
    return update_from_group(t.customer.select("c_custkey", "c_mktsegment"), source.withColumnRenamed("o_custkey", "c_custkey"),
                             "c_custkey", "c_mktsegment", "priority")


#: The publisher whose control row is stamped, and the day of the run.
STAMPED, RUN_DAY = "Brand#11", "1998-08-02"


@report("publisher_run_stamp", covers=("M10",), tag="STAMP", oracle=f"""
SELECT p_brand AS publisher, CASE WHEN p_brand = '{STAMPED}' THEN DATE '{RUN_DAY}' ELSE max(CAST(l_shipdate AS DATE)) END AS last_update
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand""")
def publisher_run_stamp(t: Tables):
    """Control rows (publisher, last update); the one whose mail just ran carries the run's day."""
    last = t.lineitem.groupBy("l_partkey").agg(F.max("l_shipdate").cast("date").alias("day"))
    control = (t.part.join(last, F.col("l_partkey") == F.col("p_partkey"), "left")
               .groupBy(F.col("p_brand").alias("publisher")).agg(F.max("day").alias("last_update")))
    return stamp(control, "publisher", STAMPED, "last_update", F.lit(RUN_DAY).cast("date"))


# ---------------------------------------------------------------- S12
@report("newest_drop", covers=("S12",), tag="NEWEST", oracle="""
WITH f AS (SELECT '/drop/' || strftime(o_orderdate, '%Y%m') || '/order-' || o_orderkey || '.txt' AS file_path,
                  strftime(o_orderdate, '%Y%m') AS dir, o_orderdate AS mtime FROM orders),
d AS (SELECT * FROM f WHERE dir = (SELECT max(dir) FROM f))
SELECT file_path, mtime FROM d WHERE mtime = (SELECT max(mtime) FROM d)""")
def newest_drop(t: Tables):
    """The newest files of the newest folder, one folder per month and one file per order."""
    files = t.orders.select(F.concat(F.lit("/drop/"), F.date_format("o_orderdate", "yyyyMM"), F.lit("/order-"),
                                     F.col("o_orderkey").cast("string"), F.lit(".txt")).alias("file_path"),
                            F.col("o_orderdate").alias("mtime"))
    return newest_file_of_newest_dir(files)


# ---------------------------------------------------------------- L7
@report("inline_publisher_list", covers=("L7",), tag="INLINE", oracle="""
WITH n AS (SELECT count(*) AS n FROM part)
SELECT 'publishers' AS sheet, p_brand AS line, CAST(NULL AS VARCHAR) AS notice FROM part GROUP BY p_brand
UNION ALL SELECT 'products', CAST(p_partkey AS VARCHAR), NULL FROM part, n WHERE n <= 1000
UNION ALL SELECT 'products', NULL, 'more than 1000 rows' FROM n WHERE n > 1000""")
def inline_publisher_list(t: Tables):
    """Two inline sheets; one of more than 1,000 rows is a notice instead."""
    pubs = inline_or_notice(t.part.select(F.col("p_brand").alias("line")).distinct())
    prods = inline_or_notice(t.part.select(F.col("p_partkey").cast("string").alias("line")))
    return (pubs.select(F.lit("publishers").alias("sheet"), "line", "notice")
            .unionByName(prods.select(F.lit("products").alias("sheet"), "line", "notice")))


# ---------------------------------------------------------------- T6
@report("proposed_table", covers=("T6",), tag=None, oracle=f"""
WITH s AS ({INFER_SCHEMA_SQL})
SELECT 'create table shop.items (' || chr(10) || string_agg('  ' || column_name || ' ' || inferred_type ||
         CASE WHEN inferred_type IN ('varchar', 'char') THEN '(' || length || ')' ELSE '' END, ',' || chr(10) ORDER BY position)
       || coalesce(',' || chr(10) || '  primary key (' || max(column_name) FILTER (WHERE is_key) || ')', '') || chr(10) || ')' AS ddl
FROM s""")
def proposed_table(t: Tables):
    """The create statement proposed for a drop file whose table is unknown."""
    return ddl_frame(infer_schema(drop_file_lines(t), HEADER), "shop.items")


# ---------------------------------------------------------------- P14, R1
REQUESTED_SQL = with_sql(PRODUCTS_SQL, PRODUCT_SALES_SQL, f"""
named AS (SELECT DISTINCT event_id AS request, unnest(regexp_extract_all(
            'please send ' || {PRODUCT_CODE_SQL.format(k="user_id")} || ' and ' || {PRODUCT_CODE_SQL.format(k="event_id")},
            '{PRODUCT_CODE_RE}', 1)) AS code FROM events)""") + """
SELECT n.request, p.product, p.publisher, CAST(s.sales AS DOUBLE) AS sales, CAST(s.units AS DOUBLE) AS units
FROM named n JOIN products p ON p.product = n.code LEFT JOIN product_sales s ON s.l_partkey = p.p_partkey"""


@report("requested_products", covers=("P14",), tag="DAILYREQ", oracle=REQUESTED_SQL)
def requested_products(t: Tables):
    """The daily product report restricted to the codes that each request names (an equi-join of mined
    parameters with the report; a request that names no product gets no rows)."""
    text = F.concat(F.lit("please send "), product_code("user_id"), F.lit(" and "), product_code("event_id"))
    requests = t.events.select(F.col("event_id").alias("msg"), F.explode(product_codes(text)).alias("code"))
    daily = (products(t).join(product_sales(t), F.col("l_partkey") == F.col("p_partkey"), "left")
             .select("product", "publisher", as_double("sales").alias("sales"), as_double("units").alias("units")))
    return per_request(daily, "product", requests, "msg", "code").withColumnRenamed("msg", "request")


# ---------------------------------------------------------------- S10 with J20
@report("schedule_sheet", covers=("S10", "J20", "R26"), tag="SHEETLOOKUP", oracle="""
WITH vis AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_acctbal >= 0),
mode AS (SELECT s_nationkey, min(s_name) AS s_name FROM vis GROUP BY s_nationkey)
SELECT o.o_orderkey AS asin, CAST(o.o_orderdate AS DATE) AS schedule,
       coalesce(v.s_name, m.s_name) AS contact,
       CASE WHEN v.s_suppkey IS NOT NULL THEN 'exact' WHEN m.s_nationkey IS NOT NULL THEN 'nation' END AS matched_by
FROM orders o LEFT JOIN vis v ON v.s_suppkey = o.o_custkey LEFT JOIN mode m ON m.s_nationkey = o.o_custkey % 25""")
def schedule_sheet(t: Tables):
    """A sheet with loosely written headers, its columns found by what their names contain, looked up exactly,
    else by nation."""
    sheet = t.orders.select(F.col("o_orderkey").alias(" Product ASIN "), F.col("o_orderdate").cast("date").alias("Schedule Day"),
                            F.col("o_custkey").alias("Vendor Code"))
    roles = resolve_columns(sheet.columns)
    rows = bind_sheet(sheet, roles).withColumn("nation", F.col("code") % 25)
    vis = t.supplier.filter(F.col("s_acctbal") >= 0).select("s_suppkey", "s_nationkey", "s_name")
    fallback = mode_per_key(vis, "s_nationkey", "s_name")
    out = lookup_with_fallback(rows, vis, ("code", "s_suppkey"), fallback, ("nation", "s_nationkey"), "s_name", "contact")
    return out.select("asin", "schedule", "contact", "matched_by")
