"""Catalog reports: R1, R2, R3, R4, R11, R13, R14, R15, R20, R26, R28, R30."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions.dates import week_sunday, yyyymmdd
from shelfwise.functions.numeric import money_sum, as_double, money, percent_text, ratio, rounded_double
from shelfwise.functions.text import MULTILINE_SQL, PRODUCT_CODE_RE, multilines_in_html, zero_padded
from shelfwise.operators.joins import not_in_anti_join
from shelfwise.operators.params import Parameter
from shelfwise.operators.sequence import group_sequence
from shelfwise.operators.topn import latest_per_key
from shelfwise.plans.registry import report
from shelfwise.plans.views import PRODUCT_CODE_SQL, PRODUCTS_SQL, product_code, products, with_sql
from shelfwise.sources.tables import Tables

# Fixed report parameters of the analogue data (dates inside the test data range).
LAUNCH_CUTOFF = "2001-06-01"      # "launched" = sold on or after this day
AS_OF = "2001-12-01"


# ---------------------------------------------------------------- R1
R1_SQL = f"""
WITH daily AS (
  SELECT user_id, CAST(ts AS DATE) AS day,
         SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END) AS sales,
         COUNT(*) FILTER (WHERE event_type = 'purchase') AS units,
         COUNT(*) FILTER (WHERE event_type = 'view') AS views,
         COUNT(*) FILTER (WHERE event_type = 'click') AS borrows,
         MAX(CASE WHEN event_type = 'signup' THEN 'SIGNUP' END) AS deal
  FROM events GROUP BY user_id, CAST(ts AS DATE))
SELECT {PRODUCT_CODE_SQL.format(k='d.user_id')} AS product, c.c_name AS title, c.c_mktsegment AS band, d.day,
       CAST(ROUND(CAST(CAST(d.sales AS DOUBLE) / NULLIF(CAST(d.units AS DOUBLE), 0) AS DECIMAL(38,10)), 2) AS DOUBLE) AS avg_price,
       CAST(d.sales AS DOUBLE) AS sales, d.units, d.views,
       CAST(ROUND(CAST(CAST(d.units AS DOUBLE) / NULLIF(CAST(d.views AS DOUBLE), 0) * 100.0 AS DECIMAL(38,10)), 1)
            AS DECIMAL(38,1)) || '%' AS conversion,
       d.borrows, d.deal
FROM daily d JOIN customer c ON c.c_custkey = d.user_id
WHERE d.units > 0
"""


def product_key(code: str) -> int | None:
    """The number of a product code; none for a code that no product has."""
    return int(code[1:]) if code[1:].isdecimal() and code[1:].isascii() else None


@report("product_daily_performance", covers=("R1", "A1", "A2", "A11", "J1", "J4", "F3"), oracle=R1_SQL, tag="DAILY",
        params=(Parameter("events.user_id", PRODUCT_CODE_RE, product_key),))
def product_daily_performance(t: Tables):
    """Per product-day with sales: average price, sales, units, views, conversion,
    borrows and deal flag. One pass over the daily facts (conditional aggregates
    replace the reference's four joins on product + day)."""
    ev = t.events
    is_ = lambda k: F.col("event_type") == k
    daily = (ev.groupBy("user_id", F.col("ts").cast("date").alias("day"))
             .agg(money_sum(F.when(is_("purchase"), F.col("value"))).alias("sales"),
                  F.count(F.when(is_("purchase"), 1)).alias("units"),
                  F.count(F.when(is_("view"), 1)).alias("views"),
                  F.count(F.when(is_("click"), 1)).alias("borrows"),
                  # integer flag keeps every buffer fixed-width (hash aggregate, not sort-based)
                  F.max(F.when(is_("signup"), F.lit(1))).alias("_deal"))
             .filter(F.col("units") > 0)
             .withColumn("deal", F.when(F.col("_deal") == 1, F.lit("SIGNUP"))))
    cust = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    return (daily.join(cust, daily.user_id == cust.c_custkey, "inner")
            .select(product_code("user_id").alias("product"), F.col("c_name").alias("title"),
                    F.col("c_mktsegment").alias("band"), "day",
                    rounded_double(ratio("sales", "units"), 2).alias("avg_price"),
                    as_double("sales").alias("sales"), "units", "views",
                    percent_text("units", "views", 1).alias("conversion"), "borrows", "deal"))


# ---------------------------------------------------------------- R2
R2_SQL = with_sql(PRODUCTS_SQL, """
band AS (SELECT l_partkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS ytd_sales,
                CAST(MIN(l_shipdate) AS DATE) AS onsite_date FROM lineitem GROUP BY l_partkey)
SELECT v.product, v.publisher, v.title, v.p_size, CAST(b.ytd_sales AS DOUBLE) AS ytd_sales, b.onsite_date
FROM band b, products v
WHERE b.ytd_sales BETWEEN 1200000 AND 1300000 AND b.onsite_date >= DATE '1995-02-01'
  AND b.l_partkey = v.p_partkey
ORDER BY b.onsite_date DESC
""")


@report("mid_band_products", covers=("R2", "J3", "P6", "P13", "L1", "A13"), oracle=R2_SQL, tag="MIDBAND")
def mid_band_products(t: Tables):
    """Products with sales between 1.2M and 1.3M first sold on or after 1995-02-01."""
    band = (t.lineitem.groupBy("l_partkey")
            .agg(money_sum("l_extendedprice").alias("ytd_sales"),
                 F.min("l_shipdate").cast("date").alias("onsite_date"))
            .filter(F.col("ytd_sales").between(1200000, 1300000)
                    & (F.col("onsite_date") >= F.lit("1995-02-01").cast("date"))))
    v = products(t)
    return (band.join(v, band.l_partkey == v.p_partkey)
            .orderBy(F.col("onsite_date").desc())
            .select("product", "publisher", "title", "p_size", as_double("ytd_sales").alias("ytd_sales"),
                    "onsite_date"))


# ---------------------------------------------------------------- R3
R3_SQL = """
SELECT d.source AS fro, d.lang, l.* FROM labels l, documents d
WHERE l.doc_id = d.doc_id ORDER BY d.source DESC
"""


@report("audit_join", covers=("R3", "J3", "P2", "L1"), oracle=R3_SQL, tag="AUDIT")
def audit_join(t: Tables):
    """Label rows (``l.*``) with who produced the document (source, language)."""
    lab, doc = t.labels.alias("l"), t.documents.alias("d")
    return (lab.join(doc, F.col("l.doc_id") == F.col("d.doc_id"))
            .select(F.col("d.source").alias("fro"), F.col("d.lang"), "l.*")
            .orderBy(F.col("fro").desc()))


# ---------------------------------------------------------------- R4
R4_SQL = with_sql(PRODUCTS_SQL, """
high AS (SELECT p_partkey AS hkey, p_size AS reviews_count FROM part WHERE p_size >= 48),
di AS (SELECT l_partkey, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS q, SUM(CAST(l_discount AS DECIMAL(18,2))) AS s,
              COUNT(*) AS n FROM lineitem GROUP BY l_partkey)
SELECT high.reviews_count,
       CAST(ROUND(CAST(CAST(di.q AS DOUBLE) / CAST(di.n AS DOUBLE) AS DECIMAL(38,10)), 0) AS DOUBLE) AS rate_number,
       CAST(ROUND(CAST(CAST(di.s AS DOUBLE) / CAST(di.n AS DOUBLE) * 100.0 AS DECIMAL(38,10)), 1) AS DOUBLE) AS score,
       ab.*
FROM products ab
LEFT JOIN high ON high.hkey = ab.p_partkey
LEFT JOIN di ON di.l_partkey = ab.p_partkey
WHERE ab.p_retailprice IS NOT NULL
  AND (ab.p_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey
                        HAVING SUM(CAST(l_discount AS DECIMAL(18,2))) >= COUNT(*) * 0.06)
       OR ab.p_partkey IN (SELECT hkey FROM high))
ORDER BY 1 DESC
""")


@report("high_score_products", covers=("R4", "A1", "A4", "J2", "J8", "P5", "P9"), oracle=R4_SQL, tag="HIGHSCORE")
def high_score_products(t: Tables):
    """Products with average discount score >= 6 % or on the high-score list, with scores."""
    ab = products(t)
    high = t.part.filter(F.col("p_size") >= 48).select(F.col("p_partkey").alias("hkey"),
                                                       F.col("p_size").alias("reviews_count"))
    di = (t.lineitem.groupBy("l_partkey")
          .agg(money_sum("l_quantity").alias("q"), money_sum("l_discount").alias("s"),
               F.count(F.lit(1)).alias("n")))
    # HAVING avg(score) >= 0.06, stated exactly: sum >= 0.06 * count (decimals, no float edge).
    scored = di.filter(F.col("s") >= F.col("n") * F.lit(0.06).cast("decimal(3,2)")).select(
        F.col("l_partkey").alias("k"))
    listed = high.select(F.col("hkey").alias("k"))
    # P5 + J8: (a IN sub1 OR a IN sub2) == semi join against the union of both key sets.
    keys = scored.unionByName(listed).distinct()
    chosen = ab.filter(F.col("p_retailprice").isNotNull()).join(keys, ab.p_partkey == keys.k, "left_semi")
    return (chosen.join(high, chosen.p_partkey == high.hkey, "left")
            .join(di, chosen.p_partkey == di.l_partkey, "left")
            .select("reviews_count",
                    rounded_double(ratio("q", "n"), 0).alias("rate_number"),
                    rounded_double(ratio("s", "n") * F.lit(100.0), 1).alias("score"),
                    *[chosen[c] for c in ab.columns])
            .orderBy(F.col("reviews_count").desc()))


# ---------------------------------------------------------------- R11
R11_SQL = with_sql(PRODUCTS_SQL, """
cand AS (SELECT p_partkey AS k FROM part WHERE p_size > 45
         UNION ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= DATE '2001-01-01'
         UNION ALL SELECT p_partkey FROM part WHERE p_retailprice >= 995),
deal AS (SELECT l_partkey, l_shipdate, l_discount, l_orderkey, l_linenumber, l_suppkey,
                ROW_NUMBER() OVER (PARTITION BY l_partkey
                                   ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS r
         FROM lineitem)
SELECT p.product, p.title, p.publisher, CAST(d.l_shipdate AS DATE) AS last_deal_day,
       'DISC_' || CAST(CAST(d.l_discount AS DECIMAL(18,2)) AS VARCHAR) AS deal_title
FROM products p LEFT JOIN deal d ON d.l_partkey = p.p_partkey AND d.r = 1
WHERE p.p_partkey IN (SELECT k FROM cand)
""")


@report("new_launch_candidates", covers=("R11", "U2", "J8", "J16", "W3"), oracle=R11_SQL, tag="NEWLAUNCH")
def new_launch_candidates(t: Tables):
    """Products from three candidate sources (union all, used as a set) with their latest deal."""
    li = t.lineitem
    cand = (t.part.filter(F.col("p_size") > 45).select(F.col("p_partkey").alias("k"))
            .unionByName(li.filter((F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp")))
                         .select(F.col("l_partkey").alias("k")))
            .unionByName(t.part.filter(F.col("p_retailprice") >= 995).select(F.col("p_partkey").alias("k"))))
    deal = latest_per_key(li.select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_discount"),
                          ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"])
    p = products(t).join(cand, F.col("p_partkey") == F.col("k"), "left_semi")
    return (p.join(deal, p.p_partkey == deal.l_partkey, "left")
            .select("product", "title", "publisher", F.col("l_shipdate").cast("date").alias("last_deal_day"),
                    F.concat(F.lit("DISC_"), money("l_discount").cast("string")).alias("deal_title")))


# ---------------------------------------------------------------- R13
R13_SQL = with_sql(PRODUCTS_SQL, f"""
nos AS (SELECT l.l_partkey, year(o.o_orderdate) AS snapshot, 'RF_' || l.l_returnflag AS source
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
latest AS (SELECT * FROM nos WHERE snapshot = (SELECT MAX(snapshot) FROM nos)),
gs AS (SELECT l_partkey, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM latest GROUP BY l_partkey)
SELECT p.product, left(p.title, 15) AS title, left(p.author, 15) AS author, p.publisher,
       CAST(p.p_size AS BIGINT) AS rank, gs.sources
FROM products p
LEFT JOIN gs ON gs.l_partkey = p.p_partkey
WHERE p.p_partkey IN (SELECT DISTINCT l_partkey FROM latest)
  AND p.title <> '' AND p.publisher <> ''
  AND p.p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= DATE '{LAUNCH_CUTOFF}' AND l_partkey IS NOT NULL)
ORDER BY rank
""")


@report("not_launched_rank", covers=("R13", "A6", "A9", "J2", "J8", "J9", "P11", "F1", "P16"), oracle=R13_SQL, tag="NOTLAUNCHEDRANK")
def not_launched_rank(t: Tables):
    """Products flagged in the latest pattern snapshot that are not launched, with the
    sorted list of sources that flagged them."""
    nos = (t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag")
           .join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
           .select("l_partkey", F.year("o_orderdate").alias("snapshot"),
                   F.concat(F.lit("RF_"), F.col("l_returnflag")).alias("source")))
    latest = nos.filter(F.col("snapshot") == nos.agg(F.max("snapshot")).scalar())
    # A6 group_concat: distinct first (bounded by the number of sources), then an ordered list.
    gs = (latest.select("l_partkey", "source").distinct()
          .groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources")))
    launched = t.lineitem.filter(F.col("l_shipdate") >= F.lit(LAUNCH_CUTOFF).cast("timestamp")).select("l_partkey").filter("l_partkey IS NOT NULL")
    p = products(t).filter((F.col("title") != "") & (F.col("publisher") != ""))
    p = not_in_anti_join(p, launched, "p_partkey", "l_partkey")
    # One row per product flagged in the latest snapshot: the join is the membership test as well.
    return (p.join(gs, p.p_partkey == gs.l_partkey)
            .select("product", F.left("title", F.lit(15)).alias("title"), F.left("author", F.lit(15)).alias("author"),
                    "publisher", F.col("p_size").cast("bigint").alias("rank"), "sources")
            .orderBy("rank"))


# ---------------------------------------------------------------- R14 / R15
def _creation(t: Tables, bucket, name: str):
    o = t.orders.filter((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))
                        & F.col("o_orderpriority").like("1%"))
    return (o.groupBy(bucket.alias(name))
            .agg(F.count_distinct("o_custkey").alias("tc"))
            .orderBy(F.col(name).desc()))


R14_SQL = """
SELECT CAST(month(o_orderdate) AS BIGINT) AS month, COUNT(DISTINCT o_custkey) AS tc
FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderpriority LIKE '1%'
GROUP BY month(o_orderdate) ORDER BY 1 DESC
"""
R15_SQL = """
SELECT CAST(strftime(o_orderdate, '%U') AS BIGINT) AS week, COUNT(DISTINCT o_custkey) AS tc
FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderpriority LIKE '1%'
GROUP BY 1 ORDER BY 1 DESC
"""


@report("creation_by_month", covers=("R14", "A3", "A5", "L2", "P8"), oracle=R14_SQL, tag="CREATION")
def creation_by_month(t: Tables):
    """Distinct urgent-order customers per calendar month (years merged, as the reference)."""
    return _creation(t, F.month("o_orderdate").cast("bigint"), "month")


R14Y_SQL = """
SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month,
       COUNT(DISTINCT o_custkey) AS tc
FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderpriority LIKE '1%'
GROUP BY 1, 2 ORDER BY 1 DESC, 2 DESC
"""


@report("creation_by_year_month", covers=("R14", "A3", "A5"), oracle=R14Y_SQL, tag="CREATIONYM")
def creation_by_year_month(t: Tables):
    """Year-aware variant of the monthly count (the reference's month grouping merges years)."""
    o = t.orders.filter((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))
                        & F.col("o_orderpriority").like("1%"))
    return (o.groupBy(F.year("o_orderdate").cast("bigint").alias("year"), F.month("o_orderdate").cast("bigint").alias("month"))
            .agg(F.count_distinct("o_custkey").alias("tc"))
            .orderBy(F.col("year").desc(), F.col("month").desc()))


@report("creation_by_week", covers=("R15", "A3", "A5", "F9"), oracle=R15_SQL, tag="CREATIONW")
def creation_by_week(t: Tables):
    """Same per Sunday-started week number (0-53)."""
    return _creation(t, week_sunday("o_orderdate"), "week")


# ---------------------------------------------------------------- R20
R20_SQL = with_sql(PRODUCTS_SQL, f"""
last_user AS (SELECT conv_id, text FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) r
              FROM conversations WHERE role = 'user') WHERE r = 1),
last_asst AS (SELECT conv_id, text FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) r
              FROM conversations WHERE role = 'assistant') WHERE r = 1)
SELECT p.product, left(p.title, 12) AS title, left(p.author, 8) AS author, p.p_size,
       {MULTILINE_SQL.format(c='u.text')} AS last_status,
       {MULTILINE_SQL.format(c='a.text')} AS last_eta
FROM products p
LEFT JOIN last_user u ON u.conv_id = p.p_partkey
LEFT JOIN last_asst a ON a.conv_id = p.p_partkey
WHERE p.p_size IS NOT NULL
  AND p.p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= DATE '{LAUNCH_CUTOFF}' AND l_partkey IS NOT NULL)
ORDER BY p.p_size DESC
""")


@report("not_launched_status", covers=("R20", "J9", "J21", "W3", "P9", "F20", "F1", "L6"), oracle=R20_SQL, tag="NOTLAUNCHED")
def not_launched_status(t: Tables):
    """Not-launched products with their latest status and latest ETA comment
    (one latest-per-key aggregate per comment type, then left joins; no per-row lookups)."""
    conv = t.conversations
    last_user = latest_per_key(conv.filter(F.col("role") == "user").select("conv_id", "turn", "text"),
                               ["conv_id"], ["turn"]).select(F.col("conv_id").alias("u_id"), F.col("text").alias("u_text"))
    last_asst = latest_per_key(conv.filter(F.col("role") == "assistant").select("conv_id", "turn", "text"),
                               ["conv_id"], ["turn"]).select(F.col("conv_id").alias("a_id"), F.col("text").alias("a_text"))
    launched = t.lineitem.filter(F.col("l_shipdate") >= F.lit(LAUNCH_CUTOFF).cast("timestamp")).select("l_partkey").filter("l_partkey IS NOT NULL")
    p = not_in_anti_join(products(t).filter(F.col("p_size").isNotNull()), launched, "p_partkey", "l_partkey")
    return (p.join(last_user, p.p_partkey == last_user.u_id, "left")
            .join(last_asst, p.p_partkey == last_asst.a_id, "left")
            .select("product", F.left("title", F.lit(12)).alias("title"), F.left("author", F.lit(8)).alias("author"),
                    "p_size", multilines_in_html("u_text").alias("last_status"),
                    multilines_in_html("a_text").alias("last_eta"))
            .orderBy(F.col("p_size").desc()))


# ---------------------------------------------------------------- R26
R26_SQL = """
WITH vis AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal >= 0),
mode AS (SELECT c_nationkey, c_mktsegment FROM (
           SELECT c_nationkey, c_mktsegment, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) r
           FROM (SELECT c_nationkey, c_mktsegment, COUNT(*) n FROM vis GROUP BY 1, 2)) WHERE r = 1)
SELECT o.o_orderkey, o.o_custkey, c.c_nationkey,
       COALESCE(v.c_mktsegment, m.c_mktsegment) AS segment,
       CASE WHEN v.c_custkey IS NOT NULL THEN 'exact' WHEN m.c_mktsegment IS NOT NULL THEN 'nation' END AS matched_by
FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN vis v ON v.c_custkey = o.o_custkey
LEFT JOIN mode m ON m.c_nationkey = c.c_nationkey
"""


@report("schedule_enrichment", covers=("R26", "J20", "A10"), oracle=R26_SQL, tag="SCHEDULE")
def schedule_enrichment(t: Tables):
    """Each order gets its customer's segment from the visible-customer list, else the
    most frequent visible segment of the customer's nation."""
    from shelfwise.operators.joins import lookup_with_fallback
    from shelfwise.operators.grouping import mode_per_key

    cust = t.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    vis = cust.filter(F.col("c_acctbal") >= 0).select("c_custkey", "c_mktsegment")
    mode = mode_per_key(cust.filter(F.col("c_acctbal") >= 0), "c_nationkey", "c_mktsegment")
    rows = (t.orders.select("o_orderkey", "o_custkey")
            .join(cust.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .drop("c_custkey"))
    return lookup_with_fallback(rows, exact=vis, exact_on=("o_custkey", "c_custkey"),
                                fallback=mode, fallback_on=("c_nationkey", "c_nationkey"),
                                value="c_mktsegment", out="segment").select(
        "o_orderkey", "o_custkey", "c_nationkey", "segment", "matched_by")


# ---------------------------------------------------------------- R28
R28_SQL = with_sql(PRODUCTS_SQL, f"""
last_turn AS (SELECT conv_id, role, text FROM (
   SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) r FROM conversations) WHERE r = 1),
approved AS (SELECT p.*, lt.text AS description FROM products p JOIN last_turn lt ON lt.conv_id = p.p_partkey
             WHERE lt.role = 'assistant')
SELECT product, publisher, title, author,
       publisher || '_' || product || '_' || strftime(DATE '{AS_OF}', '%Y%m%d') || '_' ||
         (CASE WHEN length(CAST(ROW_NUMBER() OVER (PARTITION BY publisher ORDER BY product) AS VARCHAR)) >= 4 THEN CAST(ROW_NUMBER() OVER (PARTITION BY publisher ORDER BY product) AS VARCHAR) ELSE right(repeat('0', 4) || CAST(ROW_NUMBER() OVER (PARTITION BY publisher ORDER BY product) AS VARCHAR), 4) END) AS ref_id,
       CASE WHEN length(description) >= 2000 THEN 'Y' ELSE 'N' END AS long_description,
       CASE WHEN contains(product, 'E') OR NOT contains(product, '97') THEN 'Y' ELSE 'N' END AS bad_isbn,
       CASE WHEN author IS NULL OR author = '' THEN 'Y' ELSE 'N' END AS missing_author
FROM approved
""")


@report("intake_sheet", covers=("R28", "J16", "J2", "P10", "F2", "W6", "F24"), oracle=R28_SQL, tag="INTAKE")
def intake_sheet(t: Tables):
    """Approved products (latest comment is an approval turn) with sequential reference
    ids per publisher and QA flags."""
    last = latest_per_key(t.conversations.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"])
    approved = (products(t).join(last.filter(F.col("role") == "assistant"),
                                 F.col("p_partkey") == F.col("conv_id"))
                .withColumnRenamed("text", "description"))
    seq = group_sequence(approved, ["publisher"], ["product"], "seq")
    return seq.select(
        "product", "publisher", "title", "author",
        F.concat_ws("_", "publisher", "product", yyyymmdd(F.lit(AS_OF).cast("date")),
                    zero_padded("seq", 4)).alias("ref_id"),
        F.when(F.length("description") >= 2000, "Y").otherwise("N").alias("long_description"),
        F.when(F.col("product").contains("E") | ~F.col("product").contains("97"), "Y").otherwise("N").alias("bad_isbn"),
        F.when(F.col("author").isNull() | (F.col("author") == ""), "Y").otherwise("N").alias("missing_author"))


# ---------------------------------------------------------------- R30
R30_SQL = """
WITH rights AS (SELECT p.p_brand AS publisher, MAX(l.l_shipdate) AS last_update
                FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey GROUP BY p.p_brand)
SELECT DISTINCT publisher FROM rights
WHERE last_update IS NULL
   OR strftime(last_update, '%Y%m%d') <> (SELECT strftime(MAX(l_shipdate), '%Y%m%d') FROM lineitem)
"""


@report("due_publishers", covers=("R30", "A9", "P9", "F8", "P11", "A13", "F10"), oracle=R30_SQL, tag="DUE")
def due_publishers(t: Tables):
    """Publishers not yet updated on the as-of day (= the latest sale day in the data)."""
    days = t.lineitem.groupBy("l_partkey").agg(F.max("l_shipdate").alias("day"))   # before the join: one row per product
    rights = (t.part.select("p_partkey", "p_brand")
              .join(days, F.col("l_partkey") == F.col("p_partkey"), "left")
              .groupBy(F.col("p_brand").alias("publisher")).agg(F.max("day").alias("last_update")))
    today = yyyymmdd(t.lineitem.agg(F.max("l_shipdate")).scalar())
    return (rights.filter(F.col("last_update").isNull() | (yyyymmdd("last_update") != today))
            .select("publisher").distinct())


# ---------------------------------------------------------------- R25
WORKLIST_AS_OF = "2001-12-01"

R25_SQL = f"""
WITH src AS (
  SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, 1 AS prio, 'CHK' AS src
  FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL
  SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE), 2, 'DEAL'
  FROM lineitem WHERE l_discount >= 0.09
  UNION ALL
  SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE), 3, 'WEEK'
  FROM lineitem WHERE l_linestatus = 'O'),
first AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_partkey
            ORDER BY prio, day, l_suppkey, l_orderkey, l_linenumber) r FROM src) WHERE r = 1),
w AS (SELECT {PRODUCT_CODE_SQL.format(k='l_partkey')} AS product, 'V' || (CASE WHEN length(CAST(l_suppkey AS VARCHAR)) >= 4 THEN CAST(l_suppkey AS VARCHAR) ELSE right(repeat('0', 4) || CAST(l_suppkey AS VARCHAR), 4) END) AS vendor,
             src, day, datediff('day', day, DATE '{WORKLIST_AS_OF}') AS age_days, l_partkey
      FROM first f
      WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = f.l_partkey AND p.p_size <= 3)),
io AS (SELECT {PRODUCT_CODE_SQL.format(k='p_partkey')} AS code, 'IN' AS io FROM part WHERE p_size >= 45
       UNION ALL
       SELECT 'V' || (CASE WHEN length(CAST(s_suppkey AS VARCHAR)) >= 4 THEN CAST(s_suppkey AS VARCHAR) ELSE right(repeat('0', 4) || CAST(s_suppkey AS VARCHAR), 4) END), 'OUT' FROM supplier WHERE s_acctbal < 0)
SELECT w.product, w.vendor, w.src, w.day, w.age_days, io.io
FROM w LEFT JOIN io ON io.code = w.product OR io.code = w.vendor
"""


@report("metadata_worklist", covers=("R25", "W5", "J11", "J13", "P15", "F22", "U2"), oracle=R25_SQL, tag="METADATA")
def metadata_worklist(t: Tables):
    """Products to check: first source wins (checklist > deal schedule > weekly list),
    cleared products skipped, age in days, and the weekly in/out change found either by
    product or by vendor code (disjunctive lookup as two equi-joins)."""
    return worklist(t)


def worklist(t: Tables, since: str | None = None):
    """The worklist of whole sources, as the reference has it (its interval is never compared with a day), or of what was
    sold ``since`` a day."""
    from shelfwise.functions.dates import age_days, date_lit
    from shelfwise.operators.joins import disjunctive_join
    from shelfwise.operators.topn import priority_first

    li = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag",
                           "l_discount", "l_linestatus")
    if since:
        li = li.filter(F.col("l_shipdate") >= date_lit(since).cast("timestamp"))
    base = ["l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day")]
    src = (li.filter(F.col("l_returnflag") == "R").select(*base, F.lit(1).alias("prio"), F.lit("CHK").alias("src"))
           .unionByName(li.filter(F.col("l_discount") >= 0.09).select(*base, F.lit(2).alias("prio"), F.lit("DEAL").alias("src")))
           .unionByName(li.filter(F.col("l_linestatus") == "O").select(*base, F.lit(3).alias("prio"), F.lit("WEEK").alias("src"))))
    first = priority_first(src, ["l_partkey"], "prio", ["day", "l_suppkey", "l_orderkey", "l_linenumber"])
    cleared = t.part.filter(F.col("p_size") <= 3).select(F.col("p_partkey").alias("ck"))
    w = (first.join(cleared, first.l_partkey == cleared.ck, "left_anti")
         .select(product_code("l_partkey").alias("product"),
                 F.concat(F.lit("V"), zero_padded("l_suppkey", 4)).alias("vendor"),
                 "src", "day", age_days("day", WORKLIST_AS_OF).cast("bigint").alias("age_days")))
    io = (t.part.filter(F.col("p_size") >= 45).select(product_code("p_partkey").alias("code"), F.lit("IN").alias("io"))
          .unionByName(t.supplier.filter(F.col("s_acctbal") < 0)
                       .select(F.concat(F.lit("V"), zero_padded("s_suppkey", 4)).alias("code"),
                               F.lit("OUT").alias("io"))))
    return (disjunctive_join(w, io, ("product", "code"), ("vendor", "code"), how="left")
            .select("product", "vendor", "src", "day", "age_days", "io"))
