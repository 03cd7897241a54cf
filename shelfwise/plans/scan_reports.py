"""R19 publisher scan: seven sheets over one product-level view, for every publisher
in one run (the reference took the first publisher named in the request only).

Sheets: first-listing deals, low conversion, no traffic, suppressed titles, never
discounted, inactive titles, deal uplift. "Missing metric last" orderings are
``asc_nulls_last`` (the reference's ``order by isnull(x), x``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numeric import money_sum, as_double, money, ratio, rounded_double
from shelfwise.operators.topn import latest_per_key
from shelfwise.plans.registry import report
from shelfwise.plans.views import PRODUCTS_SQL, products, with_sql
from shelfwise.sources.tables import Tables

# Fixed analogue parameters: the as-of day and the trailing windows.
AS_OF = "2001-11-05"
T30_FROM = "2001-10-06"
T90_FROM = "2001-08-07"
DEAL_DISCOUNT = 0.09


def vendor_ltd(t: Tables) -> DataFrame:
    """Per product: trailing-30-day units, trailing-90-day views (sale lines), conversion,
    first sale day, suppression state and deal flag -- one aggregate over the sales."""
    li = t.lineitem
    t30 = F.col("l_shipdate") >= F.lit(T30_FROM).cast("timestamp")
    t90 = F.col("l_shipdate") >= F.lit(T90_FROM).cast("timestamp")
    agg = li.groupBy("l_partkey").agg(
        money_sum(F.when(t30, F.col("l_quantity"))).alias("pu_t30"),
        F.count(F.when(t90, 1)).alias("_gv"),
        F.min("l_shipdate").cast("date").alias("onsite_date"),
        F.max(money("l_discount")).alias("_max_disc"))
    p = products(t)
    return (p.join(agg, p.p_partkey == agg.l_partkey, "left")
            .select("product", "publisher", "title", "onsite_date",
                    as_double("pu_t30").alias("pu_t30"),
                    F.when(F.col("_gv") > 0, F.col("_gv")).alias("gv_t30"),
                    rounded_double(ratio("pu_t30", F.when(F.col("_gv") > 0, F.col("_gv"))), 4).alias("cr_t30"),
                    F.when(F.col("p_size") <= 3, "COMPLETELY_SUPPRESSED").otherwise("ACTIVE").alias("suppression_state"),
                    F.when(F.col("_max_disc") >= 0.08, "y").otherwise("n").alias("deal_flag")))


VENDOR_LTD_SQL = with_sql(PRODUCTS_SQL, f"""
agg AS (SELECT l_partkey,
               SUM(CASE WHEN l_shipdate >= DATE '{T30_FROM}' THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS pu_t30,
               COUNT(*) FILTER (WHERE l_shipdate >= DATE '{T90_FROM}') AS gv,
               CAST(MIN(l_shipdate) AS DATE) AS onsite_date, MAX(CAST(l_discount AS DECIMAL(18,2))) AS max_disc
        FROM lineitem GROUP BY l_partkey),
ltd AS (SELECT p.product, p.publisher, p.title, a.onsite_date, CAST(a.pu_t30 AS DOUBLE) AS pu_t30,
               CASE WHEN a.gv > 0 THEN a.gv END AS gv_t30,
               CAST(ROUND(CAST(CAST(a.pu_t30 AS DOUBLE) / CAST(CASE WHEN a.gv > 0 THEN a.gv END AS DOUBLE)
                    AS DECIMAL(38,10)), 4) AS DOUBLE) AS cr_t30,
               CASE WHEN p.p_size <= 3 THEN 'COMPLETELY_SUPPRESSED' ELSE 'ACTIVE' END AS suppression_state,
               CASE WHEN a.max_disc >= 0.08 THEN 'y' ELSE 'n' END AS deal_flag
        FROM products p LEFT JOIN agg a ON a.l_partkey = p.p_partkey)
""")


def _sheet_sql(where: str, order: str) -> str:
    return VENDOR_LTD_SQL + f"SELECT * FROM ltd {where} ORDER BY publisher, {order}\n"


@report("publisher_scan_low_cr", covers=("R19", "L4", "P9"), oracle=_sheet_sql("", "cr_t30 NULLS LAST, onsite_date DESC"),
        tag="PUBSCAN")
def publisher_scan_low_cr(t: Tables):
    """Every title by ascending conversion, titles without conversion last."""
    return vendor_ltd(t).orderBy("publisher", F.col("cr_t30").asc_nulls_last(), F.col("onsite_date").desc())


@report("publisher_scan_no_gv", covers=("R19", "L4"), oracle=_sheet_sql("", "gv_t30 NULLS LAST, onsite_date DESC"))
def publisher_scan_no_gv(t: Tables):
    """Every title by ascending traffic, titles without traffic last."""
    return vendor_ltd(t).orderBy("publisher", F.col("gv_t30").asc_nulls_last(), F.col("onsite_date").desc())


@report("publisher_scan_inactive", covers=("R19", "L4"), oracle=_sheet_sql("", "pu_t30 NULLS LAST, onsite_date DESC"))
def publisher_scan_inactive(t: Tables):
    """Every title by ascending recent units, titles without units last."""
    return vendor_ltd(t).orderBy("publisher", F.col("pu_t30").asc_nulls_last(), F.col("onsite_date").desc())


@report("publisher_scan_suppressed", covers=("R19", "P4", "P7"),
        oracle=_sheet_sql("WHERE suppression_state = 'COMPLETELY_SUPPRESSED'", "onsite_date DESC"))
def publisher_scan_suppressed(t: Tables):
    """Completely suppressed titles."""
    return (vendor_ltd(t).filter(F.col("suppression_state") == "COMPLETELY_SUPPRESSED")
            .orderBy("publisher", F.col("onsite_date").desc()))


@report("publisher_scan_no_deal", covers=("R19", "P4"), oracle=_sheet_sql("WHERE deal_flag = 'n'", "onsite_date DESC"))
def publisher_scan_no_deal(t: Tables):
    """Titles never discounted by 8 % or more."""
    return vendor_ltd(t).filter(F.col("deal_flag") == "n").orderBy("publisher", F.col("onsite_date").desc())


FL_DEAL_SQL = with_sql(PRODUCTS_SQL, """
first_sale AS (SELECT * FROM (SELECT l_partkey, l_shipdate, l_discount,
      ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) r
      FROM lineitem) WHERE r = 1)
SELECT p.product, p.publisher, p.title, CAST(f.l_shipdate AS DATE) AS onsite_date,
       CAST(CAST(f.l_discount AS DECIMAL(18,2)) AS DOUBLE) AS first_discount
FROM products p JOIN first_sale f ON f.l_partkey = p.p_partkey
WHERE CAST(f.l_discount AS DECIMAL(18,2)) >= 0.05
ORDER BY p.publisher, onsite_date DESC
""")


@report("publisher_scan_fl_deal", covers=("R19", "W3"), oracle=FL_DEAL_SQL)
def publisher_scan_fl_deal(t: Tables):
    """Titles whose first sale was already discounted by 5 % or more (first-listing deal)."""
    first = latest_per_key(
        t.lineitem.select("l_partkey", (-F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("k1"),
                          (-F.col("l_orderkey")).alias("k2"), (-F.col("l_linenumber")).alias("k3"),
                          (-F.col("l_suppkey")).alias("k4"), "l_shipdate", "l_discount"),
        ["l_partkey"], ["k1", "k2", "k3", "k4"])
    p = products(t)
    return (p.join(first, p.p_partkey == first.l_partkey)
            .filter(money("l_discount") >= F.lit(0.05).cast("decimal(3,2)"))
            .select("product", "publisher", "title", F.col("l_shipdate").cast("date").alias("onsite_date"),
                    as_double(money("l_discount")).alias("first_discount"))
            .orderBy("publisher", F.col("onsite_date").desc()))


DEAL_UPLIFT_SQL = with_sql(PRODUCTS_SQL, f"""
deal AS (SELECT l_partkey, CAST(MAX(l_shipdate) AS DATE) AS start_day FROM lineitem
         WHERE l_discount >= {DEAL_DISCOUNT} GROUP BY l_partkey),
w AS (SELECT d.l_partkey, d.start_day,
        SUM(CASE WHEN l.l_shipdate >= d.start_day - INTERVAL 30 DAY AND l.l_shipdate < d.start_day
                 THEN CAST(l.l_quantity AS DECIMAL(18,2)) END) AS prior_units,
        SUM(CASE WHEN l.l_shipdate >= d.start_day AND l.l_shipdate < d.start_day + INTERVAL 7 DAY
                 THEN CAST(l.l_quantity AS DECIMAL(18,2)) END) AS campaign_units,
        SUM(CASE WHEN l.l_shipdate >= d.start_day + INTERVAL 7 DAY AND l.l_shipdate < d.start_day + INTERVAL 37 DAY
                 THEN CAST(l.l_quantity AS DECIMAL(18,2)) END) AS post_units,
        SUM(CASE WHEN l.l_shipdate >= d.start_day - INTERVAL 30 DAY AND l.l_shipdate < d.start_day
                 THEN CAST(l.l_extendedprice AS DECIMAL(18,2)) END) AS prior_gms,
        SUM(CASE WHEN l.l_shipdate >= d.start_day AND l.l_shipdate < d.start_day + INTERVAL 7 DAY
                 THEN CAST(l.l_extendedprice AS DECIMAL(18,2)) END) AS campaign_gms,
        SUM(CASE WHEN l.l_shipdate >= d.start_day + INTERVAL 7 DAY AND l.l_shipdate < d.start_day + INTERVAL 37 DAY
                 THEN CAST(l.l_extendedprice AS DECIMAL(18,2)) END) AS post_gms
      FROM deal d JOIN lineitem l ON l.l_partkey = d.l_partkey
      WHERE l.l_shipdate >= d.start_day - INTERVAL 30 DAY AND l.l_shipdate < d.start_day + INTERVAL 37 DAY
      GROUP BY d.l_partkey, d.start_day)
SELECT p.product, p.publisher, p.title, w.start_day, CAST(w.start_day + INTERVAL 6 DAY AS DATE) AS end_day,
       CAST(w.prior_units AS DOUBLE) AS prior_units, CAST(w.campaign_units AS DOUBLE) AS campaign_units,
       CAST(w.post_units AS DOUBLE) AS post_units, CAST(w.prior_gms AS DOUBLE) AS prior_gms,
       CAST(w.campaign_gms AS DOUBLE) AS campaign_gms, CAST(w.post_gms AS DOUBLE) AS post_gms
FROM w JOIN products p ON p.p_partkey = w.l_partkey
ORDER BY p.publisher, w.start_day DESC, p.product
""")


@report("publisher_scan_deal_uplift", covers=("R19", "J4", "A2"), oracle=DEAL_UPLIFT_SQL)
def publisher_scan_deal_uplift(t: Tables):
    """Latest deep-discount day of each title with units and sales in the 30 days before,
    the 7 deal days, and the 30 days after (an equi-join on the product plus a day range)."""
    li = t.lineitem.select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    deal = (li.filter(F.col("l_discount") >= DEAL_DISCOUNT).groupBy(F.col("l_partkey").alias("d_key"))
            .agg(F.max("l_shipdate").cast("date").alias("start_day")))
    day = F.col("l_shipdate")
    start = F.col("start_day").cast("timestamp")
    plus = lambda n: F.date_add("start_day", n).cast("timestamp")
    prior_w = (day >= plus(-30)) & (day < start)
    camp_w = (day >= start) & (day < plus(7))
    post_w = (day >= plus(7)) & (day < plus(37))
    w = (deal.join(li, F.col("d_key") == F.col("l_partkey"))
         .filter((day >= plus(-30)) & (day < plus(37)))
         .groupBy("d_key", "start_day")
         .agg(*[money_sum(F.when(cond, F.col(c))).alias(f"{name}_{kind}")
                for name, cond in (("prior", prior_w), ("campaign", camp_w), ("post", post_w))
                for c, kind in (("l_quantity", "units"), ("l_extendedprice", "gms"))]))
    p = products(t)
    return (w.join(p, F.col("d_key") == F.col("p_partkey"))
            .orderBy("publisher", F.col("start_day").desc(), "product")
            .select("product", "publisher", "title", "start_day", F.date_add("start_day", 6).alias("end_day"),
                    *[as_double(f"{n}_{k}").alias(f"{n}_{k}") for k in ("units", "gms")
                      for n in ("prior", "campaign", "post")]))
