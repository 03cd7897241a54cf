"""Snapshot reports: R8 (deal-strong, new/carried flag), R9 (dual-high), R10 (upstream
uplift), R12 (price ladder).

Snapshot = order month; a month that the newest order does not close is partial and excluded, so the
latest complete snapshot is compared with the one before (P11/P12, W7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import zero_padded
from shelfwise.functions.numeric import money_sum, as_double, money, percent_text, ratio, round_half_up, rounded_double
from shelfwise.operators.snapshots import new_vs_carried
from shelfwise.plans.registry import report
from shelfwise.sources.tables import Tables


def complete_months(orders: DataFrame) -> DataFrame:
    """Orders of months that are over: those before the month of the day after the newest order."""
    open_month = orders.agg(F.trunc(F.date_add(F.max("o_orderdate").cast("date"), 1), "month")).scalar()
    return orders.filter(F.col("o_orderdate") < open_month.cast("timestamp"))


def customer_code(col: str):
    return F.concat(F.lit("C"), zero_padded(col, 9))


def _snapshot_agg(o: DataFrame) -> DataFrame:
    return (o.groupBy(F.trunc("o_orderdate", "month").alias("snapshot"), "o_custkey")
            .agg(F.count(F.lit(1)).alias("n_orders"), money_sum("o_totalprice").alias("total"),
                 F.min("o_orderdate").cast("date").alias("start_day"),
                 F.max("o_orderdate").cast("date").alias("end_day")))


def two_latest_snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Latest and previous snapshot rows, aggregating only those two months.

    The two snapshot months are read off the base column (``trunc`` is monotonic,
    so max over orders = max over the snapshot table): two scalar subqueries,
    then the orders are filtered to the two months before the aggregation -- the
    rest of the history is never aggregated.
    """
    o = complete_months(t.orders)
    month = F.trunc("o_orderdate", "month")
    latest = o.agg(F.max(month)).scalar()
    previous = o.filter(month < latest).agg(F.max(month)).scalar()
    snap = _snapshot_agg(o.filter((month == latest) | (month == previous)))
    return snap.filter(F.col("snapshot") == latest), snap.filter(F.col("snapshot") == previous)


SNAP_SQL = f"""WITH snap AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot, o_custkey, COUNT(*) AS n_orders,
         SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total, CAST(MIN(o_orderdate) AS DATE) AS start_day,
         CAST(MAX(o_orderdate) AS DATE) AS end_day
  FROM orders WHERE o_orderdate < (SELECT date_trunc('month', CAST(MAX(o_orderdate) AS DATE) + 1) FROM orders) GROUP BY 1, 2),
latest AS (SELECT * FROM snap WHERE snapshot = (SELECT MAX(snapshot) FROM snap)),
prev AS (SELECT * FROM snap WHERE snapshot = (SELECT MAX(snapshot) FROM snap
                                              WHERE snapshot <> (SELECT MAX(snapshot) FROM snap))),
flagged AS (
  SELECT l.*, 'N' AS new_flag FROM latest l WHERE EXISTS (SELECT 1 FROM prev p WHERE p.o_custkey = l.o_custkey)
  UNION
  SELECT l.*, 'Y' AS new_flag FROM latest l WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.o_custkey = l.o_custkey))
"""

_PCT = ("CAST(ROUND(CAST(CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0) * 100.0 AS DECIMAL(38,10)), {k})"
        " AS DECIMAL(38,{k})) || '%'")


def _flagged(t: Tables) -> tuple[DataFrame, DataFrame]:
    latest, prev = two_latest_snapshots(t)
    return new_vs_carried(latest, prev, "o_custkey"), prev


# ---------------------------------------------------------------- R8
R8_SQL = SNAP_SQL + f""",
deal AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, MAX(CAST(o_totalprice AS DECIMAL(18,2))) AS deal_price
         FROM orders GROUP BY 1, 2)
SELECT f.snapshot, 'C' || (CASE WHEN length(CAST(f.o_custkey AS VARCHAR)) >= 9 THEN CAST(f.o_custkey AS VARCHAR) ELSE right(repeat('0', 9) || CAST(f.o_custkey AS VARCHAR), 9) END) AS customer, c.c_name, c.c_mktsegment AS segment,
       f.new_flag, f.n_orders, CAST(f.total AS DOUBLE) AS total, f.start_day, f.end_day,
       datediff('day', f.start_day, f.end_day) + 1 AS days, CAST(d.deal_price AS DOUBLE) AS deal_price,
       {_PCT.format(n='d.deal_price', d='f.total', k=1)} AS deal_share
FROM flagged f
LEFT JOIN customer c ON c.c_custkey = f.o_custkey
LEFT JOIN deal d ON d.o_custkey = f.o_custkey AND d.d = f.start_day
WHERE c.c_mktsegment <> 'AUTOMOBILE'
ORDER BY f.new_flag DESC, total DESC
"""


@report("deal_strong_new_flag", covers=("R8", "W7", "P11", "P12", "J2", "J4", "J7", "J10", "J11", "U1", "F8"),
        oracle=R8_SQL, tag="NEWFLAG")
def deal_strong_new_flag(t: Tables):
    """Customers of the latest complete month, new ('Y') or carried over ('N') from the
    month before, with the deal (largest order) of their first order day."""
    flagged, _ = _flagged(t)
    cust = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    deal = (t.orders.groupBy(F.col("o_custkey").alias("d_cust"), F.col("o_orderdate").cast("date").alias("d_day"))
            .agg(F.max(money("o_totalprice")).alias("deal_price")))
    # The WHERE on the left-joined customer makes it an inner join (Catalyst does the same).
    return (flagged.join(cust, flagged.o_custkey == cust.c_custkey, "left")
            .join(deal, (F.col("o_custkey") == F.col("d_cust")) & (F.col("start_day") == F.col("d_day")), "left")
            .filter(F.col("c_mktsegment") != "AUTOMOBILE")
            .orderBy(F.col("new_flag").desc(), F.col("total").desc())
            .select("snapshot", customer_code("o_custkey").alias("customer"), "c_name",
                    F.col("c_mktsegment").alias("segment"), "new_flag", "n_orders", as_double("total").alias("total"),
                    "start_day", "end_day", (F.datediff("end_day", "start_day") + 1).cast("bigint").alias("days"),
                    as_double("deal_price").alias("deal_price"),
                    percent_text("deal_price", "total", 1).alias("deal_share")))


# ---------------------------------------------------------------- R9
R9_SQL = SNAP_SQL + f"""
SELECT f.snapshot, 'C' || (CASE WHEN length(CAST(f.o_custkey AS VARCHAR)) >= 9 THEN CAST(f.o_custkey AS VARCHAR) ELSE right(repeat('0', 9) || CAST(f.o_custkey AS VARCHAR), 9) END) AS customer, f.new_flag, f.n_orders,
       CAST(f.total AS DOUBLE) AS total,
       CAST(ROUND(CAST(CAST(f.total AS DOUBLE) / CAST(f.n_orders AS DOUBLE) AS DECIMAL(38,10)), 2) AS DOUBLE) AS avg_order,
       CASE WHEN f.total >= 600000 THEN 'HIGH' WHEN f.total >= 300000 THEN 'MID' ELSE 'LOW' END AS tier,
       CAST(p.total AS DOUBLE) AS prev_total, CAST(f.total - p.total AS DOUBLE) AS growth,
       {_PCT.format(n='f.total - p.total', d='p.total', k=1)} AS growth_pct
FROM flagged f LEFT JOIN prev p ON p.o_custkey = f.o_custkey
WHERE f.n_orders >= 2
"""


@report("dual_high_sheet", covers=("R9", "W7", "J4", "P10", "P3"), oracle=R9_SQL, tag="DUALHIGH")
def dual_high_sheet(t: Tables):
    """Latest-month customers with two or more orders: tier, average order, growth."""
    flagged, prev = _flagged(t)
    p = prev.select(F.col("o_custkey").alias("p_cust"), F.col("total").alias("p_total"))
    return (flagged.filter(F.col("n_orders") >= 2)
            .join(p, F.col("o_custkey") == F.col("p_cust"), "left")
            .select("snapshot", customer_code("o_custkey").alias("customer"), "new_flag", "n_orders",
                    as_double("total").alias("total"),
                    rounded_double(ratio("total", "n_orders"), 2).alias("avg_order"),
                    F.when(F.col("total") >= 600000, "HIGH").when(F.col("total") >= 300000, "MID")
                    .otherwise("LOW").alias("tier"),
                    as_double("p_total").alias("prev_total"),
                    as_double(F.col("total") - F.col("p_total")).alias("growth"),
                    percent_text(F.col("total") - F.col("p_total"), "p_total", 1).alias("growth_pct")))


# ---------------------------------------------------------------- R10
R10_SQL = f"""WITH u AS (
  SELECT CAST(date_trunc('month', o.o_orderdate) AS DATE) AS snapshot, o.o_custkey,
         SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS units
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
  WHERE o.o_orderdate < (SELECT date_trunc('month', CAST(MAX(o_orderdate) AS DATE) + 1) FROM orders) GROUP BY 1, 2),
latest AS (SELECT * FROM u WHERE snapshot = (SELECT MAX(snapshot) FROM u)),
prev AS (SELECT * FROM u WHERE snapshot = (SELECT MAX(snapshot) FROM u WHERE snapshot <> (SELECT MAX(snapshot) FROM u)))
SELECT l.snapshot, 'C' || (CASE WHEN length(CAST(l.o_custkey AS VARCHAR)) >= 9 THEN CAST(l.o_custkey AS VARCHAR) ELSE right(repeat('0', 9) || CAST(l.o_custkey AS VARCHAR), 9) END) AS customer,
       CASE WHEN p.o_custkey IS NULL THEN 'Y' ELSE 'N' END AS new_flag,
       CAST(l.units AS DOUBLE) AS units, CAST(p.units AS DOUBLE) AS prev_units,
       {_PCT.format(n='l.units', d='p.units', k=1)} AS uplift,
       CASE WHEN p.units IS NULL THEN 'NEW' WHEN l.units >= 1.5 * p.units THEN 'UP' ELSE 'FLAT' END AS trend
FROM latest l LEFT JOIN prev p ON p.o_custkey = l.o_custkey
"""


@report("upstream_uplift", covers=("R10", "W7", "J4", "P10", "P3", "P12"), oracle=R10_SQL, tag="UPLIFT")
def upstream_uplift(t: Tables):
    """Units bought per customer in the latest complete month vs the month before."""
    o = complete_months(t.orders).select(
        "o_orderkey", "o_custkey", "o_orderdate")
    month = F.trunc("o_orderdate", "month")
    # The two latest months with sold lines: a set of months, from orders that have any.
    months = (o.join(t.lineitem.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
              .agg(F.sort_array(F.collect_set(month), asc=False)).scalar())
    last, before = F.get(months, F.lit(0)), F.get(months, F.lit(1))
    u = (o.filter((month == last) | (month == before))
         .join(t.lineitem.select("l_orderkey", "l_quantity"), F.col("l_orderkey") == F.col("o_orderkey"))
         .groupBy(month.alias("snapshot"), "o_custkey").agg(money_sum("l_quantity").alias("units")))
    latest = u.filter(F.col("snapshot") == last)
    prev = u.filter(F.col("snapshot") == before).select(F.col("o_custkey").alias("p_cust"),
                                                        F.col("units").alias("p_units"))
    return (latest.join(prev, F.col("o_custkey") == F.col("p_cust"), "left")
            .select("snapshot", customer_code("o_custkey").alias("customer"),
                    F.when(F.col("p_cust").isNull(), "Y").otherwise("N").alias("new_flag"),
                    as_double("units").alias("units"), as_double("p_units").alias("prev_units"),
                    percent_text("units", "p_units", 1).alias("uplift"),
                    F.when(F.col("p_units").isNull(), "NEW")
                    .when(F.col("units") >= F.lit(1.5).cast("decimal(2,1)") * F.col("p_units"), "UP")
                    .otherwise("FLAT").alias("trend")))


# ---------------------------------------------------------------- R12
R12_SQL = """WITH lv AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot_day, CAST(l_discount AS DECIMAL(18,2)) AS price,
         SUM(CAST(l_quantity AS DECIMAL(18,2))) AS units, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS sales
  FROM lineitem GROUP BY 1, 2),
ladder AS (
  SELECT snapshot_day, 'pu' AS type, price,
         CAST(ROUND(CAST(CAST(SUM(units) OVER (PARTITION BY snapshot_day ORDER BY price) AS DOUBLE)
              / CAST(SUM(units) OVER (PARTITION BY snapshot_day) AS DOUBLE) AS DECIMAL(38,10)), 4) AS DECIMAL(38,4)) AS ratio
  FROM lv
  UNION ALL
  SELECT snapshot_day, 'gms', price,
         CAST(ROUND(CAST(CAST(SUM(sales) OVER (PARTITION BY snapshot_day ORDER BY price DESC) AS DOUBLE)
              / CAST(SUM(sales) OVER (PARTITION BY snapshot_day) AS DOUBLE) AS DECIMAL(38,10)), 4) AS DECIMAL(38,4))
  FROM lv),
cur AS (SELECT * FROM ladder WHERE snapshot_day = (SELECT MAX(snapshot_day) FROM ladder))
SELECT pl.snapshot_day, CAST(pl.price AS DOUBLE) AS discount,
       CAST(ROUND(pl.ratio * 100, 2) AS DECIMAL(38,2)) || '%' AS unit_share,
       CAST(ROUND(g.ratio * 100, 2) AS DECIMAL(38,2)) || '%' AS sales_share
FROM (SELECT * FROM cur WHERE type = 'pu' AND ratio >= 0.8) pl
JOIN (SELECT * FROM cur WHERE type = 'gms' AND ratio <= 0.8) g ON g.price = pl.price
"""


@report("price_ladder", covers=("R12", "J18", "P11", "F3"), oracle=R12_SQL, tag="LADDER")
def price_ladder(t: Tables):
    """Latest month: discount levels where the cumulative unit share (from no discount up)
    reaches 80 % while the cumulative sales share (from the deepest discount down) is
    still within 80 %."""
    # Only the latest month is reported: its start is trunc(max(ship day)), and only that
    # month's lines are aggregated (instead of a ladder for every month).
    li = t.lineitem
    last_month = li.agg(F.trunc(F.max("l_shipdate"), "month")).scalar()
    lv = (li.filter(F.col("l_shipdate") >= last_month.cast("timestamp"))
          .groupBy(F.trunc("l_shipdate", "month").alias("snapshot_day"), money("l_discount").alias("price"))
          .agg(money_sum("l_quantity").alias("units"), money_sum("l_extendedprice").alias("sales")))
    w_all = Window.partitionBy("snapshot_day")

    def share(measure: str, ascending: bool):
        w = Window.partitionBy("snapshot_day").orderBy(F.col("price").asc() if ascending else F.col("price").desc())
        return round_half_up(ratio(F.sum(measure).over(w), F.sum(measure).over(w_all)), 4)

    ladder = (lv.select("snapshot_day", F.lit("pu").alias("type"), "price", share("units", True).alias("ratio"))
              .unionByName(lv.select("snapshot_day", F.lit("gms").alias("type"), "price",
                                     share("sales", False).alias("ratio"))))
    cur = ladder
    pl = cur.filter((F.col("type") == "pu") & (F.col("ratio") >= 0.8)).select("snapshot_day", "price",
                                                                             F.col("ratio").alias("pu_ratio"))
    g = cur.filter((F.col("type") == "gms") & (F.col("ratio") <= 0.8)).select(F.col("price").alias("g_price"),
                                                                            F.col("ratio").alias("gms_ratio"))
    pct = lambda c: F.concat(F.round(F.col(c) * 100, 2).cast("decimal(38,2)").cast("string"), F.lit("%"))
    return (pl.join(g, F.col("price") == F.col("g_price"))
            .select("snapshot_day", as_double("price").alias("discount"), pct("pu_ratio").alias("unit_share"),
                    pct("gms_ratio").alias("sales_share")))
