"""Promotion billing (R27a-d) under three funding models, with total rows.

Analogue billing line: promotion = l_linenumber, vendor = supplier, charged =
l_linestatus 'F', price = extended price, discount = -price x l_discount,
discount tax = discount x l_tax, cost = 0.6 x price, return = l_returnflag 'R'.

All promotions are billed in one pass (group by promotion and vendor); the
reference re-ran the statement once per promotion and once per vendor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.text import zero_padded
from shelfwise.functions.cleansing import rate_value
from shelfwise.functions.numeric import as_double, cents, from_cents, money
from shelfwise.plans.registry import report
from shelfwise.sources.tables import Tables

# Fixed billing parameters: positional (promotion, model, rate) rows, as the
# reference's header-less promotion sheet (S11). Rates are text: "50%" or "0.35".
MODELS = ("VF", "CF_FIXED", "CF_ORDERED")
PROMOTIONS = [
    ("1", "VF", ""), ("2", "CF_FIXED", "50%"), ("3", "CF_ORDERED", ""), ("4", "VF", ""),
    ("5", "CF_FIXED", "0.35"), ("6", "CF_ORDERED", ""), ("7", "VF", ""),
]

MEASURES = ("order_cnt", "valid_cnt", "revenue", "coupon_amount", "original_cost", "cost_payable", "cost_adjustment")


def promotion_config(spark: SparkSession, rows=PROMOTIONS) -> DataFrame:
    """Positional rows -> (promo_id, model, rate); unknown models dropped."""
    raw = spark.createDataFrame(rows, "_c0 string, _c1 string, _c2 string")
    return (raw.select(F.col("_c0").cast("bigint").alias("promo_id"), F.col("_c1").alias("model"),
                       rate_value(F.col("_c2")).alias("rate"))
            .filter(F.col("model").isin(*MODELS)))


def billing_lines(t: Tables) -> DataFrame:
    li = t.lineitem
    price = money("l_extendedprice")
    discount = (-F.round(price * money("l_discount"), 2)).cast("decimal(18,2)")
    return li.select(
        F.col("l_linenumber").cast("bigint").alias("promo_id"),
        F.concat(F.lit("V"), zero_padded("l_suppkey", 4)).alias("vendor"),
        F.concat(F.lit("B"), zero_padded("l_partkey", 9)).alias("product"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_shipdate").cast("date").alias("order_day"),
        price.alias("price"),
        discount.alias("discount"),
        F.round(discount * money("l_tax"), 2).cast("decimal(18,2)").alias("discount_tax"),
        F.round(price * F.lit(0.6).cast("decimal(2,1)"), 2).cast("decimal(18,2)").alias("cost"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_return"),
        F.when(F.col("l_linestatus") == "F", "Y").otherwise("N").alias("is_charged"),
        F.col("l_suppkey"))


def vendor_managers(t: Tables) -> DataFrame:
    """Dimension reduced to one row per vendor first, so the join cannot multiply sums."""
    return (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .groupBy(F.col("s_suppkey").alias("m_suppkey")).agg(F.max("n_name").alias("vm")))


def _charged_lines(t: Tables) -> DataFrame:
    cfg = promotion_config(t.spark)   # small: Spark broadcasts it by its size
    return (billing_lines(t).filter(F.col("is_charged") == "Y")
            .join(cfg, "promo_id", "inner"))


def summary_all(t: Tables) -> DataFrame:
    """Per (promotion, vendor) summary for every promotion in one aggregation; the
    payable and adjustment follow the promotion's funding model."""
    lines = _charged_lines(t)
    valid = F.lit(1) - F.col("is_return")
    gross = F.col("price") + F.col("discount") + F.col("discount_tax")
    coupon = F.lit(0) - F.col("discount") - F.col("discount_tax")
    # Money sums run over BIGINT cents (exact, fixed-width buffers); 0/1 weights keep
    # the reference's sum((1 - is_return) * x) semantics (0, not NULL, for all-return groups).
    wc = lambda c: F.sum(valid * cents(c))
    # The sums are per promotion and supplier; only those few rows are joined with the managers.
    sums = lines.groupBy("promo_id", "vendor", "model", "rate", "l_suppkey").agg(
        F.count(F.lit(1)).alias("order_cnt"), F.sum(valid).cast("bigint").alias("valid_cnt"),
        from_cents(wc(F.col("price"))).alias("revenue"), from_cents(wc(coupon)).alias("coupon_amount"),
        from_cents(wc(F.col("cost"))).alias("original_cost"),
        from_cents(wc(F.col("cost") + F.col("discount") + F.col("discount_tax"))).alias("_vf_payable"),
        from_cents(wc(gross)).alias("_gross"),
        # MySQL divides decimals to 4 more places: cost/price is taken to 6 decimals.
        F.sum(F.when(F.col("is_return") == 0, _cost_share() * gross.cast("decimal(20,2)"))).alias("_ordered"))
    g = sums.join(vendor_managers(t), F.col("l_suppkey") == F.col("m_suppkey"), "left").drop("l_suppkey", "m_suppkey")
    # Operand precisions are pinned so the products stay exact (no scale cut to 6).
    scaled = F.col("rate").cast("decimal(10,6)") * F.col("_gross").cast("decimal(24,2)")
    cost = F.col("original_cost").cast("decimal(24,2)")
    payable = (F.when(F.col("model") == "VF", F.col("_vf_payable"))
               .when(F.col("model") == "CF_FIXED", F.round(scaled, 2))
               .otherwise(F.round(F.col("_ordered"), 2)))
    adjustment = (F.when(F.col("model") == "VF", F.col("coupon_amount"))
                  .when(F.col("model") == "CF_FIXED", F.round(cost - scaled, 2))
                  .otherwise(F.round(cost - F.col("_ordered").cast("decimal(30,8)"), 2)))
    return (g.withColumn("cost_payable", payable).withColumn("cost_adjustment", adjustment)
            .drop("_vf_payable", "_gross", "_ordered"))


def _summary(t: Tables, model: str) -> DataFrame:
    # The model filter is on a grouping key: Catalyst pushes it below the aggregate,
    # to the configuration join, so only that model's lines are read and summed.
    return summary_all(t).filter(F.col("model") == model)


def _cost_share():
    """cost / price to 6 decimals (NULL for a zero price), as DECIMAL(12,6) so that
    multiplying by a money amount keeps all 8 decimals."""
    return F.round(F.try_divide(F.col("cost"), F.col("price")), 6).cast("decimal(12,6)")


def _with_promo_totals(g: DataFrame) -> DataFrame:
    """``q UNION SELECT '', 'Total', sum(..) FROM (q)`` per promotion -- the total row
    adds the already-rounded group values, as the reference does."""
    rows = g.select(F.col("promo_id").cast("string").alias("promo_id"), F.col("vendor").alias("pub"), "vm",
                    *[_out(m) for m in MEASURES])
    totals = g.groupBy("promo_id").agg(*[F.sum(m).alias(m) for m in MEASURES]).select(
        F.col("promo_id").cast("string").alias("promo_id"), F.lit("").alias("pub"), F.lit("Total").alias("vm"),
        *[_out(m) for m in MEASURES])
    return rows.unionByName(totals)


def _out(m: str):
    return F.col(m).cast("bigint").alias(m) if m.endswith("_cnt") else as_double(m).alias(m)


# ------------------------------------------------------------------ oracle SQL
_LINES_SQL = """bl AS (
  SELECT CAST(l_linenumber AS BIGINT) AS promo_id, 'V' || (CASE WHEN length(CAST(l_suppkey AS VARCHAR)) >= 4 THEN CAST(l_suppkey AS VARCHAR) ELSE right(repeat('0', 4) || CAST(l_suppkey AS VARCHAR), 4) END) AS vendor,
         'B' || (CASE WHEN length(CAST(l_partkey AS VARCHAR)) >= 9 THEN CAST(l_partkey AS VARCHAR) ELSE right(repeat('0', 9) || CAST(l_partkey AS VARCHAR), 9) END) AS product, l_orderkey AS order_id,
         CAST(l_shipdate AS DATE) AS order_day, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(-ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)), 2) AS DECIMAL(18,2)) AS discount,
         CAST(ROUND(CAST(-ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)), 2) AS DECIMAL(18,2))
              * CAST(l_tax AS DECIMAL(18,2)), 2) AS DECIMAL(18,2)) AS discount_tax,
         CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.6, 2) AS DECIMAL(18,2)) AS cost,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_return,
         CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE 'N' END AS is_charged, l_suppkey
  FROM lineitem),
cfg AS (
  SELECT CAST(c0 AS BIGINT) AS promo_id, c1 AS model,
         CASE WHEN regexp_matches(c2, '^([0-9]*\\.?[0-9]+|[0-9]+\\.?[0-9]*)%$')
              THEN CAST(regexp_extract(c2, '^([0-9]*\\.?[0-9]+|[0-9]+\\.?[0-9]*)%$', 1) AS DECIMAL(18,6)) * 0.01
              ELSE TRY_CAST(c2 AS DECIMAL(18,6)) END AS rate
  FROM (VALUES {values}) v(c0, c1, c2)),
mgr AS (SELECT s_suppkey AS m_suppkey, MAX(n_name) AS vm FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
        GROUP BY s_suppkey),
cl AS (SELECT bl.*, cfg.model, cfg.rate, mgr.vm FROM bl JOIN cfg ON cfg.promo_id = bl.promo_id
       LEFT JOIN mgr ON mgr.m_suppkey = bl.l_suppkey WHERE bl.is_charged = 'Y')""".format(
    values=", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in PROMOTIONS))

_COMMON_AGGS = """MAX(vm) AS vm, COUNT(*) AS order_cnt, CAST(SUM(1 - is_return) AS BIGINT) AS valid_cnt,
  SUM((1 - is_return) * price) AS revenue, SUM((1 - is_return) * (0 - discount - discount_tax)) AS coupon_amount,
  SUM((1 - is_return) * cost) AS original_cost"""

_MODEL_AGGS = {
    "VF": """, SUM((1 - is_return) * (cost + discount + discount_tax)) AS cost_payable,
  SUM((1 - is_return) * (0 - discount - discount_tax)) AS cost_adjustment""",
    "CF_FIXED": """, ROUND(MAX(rate) * SUM((1 - is_return) * (price + discount + discount_tax)), 2) AS cost_payable,
  ROUND(SUM((1 - is_return) * cost) - MAX(rate) * SUM((1 - is_return) * (price + discount + discount_tax)), 2)
    AS cost_adjustment""",
    "CF_ORDERED": """, ROUND(SUM((1 - is_return) * ROUND(CAST(CAST(cost AS DOUBLE) / NULLIF(CAST(price AS DOUBLE), 0)
      AS DECIMAL(38,10)), 6) * (price + discount + discount_tax)), 2) AS cost_payable,
  ROUND(SUM((1 - is_return) * cost) - SUM((1 - is_return) * ROUND(CAST(CAST(cost AS DOUBLE)
      / NULLIF(CAST(price AS DOUBLE), 0) AS DECIMAL(38,10)), 6) * (price + discount + discount_tax)), 2)
    AS cost_adjustment""",
}

_OUT_SQL = ", ".join(f"CAST({m} AS BIGINT) AS {m}" if m.endswith("_cnt") else f"CAST({m} AS DOUBLE) AS {m}"
                     for m in MEASURES)
_SUM_OUT_SQL = ", ".join(f"CAST(SUM({m}) AS BIGINT) AS {m}" if m.endswith("_cnt") else f"CAST(SUM({m}) AS DOUBLE) AS {m}"
                         for m in MEASURES)


def _summary_sql(model: str) -> str:
    return f"""WITH {_LINES_SQL},
g AS (SELECT promo_id, vendor, {_COMMON_AGGS}{_MODEL_AGGS[model]}
      FROM cl WHERE model = '{model}' GROUP BY promo_id, vendor)
SELECT CAST(promo_id AS VARCHAR) AS promo_id, vendor AS pub, vm, {_OUT_SQL} FROM g
UNION ALL
SELECT CAST(promo_id AS VARCHAR), '', 'Total', {_SUM_OUT_SQL} FROM g GROUP BY promo_id
"""


@report("billing_vendor_fund", covers=("R27a", "A2", "A7", "J2", "S11", "P19", "A14", "P7"), oracle=_summary_sql("VF"), tag="BILL")
def billing_vendor_fund(t: Tables):
    """Vendor-funded promotions: payable = cost + discount + discount tax, per vendor, with totals."""
    return _with_promo_totals(_summary(t, "VF"))


@report("billing_cofund_fixed", covers=("R27b", "A2", "A7", "F17"), oracle=_summary_sql("CF_FIXED"), tag="BILL2")
def billing_cofund_fixed(t: Tables):
    """Co-funded at a fixed rate: payable = rate x (price + discount + tax)."""
    return _with_promo_totals(_summary(t, "CF_FIXED"))


@report("billing_cofund_ordered", covers=("R27c", "A2", "A7"), oracle=_summary_sql("CF_ORDERED"), tag="BILL3")
def billing_cofund_ordered(t: Tables):
    """Co-funded in proportion to cost: payable = cost/price x (price + discount + tax)."""
    return _with_promo_totals(_summary(t, "CF_ORDERED"))


BILLING_GRAND_TOTAL_SQL = f"""WITH {_LINES_SQL},
g AS ({' UNION ALL '.join(f"SELECT promo_id, vendor, {_COMMON_AGGS}{_MODEL_AGGS[m]} FROM cl WHERE model = '{m}' GROUP BY promo_id, vendor" for m in MODELS)})
SELECT '' AS promo_id, '' AS pub, 'Total' AS vm, {_SUM_OUT_SQL} FROM g
"""


@report("billing_grand_total", covers=("R27d", "A8", "U3"), oracle=BILLING_GRAND_TOTAL_SQL, tag="BILLTOTAL")
def billing_grand_total(t: Tables):
    """All promotions of all models: one grand-total row over the vendor rows (NULLs ignored)."""
    g = summary_all(t)
    return g.agg(*[F.sum(m).alias(m) for m in MEASURES]).select(
        F.lit("").alias("promo_id"), F.lit("").alias("pub"), F.lit("Total").alias("vm"), *[_out(m) for m in MEASURES])


BILLING_DETAIL_SQL = f"""WITH {_LINES_SQL}
SELECT CAST(promo_id AS VARCHAR) AS promo_id, model AS promo_description, product, vendor AS pub, order_id,
       order_day AS order_date, CAST(price AS DOUBLE) AS revenue,
       CAST(0 - discount - discount_tax AS DOUBLE) AS coupon_amount, CAST(cost AS DOUBLE) AS original_cost,
       CAST(CASE model
         WHEN 'VF' THEN cost + discount + discount_tax
         WHEN 'CF_FIXED' THEN ROUND(rate * (price + discount + discount_tax), 2)
         ELSE ROUND(ROUND(CAST(CAST(cost AS DOUBLE) / NULLIF(CAST(price AS DOUBLE), 0) AS DECIMAL(38,10)), 6)
                    * (price + discount + discount_tax), 2) END AS DOUBLE) AS cost_payable,
       CAST(CASE model
         WHEN 'VF' THEN 0 - discount - discount_tax
         WHEN 'CF_FIXED' THEN ROUND(cost - rate * (price + discount + discount_tax), 2)
         ELSE ROUND(cost - ROUND(CAST(CAST(cost AS DOUBLE) / NULLIF(CAST(price AS DOUBLE), 0) AS DECIMAL(38,10)), 6)
                    * (price + discount + discount_tax), 2) END AS DOUBLE) AS cost_adjustment,
       is_return
FROM cl
"""


@report("billing_detail", covers=("R27d", "P3"), oracle=BILLING_DETAIL_SQL, tag="BILLDETAIL")
def billing_detail(t: Tables):
    """Detail rows of every charged line under its promotion's model (returns flagged)."""
    lines = _charged_lines(t)
    gross = F.col("price") + F.col("discount") + F.col("discount_tax")
    gross = gross.cast("decimal(20,2)")
    share = _cost_share()
    rated = F.col("rate").cast("decimal(10,6)") * gross
    payable = (F.when(F.col("model") == "VF", F.col("cost") + F.col("discount") + F.col("discount_tax"))
               .when(F.col("model") == "CF_FIXED", F.round(rated, 2))
               .otherwise(F.round(share * gross, 2)))
    adjustment = (F.when(F.col("model") == "VF", F.lit(0) - F.col("discount") - F.col("discount_tax"))
                  .when(F.col("model") == "CF_FIXED", F.round(F.col("cost") - rated, 2))
                  .otherwise(F.round(F.col("cost") - share * gross, 2)))
    return lines.select(F.col("promo_id").cast("string").alias("promo_id"), F.col("model").alias("promo_description"),
                        "product", F.col("vendor").alias("pub"), "order_id", F.col("order_day").alias("order_date"),
                        as_double("price").alias("revenue"),
                        as_double(F.lit(0) - F.col("discount") - F.col("discount_tax")).alias("coupon_amount"),
                        as_double("cost").alias("original_cost"), as_double(payable).alias("cost_payable"),
                        as_double(adjustment).alias("cost_adjustment"), "is_return")
