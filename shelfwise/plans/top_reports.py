"""Publisher top lists: R21 (top products to 80 %), R22 (top sub-categories),
R23 (top authors), R5 (goal progress), R30 (publishers due)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions.numeric import as_double, percent_text, ratio, round_half_up, rounded_double, thousands
from shelfwise.operators.topn import best_per_group, running_share_cut, top_k_per_group
from shelfwise.plans.registry import report
from shelfwise.plans.views import PRODUCT_SALES_SQL, PRODUCTS_SQL, product_sales, products, with_sql
from shelfwise.sources.tables import Tables


def _sold_products(t: Tables):
    s = product_sales(t)
    return products(t).join(s, F.col("p_partkey") == F.col("l_partkey"), "inner").drop("l_partkey")


TOP_PRODUCTS_SQL = with_sql(PRODUCTS_SQL, PRODUCT_SALES_SQL, """
sold AS (SELECT p.*, s.sales FROM products p JOIN product_sales s ON p.p_partkey = s.l_partkey),
tot AS (SELECT publisher, category, SUM(sales) AS pub_sales FROM sold GROUP BY publisher, category),
ranked AS (
  SELECT s.*, ROW_NUMBER() OVER (PARTITION BY s.publisher, s.category ORDER BY s.sales DESC, s.p_partkey) AS rn,
         CAST(ROUND(CAST(CAST(s.sales AS DOUBLE) / NULLIF(CAST(t.pub_sales AS DOUBLE), 0) AS DECIMAL(38,10)), 4)
              AS DECIMAL(38,4)) AS share
  FROM sold s JOIN tot t ON s.publisher = t.publisher AND s.category = t.category),
cut AS (
  SELECT *, COALESCE(SUM(share) OVER (PARTITION BY publisher, category ORDER BY rn
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM ranked WHERE rn <= 10)
SELECT publisher, category, CAST(rn AS BIGINT) AS rn, product, title,
       CAST(sales AS DOUBLE) AS sales,
       format('{:,}', CAST(ROUND(sales, 0) AS BIGINT)) AS sales_text,
       CAST(share AS DOUBLE) AS share,
       CAST(prior + share AS DOUBLE) AS cum_share,
       CAST(ROUND(share * 100, 2) AS DECIMAL(38,2)) || '%' AS share_text
FROM cut WHERE prior <= 0.8
""")


@report("top_products_to_80pct", covers=("R21", "W2", "J17", "A12", "L5", "F5", "P1", "P18", "S7", "F4"),
        oracle=TOP_PRODUCTS_SQL, tag="TOPLIST")
def top_products_to_80pct(t: Tables):
    """Per publisher (brand x type): products by sales until 80 % of sales, at most 10."""
    sold = _sold_products(t)
    group = ["publisher", "category"]
    # Partial top-10 first: the share only matters for rows that can survive the cut.
    top = top_k_per_group(sold, group, [F.col("sales").desc(), F.col("p_partkey").asc()], 10)
    totals = sold.groupBy(*group).agg(F.sum("sales").alias("pub_sales"))
    shared = (top.join(totals, group, "inner")
              .withColumn("share", round_half_up(ratio("sales", "pub_sales"), 4)))
    cut = running_share_cut(shared, group, [F.col("rn")], "share", threshold=0.8, max_rows=10)
    return cut.select(
        "publisher", "category", F.col("rn").cast("bigint").alias("rn"), "product", "title",
        as_double("sales").alias("sales"),
        thousands("sales").alias("sales_text"),
        as_double("share").alias("share"),
        as_double("cum_share").alias("cum_share"),
        F.concat(F.round(F.col("share") * 100, 2).cast("decimal(38,2)").cast("string"), F.lit("%")).alias("share_text"),
    )


def _top_groups_with_best(t: Tables, label_col: str, label_expr, limit: int = 10):
    """Shared body of R22/R23: top ``limit`` groups of a publisher by sales, share of the
    publisher, and the best-selling product(s) of each group (ties kept)."""
    sold = _sold_products(t)
    grp = (sold.groupBy("publisher", label_col)
           .agg(F.sum("sales").alias("grp_sales")))
    pub = sold.groupBy("publisher").agg(F.sum("sales").alias("pub_sales"))
    top = top_k_per_group(grp, ["publisher"], [F.col("grp_sales").desc(), F.col(label_col).asc()], limit)
    top = top.join(pub, "publisher", "inner")
    best = best_per_group(sold, ["publisher", label_col], "sales").select(
        "publisher", label_col, "product", "title")
    return (top.join(best, ["publisher", label_col], "inner")
            .select("publisher", label_expr,
                    F.col("rn").cast("bigint").alias("grp_rank"),
                    as_double("grp_sales").alias("grp_sales"),
                    thousands("grp_sales").alias("grp_sales_text"),
                    rounded_double(ratio("grp_sales", "pub_sales") * F.lit(100.0), 0).alias("ratio_pct"),
                    "product", "title"))


_TOP_GROUPS_SQL = with_sql(PRODUCTS_SQL, PRODUCT_SALES_SQL, """
sold AS (SELECT p.*, s.sales FROM products p JOIN product_sales s ON p.p_partkey = s.l_partkey),
grp AS (SELECT publisher, {col}, SUM(sales) AS grp_sales FROM sold GROUP BY publisher, {col}),
pub AS (SELECT publisher, SUM(sales) AS pub_sales FROM sold GROUP BY publisher),
top AS (SELECT g.*, ROW_NUMBER() OVER (PARTITION BY publisher ORDER BY grp_sales DESC, {col}) AS rn FROM grp g),
best AS (SELECT s.publisher, s.{col}, s.product, s.title FROM sold s
         JOIN (SELECT publisher, {col}, MAX(sales) AS m FROM sold GROUP BY publisher, {col}) mx
           ON s.publisher = mx.publisher AND s.{col} = mx.{col} AND s.sales = mx.m)
SELECT t.publisher, {label} AS {out}, CAST(t.rn AS BIGINT) AS grp_rank, CAST(t.grp_sales AS DOUBLE) AS grp_sales,
       format('{{:,}}', CAST(ROUND(t.grp_sales, 0) AS BIGINT)) AS grp_sales_text,
       CAST(ROUND(CAST(CAST(t.grp_sales AS DOUBLE) / NULLIF(CAST(p.pub_sales AS DOUBLE), 0) * 100.0
                       AS DECIMAL(38,10)), 0) AS DOUBLE) AS ratio_pct,
       b.product, b.title
FROM top t JOIN pub p ON t.publisher = p.publisher
JOIN best b ON b.publisher = t.publisher AND b.{col} = t.{col}
WHERE t.rn <= 10
""")


TOP_CATEGORIES_SQL = _TOP_GROUPS_SQL.format(col="category", label="t.category", out="category")
TOP_AUTHORS_SQL = _TOP_GROUPS_SQL.format(col="author", label="left(trim(t.author), 12)", out="author")


@report("top_categories_best_product", covers=("R22", "A12", "J15", "W4", "L5", "F5"),
        oracle=TOP_CATEGORIES_SQL, tag="CATEGORIES")
def top_categories_best_product(t: Tables):
    """Per publisher: top 10 sub-categories by sales, share in %, best product(s)."""
    return _top_groups_with_best(t, "category", F.col("category"))


@report("top_authors_best_product", covers=("R23", "A12", "J15", "F1", "F6"),
        oracle=TOP_AUTHORS_SQL, tag="TOPAUTHOR")
def top_authors_best_product(t: Tables):
    """Per publisher: top 10 authors by sales, share in %, best product(s); name cut to 12."""
    return _top_groups_with_best(t, "author", F.left(F.trim(F.col("author")), F.lit(12)).alias("author"))


GOAL_SQL = with_sql(PRODUCTS_SQL, PRODUCT_SALES_SQL, """
goal AS (SELECT publisher, SUM(CAST(p_retailprice AS DECIMAL(18,2))) * 30 AS goal FROM products GROUP BY publisher),
act AS (SELECT p.publisher, SUM(s.sales) AS act_sales FROM products p JOIN product_sales s ON p.p_partkey = s.l_partkey
        WHERE p.publisher LIKE 'Brand#%' GROUP BY p.publisher)
SELECT g.publisher, CAST(g.goal AS DOUBLE) AS goal,
       CAST(ROUND(a.act_sales, 0) AS DOUBLE) AS act_sales,
       CAST(ROUND(CAST(CAST(a.act_sales AS DOUBLE) / NULLIF(CAST(g.goal AS DOUBLE), 0) * 100.0 AS DECIMAL(38,10)), 1)
            AS DECIMAL(38,1)) || '%' AS progress
FROM goal g JOIN act a ON a.publisher = g.publisher
ORDER BY g.goal DESC, g.publisher
LIMIT 100
""")


@report("publisher_goal_progress", covers=("R5", "J19", "F3", "L5", "P8"), oracle=GOAL_SQL, tag="GOAL")
def publisher_goal_progress(t: Tables):
    """Goal (30 x catalog retail value) vs actual sales per publisher, top 100 by goal."""
    prods = products(t)
    goal = prods.groupBy("publisher").agg(
        (F.sum(F.col("p_retailprice").cast("decimal(18,2)")) * F.lit(30)).alias("goal"))
    act = (prods.filter(F.col("publisher").startswith("Brand#"))
           .join(product_sales(t), F.col("p_partkey") == F.col("l_partkey"))
           .groupBy("publisher").agg(F.sum("sales").alias("act_sales")))
    return (goal.join(act, "publisher", "inner")
            .orderBy(F.col("goal").desc(), F.col("publisher"))
            .limit(100)
            .select("publisher", as_double("goal").alias("goal"),
                    F.round("act_sales", 0).cast("double").alias("act_sales"),
                    percent_text("act_sales", "goal", 1).alias("progress")))
