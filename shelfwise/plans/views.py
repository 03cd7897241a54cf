"""Analogue views: the catalog's business entities over the provided tables.

Mapping (fixed, see README): product = part (code ``B`` + 9-digit key),
publisher = p_brand, sub-category = p_type, author = p_name, vendor = supplier,
manager = supplier nation, sales = l_extendedprice, units = l_quantity,
sale day = l_shipdate, return = l_returnflag 'R', snapshot = order month,
daily traffic = events.

Each builder has a SQL twin (``*_SQL``) that the oracle statements reuse as CTEs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import zero_padded
from shelfwise.functions.numeric import money_sum
from shelfwise.sources.tables import Tables


def product_code(key: str | Column) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit("B"), zero_padded(k, 9))


PRODUCT_CODE_SQL = "'B' || (CASE WHEN length(CAST({k} AS VARCHAR)) >= 9 THEN CAST({k} AS VARCHAR) ELSE right(repeat('0', 9) || CAST({k} AS VARCHAR), 9) END)"


def products(t: Tables) -> DataFrame:
    """One row per product with its catalog attributes."""
    return t.part.select(
        F.col("p_partkey"),
        product_code("p_partkey").alias("product"),
        F.col("p_brand").alias("publisher"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("author"),
        F.col("p_name").alias("title"),
        F.col("p_size"),
        F.col("p_retailprice"),
    )


PRODUCTS_SQL = f"""products AS (
  SELECT p_partkey, {PRODUCT_CODE_SQL.format(k='p_partkey')} AS product, p_brand AS publisher,
         p_type AS category, p_name AS author, p_name AS title, p_size, p_retailprice
  FROM part)"""


def product_sales(t: Tables) -> DataFrame:
    """Sales per product over all lineitems (map-side partial aggregation)."""
    return (t.lineitem.groupBy("l_partkey")
            .agg(money_sum("l_extendedprice").alias("sales"),
                 money_sum("l_quantity").alias("units"),
                 F.count(F.lit(1)).alias("n_lines")))


PRODUCT_SALES_SQL = """product_sales AS (
  SELECT l_partkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS sales,
         SUM(CAST(l_quantity AS DECIMAL(18,2))) AS units, COUNT(*) AS n_lines
  FROM lineitem GROUP BY l_partkey)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
