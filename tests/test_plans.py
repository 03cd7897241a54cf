"""Plan-level guards for the scale properties claimed in the README."""
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfwise.operators.topn import top_k_per_group

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_report_plans_a_nested_loop_or_python_udf(spark):
    bad = {}
    for name, fn in entry.queries().items():
        if name.startswith("stream_"):
            continue
        plan = _plan(fn(spark, SF))
        hits = [f for f in FORBIDDEN if f in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("v"))
    plan = _plan(top_k_per_group(df, ["g"], [F.col("v").desc()], 3))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(entry.queries()["mid_band_products"](spark, SF))
    assert "ReadSchema: struct<l_partkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan
    plan = _plan(entry.queries()["creation_by_month"](spark, SF))
    assert "o_orderdate,1998-01-01" in plan        # the date predicate is pushed to the Parquet scan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" in plan
