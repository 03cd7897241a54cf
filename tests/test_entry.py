import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "publisher" in df.columns and "cum_share" in df.columns


def test_every_query_has_an_oracle_or_is_listed(spark):
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 45


def test_queries_plan_at_smallest_scale(spark):
    for name, fn in entry.queries().items():
        if name == "stream_file_drop":
            continue
        df = fn(spark, "/root/testdata/sf0.001")
        assert df.columns, name


def test_tables_from_catalog(spark):
    from shelfwise.plans.top_reports import top_products_to_80pct
    from shelfwise.sources.tables import Tables
    spark.sql("CREATE DATABASE IF NOT EXISTS shelf_test")
    for name in ("part", "lineitem"):   # external tables over the same files
        spark.sql(f"CREATE TABLE IF NOT EXISTS shelf_test.{name} USING parquet "
                  f"LOCATION '/root/testdata/sf0.001/{name}.parquet'")
    a = top_products_to_80pct(Tables(spark, "/root/testdata/sf0.001", database="shelf_test")).collect()
    b = top_products_to_80pct(Tables(spark, "/root/testdata/sf0.001")).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
