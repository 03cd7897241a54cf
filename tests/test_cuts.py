"""Nothing is shortened, merged or lost: long keys, large numbers, sequence numbers of large and NULL groups."""
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfwise.functions.cleansing import clean_cast
from shelfwise.functions.text import zero_padded, zero_padded_sql
from shelfwise.operators.sequence import group_sequence


def test_zero_padding_keeps_all_digits(spark):
    keys = [1, 999, 1000, 9999, 10000, 10009, 123456789012]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(zero_padded("k", 4)).collect()]
    assert got == [str(k).zfill(4) for k in keys]
    con = duckdb.connect()
    assert [con.execute(f"SELECT {zero_padded_sql(str(k), 4)}").fetchall()[0][0] for k in keys] == got


def test_number_beyond_the_decimal_range(spark):
    cells = ["1e30", "-1e300", "1.23456789012", "x", "12%", "", None]
    df = spark.createDataFrame([(c,) for c in cells], "v string")
    # A number column keeps them; a column of declared digits holds what they can hold, exactly.
    got = [r[0] for r in df.select(clean_cast(F.col("v"), "double")).collect()]
    assert got == [1e30, -1e300, 1.2345678901, None, 0.12, None, None]
    got = [r[0] for r in df.select(clean_cast(F.col("v"), "decimal(18,2)")).collect()]
    assert got == [None, None, Decimal("1.23"), None, Decimal("0.12"), None, None]


@pytest.mark.parametrize("parts", [3, 8, 17])
def test_sequence_of_hot_and_null_groups(spark, parts):
    n = 1_000_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 1).otherwise((F.col("id") % 50).cast("int")).alias("g"),
                               (F.col("id") * 7919 % n).alias("o"), F.concat(F.lit("payload "), "id").alias("p"))
    out = group_sequence(df, ["g"], ["o"], "seq", num_partitions=parts)
    assert out.columns == ["g", "o", "p", "seq"]
    bad = (out.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("d"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
           .filter("n <> d OR lo <> 1 OR hi <> n"))
    assert out.count() == n and bad.count() == 0
    later = out.alias("a").join(out.alias("b"), F.expr("a.g <=> b.g AND b.seq = a.seq + 1")).filter("b.o <= a.o")
    assert later.count() == 0
