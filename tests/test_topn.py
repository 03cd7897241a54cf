from pyspark.sql import functions as F

from shelfwise.operators.grouping import mode_per_key
from shelfwise.operators.sequence import group_sequence
from shelfwise.operators.topn import best_per_group, latest_per_key, priority_first, running_share_cut


def _cut(spark, shares):
    from decimal import Decimal
    df = spark.createDataFrame([("p", i, Decimal(str(s))) for i, s in enumerate(shares)],
                               "g string, k int, share decimal(10,4)")
    out = running_share_cut(df, ["g"], [F.col("share").desc(), F.col("k")], "share")
    return sorted(r.k for r in out.collect())


def test_running_share_boundary(spark):
    assert _cut(spark, [0.5, 0.3, 0.1, 0.1]) == [0, 1, 2]      # 0.8 is not above 0.8
    assert _cut(spark, [0.5, 0.31, 0.19]) == [0, 1]


def test_running_share_row_limit(spark):
    assert len(_cut(spark, [0.01] * 30)) == 10


def test_best_per_group_keeps_ties(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4), ("b", 4, 1)], "g string, k int, v int")
    assert sorted(r.k for r in best_per_group(df, ["g"], "v").collect()) == [1, 2, 4]


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, 10, "x"), (1, 20, "y"), (2, 5, "z")], "k int, ts int, c string")
    got = {r.k: r.c for r in latest_per_key(df, ["k"], ["ts"]).collect()}
    assert got == {1: "y", 2: "z"}


def test_priority_first(spark):
    df = spark.createDataFrame([(1, 3, "2017-01-01", "w"), (1, 1, "2017-02-01", "c"), (1, 1, "2017-01-15", "c0"),
                                (2, 2, "2017-01-01", "d"), (2, None, "2016-01-01", "n")],
                               "k int, prio int, day string, src string")
    got = {r.k: r.src for r in priority_first(df, ["k"], "prio", ["day"]).collect()}
    assert got == {1: "c0", 2: "d"}


def test_mode_per_key_tie_smallest(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (1, None), (2, "z")], "k int, v string")
    got = {r.k: (r.v, r.n) for r in mode_per_key(df, "k", "v").collect()}
    assert got == {1: ("a", 2), 2: ("z", 1)}


def test_group_sequence_equals_row_number(spark):
    from pyspark.sql import Window
    rows = [("big" if i % 3 else f"g{i % 7}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int")
    seq = group_sequence(df, ["g"], ["k"], num_partitions=7)
    ref = df.withColumn("seq", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert sorted(map(tuple, seq.select("g", "k", "seq").collect())) == sorted(map(tuple, ref.collect()))


def test_total_row_by_rollup(spark):
    from shelfwise.operators.grouping import with_total_row
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    out = {r.k: (r.label, r.s) for r in with_total_row(df, ["k"], {"s": F.sum("v")}, "label").collect()}
    assert out == {"a": (None, 3), "b": (None, 5), "": ("Total", 8)}
