import datetime as dt

from pyspark.sql import functions as F

from shelfwise.operators.snapshots import latest_snapshot, new_vs_carried, previous_snapshot


def test_new_vs_carried_equals_exists_union(spark):
    d1, d2 = dt.date(2017, 1, 1), dt.date(2017, 2, 1)
    df = spark.createDataFrame([(d1, "a"), (d1, "b"), (d2, "b"), (d2, "c")], "day date, k string")
    latest, prev = latest_snapshot(df, "day"), previous_snapshot(df, "day")
    got = sorted((r.k, r.new_flag) for r in new_vs_carried(latest, prev, "k").collect())
    assert got == [("b", "N"), ("c", "Y")]
    df.createOrReplaceTempView("snap")
    ref = spark.sql("""
      SELECT k, 'N' AS f FROM snap l WHERE day = (SELECT max(day) FROM snap)
        AND EXISTS (SELECT 1 FROM snap p WHERE p.k = l.k AND p.day = (SELECT max(day) FROM snap WHERE day <> (SELECT max(day) FROM snap)))
      UNION
      SELECT k, 'Y' FROM snap l WHERE day = (SELECT max(day) FROM snap)
        AND NOT EXISTS (SELECT 1 FROM snap p WHERE p.k = l.k AND p.day = (SELECT max(day) FROM snap WHERE day <> (SELECT max(day) FROM snap)))
    """)
    assert got == sorted(map(tuple, ref.collect()))


def test_single_snapshot_all_new(spark):
    df = spark.createDataFrame([(dt.date(2017, 1, 1), "a")], "day date, k string")
    out = new_vs_carried(latest_snapshot(df, "day"), previous_snapshot(df, "day"), "k").collect()
    assert [(r.k, r.new_flag) for r in out] == [("a", "Y")]
