from pyspark.sql import functions as F

from shelfwise.operators.merge import diff_merge, replace_by_key, replace_by_key_once, truncate_load, update_by_key

SCHEMA = "k int, a string, b double"


def _frames(spark):
    target = spark.createDataFrame([(1, "t1", 1.0), (2, "t2", 2.0), (3, "t3", 3.0), (4, "t4", 4.0)], SCHEMA)
    stage = spark.createDataFrame([(2, "s2", None), (3, "s3", 30.0), (5, "s5", 50.0)], SCHEMA)
    return target, stage


def _rows(df):
    return sorted(map(tuple, df.select("k", "a", "b").collect()))


def test_replace(spark):
    t, s = _frames(spark)
    out = replace_by_key(t, s, ["k"])
    assert _rows(out) == [(1, "t1", 1.0), (2, "s2", None), (3, "s3", 30.0), (4, "t4", 4.0), (5, "s5", 50.0)]
    assert _rows(replace_by_key(out, s, ["k"])) == _rows(out)   # second run changes nothing


def test_update_no_insert_null_overwrites(spark):
    t, s = _frames(spark)
    assert _rows(update_by_key(t, s, ["k"])) == [(1, "t1", 1.0), (2, "s2", None), (3, "s3", 30.0), (4, "t4", 4.0)]


def test_update_partial_columns(spark):
    t, _ = _frames(spark)
    s = spark.createDataFrame([(1, "new")], "k int, a string")
    assert _rows(update_by_key(t, s, ["k"]))[0] == (1, "new", 1.0)


def test_truncate(spark):
    t, s = _frames(spark)
    assert _rows(truncate_load(t, s)) == _rows(s)


def test_diff_merge(spark):
    cur = spark.createDataFrame([(1, "x", None), (2, "y", "p"), (3, None, "q")], "k int, s string, c string")
    stg = spark.createDataFrame([(1, "x", None), (2, "y", "CHANGED"), (3, "", "q"), (9, "n", "n")],
                                "k int, s string, c string")
    out = diff_merge(cur, stg, "k", ["s", "c"], src_col="src")
    got = sorted((r.k, r.src) for r in out.collect())
    assert got == [(1, "current"), (2, "staged"), (3, "current"), (9, "staged")]


def test_update_with_duplicate_staged_keys_keeps_one_row(spark):
    t, _ = _frames(spark)
    s = spark.createDataFrame([(2, "a", 1.0), (2, "b", 2.0)], SCHEMA)
    out = _rows(update_by_key(t, s, ["k"]))
    assert len(out) == 4 and out[1] == (2, "b", 2.0)


def test_replace_once_gives_the_rows_of_replace(spark):
    # Keys that come twice on either side, keys with a null on either side or on both, a staged key that the target lacks.
    target = spark.createDataFrame([(1, "x", 1.0), (1, "x", 1.0), (1, "y", 2.0), (2, None, 3.0), (None, "x", 4.0), (None, None, 5.0), (3, "z", None)], SCHEMA)
    stage = spark.createDataFrame([(1, "x", 9.0), (1, "x", 9.0), (2, None, 8.0), (None, None, 7.0), (4, "n", None)], SCHEMA)
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    for t, s in ((target, stage), (stage, target), (target, stage.limit(0)), (target.limit(0), stage), (target, target)):
        once = replace_by_key_once(t, s, ["k", "a"])
        assert once.columns == t.columns and rows(once) == rows(replace_by_key(t, s, ["k", "a"]))
    short = stage.select("a", "k")
    assert rows(replace_by_key_once(target, short, ["k"])) == rows(replace_by_key(target, short, ["k"]))


def test_captures_parse_each_message_once(spark, tmp_dir):
    """the merge into the log computed the parsed tables twice, once for their keys and once for their rows."""
    from datetime import datetime

    from shelfwise.plans.capture_reports import status_capture
    from shelfwise.sources.tables import Tables

    part = [(7, "Brand#1", "a <hat> & more"), (8, "Brand#1", None), (8, "Brand#1", "twice"), (120, None, "no brand"), (None, "Brand#1", "no key")]
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_name string").selectExpr(
        "*", "'t' AS p_type", "1 AS p_size", "1.0D AS p_retailprice").write.parquet(f"{tmp_dir}/part.parquet")
    day, later = datetime(1995, 3, 4), datetime(1995, 4, 1)
    lines = [(7, 3, 0.05, "R", "O", day), (7, 1, 0.0, "R", "O", day), (7, 1, 0.0, "R", "O", later), (7, 4, 0.05, "R", "F", later),
             (7, 5, 0.05, "A", "O", day), (8, 1, 0.05, "R", "O", day), (120, 3, 0.05, "R", "O", day), (None, 3, 0.05, "R", "O", day)]
    spark.createDataFrame(lines, "l_partkey long, l_linenumber int, l_tax double, l_returnflag string, l_linestatus string, "
                                 "l_shipdate timestamp").write.parquet(f"{tmp_dir}/lineitem.parquet")
    out = status_capture(Tables(spark, tmp_dir))
    assert sorted(map(tuple, out.collect())) == [
        ("B000000007", "Brand#1/0/199503/O", "line 3", "1995-03-04"), ("B000000007", "Brand#1/0/199504/O", "open", ""),
        ("B000000008", "Brand#1/0/199503/O", "", "1995-03-04"), ("B000000120", "1/199503/O", "open", "")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapIn") == 1
