import datetime as dt

from pyspark.sql import functions as F

from shelfwise.functions.dates import infer_year_month_day, parse_message_date, week_sunday
from shelfwise.functions.text import (
    between_parentheses, first_publisher_code, multilines_in_html, product_codes, split_list, sql_statement,
)


def test_week_mode0(spark):
    df = spark.createDataFrame([(dt.date(2017, 1, 1),), (dt.date(2018, 1, 1),), (dt.date(2018, 1, 7),)], "d date")
    assert [r[0] for r in df.select(week_sunday("d")).collect()] == [1, 0, 1]


def test_week_matches_strftime_U(spark):
    days = [dt.date(2016, 1, 1) + dt.timedelta(days=i) for i in range(800)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r[0] for r in df.select(week_sunday("d")).collect()]
    assert got == [int(d.strftime("%U")) for d in days]


def test_year_inference(spark):
    df = spark.createDataFrame([("1/5",), ("11/5",), ("3/4/2017",)], "s string")
    got = [r[0] for r in df.select(infer_year_month_day("s", "2017-12-10")).collect()]
    assert got == [dt.date(2018, 1, 5), dt.date(2017, 11, 5), dt.date(2017, 3, 4)]


def test_message_date_fixed_shift(spark):
    df = spark.createDataFrame([("Mon, 3 Jul 2017 10:00:00 +0000",), ("garbage",)], "h string")
    got = [r[0] for r in df.select(parse_message_date("h")).collect()]
    assert got == [dt.datetime(2017, 7, 3, 18, 0, 0), None]


def test_codes_and_publisher(spark):
    df = spark.createDataFrame([("see B00ABCDEFG and B00ABCDEFG, also B0123456789; pub abccn here",)], "t string")
    r = df.select(product_codes("t").alias("c"), first_publisher_code("t").alias("p")).first()
    assert r.c == ["B00ABCDEFG", "B00ABCDEFG", "B012345678"]   # B + nine word chars
    assert r.p == "ABCCN"


def test_sql_statement(spark):
    df = spark.createDataFrame([("please run SELECT a, b FROM t WHERE x = 1; thanks",), ("no query",),
                                ("run select 1 as x； ok",)], "t string")
    assert [r[0] for r in df.select(sql_statement("t")).collect()] == ["SELECT a, b FROM t WHERE x = 1", "",
                                                                       "select 1 as x"]


def test_multilines(spark):
    df = spark.createDataFrame([("one line",), (" a \r\n\n b \n",), (None,)], "t string")
    assert [r[0] for r in df.select(multilines_in_html("t")).collect()] == ["one line", "a<br>b", None]


def test_between_parentheses_and_split(spark):
    df = spark.createDataFrame([("Fiction (Novel/Short)", "a@x.com; b@x.com", "c@x.com,,"), ("Plain", None, "")],
                               "s string, l1 string, l2 string")
    rows = df.select(between_parentheses("s").alias("p"), split_list("l1", "l2").alias("m")).collect()
    assert rows[0].p == "NovelShort" and rows[1].p is None
    assert rows[0].m == ["a@x.com", "b@x.com", "c@x.com"] and rows[1].m == []


def test_date_literals_both_spellings(spark):
    from shelfwise.functions.dates import date_lit
    df = spark.createDataFrame([(dt.date(2017, 1, 1),), (dt.date(2016, 12, 31),)], "d date")
    assert df.filter(F.col("d") >= date_lit("20170101")).count() == 1
    assert df.filter(F.col("d") >= date_lit("2017-01-01")).count() == 1
