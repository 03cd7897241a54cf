import datetime as dt

from pyspark.sql import functions as F

from shelfwise.functions.cleansing import clean_cast, parse_date, parse_int, parse_number, rate_value


def _one(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_date_forms(spark):
    good = ["5-Jan-2017", "05-JAN-17", "2017/1/5", "2017-1-5", "1/5/2017", "20170105"]
    assert _one(spark, good, parse_date) == [dt.date(2017, 1, 5)] * 6


def test_bad_dates_are_null(spark):
    bad = ["5-Xyz-2017", "2017-13-01", "2017-02-31", "hello", None]
    assert _one(spark, bad, parse_date) == [None] * 5


def test_integers(spark):
    assert _one(spark, ["5", "+5", " 5 ", "5.7", "abc", "1_000", None], parse_int) == [5, 5, 5, None, None, None, None]


def test_numbers(spark):
    out = _one(spark, ["12.5%", ".5", "1e3", "-5%", "abc", None], parse_number)
    assert out[0] == 12.5 * 0.01
    assert out[1:3] == [0.5, 1000.0]
    assert out[3:] == [None, None, None]


def test_text_kept_and_empty_null_for_other_types(spark):
    df = spark.createDataFrame([("",), ("a\\b",)], "v string")
    text = [r[0] for r in df.select(clean_cast("v", "varchar(10)")).collect()]
    ints = [r[0] for r in df.select(clean_cast("v", "int")).collect()]
    assert text == ["", "a\\b"]
    assert ints == [None, None]


def test_rate_value(spark):
    out = _one(spark, ["50%", "0.35", "", "x%"], rate_value)
    assert [None if v is None else float(v) for v in out] == [0.5, 0.35, None, None]


def test_decimal_targets_stay_exact(spark):
    from decimal import Decimal

    cells = ["0.1", "1234567890123456.78", " 2.005 ", "-2.005", "1e3", "12.5%", "0.05%", "abc", "", "99999999999999999", "5%%"]
    out = _one(spark, cells, lambda c: clean_cast(c, "decimal(18,2)"))
    want = ["0.10", "1234567890123456.78", "2.01", "-2.01", "1000.00", "0.13", "0.00", None, None, None, None]
    assert out == [None if w is None else Decimal(w) for w in want]
    assert _one(spark, ["7.5"], lambda c: clean_cast(c, "numeric(5)")) == [Decimal(8)]


def test_timestamps(spark):
    out = _one(spark, ["2024-01-02 03:04:05", "x", ""], lambda c: clean_cast(c, "datetime"))
    assert out == [dt.datetime(2024, 1, 2, 3, 4, 5), None, None]
