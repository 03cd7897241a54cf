import datetime as dt
import os

from pyspark.sql import functions as F

from shelfwise.operators.ingest import clean_lines, ddl_text, infer_schema, normalize_header
from shelfwise.sources.dropfile import data_lines, headers, parse_file_name, scan_lines


def test_file_names(spark):
    names = ["db.tab.20170101.txt", "12.db.tab.20170101.upd", "db.tab.20170101.trunc", "tab.txt",
             "db.tab.2017.txt", "db.tab.20170101.txt.err"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(parse_file_name("n").alias("m")).collect()
    m = [r.m for r in rows]
    assert (m[0].db, m[0].table, m[0].snapshot_day, m[0].mode, m[0].seq) == ("db", "tab", dt.date(2017, 1, 1), "txt", None)
    assert (m[1].seq, m[1].mode) == (12, "upd")
    assert m[2].mode == "trunc"
    assert (m[3].table, m[3].mode, m[3].db) == ("tab", "txt", None)   # plain stem fallback
    assert m[4].table is None and m[5].table is None


def test_header_normalisation():
    assert [normalize_header(h) for h in ["Asin", "Pub-Code", "List Price", "On/Site Date", "a\\b"]] == \
        ["asin", "pub_code", "list_price", "on_site_date", "a_b"]


BODY = ("﻿Asin\tPub-Code\tList Price\tOn/Site Date\tUnits\tNote\r\n"
        "B000000001\tABCCN\t12.5\t5-Jan-2017\t3\thello\r\n"
        "B000000001\tABCCN\t12.5\t5-Jan-2017\t3\thello\r\n"
        "B000000002\tABCCN\t7\n"
        "B000000003\tABCCN\t1\t2017/1/5\t4\tx\textra\n"
        "\n"
        "B000000004\tXYZCN\t10%\t20170105\t+5\t\n")


def test_drop_file_end_to_end(spark, tmp_dir):
    path = os.path.join(tmp_dir, "shop.items.20170101.txt")
    with open(path, "w", encoding="utf-8", newline="") as fh:
        fh.write(BODY)
    lines = scan_lines(spark, tmp_dir)
    head = headers(lines).first().header
    assert head.startswith("Asin")                      # BOM stripped
    target = [("asin", "char(10)"), ("pub_code", "varchar(8)"), ("list_price", "float"),
              ("on_site_date", "date"), ("units", "int"), ("note", "varchar(8)"), ("snapshot_day", "date")]
    res = clean_lines(data_lines(lines).select("file_name", "line_no", "value"), head.split("\t"), target,
                      snapshot_day="20170101")
    rows = sorted(res.rows.collect(), key=lambda r: r.line_no)
    assert [r.asin for r in rows] == ["B000000001", "B000000004"]          # duplicate line dropped
    assert rows[0].list_price == 12.5 and rows[0].on_site_date == dt.date(2017, 1, 5) and rows[0].units == 3
    assert rows[1].list_price == 0.1 and rows[1].on_site_date == dt.date(2017, 1, 5) and rows[1].note == ""
    assert rows[1].units == 5 and rows[1].snapshot_day == dt.date(2017, 1, 1)
    rej = sorted((r.line_no, r.n_fields) for r in res.rejects.collect())
    assert rej == [(4, 3), (5, 7)]                                          # short and long rows, file line numbers


def test_infer_schema(spark):
    header = ["Asin", "N", "F", "D", "Mixed", "Empty"]
    vals = [("B000000001", "1", "1", "2017-1-5", "2017-1-5", ""), ("B000000002", "22", "2.5", "1/5/2017", "7", ""),
            ("B000000003", "-3", "3", "20170105", "x", "")]
    lines = spark.createDataFrame([("f", i + 2, "\t".join(v)) for i, v in enumerate(vals)],
                                  "file_name string, line_no long, value string")
    got = {r.column_name: (r.inferred_type, r.length, r.is_key) for r in infer_schema(lines, header).collect()}
    assert got["asin"] == ("char", 13, True)
    assert got["n"][0] == "int" and got["f"][0] == "float" and got["d"][0] == "date"
    assert got["mixed"] == ("varchar", 10, False) and got["empty"] == ("varchar", 0, False)
    ddl = ddl_text([r.asDict() for r in infer_schema(lines, header).collect()], "shop.items")
    assert "primary key (asin)" in ddl


def test_invalid_utf8_bytes_are_dropped(spark, tmp_dir):
    path = os.path.join(tmp_dir, "shop.items.20170101.txt")
    with open(path, "wb") as fh:
        fh.write("Asin\tNote\r\n".encode() + b"B000000001\tca\xfft\xe9\r\n" + "B000000002\tcafé\r\n".encode())
    lines = sorted(scan_lines(spark, tmp_dir).collect(), key=lambda r: r.line_no)
    assert [r.value for r in lines] == ["Asin\tNote", "B000000001\tcat", "B000000002\tcafé"]


def test_line_numbers_exact_across_file_splits(spark, tmp_dir):
    path = os.path.join(tmp_dir, "big.txt")
    with open(path, "w") as fh:
        fh.write("".join(f"line {i:05d} " + "x" * (i % 17) + "\n" for i in range(1, 3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = spark.read.text(tmp_dir)
        assert raw.rdd.getNumPartitions() > 5                       # the file really is split
        lines = scan_lines(spark, tmp_dir).select("line_no", "value").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {r.line_no: r.value for r in lines}
    assert len(got) == 3000
    assert all(got[i].startswith(f"line {i:05d} ") for i in range(1, 3001))
