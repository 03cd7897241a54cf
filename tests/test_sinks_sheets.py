import datetime as dt
import glob
import os
import time

from pyspark.sql import functions as F

from shelfwise.functions.cleansing import clean_cast
from shelfwise.functions.dates import week_stamp
from shelfwise.functions.text import key_summary, link, strip_number_text, strip_thousands
from shelfwise.operators.merge import stamp, update_from_group
from shelfwise.operators.sheets import (
    checklist_capture, resolve_columns, resolve_positions, validate_checklist, bind_sheet,
)
from shelfwise.operators.topn import cap_rows
from shelfwise.sources.dropfile import newest_file_of_newest_dir, retention_expired, scan_lines
from shelfwise.sources.sinks import expired_exports, export_tables, run_stamp, write_day_partition, write_report


def test_resolve_columns_fuzzy_rules():
    roles = resolve_columns(["Deal ASIN", "ASIN", "kasin", "Start Time", "schedule date", "Title", "VM", "k_code",
                             "code2"])
    assert roles == {"asin": "asin", "schedule": "schedule date", "title": "title", "vm": "vm", "code": "k_code"}
    assert resolve_columns(["asin x", "other asin"])["asin"] == "other asin"
    assert resolve_positions(["", "ASIN", "note"]) == {"asin": 1, "schedule": 0}


def test_bind_sheet(spark):
    df = spark.createDataFrame([("B000000001", "1/5", "t")], "`Deal ASIN` string, `Start Time` string, Title string")
    out = bind_sheet(df, resolve_columns(df.columns))
    assert out.columns == ["asin", "schedule", "title"]


CHECK_COLS = "asin string, src string, ss_day string, issue_title_name string, issue_pd string, " \
             "issue_cover string, issue_author string, fix_status string"


def test_validate_and_capture_checklist(spark):
    sheet = spark.createDataFrame([
        ("B000000001", "PTS", "2017-1-5", "bad title", "", "", "", ""),        # ok, status -> Y
        ("B000000002", "XYZ", "2017-1-5", "x", "", "", "", ""),              # bad source
        ("B000000003", "ABC", "5/1/2017", "x", "", "", "", ""),              # bad day
        ("B000000004", "DOTD", "2017-01-05", "", "", "", "", ""),            # no issue, no status
        ("nope", "PTS", "2017-1-5", "x", "", "", "", ""),                    # no product code
        ("B000000005", "PTS", "2017-1-5", "", "", "", "", "N"),              # status only
    ], CHECK_COLS)
    v = sorted((r.asin, r.fix_status) for r in validate_checklist(sheet).collect())
    assert v == [("B000000001", "Y"), ("B000000005", "N")]
    current = spark.createDataFrame([("B000000001", "PTS", "2017-1-5", "bad title", None, None, None, "Y", 1),
                                     ("B000000009", "PTS", "2017-1-5", "old", None, None, None, "Y", 1)],
                                    CHECK_COLS + ", msgid bigint")
    merged = checklist_capture(current, sheet, 7)
    got = sorted((r.asin, r.msgid) for r in merged.collect())
    # B1 identical (NULL == '') -> kept from current; B5 new -> inserted with the message id.
    assert got == [("B000000001", 1), ("B000000005", 7), ("B000000009", 1)]


def test_report_sink_and_day_partitions(spark, tmp_dir):
    df = spark.createDataFrame([(1, None, dt.date(2017, 1, 5))], "a int, b string, d date")
    small = spark.range(3).select(F.col("id").alias("a"))                        # known small size estimate
    plain = write_report(small, tmp_dir, "r0", "s0", "x")                       # small: left uncompressed
    assert glob.glob(os.path.join(plain, "*.csv")) and not glob.glob(os.path.join(plain, "*.gz"))
    path = write_report(df, tmp_dir, "r1", "s1", run_stamp(dt.datetime(2017, 1, 5, 9, 30)), compress_above=0)
    assert path.endswith("run_ts=2017-01-05-0930/report=r1/sheet=s1")
    assert glob.glob(os.path.join(path, "*.csv.gz"))
    back = spark.read.option("header", True).csv(path).first()
    assert (back.a, back.b, back.d) == ("1", None, "2017-01-05")   # NULL written blank
    per_key = write_report(df.withColumn("promo", F.lit(3)), tmp_dir, "r2", "detail", "x", fmt="parquet",
                           partition_by=["promo"])
    assert os.path.isdir(os.path.join(per_key, "promo=3"))          # one folder per key from one job
    hist = os.path.join(tmp_dir, "hist")
    day1 = spark.createDataFrame([(dt.date(2017, 1, 1), "D", 1)], "ss_day date, dir string, v int")
    day2 = spark.createDataFrame([(dt.date(2017, 1, 2), "D", 2)], "ss_day date, dir string, v int")
    write_day_partition(day1, hist)
    write_day_partition(day2, hist)
    write_day_partition(day2.withColumn("v", F.lit(3)), hist)   # re-run of day 2 replaces day 2 only
    assert sorted((str(r.ss_day), r.v) for r in spark.read.parquet(hist).collect()) == [("2017-01-01", 1), ("2017-01-02", 3)]


def test_export_retention(spark, tmp_dir):
    df = spark.createDataFrame([(1,)], "a int")
    for day in ("2017-01-01", "2017-01-05", "2017-01-09"):
        export_tables({"t": df}, tmp_dir, day)
    old = expired_exports(spark, tmp_dir, "t", "2017-01-10", keep_days=7)
    assert [p.rsplit("/", 1)[-1] for p in old] == ["dt=2017-01-01"]
    flags = spark.createDataFrame([(dt.date(2017, 1, 1),), (dt.date(2017, 1, 9),)], "d date") \
        .select(retention_expired("d", "2017-01-10", 7).alias("x")).collect()
    assert [r.x for r in flags] == [True, False]


def test_quiet_period_and_newest_file(spark, tmp_dir):
    for sub, name in (("a", "x.txt"), ("b", "y.txt"), ("b", "z.txt")):
        os.makedirs(os.path.join(tmp_dir, sub), exist_ok=True)
        with open(os.path.join(tmp_dir, sub, name), "w") as fh:
            fh.write("h\nv\n")
        time.sleep(1.1)
    lines = scan_lines(spark, tmp_dir + "/*/")
    files = lines.select("file_path", "mtime").distinct()
    assert newest_file_of_newest_dir(files).first().file_path.endswith("b/z.txt")
    assert scan_lines(spark, tmp_dir + "/*/", quiet_before=dt.datetime(2000, 1, 1)).count() == 0


def test_dimension_update_and_stamp(spark):
    dim = spark.createDataFrame([("P1", "old"), ("P2", "keep")], "pub string, ops string")
    src = spark.createDataFrame([("P1", "b"), ("P1", "a"), ("P1", " "), ("P2", None)], "pub string, ops string")
    out = sorted(map(tuple, update_from_group(dim, src, "pub", "ops", "ops").collect()))
    assert out == [("P1", "b"), ("P2", "keep")]
    ctl = spark.createDataFrame([("P1", None), ("P2", None)], "pub string, last string")
    st = {r.pub: r.last for r in stamp(ctl, "pub", "P2", "last", F.lit("2017-01-05")).collect()}
    assert st == {"P1": None, "P2": "2017-01-05"}


def test_row_cap(spark):
    _, fits = cap_rows(spark.range(1000))
    _, too_many = cap_rows(spark.range(1001))
    assert fits and not too_many


def test_small_text_rules(spark):
    df = spark.createDataFrame([("12345.0", "1,234\r\n", dt.date(2017, 1, 2))], "n string, s string, d date")
    r = df.select(strip_number_text("n").alias("n"), strip_thousands("s").alias("s"), week_stamp("d").alias("w"),
                  key_summary(F.array(*[F.lit("B%09d" % i) for i in range(40)]), 250).alias("k"),
                  link(F.lit("B000000001"), F.lit("t")).alias("l")).first()
    assert (r.n, r.s, r.w) == ("12345", "1234", "2017wk01")
    assert len(r.k) == 250 and r.l.endswith("B000000001#t")


def test_datetime_passthrough(spark):
    df = spark.createDataFrame([("2017-01-05 10:00:00",), ("",), ("junk",)], "v string")
    got = [r[0] for r in df.select(clean_cast("v", "datetime")).collect()]
    assert got == [dt.datetime(2017, 1, 5, 10, 0), None, None]


def test_parameters_from_request(spark):
    from shelfwise.functions.text import PRODUCT_CODE_RE, product_codes
    from shelfwise.operators.params import mine_parameters, parameter_filter, per_request

    rules = [("product", PRODUCT_CODE_RE.replace(r"[\p{L}\p{N}_]", r"\w")), ("publisher", r"(\w{3}CN)")]
    params = mine_parameters("please B000000001, B000000002 and B000000001 for ABCCN", rules)
    assert params == {"product": ["B000000001", "B000000002"], "publisher": ["ABCCN"]}
    df = spark.createDataFrame([("B000000001", "X"), ("B000000003", "ABCCN"), ("B000000004", "Y")],
                               "product string, publisher string")
    assert sorted(r.product for r in parameter_filter(df, params).collect()) == ["B000000001", "B000000003"]
    assert parameter_filter(df, mine_parameters("nothing here", rules)) is None
    reqs = spark.createDataFrame([(1, "see B000000001"), (2, "B000000004 B000000001")], "msgid long, body string") \
        .select("msgid", F.explode(product_codes("body")).alias("code"))
    got = sorted((r.msgid, r.product) for r in per_request(df, "product", reqs, "msgid", "code").collect())
    assert got == [(1, "B000000001"), (2, "B000000001"), (2, "B000000004")]


def test_cli_lists_and_runs(tmp_dir, spark):
    from shelfwise.__main__ import main
    assert main(["list"]) == 0
    assert main(["run", "creation_by_month", "--data", "/root/testdata/sf0.001", "--out", tmp_dir]) == 0
    assert glob.glob(os.path.join(tmp_dir, "run_ts=*", "report=creation_by_month", "sheet=main", "*.csv*"))


def test_routing_first_tag_wins_and_sender_lists(spark):
    from shelfwise.plans.access_reports import allowed_senders, route
    routes = (("top", "r_top"), ("price", "r_price"))
    df = spark.createDataFrame([("Price and TOP list",), ("nothing",), ("new PRICE",)], "s string")
    assert [r[0] for r in df.select(route(F.col("s"), routes, "help")).collect()] == ["r_top", "help", "r_price"]
    msgs = spark.createDataFrame([(1, "A@X.com", "P1"), (2, "b@x.com", "P1"), (3, "c@x.com", "P2")],
                                 "msgid int, sender string, pub string")
    lists = spark.createDataFrame([("P1", "a@x.com; d@x.com", "e@x.com"), ("P2", "", "c@x.com,")],
                                  "pub string, to_list string, cc string")
    got = sorted(r.msgid for r in allowed_senders(msgs, "sender", lists, "pub", ("to_list", "cc"), "pub").collect())
    assert got == [1, 3]


def test_outputs_are_compressed_by_their_written_size(spark, tmp_dir):
    """Each key's folder on its own side of the bound; rows, odd cells and folders are the same on both."""
    odd = ['plain', '', ' lead', 'a,b', 'say "hi"', 'two\nlines', 'back\\slash', None, '书名']
    rows = [(f"p{k % 3}", None if k % 7 == 0 else k % 2, k, odd[k % len(odd)]) for k in range(900) if k % 3 or k < 30]
    df = spark.createDataFrame(rows, "promo string, vendor int, n int, cell string").repartition(2, "promo", "vendor")

    def read(path):
        back = (spark.read.option("header", True).option("multiLine", True).option("nullValue", "\u0000").option("basePath", path)
                .schema("n string, cell string, promo string, vendor string").csv(path))
        return sorted((r.promo, r.vendor or "", int(r.n), r.cell) for r in back.collect())

    def kinds(path):
        leaves = glob.glob(f"{path}/promo=*/vendor=*")
        found = {}
        for leaf in leaves:
            names = [f for f in os.listdir(leaf) if not f.startswith((".", "_"))]
            found[leaf[len(path):]] = {f.endswith(".gz") for f in names}
        assert all(len(v) == 1 for v in found.values())
        return {k: v.pop() for k, v in found.items()}

    plain = write_report(df, tmp_dir, "r", "plain", "x", partition_by=["promo", "vendor"], compress_above=10**9)
    some = write_report(df, tmp_dir, "r", "some", "x", partition_by=["promo", "vendor"], compress_above=600)
    every = write_report(df, tmp_dir, "r", "every", "x", partition_by=["promo", "vendor"], compress_above=0)
    assert set(kinds(plain).values()) == {False} and set(kinds(every).values()) == {True}
    sizes = {leaf: sum(os.path.getsize(f) for f in glob.glob(f"{plain}{leaf}/*.csv")) for leaf in kinds(plain)}
    # (Sizes include the checksum files on neither side of the bound here.)
    assert kinds(some) == {leaf: size > 600 for leaf, size in sizes.items()} and len(set(kinds(some).values())) == 2
    assert read(plain) == read(some) == read(every) and len(read(plain)) == len(rows)
    assert not glob.glob(f"{tmp_dir}/run_ts=x/report=r/*-*")
    one = write_report(df.select("n", "cell"), tmp_dir, "r", "one", "x", compress_above=0)
    assert glob.glob(one + "/*.csv.gz") and not glob.glob(one + "/*.csv")


def test_promotion_sheets_on_both_sides_of_the_bound(spark, tmp_dir):
    from shelfwise.plans.written_reports import read_promotion_sheets, write_promotion_sheets
    from shelfwise.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    key = lambda df: sorted(map(tuple, df.collect()))
    plain, packed = tmp_dir + "/plain", tmp_dir + "/packed"
    write_promotion_sheets(t, plain)
    write_promotion_sheets(t, packed, compress_above=100)
    assert not glob.glob(plain + "/**/*.gz", recursive=True) and glob.glob(packed + "/**/*.gz", recursive=True)
    rows = key(read_promotion_sheets(t, plain))
    assert rows == key(read_promotion_sheets(t, packed)) and {r[0] for r in rows} == {"products", "totals"}
