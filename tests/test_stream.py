import glob
import json
import os
import time

import pytest

from shelfwise.operators.merge import latest_version
from shelfwise.streaming.file_drop import run_drop_folder

TABLES = {"items": {"target": [("asin", "char(10)"), ("units", "int"), ("note", "varchar(8)")], "keys": ["asin"]}}


def _write(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        fh.write("Asin\tUnits\tNote\n" + "".join("\t".join(r) + "\n" for r in rows))


def _run(spark, folder, root):
    q = run_drop_folder(spark, folder, root + "/tables", root + "/ckpt", TABLES, available_now=True, quiet_seconds=0)
    q.awaitTermination()
    assert q.exception() is None
    return sorted(map(tuple, spark.read.parquet(latest_version(spark, root + "/tables/shop/items")).collect()))


def test_two_steps_equal_one_batch(spark, tmp_dir):
    a = [("B1", "1", "a"), ("B2", "2", "b")]
    b = [("B2", "20", "bb"), ("B3", "30", "c")]
    step_dir, one_dir = os.path.join(tmp_dir, "steps"), os.path.join(tmp_dir, "one")
    _write(step_dir + "/in", "1.shop.items.20170101.txt", a)
    first = _run(spark, step_dir + "/in", step_dir)
    assert first == [("B1", 1, "a"), ("B2", 2, "b")]
    _write(step_dir + "/in", "2.shop.items.20170102.txt", b)
    stepped = _run(spark, step_dir + "/in", step_dir)
    _write(one_dir + "/in", "1.shop.items.20170101.txt", a)
    _write(one_dir + "/in", "2.shop.items.20170102.txt", b)
    assert stepped == _run(spark, one_dir + "/in", one_dir) == [("B1", 1, "a"), ("B2", 20, "bb"), ("B3", 30, "c")]


def test_update_mode_and_rerun_idempotent(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "in")
    _write(folder, "1.shop.items.20170101.txt", [("B1", "1", "a"), ("B2", "2", "b")])
    _write(folder, "2.shop.items.20170102.upd", [("B2", "", "z"), ("B9", "9", "n")])
    assert _run(spark, folder, tmp_dir) == [("B1", 1, "a"), ("B2", None, "z")]
    assert _run(spark, folder, tmp_dir) == [("B1", 1, "a"), ("B2", None, "z")]   # nothing new: unchanged


def test_message_stream_once_per_message(spark, tmp_dir):
    import datetime as dt
    from shelfwise.streaming.messages import MESSAGE_SCHEMA, read_log, run_message_stream

    folder = os.path.join(tmp_dir, "msgs")
    t0 = dt.datetime(2017, 7, 3, 10, 0)
    first = [(1, "a@x.com", t0, "toplist please", "B000000001 and B000000002"),
             (2, "b@x.com", t0, "price check", "B000000003")]
    again = [(2, "b@x.com", t0, "price check", "B000000003"),      # same message delivered twice
             (3, "c@x.com", t0, "hello", "")]
    spark.createDataFrame(first, MESSAGE_SCHEMA).write.parquet(os.path.join(folder, "p1"))
    spark.createDataFrame(again, MESSAGE_SCHEMA).write.parquet(os.path.join(folder, "p2"))
    audit = os.path.join(tmp_dir, "audit")

    def run():
        q = run_message_stream(spark, folder + "/*", audit, os.path.join(tmp_dir, "ck"))
        q.awaitTermination()
        assert q.exception() is None
        return sorted((r.msgid, r.type, r.key_data) for r in read_log(spark, audit).collect())

    expected = [(1, "top_products_to_80pct", "B000000001,B000000002"), (2, "price_down_candidates", "B000000003"),
                (3, "help", "")]
    assert run() == expected
    assert run() == expected


def test_unknown_table_gets_ddl_and_rejects_are_kept(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "in")
    _write(folder, "1.shop.items.20170101.txt", [("B1", "1", "a"), ("B2", "2")])            # one short row
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "2.shop.newtab.20170101.txt"), "w") as fh:
        fh.write("Kasin\tQty\tPrice\nB000000001\t3\t1.5\nB000000002\t4\t2\n")
    assert _run(spark, folder, tmp_dir) == [("B1", 1, "a")]
    ddl = open(os.path.join(tmp_dir, "tables", "_unknown", "2.shop.newtab.20170101.txt.sql")).read()
    assert "create table shop.newtab" in ddl and "kasin char(13)" in ddl and "qty int" in ddl
    assert "price float" in ddl and "primary key (kasin)" in ddl
    rej = spark.read.parquet(os.path.join(tmp_dir, "tables", "shop", "items", "_rejects", "*")).collect()
    assert [(r.line_no, r.n_fields) for r in rej] == [(3, 2)]


def test_failed_load_is_recorded_and_others_go_on(spark, tmp_dir):
    import json
    folder = os.path.join(tmp_dir, "in")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "1.shop.items.20170101.txt"), "w") as fh:
        fh.write("Foo\tBar\nx\ty\n")                                             # shares no column with items
    _write(folder, "2.shop.items.20170102.upd", [("B1", "1", "a")])             # different header/mode: own load
    _write(folder, "3.shop.items.20170103.txt", [("B7", "7", "g")])
    assert _run(spark, folder, tmp_dir) == [("B7", 7, "g")]
    failed = [json.load(open(p)) for p in glob.glob(os.path.join(tmp_dir, "tables", "_failed", "*.json"))]
    assert [f["files"] for f in failed] == [["1.shop.items.20170101.txt"]]
    assert "no column" in failed[0]["error"]


def test_duplicate_keys_last_file_in_sequence_wins(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "in")
    _write(folder, "2.shop.items.20170101.txt", [("B1", "2", "from2"), ("B2", "2", "x")])
    _write(folder, "10.shop.items.20170101.txt", [("B1", "10", "from10")])
    assert _run(spark, folder, tmp_dir) == [("B1", 10, "from10"), ("B2", 2, "x")]


def _drop(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        fh.write("\n".join(lines) + "\n")


WIDE = {"p": {"target": [("k", "int"), ("a", "varchar(8)"), ("b", "varchar(8)"), ("snapshot_day", "date")], "keys": ["k"]},
        "log": {"target": [("x", "varchar(8)")], "keys": []}}


def _load(spark, tmp_dir):
    q = run_drop_folder(spark, tmp_dir + "/in", tmp_dir + "/tables", tmp_dir + "/ckpt", WIDE, quiet_seconds=0)
    q.awaitTermination()
    assert q.exception() is None
    return lambda t: sorted(map(tuple, spark.read.parquet(latest_version(spark, f"{tmp_dir}/tables/{t}")).collect()), key=str)


def test_loads_keep_days_databases_columns_and_bad_keys_apart(spark, tmp_dir):
    import datetime as dt

    one, two = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    _drop(tmp_dir + "/in", "1.db1.p.20240101.txt", ["k\ta", "1\tx"])
    _drop(tmp_dir + "/in", "2.db1.p.20240102.txt", ["k\ta", "2\ty", "oops\tz", "bad\tw"])   # its own day; two keys do not parse
    _drop(tmp_dir + "/in", "3.db1.p.20240102.txt", ["k\ta\tb", "3\tq\tlater"])              # a column the first file lacks
    _drop(tmp_dir + "/in", "4.db2.p.20240101.txt", ["k\ta", "1\tother"])
    _drop(tmp_dir + "/in", "5.db1.log.20240101.txt", ["x", "l1"])
    _drop(tmp_dir + "/in", "6.db1.log.20240102.txt", ["x", "l2"])
    rows = _load(spark, tmp_dir)
    assert rows("db1/p") == [(1, "x", None, one), (2, "y", None, two), (3, "q", "later", two)]
    assert rows("db2/p") == [(1, "other", None, one)]
    assert rows("db1/log") == [("l1",), ("l2",)]
    assert spark.read.parquet(tmp_dir + "/tables/db1/p/_no_key/*").count() == 2


def test_second_truncating_file_replaces_the_first(spark, tmp_dir):
    _drop(tmp_dir + "/in", "1.db1.log.20240101.trunc", ["x", "old"])
    _drop(tmp_dir + "/in", "2.db1.log.20240101.trunc", ["x", "new"])
    assert _load(spark, tmp_dir)("db1/log") == [("new",)]


def test_running_errors_are_not_taken_for_bad_files(spark, tmp_dir, monkeypatch):
    import pytest
    from shelfwise.streaming import file_drop

    def full(*_):
        raise OSError("disk full")

    monkeypatch.setattr(file_drop, "write_version", full)
    _drop(tmp_dir + "/in", "1.db1.log.20240101.txt", ["x", "l1"])
    with pytest.raises(Exception, match="disk full"):
        _load(spark, tmp_dir)


def test_late_message_is_kept(spark, tmp_dir):
    import datetime as dt
    from shelfwise.streaming.messages import MESSAGE_SCHEMA, read_log, run_message_stream

    def send(name, rows):
        spark.createDataFrame(rows, MESSAGE_SCHEMA).write.parquet(f"{tmp_dir}/msgs/{name}")
        q = run_message_stream(spark, tmp_dir + "/msgs/*", tmp_dir + "/audit", tmp_dir + "/ck")
        q.awaitTermination()
        assert q.exception() is None

    send("p1", [(1, "a@x.com", dt.datetime(2024, 3, 1), "s", "b")])
    send("p2", [(2, "a@x.com", dt.datetime(2024, 1, 1), "s", "b"), (1, "a@x.com", dt.datetime(2024, 3, 1), "s", "b")])
    assert sorted(r.msgid for r in read_log(spark, tmp_dir + "/audit").collect()) == [1, 2]


# ------------------------------------------------------------------ one commit per load, file states, quiet period
LOADS = {"log": {"target": [("x", "varchar(8)")], "keys": []}, "p": {"target": [("k", "int"), ("a", "varchar(8)")], "keys": ["k"]}}


@pytest.mark.parametrize("mode, table, lines, want", [
    ("txt", "log", ["x", "l1", "l2"], [("l0",), ("l1",), ("l2",)]),
    ("txt", "p", ["k\ta", "1\tnew"], [(1, "new"), (2, "b")]),
    ("upd", "p", ["k\ta", "2\tnew", "9\tno"], [(1, "a"), (2, "new")]),
    ("trunc", "p", ["k\ta", "7\tonly"], [(7, "only")]),
])
@pytest.mark.parametrize("crash", ["before the version", "after the version"])
def test_crash_and_replay_load_once(spark, tmp_dir, monkeypatch, mode, table, lines, want, crash):
    """A batch that dies around the commit of a load is run again and gives each row once."""
    from shelfwise.streaming import file_drop

    folder = tmp_dir + "/in"
    first = {"log": ["x", "l0"], "p": ["k\ta", "1\ta", "2\tb"]}[table]
    _drop(folder, f"1.d.{table}.20240101.txt", first)
    _stream(spark, tmp_dir, LOADS)
    _drop(folder, f"2.d.{table}.20240102.{mode}", lines)
    real = file_drop.write_version

    def dies(*args, **kwargs):
        if crash == "after the version":
            real(*args, **kwargs)
        raise OSError("executor lost")

    monkeypatch.setattr(file_drop, "write_version", dies)
    with pytest.raises(Exception, match="executor lost"):
        _stream(spark, tmp_dir, LOADS)
    assert os.path.exists(f"{folder}/2.d.{table}.20240102.{mode}")
    monkeypatch.setattr(file_drop, "write_version", real)
    _stream(spark, tmp_dir, LOADS)
    rows = spark.read.parquet(latest_version(spark, f"{tmp_dir}/tables/d/{table}")).collect()
    assert sorted(map(tuple, rows)) == want
    assert sorted(os.listdir(folder + "/done")) == sorted([f"1.d.{table}.20240101.txt", f"2.d.{table}.20240102.{mode}"])


def _stream(spark, tmp_dir, tables, **options):
    q = run_drop_folder(spark, tmp_dir + "/in", tmp_dir + "/tables", tmp_dir + "/ckpt", tables, **{"quiet_seconds": 0, **options})
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def test_crash_between_moves_does_not_regroup(spark, tmp_dir, monkeypatch):
    """Two files of one load; the batch dies when the first has been moved. The second is not loaded again alone."""
    from shelfwise.streaming import file_drop

    _drop(tmp_dir + "/in", "1.d.log.20240101.txt", ["x", "l1"])
    _drop(tmp_dir + "/in", "2.d.log.20240101.txt", ["x", "l2"])
    real, moved = file_drop.fs_replace, []

    def once(spark_, src, dst):
        if "/done/" in dst:
            moved.append(dst)
            if len(moved) == 2:
                raise OSError("driver lost")
        return real(spark_, src, dst)

    monkeypatch.setattr(file_drop, "fs_replace", once)
    with pytest.raises(Exception, match="driver lost"):
        _stream(spark, tmp_dir, LOADS)
    monkeypatch.setattr(file_drop, "fs_replace", real)
    _stream(spark, tmp_dir, LOADS)
    rows = spark.read.parquet(latest_version(spark, f"{tmp_dir}/tables/d/log")).collect()
    assert sorted(map(tuple, rows)) == [("l1",), ("l2",)]
    assert len(os.listdir(tmp_dir + "/in/done")) == 2


def test_file_written_in_two_steps_is_loaded_once_and_whole(spark, tmp_dir):
    path = tmp_dir + "/in/1.d.log.20240101.txt"
    _drop(tmp_dir + "/in", "1.d.log.20240101.txt", ["x", "l1"])
    _drop(tmp_dir + "/in", "2.d.p.20240101.txt", ["k\ta", "1\ta"])
    old = time.time() - 3600
    os.utime(tmp_dir + "/in/2.d.p.20240101.txt", (old, old))
    _stream(spark, tmp_dir, LOADS, quiet_seconds=60)
    assert os.path.exists(path) and latest_version(spark, tmp_dir + "/tables/d/log") is None     # held back
    assert latest_version(spark, tmp_dir + "/tables/d/p") is not None                            # quiet for an hour
    with open(path, "a") as out:
        out.write("l2\n")
    _stream(spark, tmp_dir, LOADS, quiet_seconds=60)
    assert latest_version(spark, tmp_dir + "/tables/d/log") is None
    os.utime(path, (old, old))
    _stream(spark, tmp_dir, LOADS, quiet_seconds=60)
    _stream(spark, tmp_dir, LOADS, quiet_seconds=60)
    rows = spark.read.parquet(latest_version(spark, tmp_dir + "/tables/d/log")).collect()
    assert sorted(map(tuple, rows)) == [("l1",), ("l2",)]


def test_failed_file_is_set_aside_corrected_and_loaded(spark, tmp_dir):
    name = "1.d.log.20240101.txt"
    _drop(tmp_dir + "/in", name, ["other", "l1"])
    _stream(spark, tmp_dir, LOADS, max_attempts=2)
    assert os.path.exists(f"{tmp_dir}/in/{name}")                          # one more attempt
    _stream(spark, tmp_dir, LOADS, max_attempts=2)
    assert os.path.exists(f"{tmp_dir}/in/{name}.err") and not os.path.exists(f"{tmp_dir}/in/{name}")
    notes = [json.load(open(p)) for p in glob.glob(tmp_dir + "/tables/_failed/*.json")]
    assert [(n["files"], n["attempts"]) for n in notes] == [([name], 2)] and "no column" in notes[0]["error"]
    _drop(tmp_dir + "/in", name, ["x", "l1"])
    _stream(spark, tmp_dir, LOADS)
    assert [tuple(r) for r in spark.read.parquet(latest_version(spark, tmp_dir + "/tables/d/log")).collect()] == [("l1",)]
    assert os.listdir(tmp_dir + "/in/done") == [name]


def test_update_without_keys_empty_file_and_done_retention(spark, tmp_dir):
    import datetime as dt
    from shelfwise.streaming.file_drop import clean_done

    _drop(tmp_dir + "/in", "1.d.log.20240101.upd", ["x", "l1"])
    open(tmp_dir + "/in/2.d.log.20240101.txt", "w").close()
    _drop(tmp_dir + "/in", "3.d.log.20240101.txt", ["x", "l3"])
    _drop(tmp_dir + "/in", "notes.md", ["not a drop file"])
    _stream(spark, tmp_dir, LOADS)
    assert sorted(f for f in os.listdir(tmp_dir + "/in") if f.endswith(".err")) == ["1.d.log.20240101.upd.err", "2.d.log.20240101.txt.err"]
    assert os.path.exists(tmp_dir + "/in/notes.md")
    now = dt.datetime.now()
    assert clean_done(spark, tmp_dir + "/in", 14, now + dt.timedelta(days=13)) == []
    assert clean_done(spark, tmp_dir + "/in", 14, now + dt.timedelta(days=15)) == ["3.d.log.20240101.txt"]


def test_unknown_table_is_loaded_once_it_exists(spark, tmp_dir):
    _drop(tmp_dir + "/in", "1.d.log.20240101.txt", ["x", "l1"])
    _stream(spark, tmp_dir, {})
    assert "create table d.log" in open(tmp_dir + "/tables/_unknown/1.d.log.20240101.txt.sql").read()
    _stream(spark, tmp_dir, LOADS)
    assert [tuple(r) for r in spark.read.parquet(latest_version(spark, tmp_dir + "/tables/d/log")).collect()] == [("l1",)]


def test_definitions_from_the_catalog(spark, tmp_dir):
    """Columns, declared types and keys of catalog tables; a table without a key is appended to."""
    from shelfwise.sources.tables import catalog_tables, table_spec

    db = "drop_" + os.path.basename(tmp_dir).replace("-", "_").lower()
    spark.sql(f"CREATE DATABASE {db} LOCATION '{tmp_dir}/wh'")
    spark.sql(f"CREATE TABLE {db}.p (k int, a varchar(8), price decimal(18,2)) USING parquet TBLPROPERTIES ('key.primary' = 'k', 'key.z' = 'a')")
    spark.sql(f"CREATE TABLE {db}.u (k int, a char(4)) USING parquet TBLPROPERTIES ('key.b' = 'a', 'key.c' = 'k, a')")
    spark.sql(f"CREATE TABLE {db}.log (x string) USING parquet")
    assert table_spec(spark, db, "p") == {"target": [("k", "int"), ("a", "varchar(8)"), ("price", "decimal(18,2)")], "keys": ["k"],
                                          "types": {"k": "int", "a": "string", "price": "decimal(18,2)"}}
    assert table_spec(spark, db, "u")["keys"] == ["k", "a"] and table_spec(spark, db, "log")["keys"] == []
    assert table_spec(spark, db, "none") is None
    assert [t for t in catalog_tables(spark) if t[0] == db] == [(db, "log"), (db, "p"), (db, "u")]
    _drop(tmp_dir + "/in", f"1.{db}.p.20240101.txt", ["k\ta\tprice", "1\ta\t1.10", "2\tb\t2"])
    _drop(tmp_dir + "/in", f"2.{db}.p.20240102.txt", ["k\ta\tprice", "2\tbb\t3.30"])
    _drop(tmp_dir + "/in", f"3.{db}.log.20240101.txt", ["x", "l1"])
    _drop(tmp_dir + "/in", f"4.{db}.log.20240102.txt", ["x", "l1"])
    _drop(tmp_dir + "/in", f"5.{db}.none.20240102.txt", ["x", "l1"])
    _stream(spark, tmp_dir, None)
    assert sorted((r.k, r.a, str(r.price)) for r in spark.table(f"{db}.p").collect()) == [(1, "a", "1.10"), (2, "bb", "3.30")]
    assert [r.x for r in spark.table(f"{db}.log").collect()] == ["l1", "l1"]
    assert os.path.exists(f"{tmp_dir}/in/5.{db}.none.20240102.txt")


def test_files_of_two_charsets_in_one_folder(spark, tmp_dir):
    """A GBK file and a UTF-8 file of the same rows load alike, by the stream and by a batch scan."""
    from shelfwise.sources.dropfile import scan_lines

    lines = ["k\ta", "1\t书名", "2\t作者", "", "3\tplain"]
    os.makedirs(tmp_dir + "/in")
    for name, charset, end in (("1.d1.p.20240101.txt", "gbk", "\r\n"), ("1.d2.p.20240101.txt", "utf-8-sig", "\n")):
        with open(f"{tmp_dir}/in/{name}", "wb") as out:
            out.write((end.join(lines) + end).encode(charset))
    scanned = {}
    for r in scan_lines(spark, tmp_dir + "/in").collect():
        scanned.setdefault(r.file_name, []).append((r.line_no, r.value))
    one, two = (sorted(v) for v in scanned.values())
    assert one == two == [(1, "k\ta"), (2, "1\t书名"), (3, "2\t作者"), (5, "3\tplain")]
    _stream(spark, tmp_dir, LOADS)
    got = [sorted(map(tuple, spark.read.parquet(latest_version(spark, f"{tmp_dir}/tables/{d}/p")).collect())) for d in ("d1", "d2")]
    assert got[0] == got[1] == [(1, "书名"), (2, "作者"), (3, "plain")]


# ------------------------------------------------------------------ ledger of messages
def test_redelivered_message_changes_nothing(spark, tmp_dir):
    """A message id is acted on once: later deliveries, whatever they hold, add and change no row."""
    import datetime as dt
    from shelfwise.streaming.messages import MESSAGE_SCHEMA, read_log, run_message_stream

    t0 = dt.datetime(2024, 1, 1)

    def send(name, rows):
        spark.createDataFrame(rows, MESSAGE_SCHEMA).write.parquet(f"{tmp_dir}/msgs/{name}")
        q = run_message_stream(spark, tmp_dir + "/msgs/*", tmp_dir + "/audit", tmp_dir + "/ck")
        q.awaitTermination()
        assert q.exception() is None
        return sorted((r.msgid, r.fro, r.subject) for r in read_log(spark, tmp_dir + "/audit").collect())

    one = send("p1", [(1, "a@x.com", t0, "toplist", "B000000001"), (1, "z@x.com", t0 + dt.timedelta(1), "later", ""),
                      (2, "b@x.com", t0, "price", "")])
    assert one == [(1, "a@x.com", "toplist"), (2, "b@x.com", "price")]
    size = {p: os.path.getmtime(p) for p in glob.glob(tmp_dir + "/audit/*/*.parquet")}
    # Earlier and later copies with another sender and subject, and one new message.
    two = send("p2", [(1, "q@x.com", t0 - dt.timedelta(9), "changed", ""), (2, "q@x.com", t0 + dt.timedelta(9), "changed", ""),
                      (3, "c@x.com", t0, "hello", None)])
    assert two == [*one, (3, "c@x.com", "hello")]
    assert send("p3", [(3, "x@x.com", t0, "again", None)]) == two
    # The log is appended to: files of earlier batches are as they were.
    assert all(os.path.getmtime(p) == t for p, t in size.items())
