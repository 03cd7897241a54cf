from shelfwise.sources.html import html_table_rows, keyword_table_rows

PAGES = [
    (1, '<html><body><table id="toplist"><tr><td>RN</td><td>ASIN</td><td>Comment</td></tr>'
        '<tr><td>1</td><td> B000000001 </td><td>will&nbsp;do <b>next week</b></td></tr>'
        '<tr><td>2</td><td>B000000002</td><td></td></tr>'
        '<tr><td>3</td><td></td><td>orphan</td></tr></table></body></html>'),
    (2, '<table id="noslist"><tr><th>kasin</th><th>status</th><th>ETA</th></tr>'
        '<tr><td>B000000003</td><td>asked</td><td></td></tr><tr><td>B000000004</td><td></td><td></td></tr></table>'),
    (3, '<table id="toplist"></table>'),
    (4, '<p>no table here</p>'),
    (5, '<table id="dataTable"><tbody><tr><td>kw one</td><td>x</td><td>3</td><td>1,234</td></tr>'
        '<tr><td>Total: 2</td><td></td><td></td><td>9</td></tr></tbody></table>'),
]


def test_table_rows(spark):
    df = spark.createDataFrame(PAGES, "page_id long, html string")
    top = html_table_rows(df, "page_id", "html", table_id="toplist").collect()
    assert [(r.page_id, r.key, r.comment) for r in top] == [(1, "B000000001", "will do next week")]
    nos = html_table_rows(df, "page_id", "html", table_id="noslist", status_header="status").collect()
    assert [(r.key, r.status, r.comment) for r in nos] == [("B000000003", "asked", "")]


def test_keyword_rows(spark):
    df = spark.createDataFrame(PAGES, "page_id long, html string")
    rows = keyword_table_rows(df, "page_id", "html").collect()
    assert [(r.keyword, r.rank, r.query_groups) for r in rows] == [("kw one", "3", "1234")]


def test_parser_module_ships_with_tasks():
    # Executors need no installed copy of the package: the parser module is pickled by value.
    import shelfwise.sources.html as html_mod
    from pyspark import cloudpickle
    assert html_mod.__name__ in cloudpickle.cloudpickle._PICKLE_BY_VALUE_MODULES


def test_nested_table_keeps_the_outer_row():
    from shelfwise.sources.html import parse_tables

    page = ("<table id='o'><tr><td>asin</td><td>note</td></tr><tr><td>B1</td><td>see <table id='i'><tr><td>x</td></tr></table> end</td></tr>"
            "</table><table id='o'><tr><td>late</td></tr></table>")
    tables = parse_tables(page)
    assert [t for t, _ in tables] == ["o", "i", "o"]
    assert tables[0][1] == [["asin", "note"], ["B1", "see x end"]] and tables[1][1] == [["x"]]


def test_all_character_references_are_decoded_as_the_standard_library_does(spark):
    import html
    import random
    from html.entities import html5

    from shelfwise.sources.html import decode_references

    rnd = random.Random(6)
    texts = [f"a&{name}b &{name}; &{name.rstrip(';')}9;" for name in html5]
    texts += [f"&#{n}; &#x{n:x};&#X{n:X} &#0{n}" for n in [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE,
                                                            0x10FFFF, 0x110000, 9_999_999, 10**8, 10**30]]
    texts += ["", "no reference", "&", "&&", "&#", "&#;", "&#x;", "&#xg", "& amp;", "&amp;lt;", "&ampé;", "&notit;", "&notin;", "&" + "a" * 40 + ";",
              "&CounterClockwiseContourIntegral;", "&ampamp;", "x&", "&é;", "&copy&copy;&COPY", "\n&\t&lt\n", "&#65&#66;&#x43"]
    alphabet = ["&", "#", "x", ";", "amp", "lt", "not", "in", "1", "9f", "é", " ", "\n", "copy", "&#"]
    texts += ["".join(rnd.choices(alphabet, k=rnd.randint(1, 12))) for _ in range(3_000)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "k int, t string").repartition(4)
    got = {r.k: r.d for r in df.select("k", decode_references("t").alias("d")).collect()}
    assert got.pop(-1) is None
    assert [(t, got[k]) for k, t in enumerate(texts) if got[k] != html.unescape(t)] == []


def _by_the_standard_parser(page):
    from shelfwise.sources.html import _TableParser

    p = _TableParser()
    p.feed(page)
    p.close()
    return p.tables


def test_plain_markup_is_read_as_the_standard_parser_reads_it(monkeypatch):
    import random

    from shelfwise.sources import html

    rnd = random.Random(11)
    plain = ["<table>", '<table id="t&amp;1">', "<TABLE>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</TH>", "<b>", "</b>", "<br>", '<span ID="x" class="">',
             "text", " &amp; ", "&nbsp", "&", "&#65", "\xa0x\n", "> ", "\"", "'", "&notit;"]
    other = ["<!-- <td> -->", "<td/>", "<br />", "<script>", "</script>", "<", "<td", "<td id=x>", "<td id='q'>", '<td id="a>b">', "< td>", "<title>", "<tſ>", "<td\n>",
             '</td x="1">', "<tD>", "<?x>", "<!doctype html>"]
    pages = ["".join(rnd.choices(plain, k=rnd.randint(0, 30))) for _ in range(3_000)]
    mixed = ["".join(rnd.choices(plain + other, k=rnd.randint(0, 30))) for _ in range(3_000)]
    assert [p for p in pages + mixed if html.parse_tables(p) != _by_the_standard_parser(p)] == []
    assert html.parse_tables(None) == html.parse_tables("") == []
    # Pages of plain markup take the short way, all of them.
    want = [html.parse_tables(p) for p in pages]
    monkeypatch.setattr(html._TableParser, "feed", None)
    assert [html.parse_tables(p) for p in pages] == want


def test_rows_keep_the_ids_of_their_pages(spark):
    table = '<table id="t"><tr><td>asin</td><td>note</td></tr><tr><td>B1</td><td>x</td></tr><tr><td>B2</td><td>y</td></tr></table>'
    df = spark.createDataFrame([(2 ** 60 + 1, table), (None, table), (3, None)], "page long, html string").coalesce(1)
    got = html_table_rows(df, "page", "html", table_id="t").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(p, k, c, None, n) for p in (2 ** 60 + 1, None) for k, c, n in (("B1", "x", 2), ("B2", "y", 3))]))
