"""HTML sources.

* ``html_to_text`` (S16) is a regex chain: scripts, styles and comments
  dropped, tags removed, all character references decoded in one pass, trimmed. It runs in the
  JVM and a SQL engine can state it identically.
* ``html_table_rows`` (S13/S14/S15) needs a real parser (nested markup, header
  cells choosing the key column). It is a ``mapInArrow`` over the HTML column
  using the standard library's ``html.parser``, or a shorter loop with the same result
  where a page is plain markup; Spark partitions the pages, each
  task parses its own batch, rows come back as a DataFrame.
"""

from __future__ import annotations

import json
import re
import sys
from html import unescape
from html.entities import html5
from html.parser import HTMLParser
from typing import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The batch parsers below run in Python workers. Shipping this module's code with
# the task (pickled by value) means executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: the package must be installed on executors
    pass

# Fixed values of the text chain.
_DROP_BLOCKS = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->"
_TAGS = r"<[^>]+>"
# List items holding one link: <li><a href="target">text</a></li>
LINK_ITEM_RE = r'<li><a href="([^"]*)">([^<]*)</a></li>'

# Character references. The names are the standard library's table; those without a semicolon are also
# read at the front of a longer run of letters. Text without an ampersand is one piece.
_PIECES = r"(?s)(&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]{0,31};?|[^&]+|&)"
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_BARE_RE = "^&(" + "|".join(_BARE) + ")"
#: Numbers that stand for other characters than their own: those of a Windows code page, and 0.
_REPLACED = {0: "\ufffd", 0x0D: "\r"} | {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
#: Numbers that stand for nothing (first and last of each range); the last two of every plane as well.
_NOTHING = ((0x1, 0x8), (0xB, 0xB), (0xE, 0x1F), (0x7F, 0x7F), (0xFDD0, 0xFDEF))
_MOST = 0x10FFFF


def decode_references(col: str | Column) -> Column:
    """Text with its character references decoded, as ``html.unescape`` does, in one pass."""
    c = F.col(col) if isinstance(col, str) else col
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    replaced = F.from_json(F.lit(json.dumps({str(n): t for n, t in _REPLACED.items()})), "map<string,string>")

    def character(piece: Column) -> Column:
        hexadecimal = F.lower(F.substring(piece, 3, 1)) == "x"
        digits = F.when(hexadecimal, F.regexp_extract(piece, "^&#[xX]0*([0-9a-fA-F]*)", 1)).otherwise(F.regexp_extract(piece, "^&#0*([0-9]*)", 1))
        # Seven digits hold every code point in either base; more are out of range.
        short = F.when(F.length(digits) <= 7, F.when(digits == "", F.lit("0")).otherwise(digits))
        number = F.when(hexadecimal, F.conv(short, 16, 10)).otherwise(short).cast("int")
        nothing = (number % 0x10000).isin(0xFFFE, 0xFFFF)
        for first, last in _NOTHING:
            nothing = nothing | number.between(first, last)
        own = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return (F.when(number.isNull() | (number > _MOST) | number.between(0xD800, 0xDFFF), F.lit("\ufffd"))
                .otherwise(F.coalesce(F.try_element_at(replaced, number.cast("string")), F.when(nothing, F.lit("")).otherwise(own))))

    def decoded(piece: Column) -> Column:
        bare = F.regexp_extract(piece, _BARE_RE, 1)
        named = F.coalesce(F.try_element_at(names, F.substr(piece, F.lit(2))),
                           F.when(bare != "", F.concat(F.try_element_at(names, bare), F.substr(piece, F.length(bare) + 2))), piece)
        return F.when(~piece.startswith("&"), piece).when(piece.startswith("&#"), F.when(F.length(piece) > 2, character(piece)).otherwise(piece)).otherwise(named)

    pieces = F.regexp_extract_all(c, F.lit(_PIECES), 1)
    return F.when(c.contains("&"), F.array_join(F.transform(pieces, decoded), "")).otherwise(c)


def html_to_text(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = F.regexp_replace(F.regexp_replace(c, _DROP_BLOCKS, ""), _TAGS, "")
    out = F.replace(decode_references(out), F.lit("\u00a0"), F.lit(" "))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _references_sql(expr: str) -> str:
    """DuckDB twin of ``decode_references``."""
    names = f"MAP([{', '.join(map(_quoted, html5))}], [{', '.join(map(_quoted, html5.values()))}])"
    replaced = "MAP([{}], [{}])".format(", ".join(map(str, _REPLACED)), ", ".join(f"chr({ord(t)})" for t in _REPLACED.values()))
    number = ("TRY_CAST(CASE WHEN lower(substr(p, 3, 1)) = 'x' THEN '0x' || right('0' || regexp_extract(p, '^&#[xX]0*([0-9a-fA-F]*)', 1), 8) "
              "ELSE '0' || regexp_extract(p, '^&#0*([0-9]*)', 1) END AS BIGINT)")
    nothing = " OR ".join([*(f"n BETWEEN {a} AND {b}" for a, b in _NOTHING), "n % 65536 IN (65534, 65535)"])
    character = (f"(SELECT CASE WHEN n IS NULL OR n > {_MOST} OR n BETWEEN 55296 AND 57343 THEN chr(65533) WHEN map_contains(numbers, n) THEN numbers[n] "
                 f"WHEN {nothing} THEN '' ELSE chr(n::INT) END FROM (SELECT {number} AS n))")
    bare = f"regexp_extract(p, '{_BARE_RE}', 1)"
    decoded = (f"CASE WHEN p[1] <> '&' THEN p WHEN p[2] = '#' THEN CASE WHEN length(p) > 2 THEN {character} ELSE p END "
               f"WHEN map_contains(names, p[2:]) THEN names[p[2:]] WHEN {bare} <> '' THEN names[{bare}] || substr(p, length({bare}) + 2) ELSE p END")
    return (f"(SELECT coalesce(string_agg({decoded}, '' ORDER BY pos), '') FROM (SELECT unnest(pieces) AS p, generate_subscripts(pieces, 1) AS pos, {names} AS names, {replaced} AS numbers "
            f"FROM (SELECT regexp_extract_all({expr}, '{_PIECES}', 1) AS pieces)))")


def _html_text_sql() -> str:
    expr = "regexp_replace(regexp_replace({c}, '" + _DROP_BLOCKS + "', '', 'g'), '" + _TAGS + "', '', 'g')"
    # The only braces that str.format is to see are those of the column, which stands for a mark that no name holds.
    expr = _references_sql("\x00").replace("{", "{{").replace("}", "}}").replace("\x00", expr)
    return f"regexp_replace(replace({expr}, chr(160), ' '), '^\\s+|\\s+$', '', 'g')"


HTML_TEXT_SQL = _html_text_sql()


# Plain markup: tags of these names, attributes in double quotes, nothing else that begins with "<". None of the names
# changes how the text behind it is read (as script, style, title or textarea do).
_PLAIN_NAMES = ("table thead tbody tfoot tr td th html body head p div span br hr b i u em strong font center ul ol li "
                "h1 h2 h3 h4 h5 h6").split()
#: What stands between "<" and ">" in a tag without attributes -> (end tag?, name of a tag that tables are made of, else None).
_PLAIN_TAGS = {slash + written: (bool(slash), name if name in ("table", "tr", "td", "th") else None)
               for name in _PLAIN_NAMES for written in (name, name.upper()) for slash in ("", "/")}
_PLAIN_ATTRIBUTE = re.compile(r' ([a-z][a-z0-9-]*)="([^"<>]*)"', re.ASCII | re.IGNORECASE)
_PLAIN_START = re.compile(r'([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="[^"<>]*")+)', re.ASCII | re.IGNORECASE)


class _TableParser(HTMLParser):
    """Collects the cell texts of every table, in the order in which the tables open.

    Each open table keeps its own row and cell, so a table nested in a cell has rows of its own and its text
    also belongs to that cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[tuple[str | None, list[list[str]]]] = []
        self._open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            rows: list[list[str]] = []
            self.tables.append((dict(attrs).get("id"), rows))
            self._open.append({"rows": rows, "row": None, "cell": None})
        elif not self._open:
            return
        elif tag == "tr":
            self._open[-1]["row"] = []
        elif tag in ("td", "th") and self._open[-1]["row"] is not None:
            self._open[-1]["cell"] = []

    def handle_endtag(self, tag):
        if not self._open:
            return
        state = self._open[-1]
        if tag in ("td", "th") and state["cell"] is not None and state["row"] is not None:
            state["row"].append("".join(state["cell"]).replace("\xa0", " ").strip())
            state["cell"] = None
        elif tag == "tr" and state["row"] is not None:
            state["rows"].append(state["row"])
            state["row"] = None
        elif tag == "table":
            self._open.pop()

    def handle_data(self, data):
        for state in self._open:
            if state["cell"] is not None:
                state["cell"].append(data)


    def read_plain(self, html: str) -> bool:
        """Reads a whole page of plain markup: calls the handlers that matter as ``feed`` and ``close`` would, in a fraction of the
        time. False where the page holds any other markup; this parser is then spent."""
        pieces = iter(html.split("<"))
        next(pieces)  # what stands before the first tag is in no table
        for piece in pieces:
            written, closed, text = piece.partition(">")
            if not closed:
                return False
            tag, attributes = _PLAIN_TAGS.get(written), ""
            if tag is None:
                start = _PLAIN_START.fullmatch(written)
                tag = start and _PLAIN_TAGS.get(start[1].lower())
                if not tag:
                    return False
                attributes = start[2]
            ends, name = tag
            if name is None:
                pass
            elif ends:
                self.handle_endtag(name)
            else:
                self.handle_starttag(name, [(k.lower(), unescape(v)) for k, v in _PLAIN_ATTRIBUTE.findall(attributes)] if attributes else [])
            if text and self._open:
                self.handle_data(unescape(text))
        return True


def parse_tables(html: str) -> list[tuple[str | None, list[list[str]]]]:
    p = _TableParser()
    if not p.read_plain(html or ""):
        p = _TableParser()
        p.feed(html or "")
        p.close()
    return p.tables


def _rows_for(html: str, table_id: str | None, key_headers: tuple[str, ...],
              status_header: str | None) -> list[tuple[str, str, str | None, int]]:
    """(key, last cell, status, row number) for rows of the chosen table.

    The header row picks the key column (and optional status column) by name;
    the last cell is the comment / ETA. Rows are kept when the key is non-empty
    and the comment (or the status) is non-empty. State is reset per row.
    """
    return _rows_of(parse_tables(html), table_id, key_headers, status_header)


def _rows_of(tables: list[tuple[str | None, list[list[str]]]], table_id: str | None, key_headers: tuple[str, ...],
             status_header: str | None) -> list[tuple[str, str, str | None, int]]:
    out = []
    for tid, rows in tables:
        if table_id is not None and tid != table_id:
            continue
        if not rows:
            break
        header = [h.lower() for h in rows[0]]
        key_idx = next((i for i, h in enumerate(header) if h in key_headers), None)
        status_idx = header.index(status_header) if status_header and status_header in header else None
        if key_idx is None:
            break
        for n, row in enumerate(rows[1:], start=2):
            if not row:
                continue
            key = row[key_idx] if key_idx < len(row) else ""
            last = row[-1]
            status = row[status_idx] if status_idx is not None and status_idx < len(row) else None
            keep = bool(key) and (bool(last) or bool(status))
            if keep:
                out.append((key, last, status, n))
        break  # the first table, or the first one with the id
    return out


def html_table_rows(df: DataFrame, id_col: str, html_col: str, table_id: str | None = None,
                    key_headers: tuple[str, ...] = ("asin", "kasin"), status_header: str | None = None) -> DataFrame:
    """S13/S14 as a distributed operator: one output row per kept table row."""
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, key string, comment string, status string, row_no int"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The cells are lists by column; a page's id is taken from the batch once for each of its rows.
            page, keys, comments, statuses, numbers = [], [], [], [], []
            for at, html in enumerate(batch.column(1).to_pylist()):
                for key, last, status, n in _rows_for(html, table_id, key_headers, status_header):
                    page.append(at)
                    keys.append(key)
                    comments.append(last)
                    statuses.append(status)
                    numbers.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(page, pa.int64())), pa.array(keys, pa.string()), pa.array(comments, pa.string()),
                                              pa.array(statuses, pa.string()), pa.array(numbers, pa.int32())],
                                             [id_col, "key", "comment", "status", "row_no"])

    return df.select(id_col, html_col).mapInArrow(parse, schema)


def captured_tables(df: DataFrame, id_col: str, html_col: str, kinds: dict[str, tuple[str, tuple[str, ...], str | None]]) -> DataFrame:
    """The filled-in rows of all comment tables of a message, which is parsed once: (id, kind, key, comment, row_no).

    ``kinds``: table id -> (kind, header names of the key column, header name of a status column or None). A table with a
    status column gives two kinds of rows: its own with the status, and ``<kind>_eta`` with the last cell where that is filled in.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    columns = [id_col, "kind", "key", "comment", "row_no"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            recs = []
            for rid, html in zip(pdf[id_col], pdf[html_col]):
                tables = parse_tables(html)
                for table_id, (kind, key_headers, status_header) in kinds.items():
                    for key, last, status, n in _rows_of(tables, table_id, key_headers, status_header):
                        if status_header is None:
                            recs.append((rid, kind, key, last, n))
                            continue
                        recs.append((rid, kind, key, status or "", n))
                        if last:
                            recs.append((rid, kind + "_eta", key, last, n))
            yield pd.DataFrame(recs, columns=columns)

    return df.select(id_col, html_col).mapInPandas(parse, f"{id_col} {id_type}, kind string, key string, comment string, row_no int")


def keyword_table_rows(df: DataFrame, id_col: str, html_col: str, table_id: str = "dataTable") -> DataFrame:
    """Positional cells 1, 3, 4 of the table -> keyword, rank, groups;
    'Total:' rows dropped, thousands separators and line breaks stripped."""
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, keyword string, rank string, query_groups string"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            recs = []
            for rid, html in zip(pdf[id_col], pdf[html_col]):
                for tid, rows in parse_tables(html):
                    if tid != table_id:
                        continue
                    for row in rows:
                        cells = row + [""] * (4 - len(row))
                        kw = cells[0].replace("\r", "").replace("\n", "")
                        if "Total:" in kw or not any(row):
                            continue
                        recs.append((rid, kw, cells[2], cells[3].replace(",", "")))
            yield pd.DataFrame(recs, columns=[id_col, "keyword", "rank", "query_groups"])

    return df.select(id_col, html_col).mapInPandas(parse, schema)


def escape_html(col: Column) -> Column:
    """Text -> HTML cell text (&, <, > and quotes escaped)."""
    out = F.replace(col, F.lit("&"), F.lit("&amp;"))
    for ch, ent in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(ch), F.lit(ent))
    return out
