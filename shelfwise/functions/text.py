"""Text extraction and formatting rules.

All are built-in column expressions (JVM side, inside whole-stage codegen).
Regexes use classes that Java and RE2 read the same way, so the DuckDB oracle
can state the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must match the reference's rules).
# product code = 'B' followed by nine word characters. Python's str ``\w``
# is Unicode-aware; [\p{L}\p{N}_] is the same class in Java and RE2.
PRODUCT_CODE_RE = r"(B[\p{L}\p{N}_]{9})"
# publisher code = three word characters followed by CN, taken from upper-cased text.
PUBLISHER_CODE_RE = r"([\p{L}\p{N}_]{3}CN)"
# sender address (first match), and the user name = shortest word run before '@'.
EMAIL_RE = r"([a-zA-Z0-9_\-\.]+@[a-zA-Z0-9]+\.[a-zA-Z0-9]+)"
USER_RE = r"([\p{L}\p{N}_]+?)@"
# F16: list separators.
LIST_SPLIT_RE = r"[,;:]"
# statement from the first 'select' up to the first ';' or full-width '；'.
SQL_STATEMENT_RE = r"(?is)(select[^;；]*)"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def product_codes(text: str | Column) -> Column:
    """all product codes in the text (array, in order, repeats kept)."""
    return F.regexp_extract_all(_c(text), F.lit(PRODUCT_CODE_RE), 1)


def first_publisher_code(text: str | Column) -> Column:
    """first publisher code of the upper-cased text; '' when none."""
    return F.regexp_extract(F.upper(_c(text)), PUBLISHER_CODE_RE, 1)


def email_addresses(text: str | Column) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(EMAIL_RE), 1)


def sender_user(address: str | Column) -> Column:
    """user name as the reference takes it: the shortest word run ending at '@'."""
    return F.regexp_extract(_c(address), USER_RE, 1)


def display_name(from_header: str | Column) -> Column:
    """quoted display name, the part after a comma ("Doe, Jane" -> "Jane"); else the user."""
    quoted = F.regexp_extract(_c(from_header), r'"(.*?)"', 1)
    after_comma = F.when(F.instr(quoted, ",") > 0, F.substring_index(quoted, ",", -1)).otherwise(quoted)
    return F.when(after_comma != "", after_comma).otherwise(sender_user(from_header))


def split_list(*cols: str | Column) -> Column:
    """F16: split several delimited lists on ``[,;:]``, flatten, trim, drop blanks."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(_c(c), F.lit("")), LIST_SPLIT_RE) for c in cols]))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def strip_number_text(col: str | Column) -> Column:
    """``12345.0`` -> ``12345`` (integral part of a number written as text)."""
    c = _c(col)
    return F.when(c.rlike(r"^\d+\.\d*$"), F.regexp_extract(c, r"^(\d+)\.", 1)).otherwise(c)


def strip_thousands(col: str | Column) -> Column:
    """drop thousands separators and CR/LF."""
    return F.regexp_replace(_c(col), r"[,\r\n]", "")


def _strip_ws(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def multilines_in_html(col: str | Column) -> Column:
    """multi-line text -> stripped non-empty lines joined by ``<br>``;
    text without a line break is returned unchanged."""
    c = _c(col)
    lines = F.split(c, r"\r\n|\n")
    joined = F.array_join(F.filter(F.transform(lines, _strip_ws), lambda x: x != ""), "<br>")
    return F.when(F.size(lines) <= 1, c).otherwise(joined)


#: DuckDB twin of ``multilines_in_html``.
MULTILINE_SQL = ("CASE WHEN len(string_split_regex({c}, '\\r\\n|\\n')) <= 1 THEN {c} ELSE "
                 "array_to_string(list_filter(list_transform(string_split_regex({c}, '\\r\\n|\\n'), "
                 "lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), '<br>') END")


def between_parentheses(col: str | Column) -> Column:
    """second chunk of ``[^()]+`` with '/' removed (``Fiction (Novel/Short)`` ->
    ``NovelShort``); NULL when there is no second chunk."""
    chunks = F.regexp_extract_all(F.regexp_replace(_c(col), "/", ""), F.lit(r"([^()]+)"), 1)
    return F.try_element_at(chunks, F.lit(2))


def sql_statement(text: str | Column) -> Column:
    """the SELECT statement inside free text, trailing blanks trimmed; '' if none."""
    return F.trim(F.regexp_extract(_c(text), SQL_STATEMENT_RE, 1))


def key_summary(values: Column, limit: int = 250) -> Column:
    """comma-joined keys cut to ``limit`` characters for the audit row."""
    return F.left(F.array_join(values, ","), F.lit(limit))


def link(key: str | Column, title: str | Column, base: str = "https://catalog.example/item/") -> Column:
    """link text built from key and title."""
    return F.concat(F.lit(base), _c(key), F.lit("#"), _c(title))


def zero_padded(col: str | Column, width: int) -> Column:
    """A number's digits, filled up with zeros to ``width``; longer numbers keep all their digits."""
    digits = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))


def zero_padded_sql(expr: str, width: int) -> str:
    """DuckDB twin of ``zero_padded``."""
    return f"CASE WHEN length(CAST({expr} AS VARCHAR)) >= {width} THEN CAST({expr} AS VARCHAR) ELSE right(repeat('0', {width}) || CAST({expr} AS VARCHAR), {width}) END"
