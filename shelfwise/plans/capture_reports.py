"""R31 comment capture: publishers answer the top list by filling the last column of
the table they received; the answers are read back into rows.

The "returned tables" are built by Spark from the data: the top list of each
publisher (<= 10 rows, so one small HTML string per publisher group) with the
latest reply of the product's conversation in the comment cell. They are parsed
by the distributed HTML table reader (S13), checked against the recipient
lists (J25), tied to their publisher through the product dimension (J27), and
merged idempotently by (product, message) into the comment log (M6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import zero_padded
from shelfwise.operators.merge import replace_by_key_once
from shelfwise.operators.topn import latest_per_key
from shelfwise.plans.access_reports import allowed_senders
from shelfwise.plans.registry import report
from shelfwise.plans.top_reports import (
    TOP_AUTHORS_SQL, TOP_CATEGORIES_SQL, TOP_PRODUCTS_SQL, top_authors_best_product, top_categories_best_product, top_products_to_80pct,
)
from shelfwise.plans.views import PRODUCT_CODE_SQL, products
from shelfwise.sources.html import captured_tables, escape_html, html_table_rows
from shelfwise.sources.tables import Tables

HEADER_ROW = "<tr><td>RN</td><td>ASIN</td><td>Title</td><td>Comment</td></tr>"


def _sender(publisher) -> F.Column:
    return F.concat(F.lower(F.regexp_replace(publisher, "[^A-Za-z0-9]", "")), F.lit("@example.com"))


def returned_toplists(t: Tables) -> DataFrame:
    """(msgid, sender, html): one reply message per publisher group of the top list."""
    top = top_products_to_80pct(t)
    last = latest_per_key(t.conversations.filter(F.col("role") == "assistant").select("conv_id", "turn", "text"),
                          ["conv_id"], ["turn"])
    prods = products(t).select("product", "p_partkey")
    rows = (top.join(prods, "product")
            .join(last, F.col("p_partkey") == F.col("conv_id"), "left")
            .select("publisher", "category", "rn",
                    F.concat(F.lit("<tr><td>"), F.col("rn").cast("string"), F.lit("</td><td>"), F.col("product"),
                             F.lit("</td><td>"), escape_html(F.col("title")), F.lit("</td><td>"),
                             escape_html(F.coalesce(F.col("text"), F.lit(""))), F.lit("</td></tr>")).alias("tr")))
    # <= 10 rows per group (the top list's own limit): a bounded list per message.
    return (rows.groupBy("publisher", "category")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "tr"))), lambda x: x["tr"]),
                              "").alias("body"))
            .select(F.concat_ws("/", "publisher", "category").alias("msgid"), _sender(F.col("publisher")).alias("sender"),
                    "publisher",
                    F.concat(F.lit('<html><body><p>Our comments:</p><table id="toplist">'), F.lit(HEADER_ROW),
                             F.col("body"), F.lit("</table></body></html>")).alias("html")))


def comment_capture_rows(t: Tables) -> DataFrame:
    msgs = returned_toplists(t)
    lists = (products(t).select("publisher").distinct()
             .select("publisher", _sender(F.col("publisher")).alias("to_list"), F.lit("ops@example.com; ").alias("cc")))
    allowed = allowed_senders(msgs, "sender", lists, "publisher", ("to_list", "cc"), "publisher")
    rows = html_table_rows(allowed.select("msgid", "html"), "msgid", "html", table_id="toplist")
    # The publisher of each captured row comes from its product, not from the table's first row.
    dim = products(t).select(F.col("product").alias("key"), F.col("publisher").alias("pub"))
    return rows.join(dim, "key", "inner").select("msgid", F.col("key").alias("product"), "pub",
                                                 F.col("comment").alias("comments"), "row_no")


COMMENT_CAPTURE_SQL = f"""
WITH top AS ({TOP_PRODUCTS_SQL}),
last AS (SELECT conv_id, text FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) r
         FROM conversations WHERE role = 'assistant') WHERE r = 1),
rows AS (SELECT t.publisher || '/' || t.category AS msgid, t.product, t.publisher AS pub,
                regexp_replace(COALESCE(l.text, ''), '^\\s+|\\s+$', '', 'g') AS comments,
                CAST(t.rn + 1 AS INTEGER) AS row_no
         FROM top t JOIN part p ON 'B' || (CASE WHEN length(CAST(p.p_partkey AS VARCHAR)) >= 9 THEN CAST(p.p_partkey AS VARCHAR) ELSE right(repeat('0', 9) || CAST(p.p_partkey AS VARCHAR), 9) END) = t.product
         LEFT JOIN last l ON l.conv_id = p.p_partkey)
SELECT * FROM rows WHERE comments <> ''
"""


@report("comment_capture", covers=("R31", "S13", "J27", "F16"), oracle=COMMENT_CAPTURE_SQL, tag="COMMENTS")
def comment_capture(t: Tables):
    """Comments captured from the returned top-list tables (key and non-empty last cell)."""
    return comment_capture_rows(t)


def merge_comments(log: DataFrame, captured: DataFrame) -> DataFrame:
    """M6: idempotent per-message replace -- rows of the same (product, msgid) are replaced."""
    return replace_by_key_once(log, captured, ["product", "msgid"])


# ------------------------------------------------------------------ R31: status and ETA tables
STATUS_HEADER = "<tr><td>ASIN</td><td>Status</td><td>Title</td><td>ETA</td></tr>"


#: Products of a message at most: those whose numbers have the same hundreds.
MESSAGE_PRODUCTS = 100


def _message_id(publisher, part, day, line_status) -> F.Column:
    return F.concat_ws("/", publisher, F.expr(f"{part} DIV {MESSAGE_PRODUCTS}").cast("string"), F.date_format(day, "yyyyMM"), line_status)


def _status_messages(t: Tables) -> DataFrame:
    """(msgid, publisher, sender, html): one status table per publisher, hundred of product numbers and month, with a row for each product and
    day of a return. Tables of status F come from an address that is not on the publisher's list; some cells are empty."""
    lines = (t.lineitem.filter(F.col("l_returnflag") == "R")
             .groupBy("l_partkey", F.to_date("l_shipdate").alias("day"), "l_linestatus")
             .agg(F.max("l_linenumber").alias("line"), F.max("l_tax").alias("tax")))
    status = F.when(F.col("line") > 2, F.concat(F.lit("line "), F.col("line").cast("string"))).otherwise("")
    eta = F.when(F.col("tax") > 0.02, F.date_format("day", "yyyy-MM-dd")).otherwise("")
    row = F.concat(F.lit("<tr><td>"), F.col("product"), F.lit("</td><td>"), status, F.lit("</td><td>"),
                   escape_html(F.col("title")), F.lit("</td><td>"), eta, F.lit("</td></tr>"))
    sender = F.when(F.col("l_linestatus") == "F", F.lit("someone@elsewhere.example")).otherwise(F.upper(_sender(F.col("publisher"))))
    rows = (lines.join(products(t), F.col("l_partkey") == F.col("p_partkey"))
            .select(_message_id(F.col("publisher"), "p_partkey", F.col("day"), F.col("l_linestatus")).alias("msgid"), "publisher",
                    sender.alias("sender"), "product", "day", row.alias("tr")))
    # A message holds a hundred products and a month at most: a bounded list.
    return (rows.groupBy("msgid", "publisher", "sender")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("product", "day", "tr"))), lambda x: x["tr"]), "").alias("body"))
            .select("msgid", "publisher", "sender",
                    F.concat(F.lit('<p>Status:</p><table id="status">'), F.lit(STATUS_HEADER), F.col("body"), F.lit("</table>")).alias("html")))


@report("status_capture", covers=("R31", "S14", "J25", "M6"), tag="STATUS", oracle=f"""
WITH l AS (SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, l_linestatus, max(l_linenumber) AS line, max(l_tax) AS tax
           FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3),
c AS (SELECT {PRODUCT_CODE_SQL.format(k='p_partkey')} AS product,
             p_brand || '/' || (p_partkey // {MESSAGE_PRODUCTS}) || '/' || strftime(day, '%Y%m') || '/' || l_linestatus AS msgid, l_linestatus,
             CASE WHEN line > 2 THEN 'line ' || line ELSE '' END AS status,
             CASE WHEN tax > 0.02 THEN CAST(day AS VARCHAR) ELSE '' END AS eta
      FROM l JOIN part ON p_partkey = l_partkey WHERE l_linestatus <> 'F'),
got AS (SELECT product, msgid, status, eta FROM c WHERE status <> '' OR eta <> ''),
log AS (SELECT DISTINCT {PRODUCT_CODE_SQL.format(k='p_partkey')} AS product,
               p_brand || '/' || (p_partkey // {MESSAGE_PRODUCTS}) || '/' || strftime(l_shipdate, '%Y%m') || '/O' AS msgid
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'N')
SELECT product, msgid, status, eta FROM got
UNION ALL SELECT product, msgid, 'open', '' FROM log WHERE (product, msgid) NOT IN (SELECT product, msgid FROM got)""")
def status_capture(t: Tables):
    """Status and ETA cells of the tables that allowed senders returned, merged into the log by (product, message):
    captured rows replace what the log held for them, other log rows stay, other senders' tables are not read."""
    msgs = _status_messages(t)
    lists = (t.part.select(F.col("p_brand").alias("publisher")).distinct()
             .select("publisher", _sender(F.col("publisher")).alias("to_list"), F.lit("ops@example.com; ").alias("cc")))
    allowed = allowed_senders(msgs, "sender", lists, "publisher", ("to_list", "cc"), "publisher")
    rows = html_table_rows(allowed.select("msgid", "html"), "msgid", "html", table_id="status", status_header="status")
    captured = rows.select(F.col("key").alias("product"), "msgid", "status", F.col("comment").alias("eta"))
    days = t.lineitem.filter(F.col("l_returnflag") != "N").select("l_partkey", F.trunc("l_shipdate", "month").alias("day")).distinct()
    log = (days.join(products(t), F.col("l_partkey") == F.col("p_partkey"))
           .select("product", _message_id(F.col("publisher"), "p_partkey", F.col("day"), F.lit("O")).alias("msgid"),
                   F.lit("open").alias("status"), F.lit("").alias("eta")))
    return merge_comments(log, captured)


# ------------------------------------------------------------------ R31: all comment tables of a message
#: Table id of a returned message -> kind in the log, header of the key column, header of the status column.
COMMENT_TABLES = {
    "toplist": ("toplist", ("asin",), None),
    "noslist": ("noslist", ("kasin", "asin"), "status"),
    "catelist": ("catelist", ("kasin",), None),
    "topauthor": ("topauthor", ("kasin",), None),
}


def _filled(table_id: str, header: str, rows) -> F.Column:
    return F.concat(F.lit(f'<table id="{table_id}"><tr>' + "".join(f"<th>{h}</th>" for h in header.split("|")) + "</tr>"), rows, F.lit("</table>"))


def _cells(*cells) -> F.Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))


def vendor_messages(t: Tables) -> DataFrame:
    """(msgid, publisher, sender, html): one message per publisher with its category table and its author table filled in, and a
    status table of their products; a publisher with an odd number writes from an address that is not on its list."""
    comment = latest_per_key(t.conversations.filter(F.col("role") == "user").select("conv_id", "turn", "text"), ["conv_id"], ["turn"])
    said = products(t).select("product", "p_partkey").join(comment, F.col("p_partkey") == F.col("conv_id"), "left").select(
        "product", F.coalesce(F.trim(F.translate(F.col("text"), "\r\n\t", "   ")), F.lit("")).alias("said"))
    parts = []
    for kind, frame, group in (("catelist", top_categories_best_product(t), "category"), ("topauthor", top_authors_best_product(t), "author")):
        # A publisher's table is as short as its list (ten rows at most).
        row = _cells(escape_html(F.col(group)), F.col("product"), escape_html(F.col("said")))
        parts.append(frame.select("publisher", group, "product").join(said, "product").select(
            "publisher", F.lit(kind).alias("kind"), F.col(group).alias("name"), "product", row.alias("tr"),
            _cells(F.col("product"), F.when(F.length("said") > 40, F.lit("long")).otherwise(""), F.lit("x"),
                   F.when(F.length("said") % 2 == 1, F.lit("2024-01-01")).otherwise("")).alias("status_tr")))
    rows = parts[0].unionByName(parts[1])

    def listed(kind: str, column: str) -> F.Column:
        items = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "product", F.col(column).alias("tr")))))
        return F.array_join(F.transform(items, lambda x: x["tr"]), "")

    html = F.concat(F.lit("<html><body>"), _filled("catelist", "Category|KASIN|Comment", listed("catelist", "tr")),
                    _filled("noslist", "KASIN|Status|Title|ETA", listed("catelist", "status_tr")),
                    _filled("topauthor", "Author|KASIN|Comment", listed("topauthor", "tr")), F.lit("</body></html>"))
    foreign = F.regexp_extract("publisher", r"([0-9]+)$", 1).try_cast("int") % 2 == 1
    return (rows.groupBy("publisher").agg(html.alias("html"))
            .select(F.col("publisher").alias("msgid"), "publisher",
                    F.when(foreign, F.lit("someone@elsewhere.example")).otherwise(_sender(F.col("publisher"))).alias("sender"), "html"))


VENDOR_TABLES_SQL = f"""
WITH cate AS ({TOP_CATEGORIES_SQL}), author AS ({TOP_AUTHORS_SQL}),
last AS (SELECT conv_id, text FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) r
         FROM conversations WHERE role = 'user') WHERE r = 1),
said AS (SELECT {PRODUCT_CODE_SQL.format(k='p_partkey')} AS product,
                coalesce(trim(translate(text, chr(13) || chr(10) || chr(9), '   ')), '') AS said
         FROM part LEFT JOIN last ON conv_id = p_partkey),
allowed AS (SELECT DISTINCT p_brand AS publisher FROM part WHERE TRY_CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) % 2 IS DISTINCT FROM 1),
rows AS (
  SELECT c.publisher AS msgid, 'catelist' AS kind, c.product, s.said AS comments FROM cate c JOIN said s USING (product) WHERE s.said <> ''
  UNION ALL SELECT a.publisher, 'topauthor', a.product, s.said FROM author a JOIN said s USING (product) WHERE s.said <> ''
  UNION ALL SELECT c.publisher, 'noslist', c.product, CASE WHEN length(s.said) > 40 THEN 'long' ELSE '' END
  FROM cate c JOIN said s USING (product) WHERE length(s.said) > 40 OR length(s.said) % 2 = 1
  UNION ALL SELECT c.publisher, 'noslist_eta', c.product, '2024-01-01' FROM cate c JOIN said s USING (product) WHERE length(s.said) % 2 = 1),
captured AS (SELECT DISTINCT r.* FROM rows r JOIN allowed a ON a.publisher = r.msgid),
log AS (SELECT publisher AS msgid, 'catelist' AS kind, product, 'earlier' AS comments FROM cate
        UNION ALL SELECT 'other', 'catelist', product, 'earlier' FROM cate)
SELECT * FROM captured
UNION ALL SELECT DISTINCT l.* FROM log l WHERE NOT EXISTS (
  SELECT 1 FROM captured c WHERE c.msgid = l.msgid AND c.kind = l.kind AND c.product = l.product)
"""


@report("vendor_tables_capture", covers=("R31", "S13", "S14", "J25", "M6"), tag="VENDORTABLES", oracle=VENDOR_TABLES_SQL)
def vendor_tables_capture(t: Tables):
    """Category, author and status tables that allowed senders returned, each message parsed once, merged into the comment log by
    (product, message, kind): what the log held for them is replaced, other rows stay."""
    msgs = vendor_messages(t)
    lists = (t.part.select(F.col("p_brand").alias("publisher")).distinct()
             .select("publisher", _sender(F.col("publisher")).alias("to_list"), F.lit("ops@example.com; ").alias("cc")))
    allowed = allowed_senders(msgs, "sender", lists, "publisher", ("to_list", "cc"), "publisher")
    captured = (captured_tables(allowed.select("msgid", "html"), "msgid", "html", COMMENT_TABLES)
                .select("msgid", "kind", F.col("key").alias("product"), F.col("comment").alias("comments")).distinct())
    listed = top_categories_best_product(t).select("publisher", "product")
    log = (listed.select(F.col("publisher").alias("msgid"), "product").unionByName(listed.select(F.lit("other").alias("msgid"), "product"))
           .select("msgid", F.lit("catelist").alias("kind"), "product", F.lit("earlier").alias("comments")).distinct())
    return replace_by_key_once(log, captured, ["product", "msgid", "kind"])


# ------------------------------------------------------------------ R32
def keyword_messages(t: Tables) -> DataFrame:
    """(msgid, html): one search-keyword report per day, as a positional ``dataTable``
    (keyword, -, rank, groups with thousands separators) ending in a 'Total:' row."""
    from shelfwise.functions.numeric import money_sum, thousands

    ev = t.events.select(F.col("ts").cast("date").alias("day"), "event_type", "value")
    per = (ev.groupBy("day", "event_type")
           .agg(F.count(F.lit(1)).alias("n"), money_sum("value").alias("v")))
    tr = F.concat(F.lit("<tr><td>"), F.col("event_type"), F.lit("</td><td>-</td><td>"), F.col("n").cast("string"),
                  F.lit("</td><td>"), thousands("v"), F.lit("</td></tr>"))
    # At most one row per event type and day: a bounded list per message.
    return (per.groupBy("day")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", tr.alias("tr")))),
                                          lambda x: x["tr"]), "").alias("rows"),
                 F.sum("n").alias("total"))
            .select(F.date_format("day", "yyyyMMdd").cast("bigint").alias("msgid"),
                    F.concat(F.lit('<table id="dataTable"><tbody>'), F.col("rows"),
                             F.lit("<tr><td>Total: "), F.col("total").cast("string"),
                             F.lit("</td><td></td><td></td><td></td></tr></tbody></table>")).alias("html")))


KEYWORD_CAPTURE_SQL = """
SELECT CAST(strftime(CAST(ts AS DATE), '%Y%m%d') AS BIGINT) AS msgid, event_type AS keyword,
       CAST(COUNT(*) AS VARCHAR) AS rank,
       CAST(CAST(ROUND(SUM(CAST(value AS DECIMAL(18,2))), 0) AS BIGINT) AS VARCHAR) AS query_groups
FROM events GROUP BY 1, event_type
"""


KEYWORD_LOG_SQL = f"""
WITH captured AS ({KEYWORD_CAPTURE_SQL}),
log AS (SELECT CAST(strftime(CAST(ts AS DATE) + CAST(event_id % 2 AS INTEGER) * INTERVAL 4000 DAY, '%Y%m%d') AS BIGINT) AS msgid,
               'earlier ' || event_type AS keyword, '1' AS rank, '2' AS query_groups FROM events GROUP BY 1, 2)
SELECT * FROM captured UNION ALL SELECT * FROM log WHERE msgid NOT IN (SELECT msgid FROM captured)
"""


@report("keyword_log", covers=("R32", "M6", "S15"), oracle=KEYWORD_LOG_SQL, tag="KEYWORDLOG")
def keyword_log(t: Tables):
    """Keyword tables merged by message: all that the log held of a message goes when it is delivered again, other messages' rows stay."""
    from shelfwise.sources.html import keyword_table_rows

    captured = keyword_table_rows(keyword_messages(t), "msgid", "html")
    day = F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 2).cast("int") * 4000)
    log = (t.events.select(F.date_format(day, "yyyyMMdd").cast("bigint").alias("msgid"), F.concat(F.lit("earlier "), "event_type").alias("keyword"))
           .distinct().select("msgid", "keyword", F.lit("1").alias("rank"), F.lit("2").alias("query_groups")))
    return replace_by_key_once(log, captured, ["msgid"])


@report("keyword_capture", covers=("R32", "S15", "F19"), oracle=KEYWORD_CAPTURE_SQL, tag="KEYWORDS")
def keyword_capture(t: Tables):
    """Daily keyword tables read back positionally: 'Total:' rows dropped, separators stripped."""
    from shelfwise.sources.html import keyword_table_rows
    return keyword_table_rows(keyword_messages(t), "msgid", "html")


# ------------------------------------------------------------------ R33
CHECKLIST_MSGID = 7


def _checklist_rows(li: DataFrame, status_default: str | None) -> DataFrame:
    """Checklist-shaped rows from return lines (display-case headers, as a sheet has)."""
    status = F.when(F.col("l_quantity") < 10, F.lit("N")).otherwise(F.lit(status_default or ""))
    return li.select(
        F.concat(F.lit("B"), zero_padded("l_partkey", 9)).alias("ASIN"),
        F.when(F.col("l_discount") == 0, F.lit("XYZ")).when(F.col("l_linestatus") == "F", F.lit("PTS"))
        .otherwise(F.lit("ABC")).alias("Src"),
        F.date_format("l_shipdate", "yyyy-M-d").alias("SS_Day"),
        F.when(F.col("l_discount") >= 0.05, F.lit("title")).otherwise(F.lit("")).alias("Issue_Title_Name"),
        F.when(F.col("l_tax") >= 0.05, F.lit("pd")).otherwise(F.lit("")).alias("Issue_PD"),
        F.lit("").alias("Issue_Cover"),
        F.when(F.col("l_quantity") > 40, F.lit("author")).otherwise(F.lit("")).alias("Issue_Author"),
        status.alias("Fix_Status"))


def _since(d: str):
    return F.col("l_shipdate") >= F.lit(d).cast("timestamp")


@report("checklist_capture", covers=("R33", "S9", "T11", "M7"), tag="CHECKLIST", oracle=f"""
WITH rows AS (
  SELECT 'B' || (CASE WHEN length(CAST(l_partkey AS VARCHAR)) >= 9 THEN CAST(l_partkey AS VARCHAR) ELSE right(repeat('0', 9) || CAST(l_partkey AS VARCHAR), 9) END) AS asin,
         CASE WHEN l_discount = 0 THEN 'XYZ' WHEN l_linestatus = 'F' THEN 'PTS' ELSE 'ABC' END AS src,
         strftime(l_shipdate, '%Y-%-m-%-d') AS ss_day,
         CASE WHEN l_discount >= 0.05 THEN 'title' ELSE '' END AS issue_title_name,
         CASE WHEN l_tax >= 0.05 THEN 'pd' ELSE '' END AS issue_pd, '' AS issue_cover,
         CASE WHEN l_quantity > 40 THEN 'author' ELSE '' END AS issue_author,
         CASE WHEN l_quantity < 10 THEN 'N' ELSE '' END AS fix_status, l_shipdate
  FROM lineitem WHERE l_returnflag = 'R'),
cur AS (SELECT asin, src, ss_day, issue_title_name, issue_pd, issue_cover, issue_author,
               CASE WHEN fix_status = '' THEN 'Y' ELSE fix_status END AS fix_status, CAST(1 AS BIGINT) AS msgid
        FROM rows WHERE l_shipdate >= DATE '2000-07-01' AND l_shipdate < DATE '2001-07-01'),
stg AS (SELECT asin, src, ss_day, issue_title_name, issue_pd, issue_cover, issue_author,
               CASE WHEN fix_status = '' THEN 'Y' ELSE fix_status END AS fix_status, CAST({CHECKLIST_MSGID} AS BIGINT) AS msgid
        FROM rows
        WHERE l_shipdate >= DATE '2001-01-01' AND asin <> ''
          AND (fix_status <> '' OR issue_title_name <> '' OR issue_pd <> '' OR issue_cover <> '' OR issue_author <> '')
          AND regexp_matches(asin, 'B\\w{{9}}') AND src IN ('PTS', 'ABC', 'DOTD')
          AND regexp_matches(ss_day, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}')),
changed AS (SELECT s.* FROM stg s WHERE NOT EXISTS (
   SELECT 1 FROM cur c WHERE c.asin = s.asin AND c.issue_title_name = s.issue_title_name
     AND c.issue_pd = s.issue_pd AND c.issue_cover = s.issue_cover AND c.issue_author = s.issue_author
     AND c.fix_status = s.fix_status))
SELECT * FROM cur WHERE asin NOT IN (SELECT asin FROM changed)
UNION ALL SELECT * FROM changed
""")
def checklist_capture_report(t: Tables):
    """A checklist sheet (exact headers, display case) validated and diff-merged into the
    current checklist: identical rows dropped, changed products replaced, new ones added."""
    from shelfwise.operators.sheets import CHECKLIST_ISSUES, bind_exact, checklist_capture

    li = t.lineitem.filter(F.col("l_returnflag") == "R")
    cols = ["asin", "src", "ss_day", *CHECKLIST_ISSUES, "fix_status"]
    current = (bind_exact(_checklist_rows(li.filter(_since("2000-07-01") & ~_since("2001-07-01")), "Y"), cols)
               .withColumn("msgid", F.lit(1).cast("bigint")))
    sheet = bind_exact(_checklist_rows(li.filter(_since("2001-01-01")), None), cols)
    return checklist_capture(current, sheet, CHECKLIST_MSGID)
