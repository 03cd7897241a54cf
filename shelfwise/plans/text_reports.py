"""Text extraction reports: F12-F15 over documents/events, S16 (HTML -> text),
S13-style link rows, J12 (keyword hit list), R24 (deal-intent list), R29 (ad-hoc SQL from a request)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions.dates import FIXED_SHIFT_HOURS, RFC_DATE_PATTERN, parse_message_date
from shelfwise.functions.text import (
    EMAIL_RE, MULTILINE_SQL, PRODUCT_CODE_RE, USER_RE, email_addresses, multilines_in_html, product_codes, sender_user,
)
from shelfwise.operators.joins import not_in_anti_join, phrase_hits
from shelfwise.operators.topn import latest_per_key
from shelfwise.plans.registry import report
from shelfwise.plans.views import PRODUCTS_SQL, products, with_sql
from shelfwise.sources.html import html_to_text, HTML_TEXT_SQL, LINK_ITEM_RE
from shelfwise.session import spread
from shelfwise.sources.tables import Tables

# ---------------------------------------------------------------- F12
EXTRACT_CODES_SQL = f"""
SELECT doc_id, code, COUNT(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '{PRODUCT_CODE_RE}', 1)) AS code FROM documents)
GROUP BY doc_id, code
"""


@report("extract_codes", covers=("F12",), oracle=EXTRACT_CODES_SQL, tag="CODES")
def extract_codes(t: Tables):
    """Product codes mentioned in each document, with their number of mentions."""
    return (spread(t.documents.select("doc_id", "text")).select("doc_id", F.explode(product_codes("text")).alias("code"))
            .groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- F14
EXTRACT_EMAILS_SQL = f"""
SELECT doc_id, address, regexp_extract(address, '{USER_RE}', 1) AS usr FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL_RE}', 1)) AS address FROM documents)
"""


@report("extract_emails", covers=("F14",), oracle=EXTRACT_EMAILS_SQL, tag="SENDERS")
def extract_emails(t: Tables):
    """Sender-style addresses in documents and the user name the reference derives."""
    return (spread(t.documents.select("doc_id", "text")).select("doc_id", F.explode(email_addresses("text")).alias("address"))
            .select("doc_id", "address", sender_user("address").alias("usr")))


# ---------------------------------------------------------------- F15
_DATE_PARTS_SQL = " || ' ' || ".join(f"regexp_extract(header, '{RFC_DATE_PATTERN}', {i})" for i in (1, 2, 3, 4))
MESSAGE_DATES_SQL = f"""
WITH h AS (SELECT event_id, strftime(ts, '%a, %-d %b %Y %H:%M:%S') || ' +0000' AS header FROM events)
SELECT event_id, header, strptime({_DATE_PARTS_SQL}, '%d %b %Y %H:%M:%S') + INTERVAL {FIXED_SHIFT_HOURS} HOUR AS received
FROM h
"""


@report("message_dates", covers=("F15",), oracle=MESSAGE_DATES_SQL, tag="DATES")
def message_dates(t: Tables):
    """Each event rendered as an RFC 2822 date header, then parsed back the reference's way
    (offset ignored, fixed +8 h)."""
    hdr = F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    return (t.events.select("event_id", hdr.alias("header"))
            .select("event_id", "header", parse_message_date("header").alias("received")))


# ---------------------------------------------------------------- S16
HTML_TEXT_REPORT_SQL = f"SELECT page_id, {HTML_TEXT_SQL.format(c='html')} AS text FROM pages"


@report("html_text", covers=("S16", "F19"), oracle=HTML_TEXT_REPORT_SQL, tag="HTMLTEXT")
def html_text(t: Tables):
    """Plain text of every page (scripts, styles, comments and tags removed, entities decoded)."""
    return spread(t.pages.select("page_id", "html")).select("page_id", html_to_text("html").alias("text"))


# ---------------------------------------------------------------- S13 (link rows)
HTML_ROWS_SQL = f"""
SELECT page_id, CAST(pos AS BIGINT) AS pos, href, label FROM (
  SELECT page_id,
         unnest(generate_series(1, len(regexp_extract_all(html, '{LINK_ITEM_RE}', 1)))) AS pos,
         unnest(regexp_extract_all(html, '{LINK_ITEM_RE}', 1)) AS href,
         unnest(regexp_extract_all(html, '{LINK_ITEM_RE}', 2)) AS label
  FROM pages)
"""


@report("html_rows", covers=("S13",), oracle=HTML_ROWS_SQL, tag="HTMLROWS")
def html_rows(t: Tables):
    """Rows of the pages' list markup: (position, link target, link text) per list item."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK_ITEM_RE), 1).alias("href"),
                         F.regexp_extract_all("html", F.lit(LINK_ITEM_RE), 2).alias("label"))
    return (spread(t.pages.select("page_id", "html")).select("page_id", F.posexplode(pairs).alias("pos0", "item"))
            .select("page_id", (F.col("pos0") + 1).cast("bigint").alias("pos"),
                    F.col("item.href").alias("href"), F.col("item.label").alias("label")))


# ---------------------------------------------------------------- R24
KEYWORD_HIT_SQL = """
SELECT DISTINCT d.doc_id, d.lang, d.source, b.item_id
FROM documents d JOIN benchmark b ON contains(d.text, b.text)
"""


@report("keyword_hit_list", covers=("J12",), oracle=KEYWORD_HIT_SQL, tag="KEYWORDHIT")
def keyword_hit_list(t: Tables):
    """Documents containing a hot passage: whole texts, read once by an automaton of the passages."""
    docs = spread(t.documents.select("doc_id", "lang", "source", "text"))
    items = t.benchmark.select("item_id", F.col("text").alias("item_text"))
    return phrase_hits(docs, "doc_id", "text", items, "item_id", "item_text")


# Analogue: a mail brings 20 search keywords (benchmark texts), the newest one counts; a product's keyword text is the document
# of its number; the pattern list is the newest quarter of sales; banned are products returned in bulk; a product
# of a size up to 40 has a rank; comments are the user turns of its conversation.
KEYWORDS_A_MAIL, RANKED_UP_TO, BULK_RETURN = 20, 40, 49

DEAL_INTENT_SQL = with_sql(PRODUCTS_SQL, f"""
pub AS (SELECT l_partkey, CAST(MIN(l_shipdate) AS DATE) AS pub_day FROM lineitem GROUP BY l_partkey),
pattern AS (SELECT DISTINCT l_partkey FROM lineitem WHERE date_trunc('quarter', l_shipdate) = (SELECT MAX(date_trunc('quarter', l_shipdate)) FROM lineitem)),
banned AS (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= {BULK_RETURN}),
hot AS (SELECT DISTINCT text AS k FROM benchmark WHERE item_id // {KEYWORDS_A_MAIL} = (SELECT MAX(item_id // {KEYWORDS_A_MAIL}) FROM benchmark)),
hit AS (SELECT DISTINCT d.doc_id, hot.k FROM documents d JOIN hot ON contains(d.text, hot.k)),
comment AS (SELECT conv_id, text FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) r
            FROM conversations WHERE role = 'user') WHERE r = 1)
SELECT p.product AS isbn, p.p_partkey AS pasin, left(p.title, 20) AS title_name, left(p.author, 8) AS author_name, pub.pub_day,
       CASE WHEN p.p_size <= {RANKED_UP_TO} THEN p.p_size END AS rank, CASE WHEN h.k IS NULL THEN ' ' ELSE left(h.k, 8) END AS keyword,
       {MULTILINE_SQL.format(c='c.text')} AS last_comment
FROM products p LEFT JOIN pub ON pub.l_partkey = p.p_partkey
LEFT JOIN hit h ON h.doc_id = p.p_partkey
LEFT JOIN comment c ON c.conv_id = p.p_partkey
WHERE p.p_partkey IN (SELECT l_partkey FROM pattern) AND p.product <> '' AND p.publisher <> ''
  AND p.p_partkey NOT IN (SELECT l_partkey FROM banned WHERE l_partkey IS NOT NULL)
ORDER BY pasin, pub_day DESC
""")


@report("deal_intent_list", covers=("R24", "J12", "J2", "J8", "J9", "J21", "P11", "L6"), oracle=DEAL_INTENT_SQL, tag="DEALINTENT")
def deal_intent_list(t: Tables):
    """Deal-intent list: products of the newest pattern list that are not banned, with rank, the hot search keywords that
    their keyword text contains (one row each, a blank without any) and the last comment."""
    li = t.lineitem
    pub = li.groupBy("l_partkey").agg(F.min("l_shipdate").cast("date").alias("pub_day"))
    newest = li.agg(F.date_trunc("quarter", F.max("l_shipdate"))).scalar()
    # The newest quarter is all that is at or after its start: the filter reaches the scan.
    pattern = li.filter(F.col("l_shipdate") >= newest).select("l_partkey").distinct()
    banned = (li.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= BULK_RETURN) & F.col("l_partkey").isNotNull())
              .select("l_partkey"))
    mail = F.expr(f"item_id DIV {KEYWORDS_A_MAIL}")
    hot = (t.benchmark.filter(mail == t.benchmark.agg(F.max(mail)).scalar())
           .select(F.col("text").alias("k"), F.col("text").alias("phrase")).distinct())
    hit = phrase_hits(spread(t.documents.select("doc_id", "text")), "doc_id", "text", hot, "k", "phrase")
    comment = latest_per_key(t.conversations.filter(F.col("role") == "user").select("conv_id", "turn", "text"), ["conv_id"], ["turn"])
    listed = products(t).filter((F.col("product") != "") & (F.col("publisher") != "")).join(
        pattern.withColumnRenamed("l_partkey", "listed"), F.col("p_partkey") == F.col("listed"), "left_semi")
    p = not_in_anti_join(listed, banned, "p_partkey", "l_partkey")
    return (p.join(pub, F.col("p_partkey") == F.col("l_partkey"), "left")
            .join(hit, F.col("p_partkey") == F.col("doc_id"), "left")
            .join(comment.select("conv_id", F.col("text").alias("comment")), F.col("p_partkey") == F.col("conv_id"), "left")
            .select(F.col("product").alias("isbn"), F.col("p_partkey").alias("pasin"), F.left("title", F.lit(20)).alias("title_name"),
                    F.left("author", F.lit(8)).alias("author_name"), "pub_day",
                    F.when(F.col("p_size") <= RANKED_UP_TO, F.col("p_size")).alias("rank"),
                    F.coalesce(F.left("k", F.lit(8)), F.lit(" ")).alias("keyword"), multilines_in_html("comment").alias("last_comment"))
            .orderBy("pasin", F.col("pub_day").desc()))


# ---------------------------------------------------------------- R29
# Fixed request text of the analogue: a message asking for a query; only the
# statement between 'select' and the first ';' is run, over the registered tables.
ADHOC_REQUEST = ("Hi team, could you run this for me:\n"
                 "select p_brand, count(*) as n_parts, round(avg(p_size), 2) as avg_size from part "
                 "where p_retailprice > 950 group by p_brand;\nthanks")
ADHOC_SQL = ("select p_brand, count(*) as n_parts, round(avg(p_size), 2) as avg_size from part "
             "where p_retailprice > 950 group by p_brand")


def run_request_sql(t: Tables, request_text: str):
    """Extract the SELECT statement from free text and run it on the tables.

    What is run starts with ``select`` and ends before the first semicolon, so Spark's parser can only
    read it as one query (words such as ``update`` in its literals are of no matter). Extraction is the
    same regex as ``sql_statement``.
    """
    import re
    from shelfwise.functions.text import SQL_STATEMENT_RE

    m = re.search(SQL_STATEMENT_RE, request_text)
    if not m:
        raise ValueError("no select statement in request")
    stmt = m.group(1).strip()
    t.register_views()
    return t.spark.sql(stmt)


@report("adhoc_request_sql", covers=("R29", "F26"), oracle=ADHOC_SQL, tag="SQL")
def adhoc_request_sql(t: Tables):
    """The statement found in a request message, run over the registered tables."""
    return run_request_sql(t, ADHOC_REQUEST)
