"""Routing and entitlement: J24 (route a message to a report), J23 / R35 (report
menu per user), R34 (recipients of scheduled reports), J25 (sender allow-list).

Users are customers (``u<key>``), groups are market segments, messages are the
user turns of the conversations (the first line of a turn is its subject).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.topn import row_numbered
from shelfwise.plans.registry import report
from shelfwise.sources.tables import Tables

# Subject tags in configuration order (first match wins), then the default.
ROUTES = (
    ("toplist", "top_products_to_80pct"),
    ("cate", "top_categories_best_product"),
    ("author", "top_authors_best_product"),
    ("goal", "publisher_goal_progress"),
    ("price", "price_down_candidates"),
    ("raise", "price_raise_candidates"),
    ("deal", "deal_strong_new_flag"),
    ("bill", "billing_vendor_fund"),
    ("select", "adhoc_request_sql"),
    ("rank", "not_launched_rank"),
    ("new", "new_launch_candidates"),
    ("the", "audit_join"),
    ("ion", "high_score_products"),
)
DEFAULT_ROUTE = "help"

# Who may run which report. 'all' = everybody; otherwise user ids
# and/or group names.
AUDIENCES = (
    ("top_products_to_80pct", ("all",)),
    ("top_categories_best_product", ("all",)),
    ("publisher_goal_progress", ("BUILDING", "MACHINERY")),
    ("price_down_candidates", ("MACHINERY",)),
    ("price_raise_candidates", ("MACHINERY", "u7")),
    ("billing_vendor_fund", ("HOUSEHOLD", "u42", "u1001")),
    ("adhoc_request_sql", ("u1", "u2", "u3")),
    ("deal_strong_new_flag", ("FURNITURE", "AUTOMOBILE")),
)
# Scheduled reports and their audiences.
SCHEDULES = (
    ("top_products_to_80pct", ("BUILDING",)),
    ("price_down_candidates", ("MACHINERY", "u7")),
    ("billing_vendor_fund", ("HOUSEHOLD", "u42")),
)
MAIL_DOMAIN = "example.com"


def _subject(text: Column) -> Column:
    return F.split(text, r"\r\n|\n").getItem(0)


def route(subject: Column, routes=ROUTES, default: str = DEFAULT_ROUTE) -> Column:
    """First configured tag contained in the subject (case-insensitive), else default.

    The route table is a fixed configuration, so it unrolls into one CASE
    expression evaluated per row -- no join, no shuffle.
    """
    s = F.lower(subject)
    expr = None
    for tag, name in routes:
        cond = s.contains(tag.lower())
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(default))


def _messages(t: Tables) -> DataFrame:
    """Every user turn is a message of its own."""
    return t.conversations.filter(F.col("role") == "user").select("conv_id", "turn", _subject(F.col("text")).alias("subject"))


def _route_sql() -> str:
    whens = " ".join(f"WHEN contains(lower(subject), '{tag}') THEN '{name}'" for tag, name in ROUTES)
    return f"CASE {whens} ELSE '{DEFAULT_ROUTE}' END"


ROUTE_SQL = f"""
WITH m AS (SELECT conv_id, turn, string_split_regex(text, '\\r\\n|\\n')[1] AS subject FROM conversations WHERE role = 'user')
SELECT conv_id, turn, {_route_sql()} AS report FROM m
"""


@report("route_messages", covers=("J24", "S17"), oracle=ROUTE_SQL, tag=None)
def route_messages(t: Tables):
    """Report each request message is routed to: all of a conversation's requests, not only its first."""
    return _messages(t).select("conv_id", "turn", route(F.col("subject")).alias("report"))


# ---------------------------------------------------------------- J23 / R35
def users(t: Tables) -> DataFrame:
    return t.customer.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("usr"),
                             F.col("c_mktsegment").alias("grp"), "c_name")


def grants_frame(t: Tables, audiences=AUDIENCES) -> DataFrame:
    rows = [(r, p) for r, ps in audiences for p in ps if p != "all"]
    return t.spark.createDataFrame(rows, "report string, principal string")


def entitled(t: Tables, audiences=AUDIENCES) -> DataFrame:
    """(usr, report) allowed when the audience has 'all', names the user, or names
    one of the user's groups. The grant table is a bounded configuration (broadcast)."""
    u = users(t).select("usr", "grp")
    grants = grants_frame(t, audiences)
    everyone = [r for r, ps in audiences if "all" in ps]
    parts = []
    if everyone:
        parts.append(u.select("usr", F.explode(F.array(*[F.lit(r) for r in everyone])).alias("report")))
    parts.append(u.join(grants, u.usr == grants.principal).select("usr", "report"))
    parts.append(u.join(grants, u.grp == grants.principal).select("usr", "report"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _values(rows) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)


_GRANTS_SQL = _values([(r, p) for r, ps in AUDIENCES for p in ps])

MENU_SQL = f"""
WITH u AS (SELECT 'u' || CAST(c_custkey AS VARCHAR) AS usr, c_mktsegment AS grp FROM customer),
g AS (SELECT * FROM (VALUES {_GRANTS_SQL}) v(report, principal)),
e AS (SELECT DISTINCT u.usr, g.report FROM u JOIN g ON g.principal = 'all' OR g.principal = u.usr OR g.principal = u.grp)
SELECT usr, CAST(ROW_NUMBER() OVER (PARTITION BY usr ORDER BY report) AS BIGINT) AS rn, report FROM e
"""


@report("user_report_menu", covers=("R35", "J23", "W1", "A9"), oracle=MENU_SQL, tag="HELP")
def user_report_menu(t: Tables):
    """Numbered list of the reports each user may request."""
    e = entitled(t)
    return row_numbered(e, ["usr"], ["report"]).select("usr", F.col("rn").cast("bigint").alias("rn"), "report")


# ---------------------------------------------------------------- R34
def _address(name: Column) -> Column:
    return F.concat(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", "")), F.lit("@" + MAIL_DOMAIN))


RECIPIENTS_SQL = f"""
WITH u AS (SELECT 'u' || CAST(c_custkey AS VARCHAR) AS usr, c_mktsegment AS grp, c_name FROM customer),
g AS (SELECT * FROM (VALUES {_values([(r, p) for r, ps in SCHEDULES for p in ps])}) v(report, principal))
SELECT DISTINCT g.report, lower(regexp_replace(u.c_name, '[^A-Za-z0-9]', '', 'g')) || '@{MAIL_DOMAIN}' AS recipient
FROM u JOIN g ON g.principal = 'all' OR g.principal = u.usr OR g.principal = u.grp
"""


@report("recipients", covers=("R34", "J23", "A9", "E2"), oracle=RECIPIENTS_SQL, tag=None)
def recipients(t: Tables):
    """Addresses each scheduled report goes to: groups expanded, users added, de-duplicated."""
    e = entitled(t, SCHEDULES)
    names = users(t).select(F.col("usr").alias("u2"), "c_name")
    return (e.join(names, e.usr == names.u2)
            .select("report", _address(F.col("c_name")).alias("recipient")).distinct())


# ---------------------------------------------------------------- J25
def allowed_senders(messages: DataFrame, sender_col: str, lists: DataFrame, key_col: str,
                    list_cols: tuple[str, ...], msg_key_col: str) -> DataFrame:
    """Keep messages whose sender appears in the recipient lists of their key
    (lists are ``[,;:]``-delimited; comparison is case-insensitive)."""
    from shelfwise.functions.text import split_list

    members = (lists.select(F.col(key_col).alias("_k"), F.explode(split_list(*list_cols)).alias("_m"))
               .select("_k", F.lower("_m").alias("_m")).distinct())
    return messages.join(members, (messages[msg_key_col] == members["_k"])
                         & (F.lower(messages[sender_col]) == members["_m"]), "left_semi")
