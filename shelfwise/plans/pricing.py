"""Pricing advice: R6/R7 (price-match deadlock), R16 (price-down), R17 (price-raise),
R18 (daily advice history, M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numeric import cents, from_cents, as_double, money, percent_text, ratio, rounded_double
from shelfwise.plans.registry import report
from shelfwise.plans.views import PRODUCTS_SQL, products, with_sql
from shelfwise.sources.tables import Tables

# Fixed analogue parameters: the recent window and the one before it (half-years).
RECENT_FROM = "2001-05-01"
PRIOR_FROM = "2000-11-01"
AS_OF = "2001-11-05"


def sale_price():
    return F.round(money("p_retailprice") * (F.lit(1) - money("l_discount")), 2).cast("decimal(18,2)")


def price_points(t: Tables) -> DataFrame:
    """Every sale as a price point: price = retail x (1 - discount), exact to the cent."""
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                           "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    part = t.part.select("p_partkey", "p_retailprice")
    return (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .withColumn("price", sale_price())
            .drop("p_partkey", "p_retailprice"))


PRICE_POINTS_SQL = """points AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_discount,
         l.l_returnflag, l.l_shipdate,
         CAST(ROUND(CAST(p.p_retailprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2))), 2)
              AS DECIMAL(18,2)) AS price
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey)"""


def price_recent(t: Tables) -> DataFrame:
    """Per product: current price (price of its latest sale day; the higher price when
    one day has several), days at that price, recent and prior half-year sales and
    units, returns, views, highest and lowest price, number of price points and
    first sale day.

    One scan of the sales and three aggregates: first per (product, discount) with plain
    hash aggregates -- a large map-side reduction, so the join with the products sees a few
    rows of each -- then per (product, price), then per product
    over those few rows, where ``max(struct(last day, price, first day))`` picks
    the current price together with its own first and last day (no join back).
    """
    recent = F.col("l_shipdate") >= F.lit(RECENT_FROM).cast("timestamp")
    prior = (F.col("l_shipdate") >= F.lit(PRIOR_FROM).cast("timestamp")) & ~recent
    # Before the join with the products: a few rows per product, one for each discount.
    per_discount = t.lineitem.groupBy("l_partkey", "l_discount").agg(
        F.min("l_shipdate").alias("first_at"), F.max("l_shipdate").alias("last_at"),
        F.sum(F.when(recent, cents("l_quantity"))).alias("pu"),
        F.count(F.when(recent & (F.col("l_returnflag") == "R"), 1)).alias("qb"),
        F.sum(cents("l_quantity")).alias("gv"),
        F.sum(F.when(prior, cents("l_extendedprice"))).alias("prior_gms"),
        F.sum(F.when(prior, cents("l_quantity"))).alias("prior_units"),
        F.sum(F.when(recent, cents("l_extendedprice"))).alias("recent_gms"))
    per_price = (
        per_discount.join(t.part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_partkey", sale_price().alias("price"))
        .agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
             *[F.sum(c).alias(c) for c in ("pu", "qb", "gv", "prior_gms", "prior_units", "recent_gms")]))
    per_part = per_price.groupBy("l_partkey").agg(
        F.max(F.struct("last_at", "price", "first_at")).alias("cur"),
        from_cents(F.sum("pu")).alias("pu"), F.sum("qb").alias("qb"), from_cents(F.sum("gv")).alias("gv"),
        from_cents(F.sum("prior_gms")).alias("prior_gms"),
        from_cents(F.coalesce(F.sum("prior_units"), F.lit(0))).alias("prior_units"),
        from_cents(F.sum("recent_gms")).alias("recent_gms"),
        F.max("price").alias("highest_price"), F.min("price").alias("low_price"),
        F.count(F.lit(1)).alias("n_prices"), F.min("first_at").cast("date").alias("os_date"))
    return per_part.select(
        "l_partkey", F.col("cur.price").alias("price"), "pu", "qb", "gv", "prior_gms", "prior_units", "recent_gms",
        "highest_price", F.datediff(F.col("cur.last_at"), F.col("cur.first_at")).cast("bigint").alias("days"),
        "low_price", "n_prices", "os_date")


PRICE_RECENT_SQL = PRICE_POINTS_SQL + f""",
cur AS (SELECT l_partkey, price FROM (
   SELECT l_partkey, price, ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, price DESC) r
   FROM points) WHERE r = 1),
st AS (SELECT l_partkey,
   SUM(CASE WHEN l_shipdate >= DATE '{RECENT_FROM}' THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS pu,
   COUNT(*) FILTER (WHERE l_shipdate >= DATE '{RECENT_FROM}' AND l_returnflag = 'R') AS qb,
   SUM(CAST(l_quantity AS DECIMAL(18,2))) AS gv,
   SUM(CASE WHEN l_shipdate >= DATE '{PRIOR_FROM}' AND l_shipdate < DATE '{RECENT_FROM}'
            THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS prior_gms,
   COALESCE(SUM(CASE WHEN l_shipdate >= DATE '{PRIOR_FROM}' AND l_shipdate < DATE '{RECENT_FROM}'
            THEN CAST(l_quantity AS DECIMAL(18,2)) END), 0) AS prior_units,
   SUM(CASE WHEN l_shipdate >= DATE '{RECENT_FROM}' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS recent_gms,
   MAX(price) AS highest_price
   FROM points GROUP BY l_partkey),
atp AS (SELECT p.l_partkey, datediff('day', MIN(p.l_shipdate), MAX(p.l_shipdate)) AS days
        FROM points p JOIN cur c ON c.l_partkey = p.l_partkey AND c.price = p.price GROUP BY p.l_partkey),
pdr AS (SELECT c.l_partkey, c.price, st.pu, st.qb, st.gv, st.prior_gms, st.prior_units, st.recent_gms,
               st.highest_price, atp.days
        FROM cur c JOIN st ON st.l_partkey = c.l_partkey JOIN atp ON atp.l_partkey = c.l_partkey)"""


def price_match(t: Tables) -> DataFrame:
    """Competitor offers per product and month (snapshot = entry month)."""
    return (t.lineitem.select(F.col("l_partkey").alias("pm_partkey"),
                              F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("competitor"),
                              F.trunc("l_shipdate", "month").alias("entry_day"))
            .distinct())


def latest_price_match(t: Tables) -> DataFrame:
    """The latest snapshot of ``price_match`` without building the other snapshots.

    The latest entry month is ``trunc(max(ship day))`` (trunc is monotonic, so this
    equals the max over the snapshot table) -- one column aggregate over the base
    table; only that month's rows are then de-duplicated.
    """
    li = t.lineitem
    last_month = li.agg(F.trunc(F.max("l_shipdate"), "month")).scalar()
    return (li.filter(F.col("l_shipdate") >= last_month.cast("timestamp"))
            .select(F.col("l_partkey").alias("pm_partkey"),
                    F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("competitor"),
                    F.trunc("l_shipdate", "month").alias("entry_day"))
            .distinct())


PRICE_MATCH_SQL = """pm_all AS (SELECT DISTINCT l_partkey AS pm_partkey, 'S' || CAST(l_suppkey AS VARCHAR) AS competitor,
                  CAST(date_trunc('month', l_shipdate) AS DATE) AS entry_day FROM lineitem),
pm AS (SELECT * FROM pm_all WHERE entry_day = (SELECT MAX(entry_day) FROM pm_all))"""


# ---------------------------------------------------------------- R16 / R17 / R18
def _advice_base(t: Tables) -> DataFrame:
    pdr = price_recent(t)
    ab = products(t)
    # The dimension's own predicates go on the dimension before the join.
    b = ab.filter(~F.col("title").like("%ring%") & (F.col("category") == "STANDARD") & (F.col("publisher") != "Brand#1"))
    vl = t.part.filter(F.col("p_size") <= 2).select(F.col("p_partkey").alias("vl_key"), F.lit("Y").alias("set_flag"))
    pm = latest_price_match(t).select("pm_partkey", "competitor")
    pu_qb = F.col("pu") + F.coalesce(F.col("qb"), F.lit(0))
    return (pdr.join(b, pdr.l_partkey == b.p_partkey, "inner")
            .join(pm, F.col("l_partkey") == F.col("pm_partkey"), "left")
            .join(vl, F.col("l_partkey") == F.col("vl_key"), "left")
            .filter((F.coalesce(F.col("set_flag"), F.lit("N")) != "Y") & (F.col("days") > 10)
                    & (F.col("gv") > F.col("days") * F.lit(0.3).cast("decimal(2,1)")))
            .withColumn("pu_qb", pu_qb))


def _highest(price: str = "price", highest: str = "highest_price"):
    return F.when(F.abs(F.col(highest) - F.col(price)) <= F.lit(0.1).cast("decimal(2,1)"), F.col(price)).otherwise(F.col(highest))


_ADVICE_FROM = """
FROM pdr
JOIN products b ON b.p_partkey = pdr.l_partkey AND b.title NOT LIKE '%ring%' AND b.category = 'STANDARD'
                AND b.publisher <> 'Brand#1'
LEFT JOIN pm ON pm.pm_partkey = pdr.l_partkey
LEFT JOIN (SELECT p_partkey AS vl_key, 'Y' AS set_flag FROM part WHERE p_size <= 2) vl ON vl.vl_key = pdr.l_partkey
WHERE COALESCE(vl.set_flag, 'N') <> 'Y' AND pdr.days > 10 AND pdr.gv > pdr.days * 0.3
"""
_DOWN_WHERE = " AND (pdr.pu + COALESCE(pdr.qb, 0)) < 0.06 * pdr.gv AND pdr.price > 850 AND pdr.recent_gms < pdr.prior_gms * 1.6"
_RAISE_WHERE = (" AND (pdr.pu + COALESCE(pdr.qb, 0)) >= 0.06 * pdr.gv"
                " AND pdr.prior_units > 0 AND pdr.price * pdr.prior_units <= pdr.prior_gms * 0.8"
                " AND pdr.recent_gms < pdr.prior_gms")
_HIGHEST_SQL = "CASE WHEN abs(pdr.highest_price - pdr.price) <= 0.1 THEN pdr.price ELSE pdr.highest_price END"
_PCT = ("CAST(ROUND(CAST(CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0) * 100.0 AS DECIMAL(38,10)), {k})"
        " AS DECIMAL(38,{k})) || '%'")
_RND = "CAST(ROUND(CAST(CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0) AS DECIMAL(38,10)), {k}) AS DOUBLE)"

PRICE_DOWN_SQL = with_sql(PRODUCTS_SQL, PRICE_RECENT_SQL, PRICE_MATCH_SQL) + f"""
SELECT b.product, b.publisher AS band, b.title, CAST(pdr.price AS DOUBLE) AS price, pdr.days,
       CAST(pdr.pu + COALESCE(pdr.qb, 0) AS DOUBLE) AS pu_qb, CAST(pdr.gv AS DOUBLE) AS gv,
       {_PCT.format(n='pdr.pu + COALESCE(pdr.qb, 0)', d='pdr.gv', k=2)} AS cr,
       CAST(pdr.prior_gms AS DOUBLE) AS prior_gms, CAST(pdr.recent_gms AS DOUBLE) AS recent_gms,
       CAST({_HIGHEST_SQL} AS DOUBLE) AS highest_price, b.p_retailprice AS pop,
       {_PCT.format(n='pdr.price', d='b.p_retailprice', k=1)} AS ep_op_ratio, pm.competitor
{_ADVICE_FROM}{_DOWN_WHERE}
"""


@report("price_down_candidates", covers=("R16", "J1", "J5", "J6", "P4", "P8", "P9", "P10", "F3", "F7", "L3", "F11", "F10"),
        oracle=PRICE_DOWN_SQL, tag="PRICEDOWN")
def price_down_candidates(t: Tables):
    """Products with traffic but low conversion at a high current price, sales not rising."""
    base = _advice_base(t).filter(_is_down())
    return (base.orderBy(ratio("pu_qb", "gv"))
            .select("product", F.col("publisher").alias("band"), "title", as_double("price").alias("price"), "days",
                    as_double("pu_qb").alias("pu_qb"), as_double("gv").alias("gv"),
                    percent_text("pu_qb", "gv", 2).alias("cr"),
                    as_double("prior_gms").alias("prior_gms"), as_double("recent_gms").alias("recent_gms"),
                    as_double(_highest()).alias("highest_price"), F.col("p_retailprice").alias("pop"),
                    percent_text("price", "p_retailprice", 1).alias("ep_op_ratio"), "competitor"))


PRICE_RAISE_SQL = with_sql(PRODUCTS_SQL, PRICE_RECENT_SQL, PRICE_MATCH_SQL) + f"""
SELECT b.product, b.publisher AS band, b.title, CAST(pdr.price AS DOUBLE) AS recent_price,
       CASE WHEN pdr.prior_units = 0 THEN NULL ELSE {_RND.format(n='pdr.prior_gms', d='pdr.prior_units', k=2)} END AS prior_price,
       pdr.days, CAST(pdr.pu + COALESCE(pdr.qb, 0) AS DOUBLE) AS pu_qb, CAST(pdr.gv AS DOUBLE) AS gv,
       {_PCT.format(n='pdr.pu + COALESCE(pdr.qb, 0)', d='pdr.gv', k=2)} AS cr,
       CAST(pdr.prior_gms AS DOUBLE) AS prior_gms, CAST(pdr.recent_gms AS DOUBLE) AS recent_gms,
       CAST({_HIGHEST_SQL} AS DOUBLE) AS highest_price, b.p_retailprice AS pop,
       {_PCT.format(n='pdr.price', d='b.p_retailprice', k=1)} AS ep_op_ratio, pm.competitor
{_ADVICE_FROM}{_RAISE_WHERE}
"""


def _is_down():
    return ((F.col("pu_qb") < F.lit(0.06).cast("decimal(3,2)") * F.col("gv")) & (F.col("price") > 850)
            & (F.col("recent_gms") < F.col("prior_gms") * F.lit(1.6).cast("decimal(2,1)")))


def _is_raise():
    return ((F.col("pu_qb") >= F.lit(0.06).cast("decimal(3,2)") * F.col("gv"))
            & (F.col("prior_units") > 0)
            & (F.col("price") * F.col("prior_units") <= F.col("prior_gms") * F.lit(0.8).cast("decimal(2,1)"))
            & (F.col("recent_gms") < F.col("prior_gms")))


def _prior_price():
    return F.when(F.col("prior_units") == 0, F.lit(None)).otherwise(rounded_double(ratio("prior_gms", "prior_units"), 2))


@report("price_raise_candidates", covers=("R17", "J5", "J6", "P10", "F3", "F7", "L3"), oracle=PRICE_RAISE_SQL,
        tag="RAISE")
def price_raise_candidates(t: Tables):
    """Products converting well whose current price is <= 80 % of the prior average price
    while sales fell."""
    return (_advice_base(t).filter(_is_raise()).orderBy(ratio("recent_gms", "prior_gms"))
            .select("product", F.col("publisher").alias("band"), "title", as_double("price").alias("recent_price"),
                    _prior_price().alias("prior_price"), "days",
                    as_double("pu_qb").alias("pu_qb"), as_double("gv").alias("gv"),
                    percent_text("pu_qb", "gv", 2).alias("cr"),
                    as_double("prior_gms").alias("prior_gms"), as_double("recent_gms").alias("recent_gms"),
                    as_double(_highest()).alias("highest_price"), F.col("p_retailprice").alias("pop"),
                    percent_text("price", "p_retailprice", 1).alias("ep_op_ratio"), "competitor"))


def _history_cols():
    return [F.lit(AS_OF).cast("date").alias("ss_day"), "dir", "product",
            F.col("publisher").alias("band"), "title", as_double("price").alias("price"),
            _prior_price().alias("prior_price"), "days", as_double("pu_qb").alias("pu_qb"), as_double("gv").alias("gv"),
            F.when(F.col("gv") == 0, F.lit(None)).otherwise(rounded_double(ratio("pu_qb", "gv"), 4)).alias("cr"),
            as_double("prior_gms").alias("prior_gms"), as_double("recent_gms").alias("recent_gms"),
            as_double(_highest()).alias("highest_price"), F.col("p_retailprice").alias("pop"),
            F.when(F.col("p_retailprice") == 0, F.lit(None))
            .otherwise(rounded_double(ratio("price", "p_retailprice"), 3)).alias("ep_op_ratio"), "competitor"]


def _hist_sql_select(direction: str, where: str) -> str:
    return f"""
SELECT DATE '{AS_OF}' AS ss_day, '{direction}' AS dir, b.product, b.publisher AS band, b.title,
       CAST(pdr.price AS DOUBLE) AS price,
       CASE WHEN pdr.prior_units = 0 THEN NULL ELSE {_RND.format(n='pdr.prior_gms', d='pdr.prior_units', k=2)} END AS prior_price,
       pdr.days, CAST(pdr.pu + COALESCE(pdr.qb, 0) AS DOUBLE) AS pu_qb, CAST(pdr.gv AS DOUBLE) AS gv,
       CASE WHEN pdr.gv = 0 THEN NULL ELSE {_RND.format(n='pdr.pu + COALESCE(pdr.qb, 0)', d='pdr.gv', k=4)} END AS cr,
       CAST(pdr.prior_gms AS DOUBLE) AS prior_gms, CAST(pdr.recent_gms AS DOUBLE) AS recent_gms,
       CAST({_HIGHEST_SQL} AS DOUBLE) AS highest_price, b.p_retailprice AS pop,
       CASE WHEN b.p_retailprice = 0 THEN NULL ELSE {_RND.format(n='pdr.price', d='b.p_retailprice', k=3)} END AS ep_op_ratio,
       pm.competitor
{_ADVICE_FROM}{where}"""


ADVICE_HISTORY_SQL = (with_sql(PRODUCTS_SQL, PRICE_RECENT_SQL, PRICE_MATCH_SQL)
                      + _hist_sql_select("D", _DOWN_WHERE) + "\nUNION ALL\n" + _hist_sql_select("R", _RAISE_WHERE))


def advice_history_rows(t: Tables) -> DataFrame:
    # The two conditions exclude each other, so one pass over the base tags its rows.
    tagged = _advice_base(t).withColumn("dir", F.when(_is_down(), "D").when(_is_raise(), "R"))
    return tagged.filter(F.col("dir").isNotNull()).select(*_history_cols())


@report("advice_history", covers=("R18", "U2", "P17"), oracle=ADVICE_HISTORY_SQL, tag="PRICEHIST")
def advice_history(t: Tables):
    """The day's history rows, both directions (written with ``write_day_partition``:
    re-running the day replaces only that day)."""
    return advice_history_rows(t)


# ---------------------------------------------------------------- R6 / R7
def _deadlock_base(t: Tables) -> DataFrame:
    pdr = price_recent(t)
    pm_latest = latest_price_match(t)
    ab = products(t).filter(F.col("publisher") != "Brand#1")
    # J14 (current price is the historic low) and A4 (more than two price points) come
    # from the same per-product aggregate as the current price.
    return (pdr.filter((F.col("price") == F.col("low_price")) & (F.col("n_prices") > 2)
                       & (F.col("days") >= 60) & (F.col("price") < 900))
            .join(ab, F.col("l_partkey") == F.col("p_partkey"))
            .filter(F.col("price") < F.col("p_retailprice") * F.lit(0.95).cast("decimal(3,2)"))
            .join(pm_latest.select(F.col("pm_partkey").alias("sk")).distinct(), F.col("l_partkey") == F.col("sk"),
                  "left_semi"), pm_latest)


def _deadlock_cols():
    return [F.col("category").alias("vm"), F.col("product").alias("kasin"), F.col("title").alias("title_name"),
            F.col("publisher").alias("code"), as_double("price").alias("recent_p"), as_double("pu").alias("recent_pu"),
            as_double("gv").alias("recent_gv"), "days", percent_text("pu", "gv", 2).alias("cr"),
            F.col("p_retailprice").alias("dlp"), percent_text("price", "p_retailprice", 2).alias("op_ratio"), "os_date"]


_DEADLOCK_SQL = with_sql(PRODUCTS_SQL, PRICE_RECENT_SQL, PRICE_MATCH_SQL) + f"""
SELECT b.category AS vm, b.product AS kasin, b.title AS title_name, b.publisher AS code,
       CAST(pdr.price AS DOUBLE) AS recent_p, CAST(pdr.pu AS DOUBLE) AS recent_pu, CAST(pdr.gv AS DOUBLE) AS recent_gv,
       pdr.days, {_PCT.format(n='pdr.pu', d='pdr.gv', k=2)} AS cr, b.p_retailprice AS dlp,
       {_PCT.format(n='pdr.price', d='b.p_retailprice', k=2)} AS op_ratio,
       (SELECT CAST(MIN(l_shipdate) AS DATE) FROM lineitem WHERE l_partkey = pdr.l_partkey) AS os_date{{extra_cols}}
FROM pdr
JOIN (SELECT l_partkey, MIN(price) AS low_price FROM points GROUP BY l_partkey) aa
  ON aa.l_partkey = pdr.l_partkey AND pdr.price = aa.low_price
JOIN products b ON b.p_partkey = pdr.l_partkey
{{extra_join}}
WHERE pdr.days >= 60 AND pdr.price < 900
  AND pdr.l_partkey IN (SELECT p_partkey FROM products WHERE publisher <> 'Brand#1')
  AND pdr.l_partkey IN (SELECT pm_partkey FROM pm)
  AND pdr.l_partkey IN (SELECT l_partkey FROM points GROUP BY l_partkey HAVING COUNT(DISTINCT price) > 2)
  AND pdr.price < b.p_retailprice * 0.95
  {{extra_where}}
ORDER BY 1, 4
"""

PRICE_DEADLOCK_SQL = _DEADLOCK_SQL.format(
    extra_cols=", pm.competitor", extra_join="LEFT JOIN pm_all pm ON pm.pm_partkey = pdr.l_partkey",
    extra_where="AND pm.entry_day = (SELECT MAX(entry_day) FROM pm_all)")
PRICE_DEADLOCK_SHEET_SQL = _DEADLOCK_SQL.format(extra_cols="", extra_join="", extra_where="")


@report("price_deadlock", covers=("R6", "J14", "J8", "A4", "J7", "P11", "F3"), oracle=PRICE_DEADLOCK_SQL, tag="DEADLOCK")
def price_deadlock(t: Tables):
    """Products long at their historic low price, discounted > 5 %, matched by a competitor
    in the latest snapshot, with more than two price points; one row per competitor."""
    base, pm_latest = _deadlock_base(t)
    # A left join whose right side is filtered to the latest snapshot in WHERE is an inner join.
    return (base.join(pm_latest.select("pm_partkey", "competitor"), F.col("l_partkey") == F.col("pm_partkey"), "inner")
            .select(*_deadlock_cols(), "competitor").orderBy("vm", "code"))


@report("price_deadlock_sheet", covers=("R7", "J14", "J8", "A4"), oracle=PRICE_DEADLOCK_SHEET_SQL, tag="DEADLOCKSHEET")
def price_deadlock_sheet(t: Tables):
    """Same list without the competitor column (one row per product)."""
    base, _ = _deadlock_base(t)
    return base.select(*_deadlock_cols()).orderBy("vm", "code")
