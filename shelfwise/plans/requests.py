"""Requests as data. A request names a report by its subject, its text gives the report's parameters, and the report's
output kind says how it is answered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfwise.operators.params import restricted
from shelfwise.operators.topn import inline_or_notice
from shelfwise.plans.access_reports import DEFAULT_ROUTE, ROUTES
from shelfwise.plans.catalog_reports import R1_SQL
from shelfwise.plans.registry import REPORTS, report
from shelfwise.sources.sinks import write_report
from shelfwise.sources.tables import Tables

#: What a request is told whose text holds no value of any parameter.
NO_PARAMETERS = "Please provide the valid params."


def requested(t: Tables, name: str, text: str) -> DataFrame | None:
    """A report for a request: whole without parameters, else restricted to what ``text`` names; None when it names nothing."""
    r = REPORTS[name]
    tables = restricted(t, text, r.params) if r.params else t
    return None if tables is None else r.build(tables)


def routed(subject: str) -> str:
    """The report that a request's subject names: the first configured tag in it."""
    return next((name for tag, name in ROUTES if tag in subject.lower()), DEFAULT_ROUTE)


@dataclass(frozen=True)
class Answer:
    report: str
    notice: str | None = None          # what was not run, and why
    path: str | None = None            # E2 ``sheet``: the written folder
    table: DataFrame | None = None     # E2 ``table``: its rows, or one notice line instead of too many


def answer(t: Tables, name: str, text: str, base: str, run: str) -> Answer:
    """Runs a report for a request and delivers it by its output kind."""
    df = requested(t, name, text)
    if df is None:
        return Answer(name, notice=NO_PARAMETERS)
    if REPORTS[name].kind == "table":
        return Answer(name, table=inline_or_notice(df))
    return Answer(name, path=write_report(df, base, name, "data", run))


# ---------------------------------------------------------------- R1 with P14
REQUEST_TEXT = "Hi, the daily data of B000000007, B000000042 and B000000008 please (not BXXXXXXXXX), and B000000042 again."
REQUESTED_DAILY_SQL = R1_SQL.rstrip() + "\n  AND d.user_id IN (7, 42, 8)\n"


@report("requested_daily_report", covers=("R1", "P14", "E1"), tag="DAILYFOR", oracle=REQUESTED_DAILY_SQL)
def requested_daily_report(t: Tables):
    """The whole daily report for the products that a request's text names; the filter is at the scan of the daily facts."""
    return requested(t, "product_daily_performance", REQUEST_TEXT)
