"""Report registry (E1/E2): name -> DataFrame builder, plus its DuckDB oracle SQL.

A report is a plain function ``Tables -> DataFrame``. The registry replaces the
reference's run-time evaluated command strings: lookup is by name, nothing is
evaluated from text.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame

from shelfwise.operators.params import Parameter
from shelfwise.sources.tables import Tables


@dataclass(frozen=True)
class Report:
    name: str
    build: Callable[[Tables], DataFrame]
    covers: tuple[str, ...] = ()
    oracle: str | None = None
    tag: str | None = None          # subject tag used by message routing (J24)
    kind: str = "sheet"              # E2 output kind: sheet | table
    audience: tuple[str, ...] = ("all",)
    doc: str = ""
    params: tuple[Parameter, ...] = ()   # E1: what a request's text may restrict the report to


REPORTS: dict[str, Report] = {}


def report(name: str, covers: tuple[str, ...] = (), oracle: str | None = None,
           tag: str | None = None, kind: str = "sheet",
           audience: tuple[str, ...] = ("all",), params: tuple[Parameter, ...] = ()):
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in REPORTS:
            raise ValueError(f"duplicate report {name}")
        REPORTS[name] = Report(name, fn, covers, oracle, tag, kind, audience, (fn.__doc__ or "").strip(), params)
        return fn
    return wrap


def load_all() -> dict[str, Report]:
    # Importing the plan modules registers their reports.
    from shelfwise.plans import (  # noqa: F401
        access_reports, billing, capture_reports, catalog_reports, field_reports, ingest_reports, pricing, scan_reports,
        requests, section_reports, snapshot_reports, text_reports, top_reports, written_reports,
    )
    return REPORTS
