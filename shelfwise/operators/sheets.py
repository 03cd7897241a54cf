"""Spreadsheet-style inputs (S9, S10, S11, T11, R33): a sheet arrives as rows of text
cells (CSV export or a table); its header row decides which column plays which
role. Header resolution works on the header names only (metadata), the rows stay
distributed.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.merge import diff_merge

# Fixed values (S10): role -> (substrings that claim a header, exact name that locks the role).
SCHEDULE_RULES = (
    ("asin", ("asin",), "asin"),
    ("schedule", ("schedule", "time"), "time"),
    ("title", ("title",), "title"),
    ("vm", ("vm",), "vm"),
    ("code", ("code",), "k_code"),
)
# Fixed values (T11): accepted checklist sources and the checklist columns.
CHECKLIST_SOURCES = ("PTS", "ABC", "DOTD")
CHECKLIST_ISSUES = ("issue_title_name", "issue_pd", "issue_cover", "issue_author")


def resolve_columns(headers: Sequence[str], rules=SCHEDULE_RULES) -> dict[str, str]:
    """For each header (trimmed, lower-cased) the first rule whose substring it
    contains claims it; a later claimant replaces an earlier one unless the earlier
    header was the rule's exact name. Returns role -> header."""
    out: dict[str, str] = {}
    for raw in headers:
        h = str(raw).strip().lower()
        for role, needles, exact in rules:
            if any(n in h for n in needles):
                if out.get(role) != exact:
                    out[role] = h
                break
    return out


def resolve_positions(headers: Sequence[str], first_n: int = 5) -> dict[str, int]:
    """S10 (worklist variant): among the first ``first_n`` headers the last one containing
    'asin' is the key, the last containing schedule/time/date the day; day defaults to 0."""
    pos = {"asin": -1, "schedule": -1}
    for j, raw in enumerate(list(headers)[:first_n]):
        h = str(raw).strip().lower()
        if "asin" in h:
            pos["asin"] = j
        elif "schedule" in h or "time" in h or "date" in h:
            pos["schedule"] = j
    if pos["schedule"] < 0:
        pos["schedule"] = 0
    return pos


def bind_sheet(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Select the resolved header columns under their role names (S9 exact names pass
    through unchanged)."""
    lower = {c.strip().lower(): c for c in df.columns}
    return df.select(*[F.col(f"`{lower[h]}`").alias(role) for role, h in roles.items() if h in lower])


def validate_checklist(rows: DataFrame) -> DataFrame:
    """Keep rows with a product code, an accepted source, a yyyy-m-d day and at least
    one issue or status; an empty status becomes 'Y'. Cells are trimmed text."""
    t = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns}
    has_any = F.lit(False)
    for c in ("fix_status", *CHECKLIST_ISSUES):
        has_any = has_any | (t[c] != "")
    ok = ((t["asin"] != "") & has_any & t["asin"].rlike(r"B\w{9}") & t["src"].isin(*CHECKLIST_SOURCES)
          & t["ss_day"].rlike(r"\d{4}-\d{1,2}-\d{1,2}"))
    out = rows.filter(ok).select(*[t[c].alias(c) for c in rows.columns])
    return out.withColumn("fix_status", F.when(F.col("fix_status") == "", F.lit("Y")).otherwise(F.col("fix_status")))


def checklist_capture(current: DataFrame, sheet_rows: DataFrame, msgid: int) -> DataFrame:
    """Validated sheet rows diff-merged into the checklist (M7)."""
    staged = validate_checklist(sheet_rows).withColumn("msgid", F.lit(msgid).cast("bigint"))
    staged = staged.select(*current.columns)
    return diff_merge(current, staged, "asin", [*CHECKLIST_ISSUES, "fix_status"])


def bind_exact(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns found by exact (trimmed, case-insensitive) header name, in ``names`` order."""
    lower = {c.strip().lower(): c for c in df.columns}
    missing = [n for n in names if n not in lower]
    if missing:
        raise ValueError(f"sheet lacks columns {missing}")
    return df.select(*[F.col(f"`{lower[n]}`").alias(n) for n in names])
