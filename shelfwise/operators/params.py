"""Report parameters mined from request text.

A report declares parameters (a base table's column and a regex); the values found in the request text
restrict the report to ``column IN (values)``, several columns OR-ed. The restriction is a filter on the
report's own scan of that table, below all that the report does, so it reaches the files.
A report whose parameters find nothing is not run. The filter is built as a
column expression (no SQL text splicing).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.tables import Tables


@dataclass(frozen=True)
class Parameter:
    """``field`` is ``table.column``; ``value`` turns what the pattern's first group found into a value of the column (None:
    the column holds no such value)."""
    field: str
    pattern: str
    value: Callable[[str], object] = str


class RestrictedTables(Tables):
    """The tables of a folder or database, one of them filtered at its scan."""

    def __init__(self, tables: Tables, name: str, condition: Column):
        super().__init__(tables.spark, tables.sf_dir, tables.database)
        self._name, self._condition = name, condition

    def __getattr__(self, name: str) -> DataFrame:
        df = super().__getattr__(name)
        return df.filter(self._condition) if name == self._name else df


def restricted(tables: Tables, text: str, parameters: Sequence[Parameter]) -> Tables | None:
    """``tables`` restricted to what a request's text names; None when it names nothing (the report is not run).

    The parameters of a report are columns of one table, as in one WHERE clause."""
    names = {p.field.split(".", 1)[0] for p in parameters}
    if len(names) != 1:
        raise ValueError("the parameters of a report belong to one table")
    # As ``re`` has no \p classes: \w is [\p{L}\p{N}_].
    rules = [(p, p.pattern.replace(r"[\p{L}\p{N}_]", r"\w")) for p in parameters]
    found = {p: [v for v in map(p.value, re.findall(pattern, text or "")) if v is not None] for p, pattern in rules}
    if not any(re.search(pattern, text or "") for _, pattern in rules):
        return None
    condition = parameter_condition({p.field.split(".", 1)[1]: list(dict.fromkeys(v)) for p, v in found.items()})
    # Codes that no row can have: the request is answered, with no rows.
    return RestrictedTables(tables, names.pop(), F.lit(False) if condition is None else condition)


def mine_parameters(text: str, rules: Sequence[tuple[str, str]]) -> dict[str, list[str]]:
    """Values per field found by each rule's regex in one request text (first group,
    order of appearance, repeats removed)."""
    out: dict[str, list[str]] = {}
    for field, pattern in rules:
        found = re.findall(pattern, text or "")
        out[field] = list(dict.fromkeys(found))
    return out


def parameter_condition(params: dict[str, list[str]]) -> Column | None:
    conds = [F.col(field).isin(values) for field, values in params.items() if values]
    return reduce(lambda a, b: a | b, conds) if conds else None


def parameter_filter(df: DataFrame, params: dict[str, list[str]]) -> DataFrame | None:
    """``df`` restricted to the mined values; ``None`` when nothing was found (not run)."""
    cond = parameter_condition(params)
    return None if cond is None else df.filter(cond)


def per_request(df: DataFrame, key_col: str, requests: DataFrame, msg_col: str, value_col: str) -> DataFrame:
    """Distributed form: many requests at once. ``requests`` holds (msg, value) pairs mined
    with column expressions (e.g. ``explode(product_codes(body))``); each report row is
    paired with the requests naming its key -- an equi-join, no per-request job."""
    r = requests.select(F.col(msg_col).alias("_msg"), F.col(value_col).alias("_v")).distinct()
    return df.join(r, df[key_col] == r["_v"], "inner").drop("_v").withColumnRenamed("_msg", msg_col)
