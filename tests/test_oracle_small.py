"""Spark result == DuckDB oracle on the smallest data folder, for a sample of reports
(the full set is checked by tools/oracle_check.py at sf0.01)."""
import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["top_products_to_80pct", "top_categories_best_product", "price_ladder", "billing_cofund_ordered",
          "metadata_worklist", "status_capture", "written_supplier_sheets", "proposed_table", "keyword_hit_list", "ingest_clean_cast", "deal_strong_new_flag", "not_launched_rank"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(cols)
    assert rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) == rows_of(cols, res.fetchall())
