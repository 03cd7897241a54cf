"""Which report sections each publisher receives.

A section is produced only for publishers holding the right for it, and only when it has rows; its heading
shows the row count. Rights are configuration: they are applied to the catalog before anything is summed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.plans.registry import report
from shelfwise.plans.top_reports import (
    TOP_PRODUCTS_SQL, _TOP_GROUPS_SQL, top_authors_best_product, top_categories_best_product, top_products_to_80pct,
)
from shelfwise.sources.tables import Tables

# Section -> publishers holding its right ('all' = everybody).
RIGHTS = (
    ("toplist", ("all",)),
    ("catelist", ("Brand#1", "Brand#2", "Brand#3", "Brand#5", "Brand#8", "Brand#13", "Brand#21")),
    ("topauthor", ("Brand#2", "Brand#4", "Brand#8", "Brand#16", "Brand#25")),
)
SECTIONS = {"toplist": top_products_to_80pct, "catelist": top_categories_best_product, "topauthor": top_authors_best_product}
_GRANTS_SQL = ", ".join(f"('{section}', '{who}')" for section, members in RIGHTS for who in members)


def _counts(df: DataFrame, section: str) -> DataFrame:
    return df.groupBy("publisher").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("section", F.lit(section))


@report("publisher_sections", covers=("J26", "A15"), tag="SECTIONS", oracle=f"""
WITH grants(section, who) AS (VALUES {_GRANTS_SQL}),
tp AS ({TOP_PRODUCTS_SQL}),
tc AS ({_TOP_GROUPS_SQL.format(col="category", label="t.category", out="category")}),
ta AS ({_TOP_GROUPS_SQL.format(col="author", label="left(trim(t.author), 12)", out="author")}),
c AS (SELECT publisher, 'toplist' AS section, COUNT(*) AS n_rows FROM tp GROUP BY publisher
      UNION ALL SELECT publisher, 'catelist', COUNT(*) FROM tc GROUP BY publisher
      UNION ALL SELECT publisher, 'topauthor', COUNT(*) FROM ta GROUP BY publisher)
SELECT c.publisher, c.section, c.n_rows FROM c
WHERE c.n_rows > 0
  AND EXISTS (SELECT 1 FROM grants g WHERE g.section = c.section AND g.who IN (c.publisher, 'all'))
""")
def publisher_sections(t: Tables):
    """Sections each publisher receives, with the row count shown in the heading."""
    counts = []
    for section, members in RIGHTS:
        # The publisher groups every section, so the filter reaches the catalog scan.
        rows = SECTIONS[section](t)
        counts.append(_counts(rows if "all" in members else rows.filter(F.col("publisher").isin(*members)), section))
    return reduce(DataFrame.unionByName, counts).select("publisher", "section", "n_rows")
