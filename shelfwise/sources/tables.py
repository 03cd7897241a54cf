"""Parquet table access (S7) and the catalog view of a data folder."""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from shelfwise.session import fs_exists

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Tables:
    """Lazy handle on the tables of one data folder (or one catalog database).

    Each attribute is a plain scan DataFrame, so column pruning and filter
    pushdown reach it. With ``database`` the tables are read from the session
    catalog instead (``spark.table``): on a cluster that avoids listing large
    folders on every access and lets table statistics and partition pruning
    inform the plans.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, database: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.database = database

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            if self.database:
                return self.spark.table(f"{self.database}.{name}")
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)

    def register_views(self) -> None:
        """Expose every table as a temp view, for ad-hoc SQL."""
        for name in self.available:
            getattr(self, name).createOrReplaceTempView(name)

    @cached_property
    def available(self) -> list[str]:
        if self.database:
            return [n for n in TABLE_NAMES if self.spark.catalog.tableExists(f"{self.database}.{n}")]
        return [n for n in TABLE_NAMES if fs_exists(self.spark, os.path.join(self.sf_dir, f"{n}.parquet"))]


#: Table properties that name the columns of a key: the primary key, or any other one.
PRIMARY_KEY, OTHER_KEYS = "key.primary", "key."


def table_spec(spark: SparkSession, database: str, table: str) -> dict | None:
    """What a load needs to know of a catalog table: ``target`` [(column, declared type)] in order, ``keys``,
    and ``types``, what Spark stores each column as.

    Columns and types come from the session catalog. Keys are table properties: ``key.primary = 'a,b'``, else the
    last-named of the other ``key.<name>`` properties, else none. None for a table that does not exist.
    """
    name = f"`{database}`.`{table}`" if database else f"`{table}`"
    if not spark.catalog.tableExists(name):
        return None
    target = []
    for row in spark.sql(f"DESCRIBE TABLE {name}").collect():
        if not row["col_name"] or row["col_name"].startswith("#"):
            break
        target.append((row["col_name"].lower(), row["data_type"]))
    properties = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    others = sorted(k for k in properties if k.startswith(OTHER_KEYS))
    key = PRIMARY_KEY if PRIMARY_KEY in properties else (others[-1] if others else None)
    return {"target": target, "keys": [c.strip().lower() for c in properties[key].split(",")] if key else [],
            "types": {f.name.lower(): f.dataType.simpleString() for f in spark.table(name).schema.fields}}


def catalog_tables(spark: SparkSession, system: tuple[str, ...] = ("information_schema", "sys", "system")) -> list[tuple[str, str]]:
    """(database, table) of the user databases, in order."""
    return sorted((d.name, t.name) for d in spark.catalog.listDatabases() if d.name not in system
                  for t in spark.catalog.listTables(d.name) if not t.isTemporary)
