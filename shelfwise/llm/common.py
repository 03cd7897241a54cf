"""Helpers shared by the training-data operators: tables, words, checkpoints."""

from __future__ import annotations

import gc
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import checkpoint_dir

#: A word, after A-Z are lower-cased: a run of digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in a text as it stands, before A-Z are lower-cased.
WORD_ANY = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, nothing else (``lower`` would also change other letters)."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(lowered: Column) -> Column:
    """The words of a lower-cased text in order; an empty array for a null text."""
    return F.regexp_extract_all(F.coalesce(lowered, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the cluster's shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of finished steps.

    It does so once the driver's garbage collector finds them unreferenced, which an idle driver may put off
    for half an hour; jobs of many steps would hold them all on the executors' disks till then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column that is computed once per row.

    A plain column is copied into every filter that is pushed below it (and into lambdas, where it would run
    per element); the output of a generator is not."""
    return df.select("*", F.explode(F.array(value)).alias(name))
