"""Balanced contiguous shards from global byte-size prefix sums (operator 6, native).

Rows are put in order of their id by a range shuffle of narrow rows (id, size,
checksum); texts are never shuffled. Each range partition is summed up, the totals
(one row per partition) are accumulated into offsets, and a row's offset plus its
prefix sum inside the partition is its global byte position. The byte line is cut
at equal targets; a row belongs to the shard that holds its middle byte, so a cut
is off by half a row at most.

The ranged rows are checkpointed once: both the totals and the prefix sums read the
same partitions, whatever range bounds a second run would have sampled.

Defined cases: a null text has size ``overhead`` and checksum 0; a null id sorts
first; rows alike in id, checksum and size are told apart by their place in the
input, so repeated rows are spread over range partitions like any others; fewer
rows than shards leave shards empty; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm.common import checkpointed, table


def balanced_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                    overhead: int = 16) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, slot (from 0 within the shard),
    global_row and start (first byte on the global line)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("at"),
    )
    order = ["doc_id", "text_crc32", "size", "at"]
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))

    # One row per range partition: bounded by the number of shuffle partitions.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
                F.sum("bytes").over(W.partitionBy()).alias("total"))
    )
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        ranged.withColumns({"upto": F.sum("size").over(inside), "nth": F.count(F.lit(1)).over(inside)})
        .join(F.broadcast(offsets), "part")
        .select("doc_id", "size", "text_crc32",
                (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("start"),
                (F.col("rows_before") + F.col("nth") - 1).alias("global_row"), "total")
        .withColumn("shard", F.expr(f"CAST(least({n_shards - 1}, ((2 * start + size) * {n_shards}) DIV (2 * total)) AS INT)"))
    )
    # One row per shard.
    firsts = placed.groupBy("shard").agg(F.min("global_row").alias("first_row"))
    return (placed.join(F.broadcast(firsts), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("global_row") - F.col("first_row")).alias("slot"),
                    "global_row", "start"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = balanced_shards(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


# CRC-32 bit by bit over the bytes of the text (reflected polynomial 0xEDB88320).
ORACLE = """
WITH RECURSIVE bits(i, v, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), steps AS (SELECT list(v ORDER BY i) AS crc FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
         hex(encode(coalesce(text, ''))) AS h
  FROM documents
), c AS (
  SELECT doc_id, size, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda p: ('0x' || substr(h, p, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM d, steps
), p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start,
         row_number() OVER (ORDER BY doc_id, text_crc32, size) AS g, sum(size) OVER () AS total
  FROM c
), s AS (
  SELECT *, least(39, ((2 * start + size) * 40) // (2 * total))::INT AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY g) - 1 AS slot,
       CAST(NULL AS INT) AS grown_shard
FROM s
"""
