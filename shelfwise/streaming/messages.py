"""Request messages as a stream, each handled once.

Messages (msgid, sender, receive, subject, body) arrive as files in a folder. Each is routed to a report (J24), its
product codes are extracted (F12, F29) and one audit row is appended (S23), however late it comes.

The ledger of seen messages is keyed state of the stream: an id keeps the poll that saw it first and the audit row of its first
received message there. A row is emitted when its id's first poll is the present one, so a message delivered
again changes nothing, whatever it holds by then. A batch reads and writes the state of its own ids (RocksDB, with
changelogs in the checkpoint), and appends one folder to the log: its cost does not depend on how long the log is. A batch
that is run again has the same poll time and overwrites its own folder with the same rows (X3).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.text import key_summary, product_codes
from shelfwise.plans.access_reports import route
from shelfwise.session import fs_list, fs_read_text

MESSAGE_SCHEMA = "msgid long, sender string, receive timestamp, subject string, body string"
AUDIT_COLUMNS = ("fro", "receive", "subject", "type", "key_data")
AUDIT_SCHEMA = "msgid long, fro string, receive timestamp, subject string, type string, key_data string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def audit_rows(messages: DataFrame) -> DataFrame:
    """One audit row per message: who, when, which report, and the keys it named."""
    return messages.select(
        "msgid", F.col("sender").alias("fro"), "receive", "subject",
        route(F.col("subject")).alias("type"),
        key_summary(F.array_sort(F.array_distinct(product_codes(F.col("body"))))).alias("key_data"))


def first_seen(messages: DataFrame) -> DataFrame:
    """Audit rows of a stream of messages, one for each id: that of the first received message of the poll that saw the id first."""
    seen = audit_rows(messages).withColumn("poll", F.current_timestamp())
    # Texts break ties between messages received at the same time.
    first = F.struct("poll", "receive", "fro", "subject", "type", "key_data")
    by_id = seen.groupBy("msgid").agg(F.min(first).alias("m"), F.max("poll").alias("last"))
    return by_id.filter(F.col("m.poll") == F.col("last")).select("msgid", *[F.col(f"m.{c}").alias(c) for c in AUDIT_COLUMNS])


def read_log(spark: SparkSession, audit_dir: str) -> DataFrame:
    """The audit log: the rows of all batches."""
    batches = [p for p in fs_list(spark, audit_dir) if p.rsplit("/", 1)[-1].startswith("batch-")]
    return spark.read.schema(AUDIT_SCHEMA).parquet(*batches) if batches else spark.createDataFrame([], AUDIT_SCHEMA)


def run_message_stream(spark: SparkSession, folder: str, audit_dir: str, checkpoint: str,
                       available_now: bool = True, processing_time: str = "30 seconds", max_files: int = 1_000):
    """Start the message stream (the reference polls every 30 s)."""

    def append(batch: DataFrame, batch_id: int) -> None:
        # The stream's own id keeps batches of another checkpoint apart.
        stream = json.loads(fs_read_text(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]
        batch.write.mode("overwrite").parquet(f"{audit_dir.rstrip('/')}/batch-{stream}-{batch_id:08d}")

    stream = spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(folder)
    q = first_seen(stream).writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime=processing_time)
    # State on disk with changelogs, for this query only.
    name = "spark.sql.streaming.stateStore.providerClass"
    changelog = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
    before = {n: spark.conf.get(n, None) for n in (name, changelog)}
    try:
        spark.conf.set(name, STATE_STORE)
        spark.conf.set(changelog, "true")
        return q.start()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)
