"""WARC derivatives: metadata and plain-text conversion records of responses (operator 7).

Each response record gives two records that point back to it: a ``conversion`` record with
the visible text of the page, and a ``metadata`` record, a JSON object with the response's
own WARC and HTTP headers, its title and its links. Both carry WARC-Refers-To with the
response's record id, its target URI and date, and digests: their own block digest, and the
response's payload digest, checked against the payload. Record ids follow from the
response's id and the kind, so a repeated run gives the same records.

Records are read from and written to WARC files (any version 1.x) with Spark's text source, which cuts them wherever
a version string stands, in a header or in a payload. Narrow rows (place, length, declared length of each piece) say
what the pieces are, whichever splits they came from: a header is sound when the block that it declares ends where another
header or the file ends; pieces inside a sound record are its payload and are put together again; a record that is not
sound, as one cut short, ends at the next header, which it does not swallow.

Defined cases: a response without a record id, with a null or unreadable record, or cut
short gives no derivative and is listed by ``unreadable``; bytes before a file's first header are such a row too; other record types are passed over; null
html is an empty page, a null url an empty target; repeated responses give repeated records;
empty tables give empty results; other columns are carried by ``derive`` unless their names clash.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm.common import table
from shelfwise.llm.html_text import Page
from shelfwise.session import scratch_path
from shelfwise.sources.dropfile import numbered_rows

VERSION = b"WARC/1.0\r\n"
#: What all versions that are read begin with; the rest of the version follows up to a line end.
BEGIN = b"WARC/1."
#: Date of responses that are made from a table without dates.
DATE = "2024-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[list[tuple[str, str]], bytes, bool]:
    """Headers in order, block, and whether the block is as long as it says."""
    if raw.startswith(BEGIN):
        raw = raw.partition(b"\r\n")[2]
    head, found, rest = raw.partition(b"\r\n\r\n")
    headers = headers_of(head)
    length = dict((k.lower(), v) for k, v in headers).get("content-length", "")
    if not found or not length.isdigit():
        return headers, b"", False
    return headers, rest[:int(length)], len(rest) >= int(length)


def headers_of(head: bytes) -> list[tuple[str, str]]:
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    return [(k.strip(), v.strip()) for k, colon, v in (line.partition(":") for line in lines) if colon]


def response(key: str, url: str, body: bytes, date: str = DATE) -> bytes:
    """A response record of an HTML page; its record id follows from ``key``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http + body
    return record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"),
                   ("WARC-Date", date), ("WARC-Target-URI", " ".join(url.split())), ("WARC-Payload-Digest", digest(body)),
                   ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")], block)


def derivatives(raw: bytes | None) -> list[dict] | None:
    """The two records of a response; none for another type; None for what cannot be read."""
    if raw is None:
        return None
    headers, block, whole = parse(raw)
    own = {k.lower(): v for k, v in headers}
    if not whole or not own.get("warc-record-id") or "warc-type" not in own:
        return None
    if own["warc-type"].lower() != "response":
        return []
    head, _, body = block.partition(b"\r\n\r\n")
    status, _, fields = head.partition(b"\r\n")
    http = headers_of(fields)
    kind = dict((k.lower(), v) for k, v in http).get("content-type", "")
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)
    try:
        text = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:  # a charset that nobody knows
        text = body.decode("utf-8", "replace")
    payload = digest(body)
    stated = own.get("warc-payload-digest")
    page = Page(text)
    blocks = {
        "conversion": ("text/plain", "\n".join(b[0] for b in page.blocks)),
        "metadata": ("application/json", json.dumps({
            "warc": [list(h) for h in headers], "status": status.decode("utf-8", "replace"), "http": [list(h) for h in http],
            "payload_digest": payload, "payload_digest_stated": stated, "payload_digest_agrees": stated in (None, payload),
            "title": page.title, "links": page.links}, ensure_ascii=False)),
    }
    out = []
    for name, (content_type, content) in blocks.items():
        data = content.encode()
        ident = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, own['warc-record-id'] + '#' + name)}>"
        out.append({"warc_type": name, "record_id": ident, "refers_to": own["warc-record-id"],
                    "target_uri": own.get("warc-target-uri", ""), "warc_date": own.get("warc-date", ""), "content_type": content_type,
                    "block_digest": digest(data), "source_payload_digest": payload, "content": content,
                    "record": record([("WARC-Type", name), ("WARC-Record-ID", ident), ("WARC-Date", own.get("warc-date", "")),
                                      ("WARC-Target-URI", own.get("warc-target-uri", "")), ("WARC-Refers-To", own["warc-record-id"]),
                                      ("WARC-Refers-To-Target-URI", own.get("warc-target-uri", "")),
                                      ("WARC-Refers-To-Date", own.get("warc-date", "")), ("WARC-Block-Digest", digest(data)),
                                      ("WARC-Source-Payload-Digest", payload), ("Content-Type", content_type)], data)})
    return out


_FIELDS = ["warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "source_payload_digest", "content"]


def _carried(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def derive(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Two rows per response: the other columns of ``records``, the record's fields, its text ``content`` and whole ``record``."""
    names = [c for c in records.columns if c != record_col and c not in (*_FIELDS, "record")]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                made = [(i, d) for i, raw in enumerate(part.column(record_col).to_pylist()) for d in derivatives(raw) or ()]
                at = pa.array([i for i, _ in made], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n).take(at) for n in names), *(pa.array([d[f] for _, d in made], pa.string()) for f in _FIELDS),
                     pa.array([d["record"] for _, d in made], pa.binary())], names=[*names, *_FIELDS, "record"])

    return records.mapInArrow(run, f"{_carried(records, names)}{', '.join(f + ' string' for f in _FIELDS)}, record binary")


def unreadable(records: DataFrame, record_col: str = "record") -> DataFrame:
    """The rows of ``records`` that give no derivative because they cannot be read."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([derivatives(raw) is None for raw in batch.column(record_col).to_pylist()], pa.bool_()))

    return records.mapInArrow(run, records.schema)


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record): every page (page_id, url, html) as a response record."""
    rows = pages.select("page_id", "url", "html")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                made = [response(f"{i}|{u}", u or "", (h or "").encode()) for i, u, h in zip(*(part.column(n).to_pylist() for n in ("page_id", "url", "html")))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(made, pa.binary())], names=["page_id", "record"])

    return rows.mapInArrow(run, f"{_carried(rows, ['page_id'])}record binary")


def write_warc(records: DataFrame, path: str, record_col: str = "record") -> None:
    """WARC files (gzip) in folder ``path``, one per partition."""
    body = F.expr(f"CAST(substring(`{record_col}`, 1, length(`{record_col}`) - 2) AS STRING)")
    records.select(body.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record): the records of WARC files, plain (split among tasks) or gzip, whole or as far as they go."""
    begin = BEGIN.decode()
    raw = (spark.read.option("lineSep", begin).text(path)
           .select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("_id")))
    # Spark's regexes and string functions see the head as text; lengths are bytes. A piece that follows a version string
    # begins with the rest of the version, then the header's fields.
    head = F.substring_index("value", "\r\n\r\n", 1)
    narrow = numbered_rows(raw.select(
        "file_path", "block", "_id", F.octet_length("value").alias("n"), F.octet_length(head).alias("head"),
        (head.rlike(r"^[0-9]+\r\n") & head.rlike(r"(?i)\nWARC-Type[ \t]*:")).alias("typed"),
        F.regexp_extract(head, r"(?i)\nContent-Length[ \t]*:[ \t]*(\d{1,18})[ \t]*(\r|$)", 1).try_cast("bigint").alias("declared")
    ).withColumn("keep_id", F.col("_id"))).withColumnRenamed("keep_id", "id")
    # The first piece of a file stands before the first version string.
    by_place = W.partitionBy("file_path").orderBy("line_no")
    placed = narrow.withColumns({
        "at": F.sum(F.col("n") + len(begin)).over(by_place) - F.col("n") - 2 * len(begin),
        "size": F.sum("n").over(W.partitionBy("file_path")) + len(begin) * (F.count(F.lit(1)).over(W.partitionBy("file_path")) - 1),
    }).withColumn("header", (F.col("line_no") > 1) & F.col("typed") & (F.col("head") < F.col("n")))
    placed = placed.withColumn("ends", F.when(F.col("header"), F.col("at") + len(begin) + F.col("head") + 4 + F.col("declared") + 4))
    # Sound: the declared block ends at another header, or with the file (the last line ends may be missing).
    places = placed.filter("header").select(F.col("file_path").alias("f"), F.col("at").alias("next"))
    placed = placed.join(places, (F.col("file_path") == F.col("f")) & (F.col("ends") == F.col("next")), "left")
    placed = placed.withColumn("sound", F.coalesce(F.col("next").isNotNull() | F.col("ends").between(F.col("size"), F.col("size") + 4), F.lit(False)))
    covered = F.max(F.when(F.col("sound"), F.col("ends"))).over(by_place.rowsBetween(W.unboundedPreceding, -1))
    placed = placed.withColumn("starts", (F.col("line_no") == 1) | (F.col("header") & (F.coalesce(covered, F.lit(0)) <= F.col("at"))))
    placed = placed.withColumn("of", F.max(F.when(F.col("starts"), F.col("line_no"))).over(by_place))
    pieces = F.count(F.lit(1)).over(W.partitionBy("file_path", "of"))
    # Pieces that are not a record by themselves: few, and narrow.
    marks = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    placed.withColumn("pieces", pieces).filter((F.col("pieces") > 1) | (F.col("line_no") == 1)).select("id", "file_path", "of", "line_no").write.parquet(marks)
    parts = spark.read.parquet(marks).select(F.col("id").alias("_id"), F.col("file_path").alias("of_file"), "of", "line_no")
    data = raw.select("_id", F.col("value").cast("binary").alias("piece"))
    version = F.lit(bytearray(BEGIN))
    alone = data.join(parts.select("_id"), "_id", "left_anti").select(F.concat(version, "piece").alias("record"))
    joined = (data.join(parts, "_id").groupBy("of_file", "of").agg(F.sort_array(F.collect_list(F.struct("line_no", "piece"))).alias("p"))
              .withColumn("record", F.aggregate(F.slice("p", 2, F.size("p")), F.element_at("p", 1)["piece"], lambda acc, x: F.concat(acc, version, x["piece"])))
              .select(F.when(F.col("of") > 1, F.concat(version, "record")).otherwise(F.col("record")).alias("record")))
    return alone.unionByName(joined).filter(F.length("record") > 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(responses(table(spark, sf_dir, "pages")))
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest",
                       "source_payload_digest", F.octet_length("content").cast("long").alias("n_bytes"),
                       F.octet_length("record").cast("long").alias("record_bytes"), F.md5("content").alias("content_md5"))
