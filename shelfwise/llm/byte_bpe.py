"""Byte-level BPE encoding and decoding by overlapping chunks (operator 10).

A text of at most ``chunk`` characters is one chunk and is encoded where it was read.
A longer one is cut into chunks that overlap; the chunks of all documents are
pre-tokenised in parallel, each from its own first character. A chunk may begin inside a
pre-token, so its first boundaries can be wrong; but what the pattern matches depends only
on the text from the match's start on, so from the first boundary that two neighbouring
chunks share, both agree. The chunks of a document are stitched there. Where no boundary
is shared (one pre-token covers the overlap) the pattern runs on over the joined text.
The pieces between the stitched boundaries are then encoded, each by itself.

Ids are little-endian unsigned 32-bit integers in a binary column. Decoding concatenates
the raw bytes of the ids.

Defined cases: null and empty texts have no ids; rows are told apart by their place in
the input, so repeated rows and null ids are encoded row by row; an empty table gives an
empty result; other columns are ignored by ``encode``, which carries ``keep`` columns.
"""

from __future__ import annotations

import base64
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import table

#: Characters in a chunk, and how far it runs into the next one.
CHUNK, OVERLAP = 32_768, 1_024
#: Encoded pieces that a task remembers.
REMEMBERED = 200_000
#: Rows in an outgoing batch.
BATCH = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _Encoded(dict):
    """Piece to the bytes of its ids; forgets all when full."""

    def __init__(self, encoding):
        self.encoding = encoding

    def __missing__(self, piece: str) -> bytes:
        import numpy as np

        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.asarray(self.encoding.encode_ordinary(piece), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def _encoder(ranks_path: str, pattern: str):
    import regex
    import tiktoken

    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
    return regex.compile(pattern), _Encoded(encoding)


def _stitched(chunks: list[tuple[int, str, list[int]]], find) -> tuple[str, list[int]]:
    """The whole text and the starts of its pre-tokens, from chunks of (first character, text, own starts)."""
    parts, end, starts = [], 0, []
    for first, text, own in chunks:
        parts.append(text[end - first:])
        end = max(end, first + len(text))
        if first == 0:
            starts = list(own)
            continue
        tail = bisect_left(starts, first)
        known = set(starts[tail:])
        meet = next((k for k, s in enumerate(own) if first + s in known), None)
        if meet is not None:
            del starts[bisect_left(starts, first + own[meet]):]
            starts += [first + s for s in own[meet:]]
        else:  # one pre-token covers the overlap: it may go on
            last = starts.pop()
            starts += [last + m.start() for m in find("".join(parts)[last:])]
    return "".join(parts), starts


def _short(ranks_path: str, pattern: str, keep: tuple[str, ...]):
    """Whole texts, after the ``keep`` columns, to their ids."""

    def run(batches):
        pattern_, encoded = _encoder(ranks_path, pattern)
        find, get, width = pattern_.findall, encoded.__getitem__, len(keep)
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                ids = [b"".join(map(get, find(t))) for t in part.column(width).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:width], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=[*keep, "n_tokens", "ids"])

    return run


def _starts(pattern: str):
    """Chunks to the starts of their own pre-tokens."""

    def run(batches):
        import regex

        find = regex.compile(pattern).finditer
        for batch in batches:
            own = [[m.start() for m in find(t)] for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(pa.int32()))],
                                             names=[*batch.schema.names, "_starts"])

    return run


def _stitch(ranks_path: str, pattern: str, keep: tuple[str, ...]):
    """The chunks of one text to its ids."""
    made = []  # one encoder for all groups of a task

    def run(group):
        if not made:
            made.append(_encoder(ranks_path, pattern))
        pattern_, encoded = made[0]
        group = group.sort_by("_first")
        text, at = _stitched(list(zip(group.column("_first").to_pylist(), group.column("_text").to_pylist(),
                                      group.column("_starts").to_pylist())), pattern_.finditer)
        ids = b"".join(encoded[text[a:b]] for a, b in zip(at, [*at[1:], len(text)]))
        return pa.table([*(group.column(c).slice(0, 1) for c in keep), pa.array([len(ids) // 4], pa.int64()),
                         pa.array([ids], pa.binary())], names=[*keep, "n_tokens", "ids"])

    return run


def _raw_bytes(ranks_path: str, ids_col: str = "ids"):
    """Batches with ids to the same with ``decoded``: the raw bytes of each row's ids, joined."""

    def run(batches):
        import numpy as np

        ranks = read_ranks(ranks_path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            tokens[rank] = raw
        token = tokens.__getitem__
        for batch in batches:
            back = [None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist()))
                   for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
           chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens (long) and ids (binary) of every row of ``docs``; with ``decoded``, the ids are
    decoded again in the same task."""
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)
    out = f"{schema}n_tokens bigint, ids binary{', decoded binary' * decoded}"
    short, stitch = _short(ranks_path, pattern, keep), _stitch(ranks_path, pattern, keep)
    if decoded:
        back, ids_of, ids_of_group = _raw_bytes(ranks_path), short, stitch
        short = lambda batches: back(ids_of(batches))
        stitch = lambda group: pa.Table.from_batches(back(ids_of_group(group).combine_chunks().to_batches()))
    one = rows.filter(F.length("_text") <= chunk).mapInArrow(short, out)
    cut = (
        rows.withColumn("_row", F.monotonically_increasing_id()).filter(F.length("_text") > chunk)
        .select(*keep, "_row", "_text", F.explode(F.expr(f"sequence(0, length(_text) - 1, {chunk})")).alias("_first"))
        .withColumn("_text", F.expr(f"substring(_text, _first + 1, {chunk + overlap})"))
    )
    cut_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    # The chunks of one document, which was one row of the input, meet in one group.
    many = cut.mapInArrow(_starts(pattern), f"{cut_schema}, _starts array<int>").groupBy("_row").applyInArrow(stitch, out)
    return one.unionByName(many)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the raw bytes of its ids."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_raw_bytes(ranks_path, ids_col), f"{schema}, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, **chunks) -> DataFrame:
    both = encode(docs, ranks_path, pattern, decoded=True, **chunks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
