"""Token counts from distinct pre-tokens (operator 5).

Texts are normalised and cut into pre-tokens as the tokenizer's file says; no text is
ever encoded. Documents are taken in blocks. Of each block, the pre-tokens and their
per-document frequencies (a sparse matrix) are dealt by a hash of the pre-token, so that
every distinct pre-token of the corpus lives in one partition. There its pieces are
counted once, joined to the frequencies of all blocks, and summed per document; a second
shuffle adds the partial sums (four bytes per document and partition) of a block.

A frequent pre-token arrives pre-aggregated, once per block with one entry per document
that holds it, and never as one row per occurrence.

Defined cases: null and empty texts have no tokens; rows are counted one by one, so
repeated rows and null ids are fine; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import table

#: Documents and characters in a block at most (a longer text is a block of its own).
BLOCK_DOCS, BLOCK_CHARS = 4_096, 16_000_000
#: Counted pre-tokens that a task remembers; beyond, it counts again.
REMEMBERED = 2_000_000

_PARTS = "block bigint, bucket int, n_docs int, pretokens string, postings binary, doc_id array<bigint>, n_bytes array<bigint>"
_SEPARATOR = " "  # no pre-token holds white space


class PreTokens:
    """Normalisation and pre-tokenisation of a tokenizer file of the kind NFC, white space, lower case, one split pattern."""

    def __init__(self, path: str):
        import json

        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or not (split["behavior"] == "Removed" and split["invert"]):
            raise ValueError(f"not a tokenizer of this kind: {path}")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        #: Special strings in a text are one token each, as the library takes them by default.
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def __call__(self, text: str) -> list[str]:
        if self.special is not None and (parts := self.special.split(text))[1:]:
            return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            import unicodedata

            # Lower-cased letter by letter: no final form of the letter sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find(text.lower())


def _frequencies(path: str, n_buckets: int):
    """Blocks of documents to rows of (block, bucket): the bucket's pre-tokens and where they occur how often."""

    def run(batches):
        import zlib
        from itertools import count

        import numpy as np

        pre = PreTokens(path)
        first = TaskContext.get().partitionId() << 24

        class Numbers(dict):
            def __missing__(self, piece):
                self[piece] = n = len(self)
                return n

        def rows(block, ids, sizes, held, numbers):
            n = len(ids)
            lengths = np.fromiter(map(len, held), np.int64, n)
            pairs = np.concatenate(held) * np.int64(n) + np.repeat(np.arange(n), lengths) if n else np.zeros(0, np.int64)
            pairs, times = np.unique(pairs, return_counts=True)
            piece, doc = pairs // max(n, 1), pairs % max(n, 1)
            names = np.array([*numbers, None], dtype=object)[:-1]
            bucket = np.fromiter((zlib.crc32(p.encode()) % n_buckets for p in numbers), np.int32, len(numbers))
            order = np.argsort(bucket[piece], kind="stable")
            piece, doc, times = piece[order], doc[order], times[order]
            edges = np.searchsorted(bucket[piece], np.arange(n_buckets + 1))
            out = [(block, block % n_buckets, n, None, None, ids, sizes)]
            for b in range(n_buckets):
                lo, hi = edges[b], edges[b + 1]
                if hi > lo:
                    own, local = np.unique(piece[lo:hi], return_inverse=True)
                    # Sorted by piece: steps of 0 and 1, and document and count columns apart, pack well.
                    packed = b"".join((np.diff(local, prepend=0).astype(np.uint8).tobytes(), doc[lo:hi].astype("<u2").tobytes(),
                                       times[lo:hi].astype("<u4").tobytes()))
                    out.append((block, b, n, _SEPARATOR.join(names[own]), zlib.compress(packed, 1), None, None))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(),
                                                            pa.list_(pa.int64()), pa.list_(pa.int64())))],
                names=["block", "bucket", "n_docs", "pretokens", "postings", "doc_id", "n_bytes"])

        blocks = count(first)
        ids, sizes, held, numbers, chars = [], [], [], Numbers(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                pieces = pre(text)
                ids.append(doc_id)
                sizes.append(len(text.encode()))
                held.append(np.fromiter(map(numbers.__getitem__, pieces), np.int64, len(pieces)))
                chars += len(text)
                if len(ids) >= BLOCK_DOCS or chars >= BLOCK_CHARS:
                    yield rows(next(blocks), ids, sizes, held, numbers)
                    ids, sizes, held, numbers, chars = [], [], [], Numbers(), 0
        if ids:
            yield rows(next(blocks), ids, sizes, held, numbers)

    return run


def _counted(path: str):
    """Rows of (block, bucket) to the tokens they add to each document of the block."""

    def run(batches):
        import os
        import zlib

        import numpy as np
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        known: dict[str, int] = {}
        for batch in batches:
            sums = []
            for n, pretokens, postings in zip(batch.column("n_docs").to_pylist(), batch.column("pretokens").to_pylist(),
                                              batch.column("postings").to_pylist()):
                if pretokens is None:
                    sums.append(None)
                    continue
                own = pretokens.split(_SEPARATOR)
                if len(known) + len(own) > REMEMBERED:
                    known.clear()
                new = [p for p in own if p not in known]
                known.update(zip(new, map(len, tokenizer.encode_batch(new, add_special_tokens=False))))
                pieces = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
                raw = zlib.decompress(postings)
                m = len(raw) // 7
                local = np.cumsum(np.frombuffer(raw, np.uint8, m))
                doc = np.frombuffer(raw, "<u2", m, m)
                times = np.frombuffer(raw, "<u4", m, 3 * m)
                sums.append(np.bincount(doc, weights=pieces[local] * times, minlength=n).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), pa.array(sums, pa.binary()), batch.column("doc_id"), batch.column("n_bytes")],
                names=["block", "sums", "doc_id", "n_bytes"])

    return run


def _summed(block: pa.Table) -> pa.Table:
    """All partial sums of a block, added up."""
    import numpy as np

    ids = next(x for x in block.column("doc_id").to_pylist() if x is not None)
    sizes = next(x for x in block.column("n_bytes").to_pylist() if x is not None)
    total = np.zeros(len(ids), np.int64)
    for part in block.column("sums").to_pylist():
        if part is not None:
            total += np.frombuffer(part, "<i8")
    return pa.table([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(total, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer_path: str, n_buckets: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row. ``n_buckets`` is in how many parts the vocabulary of the corpus is
    held (default: the session's shuffle partitions); each part has to fit in a task."""
    spark = docs.sparkSession
    buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = docs.select("doc_id", "text").mapInArrow(_frequencies(tokenizer_path, buckets), _PARTS)
    counted = (parts.repartition(buckets, "bucket").drop("bucket")
               .mapInArrow(_counted(tokenizer_path), "block bigint, sums binary, doc_id array<bigint>, n_bytes array<bigint>"))
    return counted.groupBy("block").applyInArrow(_summed, "doc_id bigint, n_bytes bigint, n_tokens bigint")


#: A document of more tokens is over the limit.
LIMIT = 2_048


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
