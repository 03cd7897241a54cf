"""Quality of whole texts by a byte-level convolutional network (operator 11).

A text is covered by overlapping chunks of bytes. ``FILTERS`` learned filters, each ``WIDTH`` bytes wide, run over every
chunk; a chunk keeps the largest rectified response of each filter. Two dense layers turn these into a
log-odds ratio, and the chunks of a document, weighted by their bytes, combine into one probability together with
the classes' shares among all learnable labels (the training sample holds as many rows of either class). A text shorter than a
chunk counts as that part of a chunk, so a few bytes move the shares little.

The network is trained here, in numpy, by backpropagation with Adam on a bounded sample: ``SLICES * PER_SLICE`` rows of each class at most,
the first ``PER_SLICE`` by a hash of the id in each of ``SLICES`` parts of the ids, one stretch of ``STRETCH`` characters from anywhere in the text. A filter's weights for each byte are a row of
a table, so a convolution is ``WIDTH`` look-ups a position; the tables travel with the task.

Defined cases: a null or empty text has no chunk and gets the share of label 1; without a learnable label
the score is 0.5, with one class only the smoothed share of label 1 for every text; labels other than 0 and 1, null labels and null
ids are never learned from; an id with several labels counts once with each; several texts of one id give one
training row for each label; repeated rows are scored one by one; an empty table has no rows; other
columns are kept by ``score`` and ignored by the query.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm.common import table

#: Bytes of a chunk, and from one chunk's start to the next; chunks computed at once.
CHUNK, STRIDE, TOGETHER = 256, 224, 32
WIDTH, FILTERS, HIDDEN = 6, 48, 16
#: The training sample: parts that a class is cut into by a hash of the id, rows taken from each, characters of a row.
SLICES, PER_SLICE, STRETCH = 64, 16, 2_048
#: Training: steps, documents in a step, learning rate, weight decay, seed.
STEPS, PER_STEP, RATE, DECAY, SEED = 400, 48, 0.01, 1e-4, 5
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learnable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of labelled documents outside the held-out fold."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
            .filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
            .distinct().join(ids, "doc_id", "left_semi"))


def training_sample(docs: DataFrame, labelled: DataFrame, per_slice: int = PER_SLICE, stretch: int = STRETCH) -> list[tuple[int, str]]:
    """(quality, text) of at most ``per_slice`` rows of each slice of each class, in a fixed order."""
    by_hash = W.partitionBy("quality", F.pmod("h", F.lit(SLICES))).orderBy("h", "doc_id")
    picked = (
        labelled.withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
        .withColumn("nth", F.row_number().over(by_hash)).filter(F.col("nth") <= per_slice).select("doc_id", "quality")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    piece = F.expr(f"substring(text, 1 + CAST(pmod(xxhash64(CAST(doc_id AS STRING), 3), greatest(1, length(text) - {stretch})) AS INT), {stretch})")
    # At most two classes of SLICES * per_slice ids are broadcast.
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min(piece).alias("piece"))
    return sorted((r["quality"], r["piece"]) for r in rows.select("quality", "piece").collect())


def chunks(texts: list[bytes], chunk: int = CHUNK, stride: int = STRIDE):
    """The bytes of all texts, and of each chunk: its start in them, its bytes, and whose it is. Together they cover every text."""
    import numpy as np

    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    per = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - chunk) // stride)), 0)
    owner = np.repeat(np.arange(len(texts)), per)
    place = (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * stride
    flat = np.frombuffer(b"".join(texts) + bytes(chunk + WIDTH), np.uint8)
    return flat, (np.cumsum(lengths) - lengths)[owner] + place, np.minimum(chunk, lengths[owner] - place), owner


class Network:
    """Filters over bytes, the largest rectified response of each in a chunk, and two dense layers."""

    def __init__(self, width: int = WIDTH, filters: int = FILTERS, hidden: int = HIDDEN, seed: int = SEED):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.width = width
        self.p = {
            "t": rng.normal(0, 0.2, (width, 256, filters)).astype(np.float32),
            "c": np.zeros(filters, np.float32),
            "v": rng.normal(0, 0.3, (filters, hidden)).astype(np.float32),
            "d": np.zeros(hidden, np.float32),
            "w": rng.normal(0, 0.3, hidden).astype(np.float32),
            "b": np.zeros(1, np.float32),
        }

    def pooled(self, flat, start, filled, where: bool = False):
        """(chunk, filter): largest response over the positions of a chunk's bytes; with the positions, if asked for."""
        import numpy as np

        # A window may reach past the chunk's bytes: into the next one's or, at the end, into padding; bytes that are not the chunk's count as 0.
        codes = flat[start[None, :] + np.arange(CHUNK + self.width - 1)[:, None]]
        short = np.flatnonzero(filled < CHUNK)
        for k in short.tolist():
            codes[filled[k]:, k] = 0
        codes[CHUNK:] = 0
        out = np.take(self.p["t"][0], codes[:CHUNK], axis=0)
        for k in range(1, self.width):
            out += np.take(self.p["t"][k], codes[k:CHUNK + k], axis=0)
        for k in short.tolist():
            out[filled[k]:, k] = -np.inf
        top = out.max(0) + self.p["c"]
        np.maximum(top, 0, out=top)
        return (top, out.argmax(0), codes) if where else top

    def log_odds(self, texts: list[bytes]):
        """Of each text: the chunks' log-odds weighted by their bytes; a text of less than a chunk has that much less evidence."""
        import numpy as np

        flat, start, filled, owner = chunks(texts)
        each = np.empty(len(start), np.float64)
        for k in range(0, len(start), TOGETHER):
            top = self.pooled(flat, start[k:k + TOGETHER], filled[k:k + TOGETHER])
            each[k:k + TOGETHER] = np.tanh(top @ self.p["v"] + self.p["d"]) @ self.p["w"] + self.p["b"][0]
        total = np.bincount(owner, weights=each * filled, minlength=len(texts))
        return total / np.maximum(CHUNK, np.bincount(owner, weights=filled, minlength=len(texts)))

    def gradients(self, texts: list[bytes], target):
        """Mean loss of the documents and its gradients."""
        import numpy as np

        flat, start, filled, owner = chunks(texts)
        top, at, codes = self.pooled(flat, start, filled, where=True)
        share = filled / np.maximum(CHUNK, np.bincount(owner, weights=filled, minlength=len(texts)))[owner]
        inner = np.tanh(top @ self.p["v"] + self.p["d"])
        odds = np.bincount(owner, weights=(inner @ self.p["w"] + self.p["b"][0]) * share, minlength=len(texts))
        prob = 1 / (1 + np.exp(-odds))
        loss = -np.mean(np.log(np.where(target == 1, prob, 1 - prob) + 1e-12))
        each = (((prob - target) / len(texts))[owner] * share).astype(np.float32)
        below = each[:, None] * self.p["w"][None, :] * (1 - inner * inner)
        back = (below @ self.p["v"].T) * (top > 0)
        grads = {"w": inner.T @ each, "b": np.array([each.sum()], np.float32), "v": top.T @ below, "d": below.sum(0),
                 "c": back.sum(0), "t": np.zeros_like(self.p["t"])}
        rows, cols = np.arange(len(start))[:, None], np.arange(top.shape[1])[None, :]
        for k in range(self.width):
            np.add.at(grads["t"][k], (codes[at + k, rows], cols), back)
        return loss, grads


def train(sample: list[tuple[int, str]], steps: int = STEPS, per_step: int = PER_STEP, rate: float = RATE, seed: int = SEED) -> Network | None:
    """The network that tells the classes apart; none when there are no texts of both."""
    import numpy as np

    sample = [(q, t.encode()) for q, t in sample if t]
    by_class = [[t for q, t in sample if q == k] for k in (0, 1)]
    if not all(by_class):
        return None
    net = Network(seed=seed)
    rng = np.random.default_rng(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    half = per_step // 2
    target = np.repeat([0, 1], half)
    for step in range(1, steps + 1):
        texts = [own[i] for own in by_class for i in rng.integers(0, len(own), half)]
        _, grads = net.gradients(texts, target)
        for k, g in grads.items():
            if k in ("t", "v", "w"):
                g = g + DECAY * net.p[k]
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            net.p[k] -= rate * (1 - 0.9 * step / steps) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return net


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Network | None, float]:
    """The network, and the log-odds of label 1 among all learnable labels."""
    import math

    labelled = learnable(docs, labels)
    count = {r["quality"]: r["n"] for r in labelled.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = training_sample(docs, labelled) if count else []
    return train(sample), math.log((count.get(1, 0) + 0.5) / (count.get(0, 0) + 0.5))


def score(docs: DataFrame, net: Network | None, prior: float, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    docs = docs.drop("score")
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        import numpy as np

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [(t or "").encode() for t in part.column(names.index(text_col)).to_pylist()]
                odds = prior + (net.log_odds(texts) if net is not None else np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-odds)), pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(run, f"{schema}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), *fitted(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
