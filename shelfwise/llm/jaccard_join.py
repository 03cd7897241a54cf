"""N-gram Jaccard self-join with a MinHash LSH forest (operator 8).

Texts become sets of ``n``-word shingles; texts of equal sets are one class. Each class
has a MinHash signature, cut into the labels of ``TREES`` prefix trees. A tree is kept
sorted by label, so classes below one trie node are neighbours. The matched prefix starts
at the whole label and is shortened, level by level, until pairs at the threshold are
expected to share a prefix in some tree with the target recall; classes below a node at that
depth are candidates, deeper matches first. A node of any size is whole: a large one is cut into blocks and
all pairs of blocks are compared.

Candidates whose signatures agree too little are dropped (a pair at the threshold is
dropped with a chance of about 2e-6). What remains is grouped by connected components, and
inside a component all pairs are verified on the shingle sets, again in blocks: links are
counted exactly and sent on as a spanning forest, never as pairs.

Defined cases: a text of fewer than ``n`` words but not none is one shingle; null texts
and texts without a word link with nothing and stay; equal rows are rows of one class;
rows of a null id take part, and such an id names a class or component only if it has no other; an
empty table gives an empty result; other columns are ignored (``keep_one`` keeps them).
"""

from __future__ import annotations

from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import WORD_ANY, checkpointed, lower_ascii, release, table, words
from shelfwise.llm.graph import Forest, block_pairs, components, in_groups

N, THRESHOLD = 5, "0.8"
#: Trees, hashes in a whole label, expected recall of a pair at the threshold, agreeing hashes a candidate needs.
TREES, LABEL, RECALL, AGREE = 16, 4, 0.9999, 35
#: Classes in a block of candidates; classes and shingles in a block that is verified; seed.
BLOCK, BLOCK_SETS, BLOCK_SHINGLES, SEED = 1_024, 1_024, 1_000_000, 3


def prefix_depth(threshold: float, trees: int = TREES, label: int = LABEL, recall: float = RECALL) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree with the target recall (1 at least)."""
    depth = label
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def hashed_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, hashes): a row's identity and the hashes of its words in order."""
    return docs.select("doc_id", F.md5(F.col(text_col)).alias("text_key"),
                       F.transform(words(lower_ascii(F.col(text_col))), lambda w: F.xxhash64(w)).alias("hashes"))


def _shingles(lists, n: int):
    """Arrow lists of word hashes to the sorted distinct shingles of each."""
    import numpy as np

    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    odd, out = np.uint64(0x9E3779B97F4A7C15), []
    for lo, hi in zip(ends[:-1], ends[1:]):
        h = flat[lo:hi]
        if not len(h):
            out.append(np.zeros(0, np.uint64))
            continue
        width = min(n, len(h))
        s = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            s = (s ^ h[k:len(h) - width + 1 + k]) * odd
            s ^= s >> np.uint64(29)
        out.append(np.unique(s))
    return out


def _signatures(n: int, hashes: int, seed: int):
    def run(batches):
        import hashlib

        import numpy as np

        rng = np.random.default_rng(seed)
        times = rng.integers(1, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        plus = rng.integers(0, 2**63, hashes, dtype=np.uint64)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = _shingles(part.column("hashes"), n)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                some = np.flatnonzero(sizes)
                signed = np.zeros((len(sets), hashes), ">u4")
                if len(some):
                    flat = np.concatenate([sets[i] for i in some])
                    starts = np.cumsum(sizes[some]) - sizes[some]
                    for j in range(hashes):
                        signed[some, j] = np.minimum.reduceat(flat * times[j] + plus[j], starts) >> np.uint64(32)
                keys = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array([signed[i].tobytes() if sizes[i] else None for i in range(len(sets))], pa.binary())],
                    names=["doc_id", "text_key", "class", "n_shingles", "signature"])

    return run


def _agreeing(agree: int):
    """Classes below a trie node to a spanning forest of those whose signatures agree."""

    def work(rows: pa.Table):
        import numpy as np

        signed = np.stack([np.frombuffer(s, ">u4") for s in rows.column("signature").to_pylist()]).astype(np.uint32)
        names, own = rows.column("class").to_pylist(), np.array(rows.column("own"))
        apart = rows.column("bi")[0].as_py() != rows.column("bj")[0].as_py()
        forest = Forest(len(names))
        for i in range(len(names) - 1):  # sorted by label: the deepest matches meet first
            rest = i + 1 + np.flatnonzero(forest.label[i + 1:] != forest.label[i])
            if apart:
                rest = rest[own[rest] != own[i]]
            if len(rest):
                near = rest[(signed[rest] == signed[i]).sum(1) >= agree]
                if len(near):
                    forest.link(i, near)
        if forest.edges:
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in c], pa.binary()) for c in zip(*forest.edges)], names=["a", "b"])

    return work


def _verified(n: int, share: Fraction):
    """Members of a pair of blocks, with their word hashes, to rows and classes linked, and to a spanning forest of links."""
    num, den = share.numerator, share.denominator

    def work(rows: pa.Table):
        import numpy as np

        names, own, weight = rows.column("class").to_pylist(), np.array(rows.column("own")), np.array(rows.column("n"))
        sets = _shingles(rows.column("hashes"), n)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        bi, bj = rows.column("bi")[0].as_py(), rows.column("bj")[0].as_py()
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, piece, held = np.unique(every, return_inverse=True, return_counts=True)
        # Postings: for each shingle, the rows that hold it.
        order = np.argsort(piece, kind="stable")
        posted, ends = owner[order], np.cumsum(held)
        first = np.cumsum(sizes) - sizes
        forest = Forest(len(sets))
        links, classes = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        for i in range(len(sets)):
            pieces = piece[first[i]:first[i] + sizes[i]]
            pieces = pieces[held[pieces] > 1]
            if not len(pieces):
                continue
            common = np.bincount(np.concatenate([posted[ends[p] - held[p]:ends[p]] for p in pieces]), minlength=len(sets))
            near = common * den >= num * (sizes[i] + sizes - common)
            near[i] = False
            if bi != bj:
                near &= own != own[i]
            near = np.flatnonzero(near)
            if len(near):
                links[i], classes[i] = weight[near].sum(), len(near)
                forest.link(i, near)
        linked = np.flatnonzero(classes)
        if len(linked):
            a, b = list(zip(*forest.edges))
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in linked] + [names[k] for k in a], pa.binary()),
                 pa.array(links[linked].tolist() + [0] * len(a)), pa.array(classes[linked].tolist() + [0] * len(a)),
                 pa.array([None] * len(linked) + [names[k] for k in b], pa.binary())],
                names=["class", "links", "class_links", "other"])

    return work


def similar_texts(docs: DataFrame, n: int = N, threshold: str = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_key (md5 of the text), class_id (smallest id of its class),
    n_links (other rows linked, copies included), n_class_links (other classes linked), component_id (smallest id
    reachable by links) and kept (one text of each component)."""
    share = Fraction(threshold)
    depth = prefix_depth(float(share), recall=recall)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    features = checkpointed(hashed_words(docs).mapInArrow(
        _signatures(n, TREES * LABEL, SEED), f"doc_id {id_type}, text_key string, class binary, n_shingles bigint, signature binary"))
    # Which row stands for others: the smallest id, null last, then the smallest text key.
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = checkpointed(
        features.filter(F.col("class").isNotNull()).groupBy("class")
        .agg(F.min(who).alias("who"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"),
             F.first("signature").alias("signature")))

    # Trie nodes at the depth, with more than one class.
    nodes = classes.select("class", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "signature").select(
        "class", "tree", F.expr(f"xxhash64(substring(signature, tree * {4 * LABEL} + 1, {4 * depth}))").alias("node"))
    shared = nodes.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    entries = (nodes.join(shared, ["tree", "node"]).join(classes.select("class", "signature"), "class")
               .withColumn("label", F.expr(f"substring(signature, tree * {4 * LABEL} + 1, {4 * LABEL})")))
    blocks = block_pairs(entries, ["tree", "node"], "class", F.ceil(F.col("size") / BLOCK))
    candidates = in_groups(blocks.select("tree", "node", "bi", "bj", "own", "label", "class", "signature"),
                           ["tree", "node", "bi", "bj"], ["label"], _agreeing(AGREE), "a binary, b binary")
    grouped = checkpointed(components(candidates)).select(F.col("node").alias("class"), F.col("component").alias("grp"))
    del nodes, shared, entries, blocks, candidates
    release(docs.sparkSession)

    # The texts of the candidates' classes, one text each; all others end at this join.
    sizes = (grouped.join(classes, "class").groupBy("grp")
             .agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("weight")))
    chosen = grouped.join(classes, "class").join(sizes, "grp").select(
        "grp", "class", "n", "size", "weight", row_key(F.col("who.doc_id"), F.col("who.text_key")).alias("_row"))
    texts = docs.select(row_key(F.col("doc_id"), F.md5("text")).alias("_row"), "text").join(chosen, "_row").dropDuplicates(["_row"])
    parts = block_pairs(texts.select("grp", "class", "n", "size", "weight", "text"), ["grp"], "class",
                        F.greatest(F.ceil(F.col("size") / BLOCK_SETS), F.least(F.col("size"), F.ceil(F.col("weight") / BLOCK_SHINGLES))))
    sets = parts.select("grp", "bi", "bj", "own", "class", "n",
                        F.transform(words(lower_ascii(F.col("text"))), lambda w: F.xxhash64(w)).alias("hashes"))
    verified = checkpointed(in_groups(sets, ["grp", "bi", "bj"], ["class"], _verified(n, share),
                                      "class binary, links bigint, class_links bigint, other binary"))

    del texts, parts, sets, chosen, sizes
    release(docs.sparkSession)

    found = components(verified.filter(F.col("other").isNotNull()).select(F.col("class").alias("a"), F.col("other").alias("b")))
    counts = verified.filter(F.col("other").isNull()).groupBy("class").agg(F.sum("links").alias("links"), F.sum("class_links").alias("class_links"))
    found = checkpointed(found.withColumnRenamed("node", "class"))
    release(docs.sparkSession)
    first = found.join(classes, "class").groupBy("component").agg(F.min("who").alias("first"))
    linked = (classes.select("class", "who", "n").join(found, "class").join(first, "component").join(counts, "class")
              .select("class", "who", (F.col("links") + F.col("n") - 1).alias("n_links"), F.col("class_links").alias("n_class_links"), "first"))
    # Classes without a link are not joined on a component: its null would be one key.
    lone = classes.join(found, "class", "left_anti").select(
        "class", "who", (F.col("n") - 1).alias("n_links"), F.lit(0).cast("long").alias("n_class_links"), F.col("who").alias("first"))
    per_class = linked.unionByName(lone).withColumn("class_id", F.col("who.doc_id")).drop("who")
    together = features.filter(F.col("class").isNotNull()).select("doc_id", "text_key", "class").join(per_class, "class").select(
        "doc_id", "text_key", "class_id", "n_links", "n_class_links", F.col("first.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).alias("kept"))
    none = F.lit(0).cast("long")
    alone = features.filter(F.col("class").isNull()).select(
        "doc_id", "text_key", F.col("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_class_links"),
        F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return together.unionByName(alone)


def row_key(doc_id: Column, text_key: Column) -> Column:
    """Names a row by its id and text; null for a null text."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), text_key)


def keep_one(docs: DataFrame, n: int = N, threshold: str = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component of similar texts; texts without a word stay. Columns stay as they are."""
    stays = similar_texts(docs, n, threshold).filter("kept").select(row_key(F.col("doc_id"), F.col("text_key")).alias("_row")).distinct()
    has_words = F.coalesce(F.col("text").rlike(WORD_ANY), F.lit(False))
    # Rows alike in id and text are copies of one another: one of them stays.
    one = (docs.filter(has_words).withColumn("_row", row_key(F.col("doc_id"), F.md5("text")))
           .join(stays, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row"))
    return one.unionByName(docs.filter(~has_words))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(table(spark, sf_dir, "documents")).drop("text_key")


#: Exact over all pairs of distinct shingle sets that share a shingle.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
                                                       lambda i: array_to_string(w[i:i + 4], ' ')))) AS s
  FROM d WHERE len(w) > 0
), c AS (SELECT s, min(doc_id) AS class_id, count(*) AS n, len(s) AS m FROM s GROUP BY s),
x AS (SELECT class_id, m, n, unnest(s) AS g FROM c),
pairs AS (
  SELECT x.class_id AS a, y.class_id AS b, any_value(y.n) AS n
  FROM x JOIN x y ON x.g = y.g AND x.class_id <> y.class_id
  GROUP BY x.class_id, y.class_id, x.m, y.m HAVING 10 * count(*) >= 8 * (x.m + y.m - count(*))
), r AS (
  SELECT class_id AS v, class_id AS t FROM c
  UNION
  SELECT p.b, r.t FROM r JOIN pairs p ON p.a = r.v
), k AS (SELECT v AS class_id, min(t) AS component_id FROM r GROUP BY v),
l AS (SELECT a AS class_id, sum(n) AS links, count(*) AS class_links FROM pairs GROUP BY a)
SELECT s.doc_id, c.class_id, CAST(c.n - 1 + coalesce(l.links, 0) AS BIGINT) AS n_links,
       CAST(coalesce(l.class_links, 0) AS BIGINT) AS n_class_links, k.component_id, s.doc_id = k.component_id AS kept
FROM s JOIN c ON s.s = c.s JOIN k ON k.class_id = c.class_id LEFT JOIN l ON l.class_id = c.class_id
UNION ALL
SELECT doc_id, doc_id, 0, 0, doc_id, true FROM d WHERE len(w) = 0
"""
