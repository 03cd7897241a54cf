"""Merkle manifest of a data set, its leaves placed by bitmap ranks (operator 13).

Every source has a tree whose leaves ascend by id, and the sources' roots are the leaves of one more tree.

* Rank index. The ids of a source are a compressed bitmap: one 64-bit word per stretch of 64 ids that
  holds any (``bit_or`` of single bits, merged from all tasks). Popcounts of the words are the last
  level of a directory that has a fan-out of 2^16 and sums upwards; a word's start is the sum of the counts before it
  at each level. A leaf's slot is its word's start plus the popcount of the lower bits: leaves are never
  sorted, and no window holds more than 65,536 directory rows.
* Slot arrays. Leaves are gathered into arrays keyed by slot div 3^6; an array reduces six levels at once,
  and the node it leaves is an element of an array of the next step, until each tree has one node.
* Proofs come down the same arrays: the siblings of an element, level by level, then those of its array's node.

Jobs: written arrays of each step (a checkpoint), so a lost executor repeats one step.

Defined cases: a null id sorts first in its source and is never tampered with; rows of one id are placed by
their digests (equal rows in any order), each with a slot of its own, by counting over range partitions;
a null source is a source, the first; a lone leaf is its subroot, a lone subroot the root; an empty
table has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm.common import checkpointed, table
from shelfwise.operators.sequence import group_sequence

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one slot array reduces, and nodes in a run.
STEP, RUN = 6, 3
#: Directory: bits of the ids of a word, then of each level's fan-out.
WORD_BITS, FAN_BITS, TOP_LEVELS = 6, 16, 3

_POWERS = [RUN**k for k in range(40)]


def digest_of(values: Sequence[Column]) -> Column:
    """Hex SHA-256 of values told apart by their byte counts."""
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
             for v in (value.cast("string") for value in values)]
    return F.sha2(F.concat(*parts), 256)


def leaf_rows(docs: DataFrame, changed: Column | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """doc_id, tree (the source as a key whose order has null first), leaf, and ``altered``: the digest with ``changed`` in
    place of the text, null where the text stays as it is."""
    columns = [F.col(c) for c in fields]
    altered = F.lit(None).cast("string")
    if changed is not None:
        altered = F.when(changed != F.col("text"), digest_of([changed if c == "text" else F.col(c) for c in fields]))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"),
        digest_of(columns).alias("leaf"), altered.alias("altered"),
    )


def rank_index(rows: DataFrame) -> DataFrame:
    """The bitmap words of each tree with their starts: tree, word, bits, n (rows of the word), start."""
    words = checkpointed(
        rows.groupBy("tree", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count(F.lit(1)).alias("n")))
    levels = [words.select("tree", F.col("word").alias("at"), "n")]
    for _ in range(TOP_LEVELS):
        levels.append(levels[-1].groupBy("tree", F.shiftright("at", FAN_BITS).alias("at")).agg(F.sum("n").alias("n")))
    # The highest level has 2^10 entries a tree at most.
    starts = levels[-1].select("tree", "at", _before(["tree"], "at").alias("start"))
    for level in reversed(levels[:-1]):
        inside = level.select("tree", "at", F.shiftright("at", FAN_BITS).alias("_up"),
                              _before(["tree", F.shiftright("at", FAN_BITS)], "at").alias("_inside"))
        above = starts.select("tree", F.col("at").alias("_up"), F.col("start").alias("_start"))
        starts = inside.join(above, ["tree", "_up"]).select("tree", "at", (F.col("_start") + F.col("_inside")).alias("start"))
    return checkpointed(words.join(starts.withColumnRenamed("at", "word"), ["tree", "word"]))


def _before(group: list, order: str) -> Column:
    """Rows counted by the directory entries before one, among its siblings."""
    return F.coalesce(F.sum("n").over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def with_slots(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (doc_id, tree, leaf, altered) with ``slot``, and (tree, size)."""
    low = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    rows = rows.withColumns({"word": F.shiftright(low, WORD_BITS), "bit": low.bitwiseAND(2**WORD_BITS - 1).cast("int")})
    index = rank_index(rows)
    sizes = index.groupBy("tree").agg(F.sum("n").alias("size"))
    joined = rows.join(index, ["tree", "word"])
    regular = F.col("n") == F.expr("bit_count(bits)")
    names = ["doc_id", "tree", "leaf", "altered", "slot"]
    placed = joined.filter(regular).withColumn("slot", F.expr("start + bit_count(bits & ~shiftleft(-1L, bit))")).select(*names)
    if not index.filter(~regular).isEmpty():
        # Words with an id that several rows share: their rows are numbered over range partitions.
        shared = joined.filter(~regular).withColumn("_at", F.monotonically_increasing_id())
        shared = group_sequence(shared, ["tree", "word"], ["doc_id", "leaf", "altered", "_at"], "_nth")
        placed = placed.unionByName(shared.withColumn("slot", F.col("start") + F.col("_nth") - 1).select(*names))
    return placed, sizes


def _height(size: Column) -> Column:
    """Levels above the leaves."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < size))


_WIDTH = RUN**STEP
_STEPS = f"array({', '.join(map(str, range(STEP)))})"
_UPWARD = f"""
aggregate(slice({_STEPS}, 1, h), array(transform(items, x -> x.digest)), (acc, k) -> concat(acc, array(
  transform(sequence(0, CAST((size(element_at(acc, -1)) + {RUN - 1}) DIV {RUN} AS INT) - 1),
            i -> sha2(concat_ws('', slice(element_at(acc, -1), {RUN} * i + 1, {RUN})), 256)))))"""
#: Siblings of element i at level k: those before it and those after it in its run.
_Q = f"CAST(i DIV element_at(array({', '.join(map(str, _POWERS[:STEP]))}), k + 1) AS INT)"
_SIBLINGS = f"""
transform(slice({_STEPS}, 1, h), k -> named_struct(
  'pre', concat_ws('', slice(levels[k], {_Q} - {_Q} % {RUN} + 1, {_Q} % {RUN})),
  'post', concat_ws('', slice(levels[k], {_Q} + 2, {RUN - 1} - {_Q} % {RUN}))))"""


def _arrays(nodes: DataFrame, heights: DataFrame, step: int, payload: Sequence[str]) -> DataFrame:
    """tree, block, h (levels reduced here), height, items, levels, top (the node that is left)."""
    item = F.struct("slot", "digest", *payload)
    gathered = nodes.groupBy("tree", F.expr(f"slot DIV {_WIDTH}").alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    sized = gathered.join(heights, "tree").withColumn("h", F.least(F.lit(STEP), F.col("height") - STEP * step).cast("int"))
    return checkpointed(sized.withColumn("levels", F.expr(_UPWARD)).withColumn("top", F.expr("element_at(levels, -1)[0]")))


def reduce_trees(nodes: DataFrame, sizes: DataFrame, payload: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The slot arrays of every step over nodes (tree, slot, digest, payload), and (tree, root)."""
    heights = checkpointed(sizes.select("tree", _height(F.col("size")).alias("height")))
    highest = heights.agg(F.max("height")).first()[0] or 0
    steps, roots = [], []
    for step in range(max(1, -(-highest // STEP))):
        arrays = _arrays(nodes, heights, step, payload if step == 0 else ())
        steps.append(arrays)
        done = F.col("height") <= STEP * (step + 1)
        roots.append(arrays.filter(done).select("tree", F.col("top").alias("root")))
        nodes = arrays.filter(~done).select("tree", F.col("block").alias("slot"), F.col("top").alias("digest"))
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return steps, found


def paths(steps: list[DataFrame], ends: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """Of every element of the first step: tree, slot, digest, payload, path. A path is the siblings (pre, post) of each
    level up to the root; ``ends`` (tree, path) is what follows above a tree's root."""
    above = None
    for step in range(len(steps) - 1, -1, -1):
        arrays, done = steps[step], F.col("height") <= STEP * (step + 1)
        up = arrays.filter(done).join(ends.withColumnRenamed("path", "up"), "tree")
        if above is not None:
            up = up.unionByName(arrays.filter(~done).join(
                above.select("tree", F.col("slot").alias("block"), F.col("path").alias("up")), ["tree", "block"]))
        kept = ["slot", "digest", *(payload if step == 0 else ())]
        fields = ", ".join(f"'{c}', x.{c}" for c in kept)
        each = F.explode(F.expr(f"transform(items, (x, i) -> named_struct({fields}, 'own', {_SIBLINGS}))")).alias("e")
        above = (up.select("tree", "up", each)
                 .select("tree", *[F.col(f"e.{c}") for c in kept], F.concat("e.own", "up").alias("path")))
    return above


_NO_PATH = "CAST(array() AS ARRAY<STRUCT<pre: STRING, post: STRING>>)"


def manifest(docs: DataFrame, changed: Column | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, slot, leaf, subroot, root, path (siblings), altered (the leaf with the text
    ``changed``; null where it is the same)."""
    rows = checkpointed(leaf_rows(docs, changed, fields))
    placed, sizes = with_slots(rows)
    payload = ["doc_id", "altered"]
    steps, subroots = reduce_trees(placed.withColumnRenamed("leaf", "digest"), sizes, payload)

    # The tree over the sources, in the order of their keys.
    ordered = group_sequence(subroots, [], ["tree"], "nth")
    top = checkpointed(ordered.select(F.lit("").alias("tree"), (F.col("nth") - 1).alias("slot"), F.col("root").alias("digest"),
                                      F.col("tree").alias("name")))
    top_steps, top_root = reduce_trees(top, top.groupBy("tree").agg(F.count(F.lit(1)).alias("size")), ["name"])
    found = top_root.first()
    root = F.lit(found["root"] if found else None).cast("string")
    of_sources = checkpointed(paths(top_steps, top_root.select("tree", F.expr(_NO_PATH).alias("path")), ["name"])
                              .select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path"))
    leaves = paths(steps, of_sources.select("tree", "path"), payload)
    return leaves.join(of_sources.select("tree", "subroot"), "tree").select(
        "doc_id", F.expr("IF(tree = '', NULL, substr(tree, 2))").alias("source"), "slot", F.col("digest").alias("leaf"),
        "subroot", root.alias("root"), "path", "altered")


def proof_text(path: str = "path") -> Column:
    """The siblings of a path, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda level: F.concat(level["pre"], level["post"])))


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, level: F.sha2(F.concat(level["pre"], acc, level["post"]), 256))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    changed = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return (manifest(docs, changed)
            .select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(), 256).alias("proof_sha256"),
                    folded(F.coalesce("altered", "leaf")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


# CRC-32 bit by bit over the id's digits (reflected polynomial 0xEDB88320).
ORACLE = """
WITH RECURSIVE bits(i, v, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
ids AS (
  SELECT DISTINCT doc_id, hex(encode(doc_id::VARCHAR)) AS h FROM documents
), odd AS (
  SELECT doc_id, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda p: ('0x' || substr(h, p, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 2 = 0 AS tampered
  FROM ids, crc
), d AS (
  SELECT doc_id, source,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
    || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') END AS cut,
    tampered
  FROM documents JOIN odd USING (doc_id)
), leaf AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256(head || tail) AS leaf,
    CASE WHEN tampered THEN sha256(head || cut) ELSE sha256(head || tail) END AS used,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS slot, count(*) OVER (PARTITION BY source) AS size
  FROM d
), node(lvl, tree, slot, digest, size) AS (
  SELECT 0, tree, slot, leaf, size FROM leaf
  UNION ALL
  SELECT lvl + 1, tree, slot // 3, sha256(string_agg(digest, '' ORDER BY slot)), (size + 2) // 3
  FROM node WHERE size > 1 GROUP BY lvl, tree, slot // 3, size
), sub AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS slot, count(*) OVER () AS size,
    lvl AS height FROM node WHERE size = 1
), top(lvl, slot, digest, size) AS (
  SELECT 0, slot, subroot, size FROM sub
  UNION ALL
  SELECT lvl + 1, slot // 3, sha256(string_agg(digest, '' ORDER BY slot)), (size + 2) // 3
  FROM top WHERE size > 1 GROUP BY lvl, slot // 3, size
), sibling AS (
  SELECT l.doc_id, n.lvl, string_agg(n.digest, '' ORDER BY n.slot) FILTER (n.slot < l.slot // (3 ** n.lvl)::BIGINT) AS pre,
    string_agg(n.digest, '' ORDER BY n.slot) FILTER (n.slot > l.slot // (3 ** n.lvl)::BIGINT) AS post
  FROM leaf l JOIN node n ON n.tree = l.tree AND n.size > 1 AND n.slot // 3 = (l.slot // (3 ** n.lvl)::BIGINT) // 3
  GROUP BY l.doc_id, n.lvl
  UNION ALL
  SELECT l.doc_id, s.height + n.lvl, string_agg(n.digest, '' ORDER BY n.slot) FILTER (n.slot < s.slot // (3 ** n.lvl)::BIGINT),
    string_agg(n.digest, '' ORDER BY n.slot) FILTER (n.slot > s.slot // (3 ** n.lvl)::BIGINT)
  FROM leaf l JOIN sub s ON s.tree = l.tree JOIN top n ON n.size > 1 AND n.slot // 3 = (s.slot // (3 ** n.lvl)::BIGINT) // 3
  GROUP BY l.doc_id, s.height, n.lvl
), proof AS (
  SELECT doc_id, sha256(string_agg(coalesce(pre, '') || coalesce(post, ''), '' ORDER BY lvl)) AS proof_sha256
  FROM sibling GROUP BY doc_id
), fold(doc_id, lvl, digest) AS (
  SELECT doc_id, 0, used FROM leaf
  UNION ALL
  SELECT f.doc_id, f.lvl + 1, sha256(coalesce(s.pre, '') || f.digest || coalesce(s.post, ''))
  FROM fold f JOIN sibling s ON s.doc_id = f.doc_id AND s.lvl = f.lvl
), folded AS (
  SELECT doc_id, arg_max(digest, lvl) AS folded_root FROM fold GROUP BY doc_id
)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root,
  f.folded_root = r.digest AS verified
FROM leaf l JOIN sub s ON s.tree = l.tree JOIN top r ON r.size = 1 JOIN folded f ON f.doc_id = l.doc_id
LEFT JOIN proof p ON p.doc_id = l.doc_id
"""
