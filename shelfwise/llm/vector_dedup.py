"""Near copies among embeddings by sorted projection passes (operator 4).

Equal vectors of a label become one class with a count. In every label, each pass gives a class
the signs of its projections on random directions, as one number whose leading bits are the
first directions; vectors are centred on their label's mean before, since signs of vectors
that share a direction are much alike. Classes are sorted by (label, number); each is compared, by cosine in
double precision, with the ``window`` classes before it, and the verified pairs of all
passes are united. A window sends on a spanning forest of its links, so a dense group
costs its rows and not its pairs. The rows at both sides of a partition's edge are compared
in a group of their own, and runs of one number longer than the window in pairs of blocks.

``schedule`` sets passes, bits and window of a label by its class count and by how far its
vectors lie from their mean, whatever its size: the cheapest way to find a pair at the threshold with the chance ``RECALL``.

What a bounded window cannot count is counted afterwards: the members of each connected
component are compared with each other in blocks, which makes ``n_links`` complete inside
components of any size without writing pairs.

Defined cases: a null label, or a vector that is null, empty, zero, or holds a null or
non-finite component, links with nothing and is its own component; vectors of different
length never link; repeated rows are rows of one class and link with each other; a null
id takes part but is never a component's id unless the component has no other, and is never kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import checkpointed, table
from shelfwise.llm.graph import Forest, block_pairs, components, in_groups

THRESHOLD = 0.98
#: Passes, signs in a number, classes compared with each, classes in a block of the exact count, seed.
PASSES, BITS, WINDOW, BLOCK, SEED = 16, 32, 64, 1_024, 5
#: Chance to find a pair at the threshold, at the mean distance from the centre; most passes, which only a label needs whose
#: vectors lie so close together that almost all of them are linked.
RECALL, MOST_PASSES = 0.9999, 128
#: A class sent once costs as much as so many comparisons.
SENT = 2_000


def schedule(n: int, spread: float, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW,
             bits: int = BITS) -> tuple[int, int, int]:
    """Passes, window and bits for a label of ``n`` classes whose unit vectors lie at a mean squared distance of ``spread``
    from their mean. The arguments are the least that is used."""
    import math

    # Chance that a pair at the threshold agrees in a sign, once centred.
    same = 1 - math.acos(max(-1.0, 1 - (1 - threshold) / max(spread, 1e-12))) / math.pi
    ways = []
    for w in (window << k for k in range(5)):
        # Signs that have to agree until a number's neighbours are a window's.
        hit = min(same ** max(0.0, math.log2(n / w)), 1 - 1e-12)
        need = math.log(1 - RECALL) / math.log1p(-hit) if hit > 1e-9 else MOST_PASSES
        p = min(MOST_PASSES, max(passes, math.ceil(need)))
        ways.append((need > MOST_PASSES, p * (w + SENT), p, w))
    _, _, p, w = min(ways)
    return p, w, min(62, max(bits, math.ceil(math.log2(max(2, n))) + 8))


def _units(column):
    """Rows of an Arrow list column as unit vectors in double precision."""
    import numpy as np

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # Scaled first: squares of very large or small components stay finite.
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _sums(batches):
    """Unit vectors to partial sums of their spaces."""
    import numpy as np

    total: dict[str, object] = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
                                          names=["space", "part"])

    for batch in batches:
        spaces = np.array(batch.column("space").to_pylist(), object)
        for space in set(spaces):
            got = _units(batch.take(pa.array(np.flatnonzero(spaces == space))).column("embedding")).sum(0)
            total[space] = total[space] + got if space in total else got
        if len(total) > 1_000:
            yield out()
            total.clear()
    if total:
        yield out()


def _scheduled(threshold: float, passes: int, window: int, bits: int):
    """Spaces (space, size, mean) with their passes, window and bits."""

    def run(batches):
        for batch in batches:
            means = batch.column("mean").to_pylist()
            set_ = [schedule(n, 1 - sum(x * x for x in m), threshold, passes, window, bits)
                    for n, m in zip(batch.column("size").to_pylist(), means)]
            yield pa.RecordBatch.from_arrays([batch.column("space"), batch.column("mean"), *(pa.array([x[k] for x in set_], pa.int32()) for k in range(3))],
                                             names=["space", "mean", "passes", "window", "bits"])

    return run


def _numbers(seed: int):
    """Classes to one row per pass, with the sorted number of the signs of their centred vectors."""

    def run(batches):
        import numpy as np

        for batch in batches:
            spaces = np.array(batch.column("space").to_pylist(), object)
            for space in sorted(set(spaces)):
                part = batch.take(pa.array(np.flatnonzero(spaces == space)))
                mean, passes, bits, window = (part.column(c)[0].as_py() for c in ("mean", "passes", "bits", "window"))
                x = _units(part.column("embedding")) - np.array(mean)
                weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
                for p in range(passes):
                    signs = x @ np.random.default_rng([seed, x.shape[1], p]).normal(size=(x.shape[1], bits)) > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(part.num_rows, p, np.int32)), part.column("space"), pa.array(signs @ weights),
                         part.column("class"), part.column("embedding"), pa.array(np.full(part.num_rows, window, np.int32))],
                        names=["pass", "space", "number", "class", "embedding", "window"])

    return run


def _links(rows: pa.Table, threshold: float) -> list[tuple[str, str]]:
    """Sorted classes to a spanning forest of the links inside the windows of each pass and space."""
    import numpy as np

    spaces = list(zip(rows.column("pass").to_pylist(), rows.column("space").to_pylist()))
    names = rows.column("class").to_pylist()
    starts = [k for k in range(len(spaces)) if not k or spaces[k] != spaces[k - 1]] + [len(spaces)]
    found = []
    for lo, hi in zip(starts, starts[1:]):
        window = rows.column("window")[lo].as_py()
        x = _units(rows.column("embedding").slice(lo, hi - lo))
        forest = Forest(hi - lo)
        for k in range(0, hi - lo, 256):
            back = max(0, k - window)
            near = x[k:k + 256] @ x[back:k + 256].T >= threshold
            for i in np.flatnonzero(near.any(1)).tolist():
                j = back + np.flatnonzero(near[i])
                j = j[(j < k + i) & (j >= k + i - window)]
                if len(j):
                    forest.link(k + i, j)
        found += [(names[lo + a], names[lo + b]) for a, b in forest.edges]
    return found


_SORTED = "pass int, space string, number bigint, class string, embedding array<double>, window int"


def _windows(widest: int, threshold: float):
    """Sorted classes of a partition to the links inside its windows, and the rows at its edges: those at its end belong to
    the edge of its number, those at its start to the edge before."""

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.int32()]
        names = ["pass", "space", "number", "class", "embedding", "window"]

        def edge(rows: pa.Table, number: int):
            for part in rows.combine_chunks().to_batches():
                nothing = pa.nulls(part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([nothing, nothing, pa.array([number] * part.num_rows, pa.int32()),
                                                  *(part.column(c).cast(t) for c, t in zip(names, kinds))], names=["a", "b", "edge", *names])

        held, first = None, 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if first < widest:
                yield from edge(rows.slice(0, widest - first), at - 1)
                first += rows.num_rows
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            if found := _links(rows, threshold):
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in zip(*found)), pa.nulls(len(found), pa.int32()),
                                                  *(pa.nulls(len(found), t) for t in kinds)], names=["a", "b", "edge", *names])
            held = rows.slice(max(0, rows.num_rows - widest))
        if held is not None:
            yield from edge(held, at)

    return run


def _named(found: list[tuple[str, str]]):
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], names=["a", "b"])


def _linked_pairs(threshold: float):
    """A pair of blocks to a spanning forest of the links between them."""

    def work(rows: pa.Table):
        import numpy as np

        x, own = _units(rows.column("embedding")), np.array(rows.column("own"))
        names, forest = rows.column("class").to_pylist(), Forest(len(own))
        a, b = (np.flatnonzero(own == rows.column(c)[0].as_py()) for c in ("bi", "bj"))
        for k in range(0, len(a), 256):
            near = x[a[k:k + 256]] @ x[b].T >= threshold
            near &= a[k:k + 256][:, None] != b[None, :]
            for i in np.flatnonzero(near.any(1)).tolist():
                forest.link(int(a[k + i]), b[near[i]])
        yield from _named([(names[i], names[j]) for i, j in forest.edges])

    return work


def _all_pairs(rows: DataFrame, group: list[str], block: int, threshold: float) -> DataFrame:
    """Links of all pairs in the groups of ``rows`` (class, embedding, size)."""
    blocks = block_pairs(rows, group, "class", F.ceil(F.col("size") / block))
    return in_groups(blocks.select(*group, "bi", "bj", "own", "class", "embedding"), [*group, "bi", "bj"], ["class"],
                     _linked_pairs(threshold), "a string, b string")


def _found(classes: DataFrame, threshold: float, passes: int, window: int, block: int, bits: int) -> DataFrame:
    """Links (a, b) of ``classes`` (class, space, embedding): enough of them to connect what is linked."""
    sizes = checkpointed(classes.groupBy("space").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    sums = classes.join(sizes, "space", "left_semi").select("space", "embedding").mapInArrow(_sums, "space string, part array<double>")
    means = (sums.select("space", F.posexplode("part").alias("pos", "v")).groupBy("space", "pos").agg(F.sum("v").alias("v"))
             # As many entries as the vectors have.
             .groupBy("space").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("sums"))
             .join(sizes, "space").select("space", "size", F.expr("transform(sums, x -> x.v / size)").alias("mean")))
    plan = checkpointed(means.mapInArrow(_scheduled(threshold, passes, window, bits),
                                         "space string, mean array<double>, passes int, window int, bits int"))
    numbered = checkpointed(classes.join(plan, "space").select("space", "class", "embedding", "mean", "passes", "window", "bits")
                            .mapInArrow(_numbers(SEED), _SORTED))
    order, widest = ["pass", "space", "number", "class"], window << 4
    near = checkpointed(numbered.repartitionByRange(*order).sortWithinPartitions(*order)
                        .mapInArrow(_windows(widest, threshold), f"a string, b string, edge int, {_SORTED}"))
    edges = in_groups(near.filter("edge IS NOT NULL").drop("a", "b"), ["edge"], order, lambda rows: _named(_links(rows, threshold)), "a string, b string")
    crowded = (numbered.groupBy("pass", "space", "number").agg(F.count(F.lit(1)).alias("size"), F.max("window").alias("_w"))
               .filter("size > _w").drop("_w"))
    runs = _all_pairs(numbered.drop("window").join(crowded, ["pass", "space", "number"]), ["pass", "space", "number"], block, threshold)
    return near.filter("edge IS NULL").select("a", "b").unionByName(edges).unionByName(runs)


def _linked_rows(threshold: float):
    """Members of a pair of blocks to how many rows each is linked with in the other block."""

    def work(rows: pa.Table):
        import numpy as np

        x = _units(rows.column("embedding"))
        own, n = np.array(rows.column("own")), np.array(rows.column("n"))
        bi, bj = rows.column("bi")[0].as_py(), rows.column("bj")[0].as_py()
        total = np.zeros(len(x), np.int64)
        for mine, theirs in {(bi, bj), (bj, bi)}:
            a, b = np.flatnonzero(own == mine), np.flatnonzero(own == theirs)
            for k in range(0, len(a), 256):
                near = x[a[k:k + 256]] @ x[b].T >= threshold
                near &= a[k:k + 256][:, None] != b[None, :]
                total[a[k:k + 256]] += near @ n[b]
        yield pa.RecordBatch.from_arrays([rows.column("class").combine_chunks(), pa.array(total)], names=["class", "linked"])

    return work


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW,
                 block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    usable = ("label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND "
              "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x != 0)")
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("usable", F.coalesce(F.expr(usable), F.lit(False)))
    space = F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string"))
    named = (rows.filter("usable").withColumn("space", space)
             .withColumn("class", F.md5(F.concat_ws(",", "space", F.col("embedding").cast("array<string>")))))
    classes = checkpointed(named.groupBy("class").agg(F.first("space").alias("space"), F.first("embedding").alias("embedding"),
                                                      F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    links = _found(classes.select("class", "space", "embedding"), threshold, passes, window, block, bits)
    found = checkpointed(components(links))  # (node, component)

    members = classes.join(found.withColumnRenamed("node", "class"), "class")
    # One row per component.
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    blocks = block_pairs(members.join(sizes, "component"), ["component"], "class", F.ceil(F.col("size") / block))
    linked = (in_groups(blocks.select("component", "bi", "bj", "own", "class", "n", "embedding"), ["component", "bi", "bj"], ["class"],
                        _linked_rows(threshold), "class string, linked bigint")
              .groupBy("class").agg(F.sum("linked").alias("linked")))
    least = members.groupBy("component").agg(F.min("least_id").alias("component_id"))
    grouped = members.select("class", "component", "n").join(linked, "class").join(least, "component").select(
        "class", (F.col("linked") + F.col("n") - 1).alias("n_links"), "component_id")
    # Classes without a link are not joined on a component: its null would be one key.
    lone = classes.join(found.withColumnRenamed("node", "class"), "class", "left_anti").select(
        "class", (F.col("n") - 1).alias("n_links"), F.col("least_id").alias("component_id"))
    per_class = grouped.unionByName(lone)
    together = named.select("vec_id", "class").join(per_class, "class").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return together.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


#: Exact over all pairs; on the given tables no pair is lost by the passes.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS n
  FROM embeddings WHERE label IS NOT NULL
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS c FROM embeddings
  UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.a
), c AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN (SELECT a AS vec_id, count(*) AS k FROM l GROUP BY a) USING (vec_id)
"""
