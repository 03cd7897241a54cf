"""Connected components of links, and groups compared in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import checkpointed, release


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link: component is the smallest node reachable.

    Alternating large-star and small-star steps: every node points its larger neighbours at the
    smallest one it knows. Each step is two joins on nodes (a hub is one key of a skew-split join, never a
    collected list); each round is checkpointed. Ends when a round changes nothing."""
    x, y = F.col(a), F.col(b)
    edges = checkpointed(links.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
        if state == before or state["n"] == 0:
            break
        before = state
        edges = checkpointed(_round(edges))
        release(edges.sparkSession)
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    return (large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def block_pairs(members: DataFrame, group: list[str], key: str, blocks: Column) -> DataFrame:
    """``members`` with ``bi``, ``bj`` and ``own``: a group of ``blocks`` > 1 is cut into blocks by a hash of ``key``, and
    every pair of blocks (bi <= bj) is a group of its own, holding both; a row belongs to its block ``own``."""
    return (
        members.withColumn("_blocks", F.greatest(F.lit(1), blocks).cast("int"))
        .withColumn("own", F.expr(f"CAST(pmod(xxhash64(`{key}`, 29), _blocks) AS INT)"))
        .select("*", F.explode(F.expr("sequence(0, _blocks - 1)")).alias("_other"))
        .withColumns({"bi": F.least("own", "_other"), "bj": F.greatest("own", "_other")})
        .drop("_blocks", "_other")
    )


def in_groups(df: DataFrame, group: list[str], order: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``work`` on the rows of each group, many small groups to a task: hash partitions sorted by group, read as a stream.
    A group has to be bounded (see ``block_pairs``)."""

    def run(batches):
        import numpy as np

        held: list[pa.RecordBatch] = []

        def split(table: pa.Table) -> list[int]:
            """Starts of the groups."""
            new = np.zeros(table.num_rows, bool)
            new[0] = True
            for name in group:
                column = table.column(name).combine_chunks()
                codes = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            return np.flatnonzero(new).tolist()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            starts = split(table)
            # The last group may go on in the next batch.
            for lo, hi in zip(starts, starts[1:]):
                yield from work(table.slice(lo, hi - lo))
            held = table.slice(starts[-1]).combine_chunks().to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


class Forest:
    """Links among the rows of one group, reduced to a spanning forest."""

    def __init__(self, n: int):
        import numpy as np

        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, i: int, others) -> None:
        """``i`` is linked with all ``others`` (an array)."""
        import numpy as np

        roots = np.unique(self.label[others])
        roots = roots[roots != self.label[i]]
        if len(roots):
            own = self.label[i]
            for r in roots.tolist():
                self.edges.append((i, int(others[np.argmax(self.label[others] == r)])))
            self.label[np.isin(self.label, roots)] = own
