"""Connected components of a link table by alternating large-star and small-star steps (DataFrames only)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspool.llm import common

#: Links that one task reduces at once; bounds its memory only.
FOREST_LINKS = 1 << 18


def spanning_forest(links: DataFrame) -> DataFrame:
    """(a, b): the links (a, b, both long) without those that close a circle within a task's part, so the same components.

    links must be a written table: its count decides how many tasks share it.
    """

    def reduced(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = list(range(len(nodes)))
        keep = []
        for k, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True)):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[x] = y
                keep.append(k)
        return pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > 2 * FOREST_LINKS:
                yield reduced(parts)
                parts, size = [], 0
        if parts:
            yield reduced(parts)

    return links.select("a", "b").coalesce(max(1, -(-links.count() // FOREST_LINKS))).mapInArrow(run, "a long, b long")


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, int(r.s or 0)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of a link with the least node that it reaches.

    Each round is two joins on the edge table, which never grows; rounds are logarithmic in the
    longest path. Hubs meet only in aggregates with partial sums and in joins that AQE can split.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = common.materialize(edges, "edges")
    state = _state(edges)
    while True:
        # Large star: larger neighbours of a node move to its least neighbour.
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = common.materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        found = _state(new)
        common.discard(edges)
        edges = new
        if found == state:
            break
        state = found
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
