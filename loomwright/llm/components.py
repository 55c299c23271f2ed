"""Connected components of a graph given by its links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import spread_join, stored


#: Links up to which one task joins them, in place of several rounds of joins.
FEW_LINKS = 20_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of a few links, by union and find with the smallest node as root."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            one, two = find(u), find(v)
            root[max(one, two)] = min(one, two)
    found = [(x, find(x)) for x in list(root)]
    nodes = [(x, r) for x, r in found if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in nodes], pa.int64()) for k in (0, 1)], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that is linked to a smaller one: root is its component's smallest node.

    ``links`` has two long columns, in any direction; repeated links and links of a node with itself
    do no harm. Alternates large-star and small-star steps, which keep components and end, after a
    number of rounds that grows with the logarithm of the size, with every node linked to its root.
    Every round is written to the shared folder. Up to FEW_LINKS links are joined by one task.
    """
    one, two = (F.col(c) for c in links.columns)
    edges = stored(links.where(one != two).select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v")).distinct(), "links")
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    seen = edges.agg(mark.alias("m")).first()["m"]
    if seen["n"] <= FEW_LINKS:
        return edges.coalesce(1).mapInArrow(_joined, "node long, root long")
    while seen["n"]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        # A node of many links is a key of many rows; the rows are dealt to several tasks.
        large = spread_join(both, least, "u", 2 * seen["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(mark.alias("m")).first()["m"]
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
