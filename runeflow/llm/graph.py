"""Connected components of edge tables, and joins whose small side is measured first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A side is broadcast only if its rows, at so many bytes each, stay under this size.
BROADCAST_BYTES = 32_000_000


def measured(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """``df`` (best a written table) with a broadcast hint if a count proves it small; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def weighed(df: DataFrame, size: Column) -> DataFrame:
    """As ``measured``, by the bytes that ``size`` gives for each row."""
    total = df.agg(F.sum(size + 64)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each batch's edges: each node with its least node of the batch."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int, root: dict[int, int] = root) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        nodes = list(root)
        yield pa.RecordBatch.from_pydict({"a": pa.array([find(x) for x in nodes], pa.int64()), "b": pa.array(nodes, pa.int64())})


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node of an edge; component is the least id reachable.

    Batches of edges are first reduced to forests where they lie. Then each node takes the least label among its
    neighbours' and follows its label's label, which halves paths, so rounds grow with the logarithm of the longest path.
    Each round is checkpointed. Null ends and loops are left out.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = cut(edges.mapInArrow(_contract, "a long, b long").where("a <> b").distinct())
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select("b", "a"))
    labels = cut(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), "component"), "to").groupBy("id").agg(F.min("component").alias("near"))
        stepped = labels.join(near, "id").select("id", F.least("component", "near").alias("next"), "component")
        above = labels.select(F.col("id").alias("next"), F.col("component").alias("above"))
        jumped = stepped.join(above, "next", "left").select("id", F.least("next", F.coalesce("above", "next")).alias("component"), F.col("component").alias("was"))
        jumped = cut(jumped)
        changed = jumped.where("component <> was").limit(1).count()
        labels = jumped.select("id", "component")
        if not changed:
            return labels
