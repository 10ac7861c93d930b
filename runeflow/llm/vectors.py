"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors whose cosine reaches the threshold lie within ``eps`` of each other, and so do their images on any leading
principal dimensions. Equal vectors become one class first. Classes are sorted by grid cells of side ``eps`` on the leading
dimensions (the epsilon grid order) and cut into intervals, and these into tiles of consecutive ones. Two tiles meet, in a
task, only if some of their cells touch and their bounds, on more dimensions, come within ``eps``; so do two intervals of
them. Inside a pair of intervals the same test is applied to halves, and halves of halves, until a part is small; what is
left is compared by matrix products in single precision with a margin, and each hit again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components

COSINE = 0.95
#: Dimensions of the sort order, of the keys that bring intervals together, and of the bounds.
ORDER_DIMS, KEY_DIMS, BOUND_DIMS = 8, 3, 16
INTERVAL = 1_024
#: Parts of so few vectors are compared without another split.
PART = 256
#: Intervals of a tile, and tiles that there should be: a task joins two tiles, so what is sent for a pair of vectors falls
#: with the tile's size.
MOST_TILE, LEAST_TILES = 32, 6
_SLACK = 1e-6

def classes_of(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, key) of every row, and the written classes (key, rep, copies, dims, raw); key is null for unusable vectors."""
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))

    # single-precision input is kept as such, which loses nothing
    width = np.float32 if df.schema[vec_col].dataType.simpleString() == "array<float>" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws, dims = [], [], []
            for x in batch.column(1):
                v = None if not x.is_valid else x.values
                a = None if v is None or v.null_count or not len(v) else np.asarray(v) + 0.0  # no negative zero
                if a is None or not np.isfinite(a).all() or not a.any():
                    keys.append(None)
                    raws.append(None)
                    dims.append(None)
                else:
                    keys.append(xxhash.xxh3_128_digest(a.tobytes()))
                    raws.append(a.astype(width).tobytes())
                    dims.append(len(a))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "key": pa.array(keys, pa.binary()), "raw": pa.array(raws, pa.binary()), "dims": pa.array(dims, pa.int32())})

    rows = written(source.mapInArrow(run, "vec_id long, key binary, raw binary, dims int"), "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("dims").alias("dims"), F.first("raw").alias("raw"))
    return rows.select("vec_id", "key"), written(classes, "classes")


def _units(raws: list[bytes], n: int, dims: int) -> np.ndarray:
    """The ``n`` vectors of ``raws`` as unit vectors in double precision; packed ones are of either width."""
    blob = b"".join(raws)
    x = np.frombuffer(blob, np.float32 if len(blob) == 4 * n * dims else np.float64).reshape(n, dims).astype(np.float64)
    top = np.abs(x).max(1, keepdims=True)
    x = x / top  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(classes: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes (columns, leading first) of the unit vectors; only sums travel, one row a task, then 32."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                u = _units(batch.column(0).to_pylist(), batch.num_rows, dims)
                n, s, ss = n + len(u), s + u.sum(0), ss + u.T @ u
        if n:
            k = (TaskContext.get().partitionId() if TaskContext.get() else 0) % 32
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "sums": pa.array([np.concatenate([[n], s, ss.ravel()]).tobytes()], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float64) for b in group.column("sums").to_pylist())
        return pa.table({"k": group.column("k").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = classes.select("raw").mapInArrow(sums, "k int, sums binary").groupBy("k").applyInArrow(add, "k int, sums binary").orderBy("k").collect()
    if not parts:
        return np.zeros(dims), np.eye(dims)
    total = sum(np.frombuffer(bytes(r["sums"]), np.float64) for r in parts)
    n, mean = total[0], total[1 : dims + 1] / total[0]
    _, axes = np.linalg.eigh(total[dims + 1 :].reshape(dims, dims) / n - np.outer(mean, mean))
    return mean, axes[:, ::-1]


def apart(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray, eps: float) -> bool:
    """Whether no point of one box comes within ``eps`` of the other box."""
    gap = np.maximum(0, np.maximum(low - high2, low2 - high))
    return float(gap @ gap) > eps * eps


def join_parts(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, cosine: float, eps: float, same: bool, at: int = 0, at2: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of similar pairs between two ordered sequences, by halves; ``same``: both are one sequence."""
    if not len(x) or not len(y) or (not same and apart(px.min(0), px.max(0), py.min(0), py.max(0), eps)):
        return
    if len(x) <= PART and len(y) <= PART:
        i, j = np.nonzero(x.astype(np.float32) @ y.astype(np.float32).T >= cosine - 1e-5)
        if same:
            i, j = i[i < j], j[i < j]
        sure = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
        if sure.any():
            yield i[sure] + at, j[sure] + at2
        return
    h, k = (len(x) + 1) // 2, (len(y) + 1) // 2
    for a, b, c, d in ((0, h, 0, k), (0, h, k, len(y)), (h, len(x), 0, k), (h, len(x), k, len(y))):
        if same and a > c:
            continue
        yield from join_parts(x[a:b], px[a:b], y[c:d], py[c:d], cosine, eps, same and a == c, at + a, at2 + c)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges with the least node that it is connected with there."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    u, v = inverse[: len(a)], inverse[len(a) :]
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            return nodes[label], nodes
        label = new


def _joined(classes: DataFrame, dims: int, cosine: float) -> DataFrame:
    """Written (cls, n, least): vectors linked with each class in other classes, and a class connected with it."""
    mean, axes = principal(classes, dims)
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + _SLACK
    order, keys, bound = min(ORDER_DIMS, dims), min(KEY_DIMS, dims), min(BOUND_DIMS, dims)
    axes = axes[:, :bound]
    cells = [f"c{k}" for k in range(order)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = np.floor((_units(batch.column(2).to_pylist(), batch.num_rows, dims) - mean) @ axes[:, :order] / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(c[:, k])) for k in range(order)]], names=[*batch.schema.names, *cells])

    placed = written(classes.select("rep", "copies", "raw").mapInArrow(place, "rep long, copies long, raw binary, " + ", ".join(f"{c} int" for c in cells)), "placed")
    n = placed.count()
    runs = placed.repartitionByRange(max(1, -(-n // (INTERVAL * MOST_TILE))), *cells, "rep").sortWithinPartitions(*cells, "rep")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            where = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(k, k + batch.num_rows))]
            k += batch.num_rows
            yield pa.RecordBatch.from_arrays([*where, *batch.columns], names=["part", "k", *batch.schema.names])

    # places in the epsilon grid order, whatever the partitions: a count of each comes to the driver
    runs = runs.select("rep", "copies", "raw", *cells[:keys]).mapInArrow(number, "part int, k long, rep long, copies long, raw binary, " + ", ".join(f"{c} int" for c in cells[:keys]))
    runs = written(runs, "order")
    sizes = {r["part"]: r["n"] for r in runs.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offsets = np.cumsum([0, *(sizes[p] for p in sorted(sizes))]).tolist()
    starts = df_of(runs, [(p, o) for p, o in zip(sorted(sizes), offsets, strict=False)], "part int, base long")
    runs = runs.join(F.broadcast(starts), "part").withColumn("interval", F.floor((F.col("base") + F.col("k")) / INTERVAL))
    size = max(1, min(MOST_TILE, n // (INTERVAL * LEAST_TILES)))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("base", "ascending"), ("k", "ascending")])
        raws = group.column("raw").to_pylist()
        p = (_units(raws, len(raws), dims) - mean) @ axes
        c = np.unique(np.stack([group.column(c).to_numpy() for c in cells[:keys]], 1), axis=0)
        one = lambda v, t: pa.array([v], t)
        return pa.table({"interval": group.column("interval").slice(0, 1), "cls": one(group.column("rep").to_pylist(), pa.list_(pa.int64())), "copies": one(group.column("copies").to_pylist(), pa.list_(pa.int64())), "raw": one(b"".join(raws), pa.binary()), "low": one(p.min(0).tolist(), pa.list_(pa.float64())), "high": one(p.max(0).tolist(), pa.list_(pa.float64())), "cells": one(c.tolist(), pa.list_(pa.list_(pa.int32())))})

    intervals = runs.groupBy("interval").applyInArrow(pack, "interval long, cls array<long>, copies array<long>, raw binary, low array<double>, high array<double>, cells array<array<int>>")
    intervals = written(intervals.withColumn("tile", F.floor(F.col("interval") / size)), "intervals")
    # two tiles meet if some of their cells touch and their bounds come within eps; a row a pair of tiles, none a pair of vectors
    ends = [f(F.element_at(c, k + 1)).alias(f"{c}{k}") for c, f in (("low", F.min), ("high", F.max)) for k in range(bound)]
    bounds = intervals.groupBy("tile").agg(*ends).select("tile", *[F.array(*[f"{c}{k}" for k in range(bound)]).alias(c) for c in ("low", "high")])
    seats = written(intervals.select("tile", F.explode("cells").alias("cell")).distinct().join(bounds, "tile"), "seats")
    steps = F.array(*[F.lit(s) for s in (-1, 0, 1)])
    near = seats.select(F.col("tile").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"), "cell")
    for k in range(keys):
        near = near.withColumn(f"s{k}", F.explode(steps))
    key = lambda shift: F.concat_ws("|", *[F.element_at("cell", k + 1) + (F.col(f"s{k}") if shift else F.lit(0)) for k in range(keys)])
    touching = seats.withColumn("key", key(False)).join(near.withColumn("key", key(True)).drop("cell", *[f"s{k}" for k in range(keys)]), "key").where("tile <= other")
    gap = F.aggregate(F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
    pairs = written(touching.where(gap <= eps * eps).select("tile", "other").distinct(), "pairs")
    blob = intervals.select("tile", "interval", "cls", "copies", "raw", "low", "high")
    left = pairs.join(blob, "tile").select("tile", "other", F.lit(True).alias("own"), *blob.columns[1:])
    right = pairs.where("tile <> other").join(blob.withColumnRenamed("tile", "other"), "other").select("tile", "other", F.lit(False).alias("own"), *blob.columns[1:])

    def meet(group: pa.Table) -> pa.Table:
        group = group.sort_by("interval")
        cls = [np.asarray(x.values) for x in group.column("cls")]
        copies = [np.asarray(x.values) for x in group.column("copies")]
        units = [_units([r], len(c), dims) for r, c in zip(group.column("raw").to_pylist(), cls, strict=True)]
        images = [(u - mean) @ axes for u in units]
        low, high = ([np.asarray(x.values) for x in group.column(c)] for c in ("low", "high"))
        own = group.column("own").to_pylist()
        mine = [k for k, x in enumerate(own) if x]
        theirs = [k for k, x in enumerate(own) if not x] or mine
        totals = [np.zeros(len(c), np.int64) for c in cls]
        edges_a, edges_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in mine:
            for b in theirs:
                if (theirs is mine and b < a) or apart(low[a], high[a], low[b], high[b], eps):
                    continue
                for i, j in join_parts(units[a], images[a], units[b], images[b], cosine, eps, a == b):
                    np.add.at(totals[a], i, copies[b][j])
                    np.add.at(totals[b], j, copies[a][i])
                    least, node = _forest(cls[a][i], cls[b][j])
                    edges_a.append(least)
                    edges_b.append(node)
        least, node = _forest(np.concatenate(edges_a), np.concatenate(edges_b))
        every = np.concatenate(cls)
        order = np.argsort(every)
        n = np.concatenate(totals)[order][np.searchsorted(every[order], node)]
        return pa.table({"cls": pa.array(node), "n": pa.array(n), "least": pa.array(least)})

    return written(left.union(right).groupBy("tile", "other").applyInArrow(meet, "cls long, n long, least long"), "met")


def df_of(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def vector_groups(df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row: links join vectors whose cosine is ``cosine`` or more.

    Vectors that are null, empty, zero, or hold a null or a component that is not finite link with nothing; vectors of
    different lengths don't link. Equal vectors are linked. Repeated rows are vectors of their own, so each counts as a
    link of the other. A cosine equal to the threshold links; vectors of any length are read whole. A row without id has its links counted, a null component and isn't kept. An empty table gives an
    empty one; other columns, whatever their names, are left out.
    """
    rows, classes = classes_of(df, id_col, vec_col)
    lengths = [r["dims"] for r in classes.select("dims").distinct().collect()]  # as many as there are models
    # a class is named by a running number, as ids may be null or repeated
    numbered = written(classes.withColumn("cls", F.monotonically_increasing_id()), "numbered")
    found = None
    for d in sorted(lengths):
        part = _joined(numbered.where(F.col("dims") == d).select(F.col("cls").alias("rep"), "copies", "raw"), d, cosine)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = found.groupBy("cls").agg(F.sum("n").alias("n"))
    comps = components(found, "least", "cls")
    state = numbered.select("key", "cls", "rep", "copies").join(links, "cls", "left").join(comps.withColumnRenamed("id", "cls"), "cls", "left")
    state = written(state.select("key", "rep", F.coalesce("component", "cls").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "state")
    names = state.groupBy("component").agg(F.min("rep").alias("least"))
    named = state.join(names, "component").select("key", "n_links", "least")
    out = rows.join(named, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("least", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
