"""Clustering round centroids by kd-tree filtering, exact in integers.

Vectors become integers, floor(scale * x). Each task builds kd-trees over blocks of its rows,
once: a node is split at the median of its widest coordinate, down to leaves of ``LEAF`` rows, and
holds its count, the sums of its coordinates and its box. The trees are written to the shared
folder and every round reads them. In a round a node's candidates are the centroids that its
parent could not rule out: against the one nearest to the middle of the box, a centroid
goes if it is strictly farther at the corner of the box that favours it most, hence at every
point of the box. A node with one candidate left is assigned whole, by count and sums; at
leaves the rows themselves are compared with the candidates left. Levels are worked through
at once, not node by node. A task gives counts and sums for each centroid, which are added up by centroid; only
the new centroids, whose number and length are fixed, pass through the driver.

How much is ruled out depends on the data: boxes are tight where rows cluster, and wide
where they don't, and then most rows are resolved at leaves. The result doesn't depend on it.

Distances, sums and means are exact: doubles hold all whole numbers involved for values
below ``SMALL``, and blocks with greater ones use integers of any length. A distance or inertia
beyond 64 bits is null. Ties go to the smaller number of a centroid. Vectors that are
null, of another length, or hold null or non-finite components take no part. Repeated rows
count each. A null id can't start a centroid, but is clustered. Fewer rows than centroids give
as many centroids as rows; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import cut, drop

#: Rows of a tree at most, and of a leaf; nodes whose candidates are compared at once.
BLOCK, LEAF, AT_ONCE = 8192, 16, 256
#: Below it doubles hold products, sums and distances exactly (64 coordinates and more).
SMALL = float(1 << 21)


@dataclass
class Tree:
    """Rows in the order of the tree, and its nodes level by level: ``start`` and ``end`` of a
    node's rows, its box and sums; children of node i of a level are 2i and 2i + 1 of the next."""

    order: np.ndarray
    rows: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def build(rows: np.ndarray) -> Tree:
    """A balanced tree: all leaves are at one depth."""
    n = len(rows)
    depth = max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))
    order, bounds = np.arange(n), np.array([0, n])
    edges = [bounds]
    for _ in range(depth):
        cuts = [0]
        for a, b in zip(bounds, bounds[1:]):
            own = order[a:b]
            x = rows[own]
            wide = int(np.argmax(x.max(axis=0) - x.min(axis=0))) if len(own) else 0
            half = len(own) // 2
            order[a:b] = own[np.argsort(x[:, wide], kind="stable")]
            cuts += [a + half, b]
        bounds = np.array(cuts)
        edges.append(bounds)
    rows = rows[order]
    levels = []
    for e in edges:
        start, end = e[:-1], e[1:]
        full = np.flatnonzero(end > start)
        shape = (len(start), rows.shape[1])
        low, high, sums = (np.zeros(shape, rows.dtype) for _ in range(3))
        if len(full):  # empty nodes lie between full ones and take no rows
            low[full] = np.minimum.reduceat(rows, start[full])
            high[full] = np.maximum.reduceat(rows, start[full])
            sums[full] = np.add.reduceat(rows, start[full])
        levels.append((start, end, low, high, sums))
    return Tree(order, rows, levels)


def _candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Which allowed centroids (nodes x centroids) may be nearest to some point of each box."""
    out = allowed.copy()
    for i in range(0, len(low), AT_ONCE):
        lo, hi, may = low[i : i + AT_ONCE], high[i : i + AT_ONCE], allowed[i : i + AT_ONCE]
        far = (centroids * centroids).sum(axis=1)[None, :] - (lo + hi) @ centroids.T  # of the middle
        best = centroids[np.where(may, far, far.max() + 1).argmin(axis=1)]
        other = centroids[None, :, :]
        corner = np.where(other > best[:, None, :], hi[:, None, :], lo[:, None, :])
        worse = ((other - best[:, None, :]) * (other + best[:, None, :] - 2 * corner)).sum(axis=2) > 0
        out[i : i + AT_ONCE] &= ~worse.astype(bool)
    return out


def assign(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]], int]:
    """The centroid of every row (in the tree's order), whole nodes as (centroid, count,
    sums), with leaves' rows given as nodes too, and how many rows were assigned with their node."""
    n, k = len(tree.rows), len(centroids)
    label, parts, whole = np.zeros(n, np.int64), [], 0
    nodes, may = np.array([0]), np.ones((1, k), bool)
    for depth, (start, end, low, high, sums) in enumerate(tree.levels):
        filled = end[nodes] > start[nodes]
        nodes, may = nodes[filled], may[filled]
        if not len(nodes):
            break
        may = _candidates(low[nodes], high[nodes], centroids, may)
        one = may.sum(axis=1) == 1
        for i, c in zip(nodes[one], may[one].argmax(axis=1)):
            label[start[i] : end[i]] = c
            whole += end[i] - start[i]
            parts.append((int(c), int(end[i] - start[i]), sums[i]))
        nodes, may = nodes[~one], may[~one]
        if depth + 1 < len(tree.levels):
            nodes, may = np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), np.repeat(may, 2, axis=0)
        elif len(nodes):
            at = np.concatenate([np.arange(start[i], end[i]) for i in nodes])
            allowed = np.repeat(may, end[nodes] - start[nodes], axis=0)
            x = tree.rows[at]
            far = (centroids * centroids).sum(axis=1)[None, :] - 2 * (x @ centroids.T)
            label[at] = np.where(allowed, far, far.max() + 1).argmin(axis=1)  # the smaller number among equals
            for c in np.unique(label[at]):
                own = x[label[at] == c]
                parts.append((int(c), len(own), own.sum(axis=0)))
    return label, parts, whole


def _exact(rows: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles where these are exact throughout, else as Python integers."""
    if not rows.size or np.abs(rows).max() < SMALL:
        return rows
    return np.array([[int(x) for x in r] for r in rows], object).reshape(rows.shape)


def _to_rows(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * flat)
    if not np.isfinite(scaled).all():
        return np.array([math.floor(scale * Fraction(float(x))) for x in flat], object).reshape(-1, dims)
    return scaled.reshape(-1, dims)


def _pack(tree: Tree, ids: pa.Array) -> dict[str, object]:
    return {"ids": ids.take(pa.array(tree.order)), "tree": pickle.dumps(tree, protocol=5)}


def _trees(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """ids and tree of blocks of rows (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, v = (c.chunk(0) for c in t.columns)
            made = _pack(build(_exact(_to_rows(v, dims, scale))), ids)
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), made["ids"])
            return pa.RecordBatch.from_arrays([listed, pa.array([made["tree"]], pa.binary())], names=["ids", "tree"])

        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                some = batch.slice(i, BLOCK)
                if count and count + some.num_rows > BLOCK:
                    yield block()
                    held, count = [], 0
                held.append(some)
                count += some.num_rows
        if count:
            yield block()

    kind = vectors.schema["id"].dataType
    return vectors.mapInArrow(run, T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("tree", T.BinaryType())]))


def _shared(centroids: list[list[int]], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and rows in one type that is exact for both."""
    small = all(abs(x) < SMALL for c in centroids for x in c)
    if small and rows.dtype != object:
        return np.array(centroids, float), rows
    return np.array(centroids, object), np.array([[int(x) for x in r] for r in rows], object).reshape(rows.shape)


def _open(blob: bytes, centroids: list[list[int]]) -> tuple[Tree, np.ndarray]:
    tree = pickle.loads(blob)
    c, rows = _shared(centroids, tree.rows)
    if rows is not tree.rows:
        wide = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
        tree = Tree(tree.order, rows, [(a, b, wide(lo), wide(hi), wide(s)) for a, b, lo, hi, s in tree.levels])
    return tree, c


def _moved(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid at the floor of its rows' means; empty ones stay."""
    dims = len(centroids[0])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for blob in batch.column(0):
                for c, n, s in assign(*_open(blob.as_py(), centroids))[1]:
                    own = total.setdefault(c, [0, [0] * dims])
                    own[0] += n
                    own[1] = [a + int(b) for a, b in zip(own[1], s)]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v[0] for v in total.values()]), pa.array([[str(x) for x in v[1]] for v in total.values()], pa.list_(pa.string()))], names=["cluster", "n", "sums"])

    def add(t: pa.Table) -> pa.Table:
        sums = [sum(map(int, column)) for column in zip(*t["sums"].to_pylist())]
        n = sum(t["n"].to_pylist())
        return pa.table({"cluster": t["cluster"][:1], "mean": pa.array([[str(s // n) for s in sums]], pa.list_(pa.string()))})

    parts = trees.select("tree").mapInArrow(part, "cluster int, n long, sums array<string>")
    means = parts.groupBy("cluster").applyInArrow(add, "cluster int, mean array<string>").collect()
    return [*map(list, ({c: centroids[c] for c in range(len(centroids))} | {r["cluster"]: [*map(int, r["mean"])] for r in means}).values())]


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every
    vector of ``dims`` components. The first centroids are the ``k`` rows whose ids, after ``salt``, have
    the least SHA-256."""
    kind = df.schema[vector].dataType.elementType
    v = F.col(vector) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(vector).cast("array<double>")
    usable = F.col(vector).isNotNull() & (F.size(vector) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.where(usable).select(F.col(key).alias("id"), v.alias("v"))
    first = kept.where("id is not null").withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)).orderBy("h", "v").limit(k).collect()
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(c, t) for c, t in (("cluster", T.IntegerType()), ("distance", T.LongType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid_sha256", T.StringType())))])
    if not first:
        return df.sparkSession.createDataFrame([], schema)
    of = lambda r: _to_rows(pa.array([r["v"]], pa.list_(pa.float64())), dims, scale)[0]
    centroids = [[int(x) for x in of(r)] for r in first]
    trees = cut(_trees(kept, dims, scale), "trees")
    for _ in range(rounds):
        centroids = _moved(trees, centroids)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blob in zip(batch.column(0), batch.column(1)):
                tree, c = _open(blob.as_py(), centroids)
                label = assign(tree, c)[0]
                gap = tree.rows - c[label]
                far = [int(x) for x in (gap * gap).sum(axis=1)]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(label, pa.int32()), pa.array([str(x) for x in far], pa.string())], names=["id", "cluster", "far"])

    assigned = cut(trees.select("ids", "tree").mapInArrow(last, T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("far", T.StringType())])), "assigned")
    drop(trees)
    exact = F.sum(F.expr("try_cast(far AS decimal(38,0))"))
    each = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(exact.alias("s"), F.count_if(F.col("far").try_cast("decimal(38,0)").isNull()).alias("wide")).withColumn("s", F.when(F.col("wide") == 0, F.col("s"))).collect()}
    held = lambda x: None if x is None or not -(2**63) <= x < 2**63 else int(x)
    whole = None if None in each.values() else sum(each.values())
    said = [(i, held(each.get(i)), held(whole), sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids) if i in each]
    about = df.sparkSession.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(F.col("id").alias(key), "cluster", F.expr("try_cast(far AS bigint)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
