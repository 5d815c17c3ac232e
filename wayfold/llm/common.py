"""Shared plumbing of the training-data operators: durable lineage cuts, connected
components and small helpers for Python workers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.durable import shared_dir

#: Edges that a task joins to forests at once.
FOREST = 1 << 20

#: Folders that cut() has written and nobody has deleted.
_WRITTEN: set[str] = set()


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later reads don't depend on any executor's disk or on recomputing what came
    before; each call uses a folder of its own, so a retried write can't mix rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wayfold-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wayfold_path = path  # for drop()
    return out


def drop(df: DataFrame | None) -> None:
    """Delete the folder behind a frame that cut() returned."""
    path = getattr(df, "_wayfold_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
    _WRITTEN.discard(path)


def clear(spark: SparkSession) -> int:
    """Delete all folders that cut() has written in this process and that are still there.

    Results that operators return read some of them, so a job calls this when it has
    written its results; how many folders there were."""
    paths = sorted(_WRITTEN)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    out = with_class(both.where("v > u"), low, ["u"], "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    out = with_class(down, low, ["u"], "n", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _places(nodes: pa.Array) -> np.ndarray:
    """A number for each node, equal for equal nodes only and in their order (nulls first)."""
    if pa.types.is_struct(nodes.type):
        parts = [_places(field) for field in nodes.flatten()]
    else:
        plain = nodes.cast(pa.int8()) if pa.types.is_boolean(nodes.type) else nodes
        parts = [pc.rank(plain, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)]
    out = nodes.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
    for own in parts:
        out = np.unique(out * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    return out


def _joined(t: pa.Table) -> pa.RecordBatch:
    """Each node of the edges u, v with the smallest that they connect it to, but for itself."""
    nodes = pa.concat_arrays([*t["u"].chunks, *t["v"].chunks])
    _, first, place = np.unique(_places(nodes), return_index=True, return_inverse=True)
    a, b = place[: t.num_rows], place[t.num_rows :]
    up = np.arange(len(first))
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, top := up[up]):
            up = top
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    hangs = np.flatnonzero(up != np.arange(len(first)))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(first[x])) for x in (hangs, up[hangs])], names=["u", "v"])


def forests(edges: DataFrame, rows: int = FOREST) -> DataFrame:
    """Edges u, v that connect what ``edges`` connect: of each ``rows`` edges of a task, stars
    round the smallest nodes, so fewer edges and fewer rounds are left. Nothing is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield _joined(pa.Table.from_batches(held))
                held = []
        if any(b.num_rows for b in held):
            yield _joined(pa.Table.from_batches(held))

    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges``: u, v (any type with an order), any orientation; loops and repeats are fine. Returns
    node, root, where root is the smallest node of the component, for every node
    that has an edge to another node. Tasks join their own edges first (``forests``), before and after
    the one shuffle that makes edges distinct; where a few tasks hold all, no round is left. Each round is a few
    shuffles of the edge list, kept in the shared folder; nothing but two counts reaches the driver.
    """
    own = forests(edges.where("u <> v"))
    now = cut(forests(own.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), "edges")
    while True:
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        mark = ends.agg(F.sum("up"), F.count_if(F.expr("up > 1 or up > 0 and down > 0"))).first()
        if not mark[1]:  # every node is a root or hangs from one root: all are stars
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            out._wayfold_path = now._wayfold_path
            return out
        large = cut(_large_star(now, mark[0]), "edges")
        then = cut(_small_star(large, mark[0]), "edges")
        drop(large)
        drop(now)
        now = then


def with_class(rows: DataFrame, classes: DataFrame, on: list[str], size: str, every: int | None = None) -> DataFrame:
    """Join rows to their classes, which are unique on ``on`` and have ``size`` rows each
    (``every`` in all, counted where it isn't given).

    Classes that hold a thousandth of the rows or more are a thousand at most, so they are
    broadcast, whatever the size of the tables, and none of them gathers in one task; the
    others are joined by their keys."""
    every = (classes.agg(F.sum(size)).first()[0] or 0) if every is None else every
    least = max(64, -(-every // 1000))
    large = F.broadcast(classes.where(F.col(size) >= least))
    rest = rows.join(large.select(*on), on, "left_anti").join(classes.where(F.col(size) < least).hint("merge"), on)
    return rows.join(large, on).unionByName(rest)
