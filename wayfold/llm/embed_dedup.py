"""Exact near-duplicates of embeddings by PCA-ordered, tiled comparison.

Equal vectors are one class from the start. A rotation onto the principal directions of a
bounded sample puts most of a vector's length into its first coordinates; the rotation
keeps inner products, so only speed depends on the sample. A k-d tree over the sample's
first coordinates parts the classes into tiles. Every tile has the box of its rotated
vectors on all coordinates, and pairs of tiles whose boxes lie too far apart for the
threshold are left out. Within a pair of tiles, blocks of rows accumulate the coordinates
in steps of ``STEP``, leading ones first; the product of what remains is at most the product
of the suffix norms, and a pair stops at the first step where the cosine can't reach the
threshold any more. Cosines that come within 1e-9 of it are computed anew from the given vectors.

A tile pair returns, for each class, how many vectors it links to and the root of its
spanning forest, never the pairs; connected components over the forests give the groups.

The most common vector length of the sample has the rotation and the tree; vectors of any
other length, however many lengths there are, are dealt by hash within their length and
compared unrotated in the same plan. There are at most 2**``DEPTH`` tiles, so the boxes
(sent to all tasks) are of a fixed size, and tiles grow beyond that.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
and vectors of different length don't link with each other. Repeated rows are rows of
one class, each another's link. Ids may be of any type with an order; an id that stands for
different vectors doesn't link them. A row without an id has links and a group like any
other, but never names a group unless no row of it has an id; its component_id is then null,
and it is kept. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import components, cut, drop, with_class
from wayfold.llm.simhash import Forest

#: Classes of a tile (a tile of more than twice as many is dealt in blocks), rows of a block, coordinates of a step, vectors of the sample, levels of the tree.
TILE, BLOCK, STEP, SAMPLE, DEPTH = 8192, 512, 16, 8192, 12
#: Coordinates that the k-d tree looks at.
SPLIT = 8
_NEAR, _ROUGH = 1e-9, 1e-5


class Tiles:
    """The rotation, a k-d tree of 2**depth tiles over rotated unit vectors, and their boxes."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.width = sample.shape[1]
        moments = sample.T @ sample / max(1, len(sample)) if len(sample) else np.eye(self.width)
        values, vectors = np.linalg.eigh(moments)
        self.basis = vectors[:, np.argsort(-values)]
        self.depth = depth
        self.axis = np.zeros(max(1, 2**depth - 1), np.int64)
        self.bound = np.zeros(len(self.axis))
        self.low = self.high = None
        self._grow(0, 0, (sample @ self.basis)[:, :SPLIT])

    def _grow(self, node: int, level: int, own: np.ndarray) -> None:
        if level == self.depth:
            return
        if len(own):
            self.axis[node] = int(np.argmax(own.max(0) - own.min(0)))
            self.bound[node] = float(np.median(own[:, self.axis[node]]))
        side = own[:, self.axis[node]] <= self.bound[node]
        self._grow(2 * node + 1, level + 1, own[side])
        self._grow(2 * node + 2, level + 1, own[~side])

    def tile(self, rotated: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(rotated), np.int64), np.arange(len(rotated))
        for _ in range(self.depth):
            right = rotated[rows, self.axis[node]] > self.bound[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)

    def partners(self, tile: int, reach: float) -> np.ndarray:
        """Tiles whose boxes lie at most ``reach`` from that of ``tile``, itself included."""
        gap = np.maximum(0, np.maximum(self.low[tile] - self.high, self.low - self.high[tile]))
        return np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= reach * reach + 1e-6)


def _unit(flat: np.ndarray, width: int) -> np.ndarray:
    x = flat.reshape(-1, width).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # lengths neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _flat(column) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy() for c in chunks])


def reach_of(threshold: float) -> float:
    """The distance of unit vectors of that cosine."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + _NEAR


def match(a: np.ndarray, b: np.ndarray | None, basis: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions (of a and b; b None: within a, each pair once) with cosine of at
    least ``threshold``, block by block. Rows are unit vectors before the rotation."""
    inner = b is None
    b = a if inner else b
    ra, rb = (a, b) if basis is None else (a @ basis, b @ basis)
    # rows in the order of the first coordinate, so that far blocks fall out as a whole
    oa, ob = np.argsort(ra[:, 0], kind="stable"), np.argsort(rb[:, 0], kind="stable")
    ra, rb = ra[oa], rb[ob]
    steps = [*range(STEP, a.shape[1], STEP), a.shape[1]]
    suffix = lambda r: [np.sqrt(np.maximum(0, np.einsum("ij,ij->i", r[:, s:], r[:, s:]))) for s in steps]
    sa, sb = suffix(ra), suffix(rb)
    # the first step of all pairs in single precision, with a margin for its rounding
    la, lb, ta, tb = (x.astype(np.float32) for x in (ra[:, : steps[0]], rb[:, : steps[0]], sa[0], sb[0]))
    least, reach = np.float32(threshold - _ROUGH), reach_of(threshold)
    for i in range(0, len(ra), BLOCK):
        ends = slice(i, i + BLOCK)
        for j in range(i if inner else 0, len(rb), BLOCK):
            others = slice(j, j + BLOCK)
            if rb[j, 0] - ra[min(i + BLOCK, len(ra)) - 1, 0] > reach or ra[i, 0] - rb[min(j + BLOCK, len(rb)) - 1, 0] > reach:
                continue
            bound = la[ends] @ lb[others].T
            bound += np.multiply.outer(ta[ends], tb[others])
            p, q = np.nonzero(bound >= least)
            if inner and i == j:
                p, q = p[p < q], q[p < q]
            for k in range(0, len(p), 65536):
                pp, qq = p[k : k + 65536] + i, q[k : k + 65536] + j
                cosine, done = np.zeros(len(pp)), 0
                for s, (end, xs, ys) in enumerate(zip(steps, sa, sb)):
                    cosine += np.einsum("ij,ij->i", ra[pp, done:end], rb[qq, done:end])
                    done = end
                    left = cosine + xs[pp] * ys[qq] >= threshold - _NEAR
                    pp, qq, cosine = pp[left], qq[left], cosine[left]
                    if not len(pp):
                        break
                close = np.flatnonzero(np.abs(cosine - threshold) <= _NEAR)
                if len(close):
                    cosine[close] = np.einsum("ij,ij->i", a[oa[pp[close]]], b[ob[qq[close]]])
                hit = cosine >= threshold
                if hit.any():
                    yield oa[pp[hit]], ob[qq[hit]]


def _class_key(v: Column) -> list[Column]:
    """128 bits that stand for a vector."""
    return [F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2")]


def _node(prefix: str) -> Column:
    """A class as a node: ordered by its least id, null last, and told apart by its hashes."""
    least = F.col(f"{prefix}least")
    return F.struct(least.isNull().alias("none"), least.alias("least"), F.col(f"{prefix}h1").alias("h1"), F.col(f"{prefix}h2").alias("h2"))


def group(df: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", tile: int = TILE) -> DataFrame:
    """key, n_links, component_id and kept of every row."""
    kind = df.schema[vector].dataType.elementType
    v = F.col(vector) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(vector).cast("array<double>")
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    flagged = df.select(F.col(key).alias("key"), F.when(usable, v).alias("v")).select("key", "v", *(F.when(F.col("v").isNotNull(), h).alias(n) for h, n in zip(_class_key(F.col("v")), ("h1", "h2"))))
    classes = cut(flagged.where("v is not null").groupBy("h1", "h2").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")), "vectors")
    found = cut(_links(classes, threshold, tile), "vector-links")
    roots = components(found.select(_node("").alias("u"), _node("r_").alias("v")))
    named = roots.select("node.h1", "node.h2", F.col("root.least").alias("component"))
    links = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    own = classes.select("h1", "h2", "least", "n").join(links, ["h1", "h2"], "left").join(named, ["h1", "h2"], "left")
    own = cut(own.select("h1", "h2", "n", (F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1).alias("n_links"), F.when(F.col("links").isNull(), F.col("least")).otherwise(F.col("component")).alias("component")), "vector-groups")
    for done in (found, classes, roots):
        drop(done)
    found = with_class(flagged.where("v is not null").select("key", "h1", "h2"), own, ["h1", "h2"], "n").select("key", "n_links", "component")
    alone = flagged.where("v is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    out = found.unionByName(alone)
    return out.select(F.col("key").alias(key), "n_links", F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))


def _links(classes: DataFrame, threshold: float, tile: int) -> DataFrame:
    """least, h1, h2, links, r_least, r_h1, r_h2: what each tile pair found for each class,
    and the root of its forest."""
    spark, reach = classes.sparkSession, reach_of(threshold)
    sizes = classes.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), "width").first()
    width, count = (most["width"], most["n"]) if most else (1, 0)
    # tiles of at most ``tile`` classes; smaller ones, but of 2048 at least, where cores would idle
    busy = min(math.ceil(math.log2(math.sqrt(4 * spark.sparkContext.defaultParallelism))), math.floor(math.log2(max(1, count / 2048))))
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, count) / tile)), busy))
    main = F.size("v") == width
    sample = classes.where(main).orderBy("h1", "h2").limit(SAMPLE).select("v").toArrow()["v"]
    tiles = Tiles(_unit(_flat(sample), width) if len(sample) else np.zeros((0, width)), depth)
    plan = spark.sparkContext.broadcast(tiles)

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, low, high = plan.value, np.full((2**depth, width), np.inf, np.float32), np.full((2**depth, width), -np.inf, np.float32)
        held = np.zeros(2**depth, np.int64)
        for b in batches:
            if b.num_rows:
                rotated = _unit(_flat(b.column(0)), width) @ t.basis
                at = t.tile(rotated)
                np.minimum.at(low, at, rotated.astype(np.float32))
                np.maximum.at(high, at, rotated.astype(np.float32))
                held += np.bincount(at, minlength=len(held))
        some = np.flatnonzero(low[:, 0] <= high[:, 0])
        rows = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * width, pa.int32()), pa.array(x[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some), rows(low), rows(high), pa.array(held[some])], names=["tile", "low", "high", "n"])

    def whole_box(group: pa.Table) -> pa.Table:
        low, high = (_flat(group[c]).reshape(-1, width) for c in ("low", "high"))
        return pa.table({"tile": group["tile"][:1], "low": pa.array([low.min(0)], pa.list_(pa.float32())), "high": pa.array([high.max(0)], pa.list_(pa.float32())), "n": [sum(group["n"].to_pylist())]})

    tiles.low, tiles.high = np.full((2**depth, width), np.inf), np.full((2**depth, width), -np.inf)
    blocks = np.ones(2**depth, np.int64)
    if depth:
        box = "tile long, low array<float>, high array<float>, n long"
        for r in classes.where(main).select("v").mapInArrow(boxes, box).groupBy("tile").applyInArrow(whole_box, box).collect():
            tiles.low[r["tile"]], tiles.high[r["tile"]] = r["low"], r["high"]
            blocks[r["tile"]] = -(-r["n"] // tile) if r["n"] > 2 * tile else 1
    else:
        tiles.low[:], tiles.high[:] = -1, 1
        blocks[:] = -(-count // tile) if count > 2 * tile else 1
    tiles.blocks, tiles.first = blocks, np.cumsum(blocks) - blocks  # a tile that the tree leaves too large is dealt in blocks, cells of their own
    plan = spark.sparkContext.broadcast(tiles)

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    some = f"least {kinds['least']}, h1 long, h2 long, n long, v {kinds['v']}"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = plan.value
        for b in batches:
            if b.num_rows:
                own = t.tile(_unit(_flat(b.column(4)), width) @ t.basis)
                at = t.first[own] + b.column(1).to_numpy() % t.blocks[own]
                known = {}
                for x, o in {*zip(at.tolist(), own.tolist())}:
                    others = np.concatenate([np.arange(t.first[p], t.first[p] + t.blocks[p]) for p in t.partners(o, reach)])
                    known[x] = np.minimum(x, others) << 32 | np.maximum(x, others)
                met = [known[x] for x in at.tolist()]
                pairs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, met)]), pa.int32()), pa.array(np.concatenate(met)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pairs], names=[*b.schema.names, "tile", "pairs"])

    cols = ["least", "h1", "h2", "n", "v"]
    first = classes.where(main).select(*cols).mapInArrow(deal, f"{some}, tile long, pairs array<long>")
    parts = F.ceil(F.col("count") / F.lit(tile)).cast("long")
    others = classes.where(~main).withColumn("width", F.size("v")).join(sizes.select("width", F.col("n").alias("count")), "width")
    others = others.withColumn("tile", F.pmod(F.col("h1"), parts))
    pair = lambda o: F.call_function("shiftleft", F.least(F.col("tile"), o), F.lit(32)).bitwiseOR(F.greatest(F.col("tile"), o))
    others = others.withColumn("pairs", F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), pair)).select(*cols, "tile", "pairs")
    dealt = first.unionByName(others).select(*cols, "tile", F.size("v").alias("width"), F.explode("pairs").alias("pair"))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        w, pair = group["width"][0].as_py(), group["pair"][0].as_py()
        n, at, x = group["n"].to_numpy(), group["tile"].to_numpy(), _unit(_flat(group["v"]), group["width"][0].as_py())
        one, two = np.flatnonzero(at == pair >> 32), np.flatnonzero(at == pair & 0xFFFFFFFF)
        links, forest, basis = np.zeros(len(n), np.int64), Forest(len(n)), plan.value.basis if w == width else None
        if pair >> 32 == pair & 0xFFFFFFFF:
            found = ((one[p], one[q]) for p, q in match(x[one], None, basis, threshold))
        elif len(one) and len(two):
            found = ((one[p], two[q]) for p, q in match(x[one], x[two], basis, threshold))
        else:
            found = ()
        for p, q in found:
            np.add.at(links, p, n[q])
            np.add.at(links, q, n[p])
            forest.join(p, q)
        mine = np.flatnonzero(links)
        own, root = group.take(pa.array(mine)), group.take(pa.array(forest.find(mine)))
        return pa.table({"least": own["least"], "h1": own["h1"], "h2": own["h2"], "links": links[mine], "r_least": root["least"], "r_h1": root["h1"], "r_h2": root["h2"]})

    out = f"least {kinds['least']}, h1 long, h2 long, links long, r_least {kinds['least']}, r_h1 long, r_h2 long"
    return dealt.groupBy("width", "pair").applyInArrow(compare, out)
