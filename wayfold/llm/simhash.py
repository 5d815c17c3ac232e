"""SimHash fingerprints of word shingles and exact near-duplicate groups by vantage points.

Fingerprints at a Hamming distance of at most ``RADIUS`` link; groups are what links
connect. Equal fingerprints are one class from the start, however many documents share
it. A vantage-point tree over a bounded sample of classes parts all of them into shards
of about ``SHARD`` classes. By the triangle inequality a pair that a boundary separates
has its inner member within RADIUS of the boundary, so only those are sent across, as
visitors: every pair meets in exactly the shard where one of the two is at home. Inside
a shard the same recursion prunes branches down to small blocks that are compared in
full. A shard returns the spanning forest of its links, never the pairs themselves, and
connected components over the forests give the groups.

Null or empty text, or white space only: fingerprint zero, linked like any other. Texts of
fewer words than a shingle give one shingle of all their words. Repeated rows are rows
of one class; a key that stands for different texts doesn't link them. Rows with a null key
have the group of their fingerprint, or null where no row with a key is in it. Extra columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm import shingles
from wayfold.llm.common import components, cut, drop, with_class

WORDS, RADIUS, SEED = 4, 4, 42
#: Classes of a shard, and classes that the tree is fitted on at most (only the shape of
#: the tree depends on them).
SHARD, SAMPLE = 32_768, 8_192
#: Levels of the tree at most; shards that are still too large are compared in blocks.
DEPTH = 11
_LEAF = 512


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        some = hashes[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    return majority(shingles.shingle_hashes(text, words))


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS) -> DataFrame:
    """key and fp (the 64 bits as a long) of every row, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[key, "fp"])

    some = df.select(key, F.col(text).alias("__text"))
    return some.mapInArrow(run, T.StructType([some.schema.fields[0], T.StructField("fp", T.LongType())]))


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """A complete binary vantage-point tree of ``depth`` levels over a sample."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int = RADIUS):
        self.depth, self.radius = depth, radius
        self.point = np.zeros(max(1, 2**depth - 1), np.uint64)
        self.bound = np.zeros(len(self.point), np.int64)
        self._grow(0, 0, sample)

    def _grow(self, node: int, level: int, own: np.ndarray) -> None:
        if level == self.depth:
            return
        if len(own) == 0:
            own = np.zeros(1, np.uint64)
        best = None
        for v in own[:: max(1, len(own) // 24)]:
            d = _distance(own, v).astype(np.int64)
            mu = int(np.median(d))
            near = np.count_nonzero((d <= mu) & (d > mu - self.radius)) + abs(2 * np.count_nonzero(d <= mu) - len(own))
            if best is None or near < best[0]:
                best = near, v, mu, d
        _, self.point[node], self.bound[node], d = best
        self._grow(2 * node + 1, level + 1, own[d <= best[2]])
        self._grow(2 * node + 2, level + 1, own[d > best[2]])

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index into fps, shard, and whether it is a visitor there, for every stay."""
        r = self.radius
        at = [(0, np.arange(len(fps)), np.zeros(len(fps), bool))]
        for _ in range(self.depth):
            below = []
            for node, idx, visits in at:
                d, mu = _distance(fps[idx], self.point[node]).astype(np.int64), self.bound[node]
                inner = np.where(visits, d <= mu + r, d <= mu)
                outer = np.where(visits, d > mu - r, d > mu)
                across = ~visits & (d <= mu) & (d > mu - r)
                below.append((2 * node + 1, idx[inner], visits[inner]))
                below.append((2 * node + 2, np.concatenate([idx[outer], idx[across]]), np.concatenate([visits[outer], np.ones(across.sum(), bool)])))
            at = below
        first = 2**self.depth - 1
        return tuple(np.concatenate(x) for x in ([i for _, i, _ in at], [np.full(len(i), node - first) for node, i, _ in at], [v for _, _, v in at]))


class Forest:
    """Union-find over positions, in whole arrays; the smaller position becomes the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            x = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            differ = a != b
            a, b = a[differ], b[differ]
            self.parent[np.maximum(a, b)] = np.minimum(a, b)


def join_shard(home: np.ndarray, visitors: np.ndarray, radius: int = RADIUS, inside: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of the forest of links among home (if ``inside``), and of visitors to home."""
    all_ = np.concatenate([home, visitors])
    forest = Forest(len(all_))
    rng = np.random.default_rng(7)

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), 1024):
            x = a[i : i + 1024]
            for j in range(0, len(b), 2048):
                y = b[j : j + 2048]
                p, q = np.nonzero(_distance(all_[x][:, None], all_[y][None, :]) <= radius)
                forest.join(x[p], y[q])

    def parts(of: np.ndarray):
        v = all_[of[rng.integers(len(of))]]
        d = _distance(all_[of], v)
        return v, d, np.median(d)

    def within(own: np.ndarray) -> None:
        todo = [own]
        while todo:
            own = todo.pop()
            if len(own) <= _LEAF:
                compare(own, own)
                continue
            _, d, mu = parts(own)
            if not (d > mu).any():  # no boundary to be had here
                compare(own, own)
                continue
            todo += [own[d <= mu], own[d > mu]]
            across(own[(d <= mu) & (d > mu - radius)], own[(d > mu) & (d <= mu + radius)])

    def across(a: np.ndarray, b: np.ndarray) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if len(a) < len(b):
                a, b = b, a
            if len(b) == 0:
                continue
            if len(a) <= _LEAF:
                compare(a, b)
                continue
            v, d, mu = parts(a)
            if not (d > mu).any():
                compare(a, b)
                continue
            e = _distance(all_[b], v)
            todo += [(a[d <= mu], b[e <= mu + radius]), (a[d > mu], b[e > mu - radius])]

    n = len(home)
    if inside:
        within(np.arange(n))
    if len(visitors):
        across(np.arange(n, len(all_)), np.arange(n))
    root = forest.find(np.arange(len(all_)))
    member = np.flatnonzero(root != np.arange(len(all_)))
    return all_[member], all_[root[member]]


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Forest edges u, v between classes (least, fp; fp distinct) that link, in shards.

    A shard of more than twice SHARD classes (deeper trees would need a larger sample) is
    compared in blocks of SHARD: home blocks within and with each other, and with blocks of visitors,
    so that no task holds more than two blocks, however many classes there are."""
    spark, n = classes.sparkSession, classes.count()
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, n) / SHARD))))
    sample = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE) if depth else classes.limit(0)
    tree = Tree(np.array([r[0] for r in sample.select("fp").collect()], np.int64).view(np.uint64), depth, radius)
    kind = classes.schema["least"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(1).to_numpy(zero_copy_only=False)
            idx, shard, visits = tree.route(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), batch.column(0).take(pa.array(idx)), pa.array(fps[idx]), pa.array(visits)], names=["shard", "least", "fp", "visits"])

    def match(group: pa.Table) -> pa.Table:
        group = group.sort_by("fp")
        fps, visits = group["fp"].to_numpy().view(np.uint64), group["visits"].to_numpy()
        order = np.argsort(fps, kind="stable")
        inside = group["one"][0].as_py() == group["two"][0].as_py()
        guest = visits if inside else group["block"].to_numpy() == group["two"][0].as_py()
        u, v = join_shard(fps[order][~guest[order]], fps[order][guest[order]], radius, inside)
        place = lambda x: pa.array(order[np.searchsorted(fps[order], x)])
        u, v = (group.take(place(x)) for x in (u, v))
        return pa.table({"ul": u["least"], "uf": u["fp"], "vl": v["least"], "vf": v["fp"]})

    routed = classes.select("least", "fp").mapInArrow(route, f"shard long, least {kind}, fp long, visits boolean")
    size = routed.groupBy("shard").agg(F.count_if(~F.col("visits")).alias("h"), F.count_if("visits").alias("g"))
    large = size.where(F.col("h") + F.col("g") > 2 * SHARD).collect() if depth else []  # of 2 ** DEPTH shards at most
    if large:
        parts = spark.createDataFrame([(r["shard"], max(1, -(-r["h"] // SHARD)), -(-r["g"] // SHARD)) for r in large], "shard long, hb long, gb long")
        routed = routed.join(F.broadcast(parts), "shard", "left").withColumn("block", F.when(F.col("visits"), F.col("hb") + F.pmod(F.xxhash64("fp"), "gb")).otherwise(F.pmod(F.xxhash64("fp"), "hb")))
        span = lambda a, b: F.filter(F.sequence(F.lit(0).cast("long"), b - 1), lambda x: x >= a)
        pair = lambda a, b: F.struct(F.least(a, b).alias("one"), F.greatest(a, b).alias("two"))
        home = F.transform(span(F.lit(0), F.col("hb") + F.col("gb")), lambda x: pair(F.col("block"), x))
        tasks = F.when(F.col("hb").isNull(), F.array(pair(F.lit(0).cast("long"), F.lit(0).cast("long")))).when(F.col("visits"), F.transform(span(F.lit(0), F.col("hb")), lambda x: pair(F.col("block"), x))).otherwise(home)
        routed = routed.select("shard", "least", "fp", F.col("visits") & F.col("hb").isNull(), F.coalesce("block", F.lit(0)), F.explode(tasks).alias("t")).toDF("shard", "least", "fp", "visits", "block", "t").select("shard", "least", "fp", "visits", "block", "t.one", "t.two")
    else:
        routed = routed.withColumns({c: F.lit(0).cast("long") for c in ("block", "one", "two")})
    found = routed.groupBy("shard", "one", "two").applyInArrow(match, f"ul {kind}, uf long, vl {kind}, vf long")
    node = lambda k: F.struct(F.col(f"{k}l").isNull().alias("none"), F.col(f"{k}l").alias("least"), F.col(f"{k}f").alias("fp"))
    return found.select(node("u").alias("u"), node("v").alias("v"))


def grouped(prints: DataFrame, key: str, radius: int = RADIUS) -> DataFrame:
    """fp, n (its rows), least and root_fp of every class of ``prints`` (key, fp): the smallest
    key of its group and the fingerprint that stands for the group.

    Nodes are (least key, fingerprint), so the smallest node of a group names it, and no join
    on groups is needed however large one is."""
    classes = cut(prints.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    edges = cut(links(classes, radius), "links")
    roots = components(edges).select(F.col("node.fp").alias("fp"), F.col("root.least").alias("root_least"), F.col("root.fp").alias("root_fp"))
    drop(edges)
    return classes.join(roots, "fp", "left").select("fp", "n", F.coalesce("root_least", "least").alias("least"), F.coalesce("root_fp", "fp").alias("root_fp"))


def group(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """key, fp and component_id (the smallest key reachable by links) of every row."""
    prints = cut(fingerprints(df, text, key, words), "prints")
    named = cut(grouped(prints, key, radius).select("fp", "n", F.col("least").alias("component_id")), "named")
    return with_class(prints, named, ["fp"], "n").select(key, "fp", "component_id")


def one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = shingles.WORDS, radius: int = RADIUS, similarity: float = shingles.THRESHOLD) -> DataFrame:
    """One row of ``df`` for each group of near-duplicates: the one of smallest key.

    Groups are formed twice: by fingerprints of ``words`` words at ``radius`` bits, and then,
    among the rows that stand for those groups, by a Jaccard similarity of at least
    ``similarity`` of their shingles (see shingles.py for why and how). Of different texts
    of one key in a group the one of smaller fingerprint stays, and one of exactly equal
    rows (by a hash where only other columns differ). Rows with a null key all stay. An
    empty table gives an empty one.

    The texts are read three times and shuffled once, by a sort-merge join at every size: the
    rows that stay grow with the input, so they are never broadcast."""
    whole = df.where(F.col(key).isNotNull())
    own = cut(shingles.sketches(whole, text, key, words, majority), "sketches")
    classes = grouped(own, key, radius).where(F.col("fp") == F.col("root_fp")).select(F.col("least").alias(key), "fp")
    first = own.join(classes.hint("merge"), [key, "fp"], "left_semi")
    first = cut(first.groupBy(key, "fp").agg(F.min(F.struct("h", "n", "bands", "bits")).alias("r"), F.count(F.lit(1)).alias("copies")).select(key, "r.*", "copies"), "first")
    roots = shingles.similar(first, whole, text, key, words, similarity)
    linked = roots.join(first.select("h", key).hint("merge"), roots["node"] == F.col("h")).select("root", "h", key)
    best = linked.groupBy("root").agg(F.min(F.struct(key, "h")).alias("best")).select("best.h")
    gone = linked.select("h").join(best.hint("merge"), "h", "left_anti")
    kept = cut(first.join(gone.hint("merge"), "h", "left_anti").select(key, "h", "copies"), "kept")
    drop(own), drop(first), drop(roots)
    out = df.join(kept.select(key, "h").hint("merge"), (df[key] == kept[key]) & (F.xxhash64(df[key], df[text]) == kept["h"]), "left_semi").select(*df.columns)
    if kept.where("copies > 1").limit(1).count():
        plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        out = out.groupBy(key, F.xxhash64(key, text)).agg(F.min_by(F.struct(*df.columns), F.xxhash64(*plain)).alias("__row")).select("__row.*")
    return out.unionByName(df.where(F.col(key).isNull()))


def digest(df: DataFrame) -> DataFrame:
    out = group(df)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
