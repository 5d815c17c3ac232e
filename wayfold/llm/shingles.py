"""Pairs of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Beyond a few bits SimHash can't serve: at a similarity of 0.8 some 10 of 64 bits differ (up
to 18 with all of the spread), where a ball round a fingerprint holds so much of the space
that no branch of a vantage-point tree falls out. So texts that ``simhash`` has left are
proposed to each other by MinHash: ``BANDS`` bands of ``ROWS`` minima meet in at least one
band with a chance of 0.997 at a similarity of 0.8, and above 0.9999 from 0.85 on. One bit of
each minimum (a sketch of 256) then holds back what is clearly less similar: 25.6 of them
differ on average at 0.8, and ``SKETCH_BITS`` may. What is left is checked exactly on the
whole sets, so nothing below the threshold links.

A band's meeting never makes its pairs as rows, nor in one task. First every text is checked with one head, the
closest by sketch among the heads of its bands; then pairs that this left in different
groups are, inside the tasks that their band is dealt to. Each text is in ``BANDS`` small rows, whatever its length, and only texts that
met any other have their sets made again.

Words are lower-cased (A-Z) and parted by white space; a text of fewer words than a shingle
is one shingle. Texts without words are similar to none here. Shingles are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import components, cut, drop

WORDS, THRESHOLD, SEED = 5, 0.8, 42
ROWS, BANDS, SKETCH_BITS = 8, 32, 45
#: Bits of the filter that holds back texts which met no other, before their sets are made.
_SLOTS = 1 << 24

_RNG = np.random.default_rng(20240301)
_TIMES, _PLUS = (_RNG.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32) for _ in range(2))
_TIMES |= np.uint32(1)
_MIX, _SALT = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1), _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of all shingles in order, repeats included (unsigned)."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    at = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1)
    starts = [0, *at[: n - words].tolist()]
    ends = (at[words - 1 :] - 1).tolist()
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], np.uint64)


def bands_and_sketch(own: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One hash for each band, and one bit for each minimum, of a set of hashes."""
    if not len(own):
        return np.zeros(0, np.int64), b""
    low = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    x = (own >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 2048):  # bounded memory for very long texts
        np.minimum(low, (x[k : k + 2048, None] * _TIMES + _PLUS).min(axis=0), out=low)
    bands = (low.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64) + _SALT
    return bands.view(np.int64), np.packbits(low & np.uint32(1)).tobytes()


def sketches(df: DataFrame, text: str, key: str, words: int, fingerprint) -> DataFrame:
    """key, h (hash of key and text), fp (``fingerprint`` of the shingle hashes), n (size
    of the set), bands and bits of every row, in one narrow pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, bands, bits = [], [], [], []
            for x in batch.column(2):
                hashes = shingle_hashes(x.as_py(), words)
                own = np.unique(hashes)
                fps.append(fingerprint(hashes))
                sizes.append(len(own))
                b, s = bands_and_sketch(own)
                bands.append(b)
                bits.append(s)
            ends = np.cumsum([0, *map(len, bands)])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), listed, pa.array(bits, pa.binary())], names=[key, "h", "fp", "n", "bands", "bits"])

    some = df.select(key, F.xxhash64(key, text).alias("h"), F.col(text).alias("__text"))
    fields = [some.schema.fields[0], *(T.StructField(k, t) for k, t in (("h", T.LongType()), ("fp", T.LongType()), ("n", T.IntegerType()), ("bands", T.ArrayType(T.LongType())), ("bits", T.BinaryType())))]
    return some.mapInArrow(run, T.StructType(fields))


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches, cut anew so that rows of one ``at`` stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column("at").to_numpy()
        end = int(np.searchsorted(at, at[-1]))
        if end:
            yield pa.Table.from_batches([*held, batch.slice(0, end)])
            held = [batch.slice(end)]
        elif held and held[-1].column("at")[0].as_py() != at[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _ends(new: np.ndarray) -> np.ndarray:
    """For each row, where its run ends."""
    starts = np.flatnonzero(new)
    return np.append(starts[1:], len(new))[np.cumsum(new) - 1]


def meetings(own: DataFrame) -> DataFrame:
    """at, h, head: the rows of bands at which two or more texts meet, with the least h of each.

    Bands are counted with partial aggregation and joined back as rows, so one that very many
    texts share is no group anywhere; Spark splits it like any skewed join."""
    rows = own.select(F.explode("bands").alias("at"), "h")
    bands = rows.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("head")).where("n > 1")
    return rows.join(bands.select("at", "head").hint("merge"), "at").select("at", "h", "head")


class _Run:
    """Columns of some rows, and which pairs of them may be similar."""

    def __init__(self, t: pa.Table | pa.RecordBatch, threshold: float, n: str = "n", bits: str = "bits"):
        self.n = t[n].to_numpy()
        self.bits = np.frombuffer(b"".join(t[bits].to_pylist()), np.uint64).reshape(len(self.n), -1)
        self.threshold = threshold

    def gap(self, i: np.ndarray, j: np.ndarray, other: _Run | None = None) -> np.ndarray:
        """Sketch bits that differ; -1 where the pair can't be similar."""
        other = other or self
        a, b = np.minimum(self.n[i], other.n[j]), np.maximum(self.n[i], other.n[j])
        differ = np.bitwise_count(self.bits[i] ^ other.bits[j]).sum(axis=1).astype(np.int64)
        return np.where((a >= self.threshold * b - 1e-9) & (differ <= SKETCH_BITS), differ, -1)


def _pairs(a: np.ndarray, b: np.ndarray, gap: np.ndarray) -> pa.RecordBatch:
    good = (gap >= 0) & (a != b)
    return pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (a, b, gap)], names=["a", "b", "gap"])


def to_heads(met: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """a, b: each text b with the closest of its bands' heads, a. ``met``: h, head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                one, two, i = _Run(t, threshold), _Run(t, threshold, "head_n", "head_bits"), np.arange(t.num_rows)
                yield _pairs(t["head"].to_numpy(), t["h"].to_numpy(), one.gap(i, i, two))

    heads = own.select(F.col("h").alias("head"), F.col("n").alias("head_n"), F.col("bits").alias("head_bits"))
    asked = met.where("h <> head").select("h", "head").distinct().join(own.select("h", "n", "bits").hint("merge"), "h").join(heads.hint("merge"), "head")
    found = asked.select("h", "n", "bits", "head", "head_n", "head_bits").mapInArrow(run, "a long, b long, gap long")
    return found.groupBy("b").agg(F.min(F.struct("gap", "a")).alias("best")).select("best.a", "b")


#: Rows of a band, and shingles of their sets, that are compared in one task, about; a larger
#: band is compared in blocks of as many.
CROWD, ROOM = 4096, 4 << 20


def _parts(met: DataFrame, own: DataFrame, roots: DataFrame, crowd: int) -> DataFrame:
    """at, band, root, h, n, bits, bands, side: the rows of the parts in which bands are compared.

    Bands all of whose texts are in one group are left out. A band of more than ``crowd`` rows, or more
    than ``ROOM`` shingles, is dealt in blocks by h, and each two of its blocks meet in a part of
    its own, so that no task holds more than two blocks of a band; every pair meets in one part."""
    of = met.select("at", "h").join(roots.hint("merge"), F.col("h") == F.col("node"), "left").select("at", "h", F.coalesce("root", "h").alias("root"))
    of = cut(of.join(own.select("h", "n").hint("merge"), "h").select("at", "h", "root", "n"), "bands")
    mixed = of.groupBy("at").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    blocks = mixed.select("at", F.greatest(F.ceil(F.col("rows") / crowd), F.least("rows", F.ceil(F.col("size") / ROOM))).cast("int").alias("blocks"))
    some = of.drop("n").join(blocks.hint("merge"), "at").join(own.select("h", "n", "bits", "bands").hint("merge"), "h")
    mine = F.pmod("h", "blocks").cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(mine, x).alias("one"), F.greatest(mine, x).alias("two")))
    each = some.select("at", "h", "n", "bits", "bands", "root", mine.alias("mine"), F.explode(parts).alias("p"))
    side = F.when(F.col("p.one") == F.col("p.two"), 2).when(F.col("mine") == F.col("p.one"), 0).otherwise(1)
    out = each.select(F.when(F.col("p.two") == 0, F.col("at")).otherwise(F.xxhash64("at", "p.one", "p.two")).alias("at"), F.col("at").alias("band"), "root", "h", "n", "bits", "bands", side.alias("side"))
    out._wayfold_path = of._wayfold_path  # for drop()
    return out


def _unlike(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of one part that are of different groups, up to 65,536 at a time."""
    root, side, at = t["root"].to_numpy(), t["side"].to_numpy(), t["at"].to_numpy()
    end, other = _ends(_changes(at)), _ends(_changes(at, root))
    i = np.flatnonzero(other < end)
    j = other[i]
    while len(i):
        for k in range(0, len(i), 65536):
            p, q = i[k : k + 65536], j[k : k + 65536]
            fair = (side[p] != side[q]) | (side[p] == 2)
            yield p[fair], q[fair]
        j = j + 1
        more = j < end[i]
        i, j = i[more], j[more]


def _proposed(t: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of _unlike() that may be similar, each in the first only of the bands that both are in."""
    r, band = _Run(t, threshold), t["band"].to_numpy()
    bands = np.array(t["bands"].to_pylist(), np.int64)
    for p, q in _unlike(t):
        good = r.gap(p, q) >= 0
        p, q = p[good], q[good]
        first = np.argmax(bands[p] == bands[q], axis=1)
        good = bands[p, first] == band[p]
        yield p[good], q[good]


def across(met: DataFrame, own: DataFrame, roots: DataFrame, threshold: float, crowd: int = CROWD) -> DataFrame:
    """a, b: all pairs of different groups that meet and may be similar, as many as there are: for
    small tables, to compare ``linked_across`` with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_runs(batches):
            r, h = _Run(t, threshold), t["h"].to_numpy()
            for p, q in _unlike(t):
                yield _pairs(np.minimum(h[p], h[q]), np.maximum(h[p], h[q]), r.gap(p, q))

    each = _parts(met, own, roots, crowd)
    found = each.select("at", "root", "h", "n", "bits", "side").repartition("at").sortWithinPartitions("at", "root", "h").mapInArrow(run, "a long, b long, gap long")
    out = found.select("a", "b").distinct()
    out._wayfold_path = each._wayfold_path
    return out


def linked_across(met: DataFrame, own: DataFrame, sets: DataFrame, roots: DataFrame, threshold: float, crowd: int = CROWD) -> DataFrame:
    """u, v: edges that connect the groups of ``roots`` which similar pairs connect. ``sets``: h, shingles.

    Every pair that across() lists is looked at, but none is ever a row: first the rows of a part stay
    that any such pair is of; then their sets are brought to the part, its pairs are checked
    there, and only those that connect two groups for the first time come out. So no step makes more
    rows than it gets, however many pairs a group has; a pair that is connected already isn't checked."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_runs(batches):
            some = np.zeros(t.num_rows, bool)
            for p, q in _proposed(t, threshold):
                some[p] = some[q] = True
            yield from t.filter(pa.array(some)).to_batches()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_runs(batches):
            held = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["shingles"]]
            h, root, up = t["h"].to_numpy(), t["root"].to_numpy().tolist(), {}

            def find(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    up[x] = x = up.get(y, y)
                return x

            found = []
            for p, q in _proposed(t, threshold):
                for i, j in zip(p.tolist(), q.tolist()):
                    x, y = find(root[i]), find(root[j])
                    if x != y and _alike(held[i], held[j], threshold):
                        up[max(x, y)] = min(x, y)
                        found.append((i, j))
            i, j = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array(h[j])], names=["u", "v"])

    each = _parts(met, own, roots, crowd)
    some = each.repartition("at").sortWithinPartitions("at", "root", "h").mapInArrow(asked, each.schema)
    whole = some.join(sets.select("h", "shingles").hint("merge"), "h").select(*each.columns, "shingles")
    out = whole.repartition("at").sortWithinPartitions("at", "root", "h").mapInArrow(link, "u long, v long")
    out._wayfold_path = each._wayfold_path  # for drop()
    return out


def sets_of(df: DataFrame, asked: DataFrame, text: str, key: str, words: int) -> DataFrame:
    """h and shingles (sorted hashes) of the asked texts. A bitmap of fixed size, gathered by
    an aggregate, holds most other texts back before their shingles are made."""
    slot = F.col("h").bitwiseAND(_SLOTS - 1) + 1
    maps = asked.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    whole = np.zeros(_SLOTS // 8, np.uint8)
    for bucket, bits in maps:
        whole[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(0).to_numpy() & (_SLOTS - 1)
            some = batch.filter(pa.array((whole[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)))
            made = pa.array([np.unique(shingle_hashes(x.as_py(), words)).tobytes() for x in some.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([some.column(0), made], names=["h", "shingles"])

    made = df.select(F.xxhash64(key, text).alias("h"), F.col(text).alias("__text")).mapInArrow(run, "h long, shingles binary")
    return made.join(asked.hint("merge"), "h", "left_semi").groupBy("h").agg(F.first("shingles").alias("shingles"))


def _alike(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets are similar enough."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = np.count_nonzero(both[1:] == both[:-1])
    return shared >= threshold * (len(both) - shared) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets are similar enough, as edges u, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                good.append(_alike(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)), threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(sets.select(F.col("h").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a")
    both = left.join(sets.select(F.col("h").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "u long, v long")


def similar(own: DataFrame, df: DataFrame, text: str, key: str, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """node, root (both h): the groups of the rows of ``own`` (sketches, h unique) that
    similar pairs connect. ``df`` has their texts. Rows similar to none aren't listed."""
    met = cut(meetings(own), "meetings")
    sets = cut(sets_of(df, met.select("h").distinct(), text, key, words), "sets")
    near = cut(verified(to_heads(met, own, threshold), sets, threshold), "links")
    first = components(near)
    wanted = linked_across(met, own, sets, first, threshold)
    far = cut(wanted, "links")
    drop(wanted)
    roots = components(near.unionByName(far))
    for done in (met, sets, near, far, first):
        drop(done)
    return roots
