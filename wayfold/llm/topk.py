"""Exact top-k inner products by aggregation without random access.

Vectors become integers, floor(scale * x). Rows and queries are dealt into a grid of cells;
in a cell every dimension is one list of its rows, sorted by value. A query reads each list
from its better end, ``STEPS`` steps of equal depth, and nothing else. What a row has been
read with counts as it is; a list that has not shown the row yet gives at most what it shows at
its present depth and at least its last entry. So each row's score lies between two sums,
which are kept by reading alone: the lower one grows with each entry read, and the upper one
also falls as the lists that have shown the row go deeper. Reading stops as soon as at most
``FINAL`` times k rows can still reach the k-th best lower bound; only the scores of
those are then resolved. Each cell gives a query's k best; the best k of all
cells are the answer, so no group holds more than k rows a cell. ``Lists.read`` counts entries read.

How early reading stops depends on the data: where a few dimensions carry the scores it
stops soon, and where all of them carry alike bounds of this kind close only near the end of
the lists.

Vectors that are null, or hold null or non-finite components, take no part; nor do rows
whose id is null. Vectors of different length are compared as if filled up with zeros. Doubles
hold all sums exactly for components below a bound; rows and queries with a greater one are
compared in integers of any length, they alone. A score beyond 64 bits is null, in its right
rank. Queries are distinct ids (of rows that repeat an id, the one of least vector asks); rows
that share a query's id are its own and left out; rows that repeat are candidates each. Fewer
rows than k give all of them; an empty table gives none. Extra columns are not read.
"""

from __future__ import annotations

import math
from fractions import Fraction
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a cell at most, queries of a cell, and how many times k rows are resolved.
ROWS, QUERIES, FINAL = 8192, 8192, 32
#: Steps in which lists are read.
STEPS = 8
_NONE = -np.inf


class Lists:
    """The rows of one cell; for each dimension its rows in descending and ascending order of
    value, with the values."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order].astype(np.float64)
        up = np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32)
        self.order = np.ascontiguousarray(up[:, ::-1]), np.ascontiguousarray(up)
        self.values = tuple(np.take_along_axis(self.rows.T, o, axis=1) for o in self.order)
        self.read = [0, 0]  # entries read, and all that there were

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, by score and then smaller id.

        Values are whole numbers in double precision; callers see to it that sums are exact."""
        n, dims = len(self.ids), np.flatnonzero(q)
        self.read[1] += n * len(dims)
        end = (q[dims] < 0).astype(int)
        weight = q[dims].astype(np.float64)
        order, values = (np.stack([x[e][d] for d, e in zip(dims, end)]) if len(dims) else np.zeros((0, n), int) for x in (self.order, self.values))
        last = weight * values[:, -1] if n else weight  # the least that a list gives
        least = np.full(n, last.sum())
        least[np.searchsorted(self.ids, query_id) : np.searchsorted(self.ids, query_id, "right")] = _NONE  # its own rows
        others = n - np.count_nonzero(least == _NONE)
        for step in range(STEPS):
            a, b = n * step // STEPS, n * (step + 1) // STEPS
            if b > a and len(dims):
                self.read[0] += (b - a) * len(dims)
                gain = weight[:, None] * values[:, a:b] - last[:, None]
                least += np.bincount(order[:, a:b].ravel(), weights=gain.ravel(), minlength=n)
            if step + 1 == STEPS:
                most = least
            else:
                room = weight * values[:, b - 1] - last if b else np.abs(weight) * np.inf
                shown = np.bincount(order[:, :b].ravel(), weights=np.repeat(room, b), minlength=n)
                most = least + (room.sum() - shown)
            bar = np.partition(least, n - k)[n - k] if others > k else _NONE
            alive = np.flatnonzero((most >= bar) & (least > _NONE))
            if len(alive) <= FINAL * k:
                break
        score = least[alive] if most is least else self.rows[alive][:, dims] @ weight
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive][best], score[best]


def _whole(column: pa.ChunkedArray, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) as rows x width, short vectors filled up with zeros; infinite where
    doubles end."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    with np.errstate(over="ignore"):
        flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _integers(vector: list, scale: int, width: int) -> list[int]:
    """The same of one vector in integers of any length."""
    whole = [math.floor(scale * Fraction(float(x))) for x in vector]
    return whole + [0] * (width - len(whole))


def _exactly(ids: np.ndarray, rows: list[list[int]], query_id: int, q: list[int], k: int) -> list[tuple[int, int]]:
    """(id, score) of the k best of a few rows, by plain sums."""
    scored = [(int(i), sum(map(mul, r, q))) for i, r in zip(ids, rows) if i != query_id]
    return sorted(scored, key=lambda x: (-x[1], x[0]))[:k]


def _sortable(score: int) -> str:
    """Text that sorts as the integers do, however long."""
    digits = str(abs(score))
    text = f"{len(digits):06d}{digits}"
    return "1" + text if score >= 0 else "0" + text.translate(_NINES)


_NINES = str.maketrans("0123456789", "9876543210")


def top_k(df: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", rows: int = ROWS) -> DataFrame:
    """query_id, rank (from 1), key, score of the k best rows of ``df`` for each query."""
    kind = df.schema[vector].dataType.elementType
    v = F.col(vector) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(vector).cast("array<double>")
    usable = F.col(vector).isNotNull() & F.col(key).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    pick = lambda d: d.where(usable).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    base = pick(df)
    asked = pick(queries).groupBy("id").agg(F.min("v").alias("v"))
    counted = base.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    count, width = counted[0], counted[1] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(count / rows), min(2 * cores, math.ceil(count / 2048)))
    blocks = max(1, math.ceil(asked.count() / QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = base.select(deal(shards).alias("shard"), each(blocks).alias("block"), F.lit(False).alias("asks"), "id", F.slice("v", 1, max(1, width)).alias("v"))
    cells = cells.unionByName(asked.select(each(shards).alias("shard"), deal(blocks).alias("block"), F.lit(True).alias("asks"), "id", F.slice("v", 1, max(1, width)).alias("v")))

    small = 2.0**25 / math.sqrt(max(1, width))  # products of such components sum up below 2 ** 53

    def cell(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks, ids, m = group["asks"].to_numpy(), group["id"].to_numpy(), _whole(group["v"], scale, width)
        narrow = np.abs(m).max(axis=1, initial=0) < small
        held, wide = np.flatnonzero(~asks & narrow), np.flatnonzero(~asks & ~narrow)
        whole = lambda some: [_integers(v, scale, width) for v in group["v"].take(pa.array(some)).to_pylist()]
        lists, beyond = Lists(ids[held], m[held]), whole(wide)
        plain = None
        out: list[tuple[int, int, int]] = []
        for j in np.flatnonzero(asks):
            i = int(ids[j])
            if narrow[j]:
                a, b = lists.top(i, m[j], k) if len(held) else ((), ())
                best = [(int(x), int(y)) for x, y in zip(a, b)]
            else:
                plain = whole(held) if plain is None else plain
                best = _exactly(ids[held], plain, i, whole([j])[0], k)
            if len(wide):
                best = sorted(best + _exactly(ids[wide], beyond, i, whole([j])[0], k), key=lambda x: (-x[1], x[0]))[:k]
            out += [(i, x, y) for x, y in best]
        columns = list(zip(*out)) if out else [(), (), ()]
        fits = [y if -(2**63) <= y < 2**63 else None for y in columns[2]]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), key: pa.array(columns[1], pa.int64()), "score": pa.array(fits, pa.int64()), "place": pa.array(map(_sortable, columns[2]), pa.string())})

    parts = cells.groupBy("shard", "block").applyInArrow(cell, f"query_id long, {key} long, score long, place string")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("place"), key))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
