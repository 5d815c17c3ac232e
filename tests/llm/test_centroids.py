"""Kd-tree filtering against plain comparisons of all rows with all centroids."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from wayfold.llm import centroids


def plain(rows, k, rounds, dims, scale, salt="2:"):
    """(id, cluster, distance, ...) with Python integers throughout."""
    kept = [(i, [math.floor(scale * Fraction(float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((j for j in range(len(kept)) if kept[j][0] is not None), key=lambda j: (hashlib.sha256(f"{salt}{kept[j][0]}".encode()).hexdigest(), kept[j][1]))
    cs = [list(kept[j][1]) for j in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda: [min(range(len(cs)), key=lambda c: (far(v, cs[c]), c)) for _, v in kept]
    for _ in range(rounds):
        label = nearest()
        for c in range(len(cs)):
            own = [v for (_, v), x in zip(kept, label) if x == c]
            if own:
                cs[c] = [sum(col) // len(own) for col in zip(*own)]
    label = nearest()
    gaps = [far(v, cs[c]) for (_, v), c in zip(kept, label)]
    fit = lambda x: x if x < 2**63 else None
    return sorted(((i, c, fit(d), fit(sum(g for g, x in zip(gaps, label) if x == c)), fit(sum(gaps)), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for (i, _), c, d in zip(kept, label, gaps)), key=repr)


def got(df, **more):
    return sorted((tuple(r) for r in centroids.cluster(df, **more).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    middles = r.normal(size=(6, 4)) * 3
    made = [(i, [float(x) for x in middles[i % 6] + r.normal(size=4) * 0.05]) for i in range(900)]
    made += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(300)]  # copies
    made += [(2000 + i, [float(i % 3), 0.0, 0.0, 0.0]) for i in range(60)]  # ties
    made += [(3000, None), (3001, []), (3002, [1.0] * 3), (3003, [1.0, None, 0.0, 0.0]), (3004, [math.nan, 0.0, 0.0, 0.0]), (3005, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (7, made[7][1]), (7, [9.0, 9.0, 9.0, 9.0])]
    return made


def test_odd_rows(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cluster int, id int").repartition(3)
    for k, rounds in ((9, 3), (1, 1), (40, 0)):
        assert got(df, k=k, rounds=rounds, dims=4) == plain(rows, k, rounds, 4, 256)


def test_values_beyond_doubles(spark):
    big = [(i, [float((-1) ** i * 10.0 ** (i % 30)), 1e15 + i, 3.0]) for i in range(60)] + [(99, [1e308, -1e308, 0.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>").repartition(2)
    assert got(df, k=5, rounds=2, dims=3) == plain(big, 5, 2, 3, 256)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [r[1:3] for r in got(df, k=40, dims=2)] == [r[1:3] for r in plain([(1, [1.0, 2.0]), (2, [3.0, 4.0])], 40, 5, 2, 256)]
    assert got(df.limit(0)) == got(df) == []


def test_nodes_are_assigned_whole_where_rows_cluster():
    r = np.random.default_rng(1)
    middles = np.floor(r.normal(size=(8, 16)) * 500)
    m = np.floor(np.repeat(middles, 500, axis=0) + r.normal(size=(4000, 16)) * 5)
    tree = centroids.build(m)
    label, parts, whole = centroids.assign(tree, middles)
    far = ((tree.rows[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (label == far.argmin(axis=1)).all() and whole > 0.9 * len(m)
    assert sum(n for _, n, _ in parts) == len(m)
    assert (sum(s for _, _, s in parts) == m.sum(axis=0)).all()


def test_equal_distances_keep_the_smaller_number():
    m = np.zeros((100, 2))
    label, _, _ = centroids.assign(centroids.build(m), np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]))
    assert (label == 0).all()
