"""Hot sessions, dense places and exact rounding: the same rows as the plain forms, with
the work spread over tasks."""

import math
from decimal import ROUND_HALF_UP, Decimal
from statistics import median

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.functions import geo, present
from wayfold.operators import grid, places, scans, sequences


@pytest.fixture(scope="module")
def one_session(spark):
    """Nearly all rows in one session, ties in time, a null session, and some short ones."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 100 == 0, F.col("id")).when(F.col("id") % 997 != 0, F.lit(1)).alias("session"),
        (F.col("id") * 7919 % 6007).alias("seq"),
        (F.col("id") * 7919 % 6007 * 3 % 3001).cast("double").alias("at_ms"),
        (59 + F.col("id") % 37 / 1000).alias("lat"),
        (18 + F.col("id") % 41 / 1000).alias("lon"),
        F.concat(F.lit("m"), F.col("id") % 5).alias("milestone"),
        F.lit(None).cast("string").alias("detail"),
    )
    return rows.repartition(3)


def spread(r):
    """Rows of each range."""
    return [x["count"] for x in r.rows.groupBy("__range").count().collect()]


def test_a_session_lies_in_all_ranges(one_session):
    n = spread(scans.Ranges(one_session, ["session"], ["at_ms", "seq"], 16))
    assert len(n) == 16 and max(n) <= 2 * median(n)


def test_hot_sessions_move_as_in_one_window(one_session):
    w = Window.partitionBy("session").orderBy("seq")
    want = one_session.withColumn("m", geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))
    want = {(r.session, r.seq): (r.m, r.m is None or r.m >= 250) for r in want.collect()}
    for ranges in (None, 1, 16):
        got = sequences.moves(one_session, order=("seq",), ranges=ranges)
        assert got.columns == [*one_session.columns, "moved_m", "asks"]
        assert {(r.session, r.seq): (r.moved_m, r.asks) for r in got.collect()} == want


def test_hot_clients_wait_as_in_one_window(one_session):
    w = Window.partitionBy("session").orderBy("at_ms", "seq")
    n = F.row_number().over(w)
    want = one_session.withColumn("n", n).withColumn("go", F.max(F.col("at_ms") - F.col("n") * 1000).over(w) + F.col("n") * 1000)
    want = {(r.session, r.seq): r.go for r in want.collect()}
    assert {(r.session, r.seq): r.go_at_ms for r in sequences.rate_gate(one_session, "session", ranges=16).collect()} == want


def test_hot_sessions_have_the_same_deltas(one_session):
    w = Window.partitionBy("session").orderBy("at_ms", "milestone")
    want = sorted(((r.session, r.at_ms, r.milestone, r.d) for r in one_session.withColumn("d", F.col("at_ms") - F.coalesce(F.lag("at_ms").over(w), F.lit(0.0))).collect()), key=repr)
    got = sequences.step_deltas(one_session, ranges=16)
    assert sorted(((r.session, r.at_ms, r.milestone, r.delta_ms) for r in got.collect()), key=repr) == want


def test_no_rows_no_scan(one_session):
    assert sequences.moves(one_session.limit(0), order=("seq",)).count() == 0 == sequences.rate_gate(one_session.limit(0), "session").count()


def test_a_million_places_in_one_cell(spark):
    n = 1_000_000
    crowd = spark.range(n).select(F.concat(F.lit("node/"), "id").alias("id"), (59.3 + F.col("id") % 1000 / 1e6).alias("lat"), (18.0 + F.floor(F.col("id") / 1000) / 1e6).alias("lon"))
    cells = grid.Grid(crowd, 25_000)
    keys = cells.of_places(crowd).groupBy(*grid.KEY).count()
    sizes = [r["count"] for r in keys.collect()]
    assert sum(sizes) == n and max(sizes) < 2.5 * cells.full
    tasks = cells.of_places(crowd).repartition(16, *grid.KEY).groupBy(F.spark_partition_id()).count().collect()
    tasks = [r["count"] for r in tasks]
    assert len(tasks) == 16 and max(tasks) <= 2 * median(tasks)
    points = spark.createDataFrame([(1, 59.3005, 18.0005), (2, 59.4, 18.0), (3, 10.0, 10.0)], "query_id long, at_lat double, at_lon double")
    got = {r.query_id: (r.n, r.m) for r in places.near_points(crowd, points, 60).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("m")).collect()}
    want = crowd.where(geo.haversine_m(F.lit(59.3005), F.lit(18.0005), F.col("lat"), F.col("lon")) <= 60).count()
    assert got == {1: (want, want)} and want > 1000


@pytest.mark.parametrize("radius", [40.0, 3_000.0, 25_000.0, 4_000_000.0])
def test_split_cells_lose_and_repeat_no_pair(spark, radius):
    """Everywhere on the globe, the poles and the date line among it, and one spot with many."""
    r = [(f"node/{i}", (i * 7919) % 1800001 / 10_000 - 90, (i * 104729) % 3600001 / 10_000 - 180) for i in range(1500)]
    r += [(f"way/{i}", 59.33, 18.06) for i in range(300)] + [(f"way/9{i}", 59.33 + i / 1e5, 18.06 - i / 1e5) for i in range(300)]
    r += [(f"way/8{i}", s * (90 - i / 1e4), i * 1.0) for i in range(180) for s in (1, -1)] + [(f"way/7{i}", i / 1e3, s * (180 - i / 1e3)) for i in range(100) for s in (1, -1)]
    some = spark.createDataFrame(r, "id string, lat double, lon double")
    at = spark.createDataFrame([(i, *p) for i, p in enumerate([(59.33, 18.06), (59.3301, 18.0599), (90.0, 0.0), (-90.0, 10.0), (89.999, -179.0), (0.05, 180.0), (0.05, -180.0), (-33.0, 151.0)])], "query_id long, at_lat double, at_lon double")
    want = at.crossJoin(some).withColumn("meters", geo.haversine_m(F.col("at_lat"), F.col("at_lon"), F.col("lat"), F.col("lon"))).where(F.col("meters") <= radius)
    want = sorted((x.query_id, x.id) for x in want.collect())
    for full, sample in ((20, 1), (grid.FULL, grid.SAMPLE)):
        assert sorted((x.query_id, x.id) for x in places.near_points(some, at, radius, full=full, sample=sample).collect()) == want
    assert want


def test_answered_points_go_no_further(spark, monkeypatch):
    rows = [(f"node/{i}", "dog_park", f"p{i}", 59.0 + i / 1e4, 18.0, (None,) * 4, "designated", None) for i in range(20)]
    asked, near = [], places.near_points
    monkeypatch.setattr(places, "near_points", lambda some, points, r, *a, **k: (asked.append((r, points.count())), near(some, points, r, *a, **k))[1])
    points = spark.createDataFrame([(1, 59.0, 18.0), (2, 59.0005, 18.0), (3, 59.08, 18.0), (4, 10.0, 10.0)], "query_id long, at_lat double, at_lon double")
    got = {r.query_id: (r.searched_radius_m, r.n) for r in places.expanding_counts(spark.createDataFrame(rows, places.SCHEMA), points, "dog_park").collect()}
    assert got == {1: (3000, 20), 2: (3000, 20), 3: (10_000, 20), 4: (25_000, 0)}
    assert [a for a in asked if a[0] > 50] == [(3000.0, 4), (10_000.0, 2), (25_000.0, 1)]


def to_fixed(x, d):
    return Decimal(abs(x)).quantize(Decimal(1).scaleb(-d), ROUND_HALF_UP)


def test_decimals_are_those_of_the_exact_value(spark):
    values = [9.95, 0.25, 0.35, 0.45, 0.05, 1.005, 2.675, 8.345, 0.15, 9.949999999999999, 0.049999999999999996, 1.25, 3.75]
    values += [59.32930005, 18.06860015, -33.86880005, 151.20930015, 1e-8, 5e-8, -5e-8, 0.00000005, 179.99999995, 0.0, 89.99999999] + [k * 0.05 for k in range(200)] + [59 + k * 5e-8 for k in range(200)]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for r in df.select("x", geo.round_coord(F.col("x")).alias("c"), present.fixed(F.col("x"), 1).alias("t")).collect():
        assert r.c == float(to_fixed(r.x, 7)) * (-1 if r.x < 0 else 1), r.x
        assert r.t == ("-" if r.x < 0 else "") + str(to_fixed(r.x, 1)), r.x


def test_distances_at_their_ties(spark):
    df = spark.createDataFrame([(m,) for m in (9950.0, 1250.0, 1350.0, 1050.0, 9999.0, 9949.9, 10_500.0, 999.5, 0.49999999999999994, math.nextafter(10_000, 0))], "m double")
    got = [r.t for r in df.select(present.format_distance(F.col("m")).alias("t")).collect()]
    assert got == ["9.9 km", "1.3 km", "1.4 km", "1.1 km", "10.0 km", "9.9 km", "11 km", "1000 m", "0 m", "10.0 km"]


def test_layers_at_their_ties(spark):
    kinds = [("way/1", "dog_park", 2.0, 1.0), ("way/1", "dog_park", 1.0, 9.0), ("way/1", "dog_park", 1.0, 2.0)]
    for rows in (kinds, kinds[::-1]):
        df = spark.createDataFrame(rows, "id string, kind string, lat double, lon double")
        out = places.union_layers(df, df.limit(0))
        assert [tuple(r) for r in out.select("lat", "lon").collect()] == [(1.0, 2.0)]
        assert "Window" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("full", [3, grid.FULL])
def test_places_are_ranked_where_they_meet_their_point(spark, full):
    """The same ranks as by a window, with ties, repeats, nulls, and a crowded spot; no window, and no pair is moved."""
    spots = spark.range(700).selectExpr("'node/' || id AS id", "if(id % 3 = 0, 'dog_park', 'bathing_spot') AS kind", "if(id % 50 = 7, null, 59 + (id % 40) / 300) AS lat", "if(id < 150, 18.0, 17.9 + (id * 7 % 90) / 300) AS lon")
    points = spark.range(60).selectExpr("if(id = 9, null, id) AS query_id", "if(id = 4, null, if(id < 20, 59.05, 58.9 + id / 200)) AS at_lat", "if(id < 20, 18.0, 17.8 + id / 150) AS at_lon")
    points = points.unionByName(points.where("query_id in (3, 30)"))
    got = places.nearest(spots, points, 5000, full, 1)
    want = places.ranked(places.near_points(spots, points, 5000, (), full, 1), ["query_id"])
    rows = lambda df: sorted((r.query_id if r.query_id is not None else -1, r.rank, r.id, round(r.meters, 3)) for r in df.select("query_id", "rank", "id", "meters").collect())
    assert rows(got) == rows(want) and got.count() > 1000
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert places.nearest(spots, points.limit(0), 5000).count() == places.nearest(spots.limit(0), points, 5000).count() == 0


def test_ranked_rows_come_by_place(spark):
    """A file of them repeats an id; by rank, ids would come in another order for every point, and rows be as many runs of ids."""
    spots = spark.range(3000).selectExpr("'node/' || id AS id", "'dog_park' AS kind", "59 + (id * 37 % 3000) / 1e6 AS lat", "18 + id / 1e6 AS lon")
    points = spark.range(40).selectExpr("id AS query_id", "59 + (id * 7 % 40) / 1e5 AS at_lat", "18 + id / 1e5 AS at_lon")
    rows = places.nearest(spots, points, 5000).collect()
    assert len(rows) == 120_000 and sum(a.id != b.id for a, b in zip(rows, rows[1:])) < 2 * 3000


def test_small_blocks_and_repeats_have_the_same_ranks(spark, monkeypatch):
    """Blocks that end within a cell, points that repeat, and two places at one spot."""
    cells = [("0", 59.0), ("1", 59.01), ("2", 59.01), ("3", 59.02), ("far", 60.0)]
    key = {k: pa.array([0] * 8) for k in grid.KEY}
    rows = pa.RecordBatch.from_pydict(key | {"__point": pa.array([0] * 5 + [1] * 3), "query_id": pa.array([None] * 5 + [7, 8, 9]), "id": pa.array([c for c, _ in cells] + [None] * 3), "lat": pa.array([y for _, y in cells] + [59.0, 59.02, 70.0]), "lon": pa.array([18.0] * 8), "times": pa.array([0] * 5 + [2, 1, 1])})
    one = lambda block: monkeypatch.setattr(places, "BLOCK", block) or sorted(tuple(r.values()) for b in places._ranked_in_cells(iter([rows]), 5000.0, 0.1, 0) for r in b.to_pylist())
    want = [(7, str(k), 2 * k + again, m) for k, m in enumerate((0.0, 1112.0, 1112.0, 2224.0)) for again in (1, 2)]
    want += [(8, "0", 4, 2224.0), (8, "1", 2, 1112.0), (8, "2", 3, 1112.0), (8, "3", 1, 0.0)]
    assert one(10**9) == one(5) == one(1) == sorted(want)


def test_places_are_dealt_out_before_they_are_copied(spark):
    """A file of one task is copied to its cells, some nine times, in as many tasks as there are for shuffles."""
    spots = spark.range(0, 500, 1, 1).selectExpr("'node/' || id AS id", "'dog_park' AS kind", "59 + id / 1e4 AS lat", "18.0 AS lon")
    points = spark.range(20).selectExpr("id AS query_id", "59 + id / 1e3 AS at_lat", "18.0 AS at_lon")
    plan = places.nearest(spots, points, 5000)._jdf.queryExecution().optimizedPlan().toString()
    copied = plan[plan.index("Generate") :]
    assert "RepartitionByExpression [id" in copied


def test_rounding_is_as_in_spark(spark):
    """Halves, their neighbours, and what lies between."""
    half = (np.arange(20_000) * 499 + 0.5) / 1000
    some = np.concatenate([half, np.nextafter(half, 0), np.nextafter(half, 1e9), half + 0.0001, half * (1 + 1e-12), [0.0, 2.675, 1.0005, 4999.9995]])
    df = spark.createDataFrame([(float(x), float(r)) for x, r in zip(some, geo.rounded(some, 3))], "x double, r double")
    assert df.where(F.round("x", 3) != F.col("r")).count() == 0
