import json
import math

import pytest
from pyspark.sql import functions as F

from wayfold.functions import tags
from wayfold.operators import objects, places, sequences
from wayfold.sources import boundary, dataset, features, live, osm_xml, state, store

NO_TAGS = (None, None, None, None)


def spots(spark, rows):
    """id, kind, name, lat, lon[, tags[, seasonal]]"""
    full = [(*r[:5], r[5] if len(r) > 5 else NO_TAGS, "designated", r[6] if len(r) > 6 else None) for r in rows]
    return spark.createDataFrame(full, places.SCHEMA)


def test_radius_is_inclusive_and_ranked(spark):
    df = spots(spark, [("node/4711", "dog_park", None, 59.375, 18.06), ("way/1", "dog_park", None, 59.33, 18.06), ("way/2", "bathing_spot", None, 59.33, 18.06), ("way/3", "dog_park", None, None, 18.0)])
    exact = places.within(df, 59.33, 18.06, 6000).where("id = 'node/4711'").first().meters
    assert {r.id for r in places.within(df, 59.33, 18.06, exact).collect()} == {"node/4711", "way/1", "way/2"}
    assert places.within(df, 59.33, 18.06, 3000, "dog_park").count() == 1
    assert [r.id for r in places.ranked(places.within(df, 59.33, 18.06, 6000)).orderBy("rank").collect()] == ["way/1", "way/2", "node/4711"]


def test_near_points_at_poles_and_date_line(spark):
    at = [(1, 59.33, 18.06), (2, 0.0, 179.99), (3, 89.99, 10.0), (4, -89.99, 0.0)]
    rows = [(f"node/{i}", "dog_park", None, a, o) for i, (a, o) in enumerate([(59.34, 18.06), (0.0, -179.99), (89.99, -170.0), (-89.98, 180.0), (10.0, 10.0)])]
    got = places.near_points(spots(spark, rows), spark.createDataFrame(at, "query_id long, at_lat double, at_lon double"), 5_000)
    assert {(r.query_id, r.id) for r in got.collect()} == {(1, "node/0"), (2, "node/1"), (3, "node/2"), (4, "node/3")}


def offset(lat, metres):
    return lat + math.degrees(metres / 6_371_000)


CASES = [
    ("merged", [("node/1", "dog_park", None, 59.0, 18.0), ("way/2", "dog_park", None, offset(59.0, 12), 18.0)], {"way/2"}),
    ("areas stay", [("way/1", "dog_park", "A", 59.0, 18.0), ("way/2", "dog_park", "A", offset(59.0, 10), 18.0)], {"way/1", "way/2"}),
    ("nodes stay", [("node/1", "dog_park", "A", 59.0, 18.0), ("node/2", "dog_park", "A", offset(59.0, 10), 18.0)], {"node/1", "node/2"}),
    ("too far", [("node/1", "dog_park", "A", 59.0, 18.0), ("way/2", "dog_park", "A", offset(59.0, 51), 18.0)], {"node/1", "way/2"}),
    ("names differ", [("node/1", "dog_park", "A", 59.0, 18.0), ("way/2", "dog_park", "B", 59.0, 18.0)], {"node/1", "way/2"}),
    ("case and space", [("node/1", "dog_park", " park A ", 59.0, 18.0), ("way/2", "dog_park", "PARK a", 59.0, 18.0)], {"way/2"}),
    ("blank is a name", [("node/1", "dog_park", " ", 59.0, 18.0), ("way/2", "dog_park", "A", 59.0, 18.0)], {"node/1", "way/2"}),
    ("other kind", [("node/1", "bathing_spot", None, 59.0, 18.0), ("way/2", "dog_park", None, 59.0, 18.0)], {"node/1", "way/2"}),
    ("relation", [("node/1", "dog_park", None, 59.0, 18.0), ("relation/2", "dog_park", None, 59.0, 18.0)], {"relation/2"}),
]


@pytest.mark.parametrize("name,rows,want", CASES, ids=[c[0] for c in CASES])
def test_collapse(spark, name, rows, want):
    assert {r.id for r in places.collapse(spots(spark, rows)).collect()} == want


def test_collapse_adopts_in_order_of_distance(spark):
    rows = [
        ("node/1", "dog_park", "far", 59.0, 18.0, (True, None, False, "mud"), ("unparsed", None, None)),
        ("node/2", "dog_park", None, offset(59.0, 20), 18.0, (None, True, True, None)),
        ("way/3", "dog_park", None, offset(59.0, 25), 18.0, (None, False, None, None)),
        ("node/2", "bathing_spot", "twin", offset(59.0, 20), 18.0),
    ]
    for order in (rows, rows[::-1]):
        got = {(r.id, r.kind): r for r in places.collapse(spots(spark, order)).collect()}
        assert set(got) == {("way/3", "dog_park"), ("node/2", "bathing_spot")}
        area = got["way/3", "dog_park"]
        assert area.name == "far" and tuple(area.tags) == (True, False, True, "mud") and area.seasonal.kind == "unparsed"


def test_expanding_search(spark):
    rows = [(f"node/{i}", "dog_park", f"p{i}", offset(59.0, 100 * i), 18.0) for i in range(4)] + [(f"node/{i}", "dog_park", f"p{i}", offset(59.0, 4000 + i), 18.0) for i in range(4, 7)]
    rows += [("way/1", "bathing_spot", None, offset(59.0, 24_000), 18.0)]
    points = spark.createDataFrame([(1, 59.0, 18.0), (2, 10.0, 10.0)], "query_id long, at_lat double, at_lon double")
    got = {r.query_id: (r.searched_radius_m, r.n) for r in places.expanding_counts(spots(spark, rows), points, "dog_park").collect()}
    assert got == {1: (10_000, 7), 2: (25_000, 0)}
    got = {r.query_id: (r.searched_radius_m, r.n) for r in places.expanding_counts(spots(spark, rows), points, "bathing_spot").collect()}
    assert got == {1: (25_000, 1), 2: (25_000, 0)}


def test_collapse_joins_without_a_product(spark, capsys):
    df = spots(spark, CASES[0][1])
    places.collapse(df).explain()
    places.expanding(df, spark.createDataFrame([(1, 59.0, 18.0)], "query_id long, at_lat double, at_lon double"), "dog_park").explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_layers_and_markers(spark):
    parks, bathing = spots(spark, [("way/1", "dog_park", "a", 1.0, 1.0)]), spots(spark, [("way/1", "bathing_spot", "b", 1.0, 1.0), ("way/2", "bathing_spot", "c", 1.0, 1.0)])
    assert {(r.id, r.kind) for r in places.union_layers(parks, bathing).collect()} == {("way/1", "dog_park"), ("way/2", "bathing_spot")}
    new = spots(spark, [("way/1", "dog_park", "a", 2.0, 1.0), ("way/3", "dog_park", "a", 2.0, 1.0)])
    assert {tuple(r) for r in places.marker_plan(parks.unionByName(bathing.where("id = 'way/2'")), new).collect()} == {("way/1", "move"), ("way/2", "remove"), ("way/3", "create")}


def test_from_features_makes_both(spark):
    df = spark.createDataFrame([("way/1", 1.0, 2.0, {"leisure": "dog_park", "name": "Hundbad", "dog:conditional": "no @ (Jun-Jul)"}), ("way/2", 1.0, 2.0, {"leisure": "bathing_place", "dog": "no"}), (None, 1.0, 2.0, {"leisure": "dog_park"})], "id string, lat double, lon double, tags map<string,string>")
    got = {(r.id, r.kind): r for r in places.once(places.from_features(df.unionByName(df), tags.of_map("tags"))).collect()}
    assert set(got) == {("way/1", "dog_park"), ("way/1", "bathing_spot")}
    assert got["way/1", "bathing_spot"].seasonal["from"].month == 6 and got["way/1", "dog_park"].seasonal is None


def obj(type_, id_, version=1, ts="2026-01-01", lat=None, lon=None, refs=None, members=None, tags=None):
    import datetime

    return type_, id_, version, datetime.datetime.fromisoformat(ts), lat, lon, refs, members, tags


def frame(spark, rows):
    return spark.createDataFrame(rows, objects.SCHEMA)


def test_newest_wins_in_any_order(spark):
    a = frame(spark, [obj("node", 1, 1, lat=1.0, lon=1.0), obj("node", 2, 3, lat=1.0, lon=1.0), obj("way", 10, 2, refs=[1])])
    b = frame(spark, [obj("node", 1, 2, lat=2.0, lon=2.0), obj("node", 2, 3, lat=1.0, lon=1.0), obj("way", 10, 1, refs=[2]), obj("node", 3, 1)])
    for x, y in ((a, b), (b, a)):
        assert {(r.type, r.id, r.version) for r in objects.newest(x, y).collect()} == {("node", 1, 2), ("node", 2, 3), ("node", 3, 1), ("way", 10, 2)}


def test_replay(spark):
    state = frame(spark, [obj("node", 1, 1), obj("node", 2, 1), obj("node", 3, 1)])
    op = lambda r, o, s: (*r, o, s)
    changes = spark.createDataFrame([op(obj("node", 1, 2), "modify", 5), op(obj("node", 1, 3), "delete", 6), op(obj("node", 2, 2), "delete", 5), op(obj("node", 2, 3), "create", 7), op(obj("node", 4, 1), "create", 5), op(obj("node", 3, 9), "modify", 4)], objects.SCHEMA + ", op string, seq long")
    got = {(r.id, r.version) for r in objects.replay(state, changes, 4).collect()}
    assert got == {(2, 3), (3, 1), (4, 1)}
    assert objects.plan_diffs(5, 5) == [] and objects.plan_diffs(5, 45)[-1] == 45
    for stored, current in ((6, 5), (5, 46)):
        with pytest.raises(ValueError):
            objects.plan_diffs(stored, current)


def world(spark):
    nodes = [obj("node", i, lat=59.0 + i / 100, lon=18.0 + i / 100) for i in range(1, 7)]
    return frame(spark, [*nodes, obj("way", 10, refs=[1, 2], tags={"leisure": "dog_park"}), obj("way", 11, refs=[3, 99], tags={"leisure": "dog_park"}), obj("way", 12, refs=[4]), obj("relation", 20, members=[("way", 10, ""), ("node", 5, "")], tags={"leisure": "dog_park"}), obj("relation", 21, members=[("relation", 20, "")], tags={"leisure": "dog_park"})])


def park():
    return F.coalesce(F.col("tags")["leisure"] == "dog_park", F.lit(False))


def test_references_closure_and_assembly(spark):
    w = world(spark)
    assert [tuple(r) for r in objects.missing_references(w).collect()] == [("node", 99, "way", 11)]
    assert {(r.type, r.id) for r in objects.closure(w, park()).collect()} == {("node", 1), ("node", 2), ("node", 3), ("node", 5), ("way", 10), ("way", 11), ("relation", 20), ("relation", 21)}
    got = {(r.type, r.id): (r.lat, r.lon) for r in objects.assemble(w, park()).collect()}
    assert got == {("way", 10): (59.015, 18.015), ("relation", 20): (59.03, 18.03)}


def test_closure_of_relations_in_relations(spark):
    """Six levels, a circle, and a relation that isn't there."""
    rel = lambda i, kind, ref, tags=None: ("relation", i, 1, None, None, None, None, [(kind, ref, "")], tags)
    rows = [rel(1, "relation", 2, {"leisure": "dog_park"}), *(rel(i, "relation", i + 1) for i in range(2, 6)), rel(6, "way", 10), rel(7, "relation", 1), rel(8, "relation", 9, {"leisure": "dog_park"}), rel(9, "relation", 8), rel(20, "relation", 404, {"leisure": "dog_park"}), ("way", 10, 1, None, None, None, [1], None, None), ("way", 11, 1, None, None, None, [2], None, None), ("node", 1, 1, None, 1.0, 1.0, None, None, None), ("node", 2, 1, None, 1.0, 1.0, None, None, None)]
    got = {(r.type, r.id) for r in objects.closure(spark.createDataFrame(rows, objects.SCHEMA), park()).collect()}
    assert got == {*(("relation", i) for i in (1, 2, 3, 4, 5, 6, 8, 9, 20)), ("way", 10), ("node", 1)}


def test_second_pass_doesnt_ask_twice(spark):
    """What the source brings may itself be incomplete; what was asked for isn't asked again."""
    rel = ("relation", 30, 1, None, None, None, None, [("way", 31, "")], {"leisure": "dog_park"})
    state_ = spark.createDataFrame([rel], objects.SCHEMA)
    source = spark.createDataFrame([rel, obj("way", 31, refs=[311, 312], tags={"leisure": "dog_park"}), obj("node", 311, lat=59.0, lon=18.0)], objects.SCHEMA)
    fixed, report = objects.repair(state_, source, park())
    # pass 1 asks for the relation; pass 2 for its way, which lacks a node; the budget counts both
    assert report == {"passes": 2, "fetched": 2, "gone": 0}
    assert {(r.type, r.id) for r in fixed.collect()} == {("relation", 30), ("way", 31), ("node", 311)}
    with pytest.raises(ValueError, match="more than 0"):
        objects.repair(state_, source, park(), budget=0)


def test_repair(spark):
    w = world(spark)
    source = frame(spark, [obj("way", 11, 2, refs=[3, 98], tags={"leisure": "dog_park"}), obj("node", 98, lat=59.1, lon=18.1), obj("node", 3, 2, lat=59.2, lon=18.2)])
    fixed, report = objects.repair(w, source, park())
    assert report == {"passes": 1, "fetched": 1, "gone": 0} and not objects.missing_references(fixed).count()
    assert {(r.type, r.id) for r in objects.assemble(fixed, park()).collect()} >= {("way", 11)}
    _, report = objects.repair(w, source.limit(0), park())
    assert report == {"passes": 1, "fetched": 0, "gone": 1}
    with pytest.raises(ValueError):
        objects.repair(w, source, park(), budget=0)


def test_as_of(spark):
    h = spark.createDataFrame([(5057, "2026-07-18"), (5058, "2026-07-19"), (5060, "2026-07-21")], "seq long, day string").select("seq", F.col("day").cast("timestamp").alias("ts"))
    at = lambda t: objects.sequence_as_of(h, F.lit(t).cast("timestamp")).first()[0]
    assert (at("2026-07-20"), at("2027-01-01"), at("2026-07-18")) == (5058, 5060, 5057)
    with pytest.raises(Exception, match="before the history"):
        at("2020-01-01")
    with pytest.raises(Exception, match="no timestamps"):
        objects.safety_timestamp(h.limit(0)).collect()


def test_sequences(spark):
    m = spark.createDataFrame([("s", "a", 10.0, 1, None), ("s", "a", 5.0, 2, "x"), ("s", "b", 20.4, 3, "")], "session string, milestone string, at_ms double, seq long, detail string")
    assert [r.line for r in sequences.step_deltas(sequences.first_marks(m)).orderBy("at_ms").collect()] == ["a\t5ms\t(+5ms)\tx", "b\t20ms\t(+15ms)"]
    f = spark.createDataFrame([("s", i, 59.0 + i * 0.002, 18.0) for i in range(3)] + [("s", 3, 60.0, 18.0)], "session string, seq long, lat double, lon double")
    assert [r.asks for r in sequences.moves(f, order=("seq",)).orderBy("seq").collect()] == [True, False, False, True]
    r = spark.createDataFrame([("c", 1, 0), ("c", 2, 100), ("c", 3, 5000), ("c", 4, 5100)], "client string, seq long, at_ms long")
    assert [x.go_at_ms for x in sequences.rate_gate(r).orderBy("seq").collect()] == [0, 1000, 5000, 6000]


def test_cache(spark):
    spot = ("node/1", "dog_park", None, 1.0, 2.0, NO_TAGS, "designated", None)
    bad = ("node/1", "dog_park", None, None, 2.0, NO_TAGS, "designated", None)
    e = spark.createDataFrame([("k", "2026-07-20 00:00:00", [spot]), ("k", "2026-07-21 00:00:00", [spot, bad]), ("empty", "2026-07-21 00:00:00", []), ("old", "2026-07-15 00:00:00", [spot]), ("future", "2026-08-01 00:00:00", [spot])], f"key string, at string, spots array<struct<{places.SCHEMA.replace(' struct', ':struct').replace(' string', ':string').replace(' double', ':double')}>>").withColumn("stored_at", F.col("at").cast("timestamp"))
    q = spark.createDataFrame([(k,) for k in ("k", "empty", "old", "future", "none")], "key string")
    got = {r.key: r.spots for r in sequences.answer_through_cache(q, e, F.lit("2026-07-22 00:00:00").cast("timestamp")).collect()}
    assert len(got["k"]) == 1 and got["empty"] == [] and got["old"] is got["future"] is got["none"] is None
    assert {r.key for r in sequences.stale_keys(e, ("k", "e")).collect()} == {"old", "future"}


def test_cache_entries_with_bad_seasons(spark):
    day = lambda m, d: (m, d)
    spot = lambda season, tags=NO_TAGS: ("node/1", "dog_park", None, 1.0, 2.0, tags, "designated", season)
    cases = {"none": spot(None), "unparsed": spot(("unparsed", None, None)), "ban": spot(("ban", day(6, 1), day(8, 31))), "month": spot(("ban", day(13, 1), day(8, 31))), "day": spot(("ban", day(6, 0), day(8, 31))), "half": spot(("ban", day(6, 1), None)), "kind": spot(("other", None, None)), "tags": spot(None, None)}
    schema = f"key string, at string, spots array<struct<{places.SCHEMA.replace(' struct', ':struct').replace(' string', ':string').replace(' double', ':double').replace(' seasonal ', ' seasonal:')}>>"
    e = spark.createDataFrame([(k, "2026-07-20 00:00:00", [s]) for k, s in cases.items()], schema).withColumn("stored_at", F.col("at").cast("timestamp"))
    assert {r.key for r in sequences.whole_entries(e).collect()} == {"none", "unparsed", "ban"}


def test_store(spark, tmp_path):
    kv = store.Store(spark, str(tmp_path / "kv"), "value string")
    rows = lambda *r: spark.createDataFrame(list(r), "key string, value string")
    assert kv.rows().count() == 0
    kv.put(rows(("a-1", "x"), ("b-1", "y")))
    kv.put(rows(("a-1", "z"), ("c-1", None)))
    assert {(r.key, r.value) for r in kv.rows().collect()} == {("a-1", "z"), ("b-1", "y"), ("c-1", None)}
    kv.delete(rows(("b-1", None), ("none", None)))
    assert [r.value for r in kv.get(rows(("a-1", None), ("b-1", None))).collect()] == ["z"]
    assert kv.sweep(("a-",)) == 1 and [r.key for r in kv.rows().collect()] == ["a-1"] and kv.sweep(("a-",)) == 0
    assert len([p for p in (tmp_path / "kv").iterdir() if p.is_dir()]) == 1  # old versions go


def test_answers_are_remembered(spark, tmp_path):
    kv = store.Store(spark, str(tmp_path / "answers"), store.ANSWERS)
    spot = ("node/1", "dog_park", None, 1.0, 2.0, NO_TAGS, "designated", None)
    answers = spark.createDataFrame([("k", [spot]), ("empty", []), ("failed", None)], f"key string, {store.ANSWERS.split(', ', 1)[1]}")
    now = F.lit("2026-07-20 00:00:00").cast("timestamp")
    assert store.remember(kv, answers, now)
    q = spark.createDataFrame([("k",), ("empty",), ("failed",)], "key string")
    got = {r.key: (r.hit, len(r.spots or [])) for r in sequences.answer_through_cache(q, kv.rows(), now).collect()}
    assert got == {"k": (True, 1), "empty": (True, 0), "failed": (False, 0)}
    (tmp_path / "file").write_text("in the way")
    assert store.remember(store.Store(spark, str(tmp_path / "file"), store.ANSWERS), answers, now) is False


def test_collapse_pairs_equal_brute_force_anywhere(spark):
    import math
    import random

    r, rows = random.Random(3), []
    for k in range(400):
        lat, lon = r.choice([(59.3, 18.0), (89.9995, 10.0), (-89.99995, 0.0), (0.0, 180.0), (78.2, -180.0), (-33.0, 151.2)])
        step = 40 / 111_000
        lat, lon = max(-90.0, min(90.0, lat + r.uniform(-2, 2) * step)), lon + r.uniform(-2, 2) * step / max(math.cos(math.radians(lat)), 1e-4)
        rows.append((f"{r.choice(['node', 'way'])}/{k}", "dog_park", None, lat, (lon + 180) % 360 - 180))
    got = {(x.node_id, x.area_id) for x in places._close_pairs(spots(spark, rows)).collect()}

    def metres(a, b):
        la, lo = math.radians(b[3] - a[3]), math.radians(b[4] - a[4])
        h = math.sin(la / 2) ** 2 + math.cos(math.radians(a[3])) * math.cos(math.radians(b[3])) * math.sin(lo / 2) ** 2
        return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))

    want = {(a[0], b[0]) for a in rows for b in rows if a[0].startswith("node") and b[0].startswith("way") and metres(a, b) <= 50}
    assert got == want and len(want) > 100


def test_gates(spark):
    with pytest.raises(ValueError, match="no places"):
        sequences.assert_sane(spots(spark, []), "elsewhere", 1)
    some = spots(spark, [(f"node/{i}", "dog_park", None, 59.3293, 18.0686) for i in range(200)] + [(f"way/{i}", "bathing_spot", None, 60.0, 18.0) for i in range(5)])
    sequences.assert_sane(some, "europe/sweden", 1)
    with pytest.raises(ValueError, match="no include rings"):
        sequences.assert_sane(some, "europe/sweden", 0)
    with pytest.raises(ValueError, match="bathing spots"):
        sequences.assert_sane(some.where("id <> 'way/0'"), "europe/sweden", 1)


def test_boundary():
    text = "name\n1\n  1.8E+01 59\n 19 59\n 19 60\nEND\n!hole\n 18.5 59.2\n 18.6x 59.2\nEND\n2\n 1 2\nEND\nEND\n"
    got = boundary.parse_boundary(text)
    assert got == {"include": [[(59.0, 18.0), (59.0, 19.0), (60.0, 19.0)], [(2.0, 1.0)]], "exclude": [[(59.2, 18.5), (59.2, 18.6)]]}
    for bad in ("", "n\n1\n 1 2\n", "n\n1\n 1 2\nEND\n", "n\nEND\nx", "n\n1\n 1 x\nEND\nEND", "n\n1\n 1 2 3\nEND\nEND"):
        with pytest.raises(ValueError):
            boundary.parse_boundary(bad)


GEOMETRIES = [
    ('{"type":"Point","coordinates":[18.123456789,59.9876543211,7]}', (59.9876543, 18.1234568)),
    ('{"type":"Polygon","coordinates":[[[18,59.3],[18.02,59.3],[18.02,59.305],[18.01,59.31],[18,59.3]]]}', (59.305, 18.01)),
    ('{"type":"MultiPolygon","coordinates":[[[[18,59.3],[18,59.31]]],[[[18,59.34],[18,59.35]]]]}', (59.325, 18.0)),
    ('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[18,59.3]},{"type":"LineString","coordinates":[[18.1,59.3],[18.1,59.35]]}]}', (59.325, 18.05)),
    ('{"type":"GeometryCollection","geometries":[{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]}]}]}', (2.0, 1.0)),
    ('{"type":"Deep","coordinates":[[[[[[18,59.3],[18.02,59.31,5]]]]]]}', (59.305, 18.01)),
    ('{"type":"Point","coordinates":[-1.5e1,2e0]}', (2.0, -15.0)),
    ('{"type":"GeometryCollection","geometries":[' * 6 + '{"type":"Deep","coordinates":[[[[[1,2]]]]]},{"type":"Point","coordinates":[3,4],"bbox":[0,0,9,9]}' + "]}" * 6, (3.0, 2.0)),
    ('{"type":"GeometryCollection","geometries":[{"type":"GeometryCollection","geometries":[]},{"type":"Point","coordinates":[1,2]}]}', (2.0, 1.0)),
    ('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"GeometryCollection","geometries":[{"type":"Point"}]}]}', None),
    ('{"type":"LineString","coordinates":[[1,2],3]}', None),
    ('{"type":"Point","coordinates":5}', None),
    ('{"type":"Point","coordinates":["18",59]}', None),
    ('{"type":"Point","coordinates":[18]}', None),
    ('{"type":"LineString","coordinates":[[1,2],[]]}', None),
    ('{"type":"LineString","coordinates":[[1,2],[3,null]]}', None),
    ('{"type":"GeometryCollection","geometries":[]}', None),
    ('{"type":"GeometryCollection"}', None),
    ("null", None),
]


def test_features(spark, tmp_path):
    rows = [f'{{"type":"Feature","id":"n{i}","properties":{{"leisure":"dog_park","n":5}},"geometry":{g}}}' for i, (g, _) in enumerate(GEOMETRIES)]
    rows += ['{"id":7,"properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}', '{"id":"x9","geometry":{"type":"Point","coordinates":[1,2]}}', "5"]
    (tmp_path / "f.geojson").write_text('{"features":[' + ",".join(rows) + "]}")
    (tmp_path / "bad.geojson").write_text('{"features":5}')
    got = {r.id: r for r in features.read_features(spark, str(tmp_path / "f.geojson")).collect()}
    assert {k: (r.lat, r.lon) for k, r in got.items()} == {f"node/{i}": at for i, (_, at) in enumerate(GEOMETRIES) if at}
    assert got["node/0"].tags == {"leisure": "dog_park"}
    with pytest.raises(Exception, match="features is not a list"):
        features.read_features(spark, str(tmp_path / "bad.geojson")).collect()


def test_xml(spark, tmp_path):
    (tmp_path / "a.osm").write_text('<osm><node id="1" version="2" timestamp="2026-01-01T00:00:00Z" lat="59.1" lon="18.1"><tag k="dog" v="yes"/></node><node id="2" version="1" timestamp="2026-01-01T00:00:00Z" lat="59.2" lon="18.2"/><way id="10" version="1" timestamp="2026-01-01T00:00:00Z"><nd ref="1"/><nd ref="2"/><tag k="a" v="1"/><tag k="a" v="2"/></way><relation id="20" version="1" timestamp="2026-01-01T00:00:00Z"><member type="way" ref="10" role="outer"/></relation></osm>')
    got = {(r.type, r.id): r for r in osm_xml.read_objects(spark, str(tmp_path / "a.osm")).collect()}
    assert got["node", 1].tags == {"dog": "yes"} and got["node", 2].lat == 59.2 and got["way", 10].refs == [1, 2] and got["way", 10].tags == {"a": "2"} and got["relation", 20].members[0].ref == 10
    folder = tmp_path / "000" / "005"
    folder.mkdir(parents=True)
    (folder / "061.osc").write_text('<osmChange><modify><node id="1" version="3" timestamp="2026-02-01T00:00:00Z" lat="1" lon="2"/><way id="10" version="2" timestamp="2026-02-01T00:00:00Z"><nd ref="1"/></way></modify><delete><node id="2" version="2" timestamp="2026-02-01T00:00:00Z"/></delete></osmChange>')
    got = {(r.type, r.id): (r.op, r.seq, r.version) for r in osm_xml.read_changes(spark, str(folder / "061.osc")).collect()}
    assert got == {("node", 1): ("modify", 5061, 3), ("way", 10): ("modify", 5061, 2), ("node", 2): ("delete", 5061, 2)}


def test_state(spark, tmp_path):
    assert state.parse_state("#c\nsequenceNumber=1\nsequenceNumber=5061\njunk\ntimestamp=2026-07-22T00\\:00\\:00Z\n") == (5061, "2026-07-22T00:00:00Z")
    for bad in ("", "sequenceNumber=x\ntimestamp=2026-07-22T00\\:00\\:00Z", "sequenceNumber=1\ntimestamp=soon"):
        with pytest.raises(ValueError):
            state.parse_state(bad)
    (tmp_path / "061.state.txt").write_text("#c\nsequenceNumber=5061\ntimestamp=2026-07-22T00\\:00\\:00Z\n")
    assert state.read_states(spark, str(tmp_path)).select("seq", F.col("ts").cast("string")).first()[:] == (5061, "2026-07-22 00:00:00")
    meta = {"schema": 1, "filterVersion": 2, "sequenceNumber": 5, "timestamp": "2026-07-22T00:00:00Z", "seededFrom": [{"file": "a", "timestamp": "t"}]}
    assert state.advanced(state.validate_meta(meta), 6, "x") == meta | {"sequenceNumber": 6, "timestamp": "x"}
    for change in ({"schema": 2}, {"filterVersion": 1}, {"sequenceNumber": 0}, {"sequenceNumber": 1.5}, {"timestamp": "soon"}, {"seededFrom": None}, {"seededFrom": [{"file": 1}]}):
        with pytest.raises(ValueError):
            state.validate_meta(meta | change)


def test_dataset(spark, tmp_path):
    good = {"id": "node/1", "kind": "dog_park", "name": "A", "lat": 59.0, "lon": 18.0, "tags": {"leashRequired": "true", "fenced": False, "surface": 5}, "provenance": "designated", "seasonal": {"kind": "ban", "from": {"month": 13, "day": 1}, "to": {"month": 1, "day": 1}}}
    doc = {"schema": 1, "generatedAt": "g", "region": "r", "attribution": "a", "license": "l", "coverage": {"include": [[[58.9, 17.5], [59.7, 18.7]], []], "exclude": []}, "spots": [good, good | {"id": "node/2", "lat": None}, good | {"id": "node/3", "seasonal": {"kind": "unparsed"}, "name": 7}, 5]}
    path = tmp_path / "d.json"

    def read(change):
        path.write_text(json.dumps(doc | change))
        return dataset.read_dataset(spark, str(path))

    envelope, rows = read({})
    got = {r.id: r for r in rows.collect()}
    assert set(got) == {"node/1", "node/3"} and tuple(got["node/1"].tags) == (None, False, None, None) and got["node/1"].seasonal is None
    assert got["node/3"].name is None and got["node/3"].seasonal.kind == "unparsed" and envelope["coverage"]["include"][0][0] == (58.9, 17.5)
    for change in ({"schema": 2}, {"coverage": {"include": [], "exclude": []}}, {"coverage": {"include": [[["x", 1]]], "exclude": []}}, {"spots": 5}, {"region": 5}):
        assert read(change) is None
    path.write_text("no json")
    assert dataset.read_dataset(spark, str(path)) is None and dataset.read_dataset(spark, str(tmp_path / "gone.json")) is None
    read({})
    loader = dataset.Loader(spark, str(path), str(tmp_path / "stored.json"))
    assert loader.load()[1].count() == 2 and (tmp_path / "stored.json").exists()
    path.write_text("broken")
    later = dataset.Loader(spark, str(path), str(tmp_path / "stored.json"))
    assert later.load()[1].count() == 2 and not later.refresh() and later.load()[1].count() == 2
    read({})
    dataset.publish(rows, envelope["coverage"], "elsewhere", "now", str(tmp_path / "out.json"), str(tmp_path / "table"))
    again = dataset.read_dataset(spark, str(tmp_path / "out.json"))
    assert sorted(map(tuple, again[1].select("id", "lat").collect())) == sorted(map(tuple, rows.select("id", "lat").collect()))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_geocode(spark):
    g = spark.createDataFrame([("Stockholm", 0.9, "59.33", "18.06"), ("Stockholm x", 0.5, " ", "18"), ("", 1.0, "1", "2"), ("stock", 0.1, "1", "2"), ("Berlin", 1.0, "1", "2")], "label string, importance double, lat string, lon string")
    assert [tuple(r) for r in sequences.geocode(g, "STOCK").collect()] == [("Stockholm", 59.33, 18.06), ("stock", 1.0, 2.0)]


def test_live_answers(spark):
    good = {"type": "node", "id": 1, "lat": 59.0, "lon": 18.0, "center": {"lat": 1, "lon": 1}, "tags": {"name": "A", "dog": "leashed", "n": 5}}
    rows = [good, good | {"tags": {}}, {"type": "way", "id": 2, "center": {"lat": 59.1, "lon": 18.1}, "tags": {"dog": "no"}}, {"type": "way", "id": 3}, {"type": "", "id": 4, "lat": 1, "lon": 1}, {"type": "node", "id": "5", "lat": 1, "lon": 1}, {"type": "way", "id": 6, "lat": 1, "center": {"lat": 2, "lon": 3}}, 7]
    body = lambda extra: spark.createDataFrame([(json.dumps({"elements": rows} | extra),)], "body string")
    parks = {r.id: r for r in live.to_places(live.elements(body({})), "dog_park").collect()}
    assert {k: (r.lat, r.lon, r.name) for k, r in parks.items()} == {"node/1": (59.0, 18.0, "A"), "way/2": (59.1, 18.1, None), "way/6": (2.0, 3.0, None)}
    assert parks["node/1"].tags.leash_required is True and parks["node/1"].provenance == "designated"
    bathing = {r.id: r.provenance for r in live.to_places(live.elements(body({"remark": ""})), "bathing_spot").collect()}
    assert bathing == {"node/1": "permitted", "way/6": "name-match"}
    for extra, kind in (({"remark": "runtime error: Query timed out"}, "timeout"), ({"elements": 5}, "malformed-response")):
        with pytest.raises(Exception, match=f"refused answer: {kind}"):
            live.elements(body(extra)).collect()
    table = spark.createDataFrame([("node/1", 59.0, 18.0, {"leisure": "dog_park"}), ("node/2", 59.0, 18.1, {"leisure": "dog_park"}), ("way/3", 59.0, 18.0, {"natural": "beach", "dog": "yes"})], "id string, lat double, lon double, tags map<string,string>")
    assert [r.id for r in live.select_live(table, 59.0, 18.0, 100.2, "dog_park").collect()] == ["node/1"]
    assert [r.id for r in live.select_live(table, 59.0, 18.0, 100.2, "bathing_spot").collect()] == ["way/3"]


def test_first_guess(spark):
    at = lambda t: F.lit(t).cast("timestamp")
    got = spark.range(1).select(*(objects.first_guess(F.lit(n), at("2026-07-22"), at(t)) for n, t in ((5061, "2026-07-20 12:00:00"), (3, "2026-01-01"), (10, "2026-07-25")))).first()
    assert tuple(got) == (5058, 1, 10)


def test_a_published_file_is_read_by_ranges(spark, tmp_path):
    """The same places as from one text, in more than one task; other layouts are one text."""
    t = spark.range(400).select(F.concat(F.lit("node/"), "id").alias("id"), F.lit("dog_park").alias("kind"), F.lit('a ",\n"spots":[ ]},').alias("name"), (F.col("id") / 10.0).alias("lat"), F.lit(2.5).alias("lon"), F.lit(None).cast("struct<leash_required:boolean,fenced:boolean,lit:boolean,surface:string>").alias("tags"), F.lit("designated").alias("provenance"), F.lit(None).cast(dataset.RULE_TYPE).alias("seasonal"))
    path = tmp_path / "out.json"
    dataset.publish(t, {"include": [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]], "exclude": []}, 'a "spots":[ b', "now", str(path), gate=False)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        envelope, rows = dataset.read_dataset(spark, str(path))
        assert envelope["region"] == 'a "spots":[ b' and rows.rdd.getNumPartitions() > 2
        assert sorted(rows.collect()) == sorted(dataset.valid_spots(dataset._whole(spark, str(path))[1]).collect()) and rows.count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    lines = path.read_text().split("\n")
    for moved in ([*lines[1:], lines[0]], lines[:-1], [lines[0], "x", *lines[1:]], [lines[0], *lines]):
        path.write_text("\n".join(moved))
        assert dataset._by_lines(spark, str(path)) is None and dataset.read_dataset(spark, str(path)) is None
    path.write_text("\n".join([lines[0] + lines[1], *lines[2:]]))
    assert dataset.read_dataset(spark, str(path))[1].count() == 400
    path.write_text("\n".join([lines[0], "", *lines[1:]]))
    assert dataset._by_lines(spark, str(path)) is None and dataset.read_dataset(spark, str(path))[1].count() == 400


def test_answers_are_dealt_out_before_they_are_sorted(spark):
    """A task of a few MB of answers has to hold no sort of all their elements."""
    answers = spark.range(40).selectExpr("""'{"elements":[{"type":"node","id":' || id % 7 || ',"lat":1,"lon":2,"tags":{"dog":"yes"}}]}' AS body""")
    got = live.to_places(live.elements(answers), "bathing_spot")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Aggregate") < plan.index("Exchange") < plan.index("Generate posexplode")
    assert got.count() == 7

