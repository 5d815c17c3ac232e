"""Published files and tables, change files at rest and as a stream."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import curve, geo
from wayfold.operators import objects, places
from wayfold.plans import refresh
from wayfold.sources import boundary, change_files, dataset, files, osm_xml

NO_TAGS = (None,) * 4


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(4)
    rows = [(f"node/{i}", "dog_park", None, r.uniform(-90, 90), r.uniform(-180, 180), NO_TAGS, "designated", None) for i in range(4000)]
    rows += [(f"way/{i}", "bathing_spot", 'a "b"\n\\ é', 59.33 + i / 1e4, 18.06, NO_TAGS, "permitted", None) for i in range(500)]
    rows += [(f"way/9{i}", "dog_park", None, a, o, NO_TAGS, "designated", None) for i, (a, o) in enumerate([(90.0, 0.0), (-90.0, 180.0), (0.0, 180.0), (0.0, -180.0), (89.9999, 77.0)])]
    return spark.createDataFrame(rows, places.SCHEMA)


def test_the_curve_visits_each_square_once_and_steps_to_a_neighbour(spark):
    at = {curve.square_index(x, y, 4): (x, y) for x in range(16) for y in range(16)}
    assert sorted(at) == list(range(256))
    assert all(abs(at[i][0] - at[i + 1][0]) + abs(at[i][1] - at[i + 1][1]) == 1 for i in range(255))
    df = spark.createDataFrame([(x * 22.5 - 180 + 1, y * 11.25 - 90 + 1, curve.square_index(x, y, 4)) for x in range(16) for y in range(16)], "lon double, lat double, want long")
    assert df.where(curve.hilbert(F.col("lat"), F.col("lon"), 4) != F.col("want")).count() == 0


POINTS = [(59.33, 18.06, 300.0), (59.33, 18.06, 25_000.0), (0.0, 180.0, 50_000.0), (89.99, 10.0, 100_000.0), (-90.0, 0.0, 1000.0), (10.0, 10.0, 3_000_000.0), (-33.0, -179.99, 900_000.0)]


def test_files_read_fall_with_the_radius(spark, many, tmp_path):
    path = str(tmp_path / "table")
    dataset.write_table(many, path, 32)
    assert spark.read.parquet(path).count() == many.count()
    read = []
    for lat, lon, radius in POINTS:
        got = dataset.stored_within(spark, path, lat, lon, radius)
        assert {r.id for r in got.collect()} == {r.id for r in places.within(many, lat, lon, radius).collect()}
        scan = got._jdf.queryExecution().executedPlan().collectLeaves().head()
        read.append(scan.metrics().apply("numFiles").value())
    assert read[0] < 4 and read[0] <= read[1] < 12 and read[4] <= 6 < read[5] < 32


def test_ranges_hold_every_place_of_the_circle(spark, many):
    keyed = many.select("id", "lat", "lon", curve.hilbert(F.col("lat"), F.col("lon")).alias("h"))
    for lat, lon, radius in POINTS:
        spans = curve.circle_ranges(lat, lon, radius)
        inside = keyed.where(geo.haversine_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) <= radius).collect()
        assert all(any(a <= r.h <= b for a, b in spans) for r in inside)


def test_published_file_is_in_order_and_whole(spark, many, tmp_path):
    path, rings = str(tmp_path / "a/spots.json"), boundary.parse_boundary(refresh.PLANET)
    for rows in (many, many.limit(0)):
        dataset.publish(rows.repartition(5), rings, "planet", "2026-01-01", path, gate=False)
        spots = json.loads(open(path, encoding="utf-8").read())["spots"]
        assert [(s["id"], s["kind"]) for s in spots] == sorted((r.id, r.kind) for r in rows.collect())
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.endswith(".crc")] == ["spots.json"]
    copy = str(tmp_path / "b/copy.json")
    files.copy_file(spark, path, copy)
    assert open(copy).read() == open(path).read()


def xml(*parts):
    return "<?xml version='1.0'?>\n<osmChange version='0.6'>" + "".join(parts) + "</osmChange>"


def node(op, i, version, extra=""):
    return f'<{op}><node id="{i}" version="{version}" timestamp="2026-07-01T10:00:00Z" lat="59.5" lon="18.0">{extra}</node></{op}>'


def put(folder, seq, text):
    with gzip.open(folder / f"{seq}.osc.gz", "wt", encoding="utf-8") as f:
        f.write(text)


def drained(spark, folder, sink, checkpoint, **options):
    q = change_files.read_stream(spark, str(folder), **options).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.seq, r.op, r.type, r.id, r.version) for r in spark.read.schema(change_files.SCHEMA).parquet(sink).collect())


def test_files_out_of_order_and_with_a_gap(spark, tmp_path):
    folder, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    put(folder, 6, xml(node("modify", 1, 3)))
    put(folder, 4, xml(node("create", 1, 1, '<tag k="a" v="1"/><tag k="a" v="&lt;2&gt;"/>'), "<modify/>", '<modify><way id="7" version="2"><nd ref="1"/><nd ref="2"/></way><relation id="8" version="1"><member type="way" ref="7" role=""/></relation></modify>'))
    first = [(4, "create", "node", 1, 1), (4, "modify", "relation", 8, 1), (4, "modify", "way", 7, 2)]
    assert drained(spark, folder, sink, checkpoint, after=3) == first  # 6 waits for 5
    row = spark.read.schema(change_files.SCHEMA).parquet(sink).where("type = 'node'").first()
    assert row.tags == {"a": "<2>"} and row.lat == 59.5 and row.refs is None
    put(folder, 8, xml())
    put(folder, 5, xml(node("delete", 1, 2)))
    more = first + [(5, "delete", "node", 1, 2), (6, "modify", "node", 1, 3)]
    assert drained(spark, folder, sink, checkpoint, after=3) == more
    put(folder, 7, xml(node("create", 9, 1)))
    assert drained(spark, folder, sink, checkpoint, after=3) == more + [(7, "create", "node", 9, 1)]
    with pytest.raises(Exception, match="change file 4 is missing|4 is missing"):
        (folder / "4.osc.gz").rename(tmp_path / "gone")
        drained(spark, folder, str(tmp_path / "o2"), str(tmp_path / "c2"), after=3, gaps="fail")


def test_broken_and_repeated_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    put(tmp_path / "x", 1, xml(node("create", 1, 1))[:-20])
    with pytest.raises(Exception, match="ParseError|no element|unclosed|mismatched"):
        change_files.read(spark, str(tmp_path / "x")).collect()
    put(tmp_path / "x", "01", xml())
    with pytest.raises(ValueError, match="two change files"):
        change_files.numbered(str(tmp_path / "x"))
    assert change_files.numbered(str(tmp_path / "nothing")) == {}


def test_written_changes_come_back_and_replay_alike(spark, tmp_path):
    from datetime import datetime

    at = datetime(2026, 7, 1, 12)
    rows = [("node", i, 1 + i % 3, at, 1.5 * i, -0.25, None, None, {"name": '<"&\n' + str(i)} if i % 2 else {}, "create modify delete".split()[i % 3], 1 + i % 4) for i in range(40)]
    rows += [("way", 1, 1, at, None, None, [1, 2], None, {}, "modify", 2), ("relation", 1, 1, at, None, None, None, [("way", 1, "outer"), ("node", 2, None)], {"a": "b"}, "create", 9)]
    df = spark.createDataFrame(rows, change_files.SCHEMA)
    assert change_files.write(df, str(tmp_path / "f")) == 5
    back = osm_xml.read_changes(spark, str(tmp_path / "f"))
    key = lambda d: sorted((tuple(x if not isinstance(x, dict) else tuple(sorted(x.items())) for x in r) for r in d.collect()), key=repr)
    assert key(back) == key(df)
    empty = spark.createDataFrame([], objects.SCHEMA)
    assert key(objects.replay(empty, back)) == key(objects.replay(empty, df))
