"""Binary extracts: files made here block by block, in all the forms that the format allows."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold.plans import refresh
from wayfold.sources import extracts, osm_pbf, osm_xml, state

WHEN = 1_767_225_600  # 2026-01-01


def varint(n):
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def signed(n):
    return varint(n << 1 ^ n >> 63)


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def steps(values):
    return b"".join(signed(b - a) for a, b in zip([0, *values], values))


def packed(values):
    return b"".join(map(varint, values))


class Words(list):
    def __call__(self, word):
        if word not in self:
            self.append(word)
        return self.index(word)


def block(groups, words, **options):
    table = field(1, b"".join(field(1, w.encode()) for w in words))
    return table + b"".join(field(2, g) for g in groups) + b"".join(field(n, v) for n, v in options.get("more", []))


def info(version):
    return field(4, field(1, version) + field(2, WHEN))


def tagged(tags, words):
    return field(2, packed(words(k) for k, _ in tags)) + field(3, packed(words(v) for _, v in tags))


def dense(nodes, words, told=True):
    """nodes: (id, version, lat, lon in units of 1e-7, tags)."""
    own = field(5, field(1, packed(n[1] for n in nodes)) + field(2, steps([WHEN] * len(nodes)))) if told else b""
    texts = b"".join(packed(x for k, v in n[4] for x in (words(k), words(v))) + b"\0" for n in nodes) if any(n[4] for n in nodes) else b""
    return field(2, field(1, steps([n[0] for n in nodes])) + own + field(8, steps([n[2] for n in nodes])) + field(9, steps([n[3] for n in nodes])) + field(10, texts))


def stored(kind, message, how="zlib"):
    if how == "raw":
        body = field(1, message)
    elif how == "zlib":
        body = field(2, len(message)) + field(3, zlib.compress(message))
    else:
        body = field(2, len(message)) + field(7, pa.compress(message, "zstd", asbytes=True)) if how == "zstd" else field(9, message)
    head = field(1, kind.encode()) + field(2, b"index") + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def header(stamp=WHEN, needs=("OsmSchema-V0.6", "DenseNodes")):
    return stored("OSMHeader", b"".join(field(4, n.encode()) for n in needs) + (field(32, stamp) if stamp else b""))


def extract():
    """Bytes of a file, and what it holds as (type, id): (version, lat, lon, refs, members, tags)."""
    blob, want = [header()], {}
    for k in range(40):
        words = Words([""])
        nodes = [(k * 1000 - 5000 + i, 1 + i % 3, 593_293_235 + i * 7 - k, -180_000_000 + i, [("leisure", "dog_park"), ("name", f"Ö{i}")] if i % 50 == 0 else []) for i in range(200)]
        blob.append(stored("OSMData", block([dense(nodes, words)], words), ["zlib", "raw", "zstd"][k % 3]))
        want |= {("node", n[0]): (n[1], n[2] / 1e7, n[3] / 1e7, None, None, dict(n[4])) for n in nodes}
    words = Words([""])
    bare = dense([(900_000, 0, 1, 2, []), (900_001, 0, 3, 4, [])], words, told=False)
    want |= {("node", 900_000): (None, 1e-7, 2e-7, None, None, {}), ("node", 900_001): (None, 3e-7, 4e-7, None, None, {})}
    lone = b"".join(field(1, varint(1 << 3) + signed(i) + info(4) + tagged([("dog", "yes")], words) + varint(8 << 3) + signed(-5) + varint(9 << 3) + signed(6)) for i in (910_000, 910_001))
    want |= {("node", i): (4, -5e-7, 6e-7, None, None, {"dog": "yes"}) for i in (910_000, 910_001)}
    ways = field(3, field(1, 10) + info(2) + tagged([("a", "1"), ("a", "2")], words) + field(8, steps([5, 3, 9_000_000_000, 5]))) + field(3, field(1, 11))
    want |= {("way", 10): (2, None, None, [5, 3, 9_000_000_000, 5], None, {"a": "2"}), ("way", 11): (None, None, None, None, None, {})}
    members = [("way", 10, "outer"), ("node", 5, ""), ("relation", 20, "x")]
    roles = field(8, packed(words(r) for _, _, r in members)) + field(9, steps([r for _, r, _ in members])) + field(10, packed(["node", "way", "relation"].index(t) for t, _, _ in members))
    relations = field(4, field(1, 20) + info(1) + roles)
    want["relation", 20] = (1, None, None, None, members, {})
    blob.append(stored("OSMData", block([bare, lone, ways, relations, b""], words)))
    words = Words([""])
    wide = field(1, varint(1 << 3) + signed(1_000_000) + varint(8 << 3) + signed(3) + varint(9 << 3) + signed(-3))
    blob.append(stored("OSMData", block([wide], words, more=[(17, 1000), (19, 50), (20, -50)])))
    want["node", 1_000_000] = (None, 3050 / 1e9, -3050 / 1e9, None, None, {})
    blob.append(stored("OSMData", b""))
    return b"".join(blob), want


def plain(rows):
    return {(r.type, r.id): (r.version, r.lat, r.lon, r.refs, r.members and [tuple(m) for m in r.members], r.tags) for r in rows}


@pytest.mark.parametrize("pieces", [1, 7, 150])
def test_every_form_at_any_split(spark, tmp_path, pieces):
    data, want = extract()
    (tmp_path / "a.osm.pbf").write_bytes(data)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, len(data) // pieces + 1)
        df = osm_pbf.read_objects(spark, str(tmp_path / "a.osm.pbf"))
        rows = df.collect()
        assert (df.rdd.getNumPartitions() > 1) == (pieces > 1)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == len(want) and plain(rows) == want
    assert df.schema.simpleString() == osm_xml.empty(spark).schema.simpleString()
    assert {r.ts is None for r in rows if r.version is None} == {True}
    assert df.where(f"version IS NOT NULL AND unix_seconds(ts) <> {WHEN}").count() == 0
    assert osm_pbf.header_timestamp(spark, str(tmp_path / "a.osm.pbf")) == "2026-01-01T00:00:00Z"


def test_written_files_read_the_same(spark, tmp_path, monkeypatch):
    data, want = extract()
    (tmp_path / "a.osm.pbf").write_bytes(data)
    rows = osm_pbf.read_objects(spark, str(tmp_path / "a.osm.pbf")).where("id <> 1000000")
    for name, stamp in (("b.osm.pbf", "2026-07-21T12:00:00Z"), ("b.osm.pbf", "2026-07-22T00:00:00Z"), ("c.osm.pbf", None)):
        osm_pbf.write_objects(rows, str(tmp_path / name), stamp)
        again = osm_pbf.read_objects(spark, str(tmp_path / name))
        assert plain(again.collect()) == {k: v for k, v in want.items() if k[1] != 1_000_000}
        assert again.select("type", "id", "ts").exceptAll(rows.select("type", "id", "ts")).count() == 0
        if stamp:
            assert osm_pbf.header_timestamp(spark, str(tmp_path / name)) == stamp
    assert not [f for f in tmp_path.iterdir() if f.name.endswith(".part")]
    table = rows.limit(500).toArrow()
    flat = table.set_column(8, "tags", pa.array([[list(t) for t in own or ()] for own in table["tags"].to_pylist()], pa.list_(pa.list_(pa.string()))))
    monkeypatch.setattr(osm_pbf, "BLOCK_ROWS", 100)
    whole = list(osm_pbf.encode(flat))
    monkeypatch.setattr(osm_pbf, "BLOCK_BYTES", 200)
    small = list(osm_pbf.encode(flat))
    ids = lambda blocks: [i for b in blocks for t in osm_pbf.decode(b[4 + 2 + 7 :]) for i in t["id"].to_pylist()]
    assert len(whole) == 5 < len(small) and sorted(ids(whole)) == sorted(ids(small)) == sorted(table["id"].to_pylist())
    osm_pbf.write_objects(rows.limit(0), str(tmp_path / "none.osm.pbf"))
    assert osm_pbf.read_objects(spark, str(tmp_path / "none.osm.pbf")).count() == 0
    with pytest.raises(Exception, match="without a position"):
        osm_pbf.write_objects(rows.where("type = 'node'").withColumn("lat", F.lit(None).cast("double")).limit(3), str(tmp_path / "d.osm.pbf"))
    assert not (tmp_path / "d.osm.pbf").exists()


def test_same_rows_as_xml(spark, tmp_path):
    words = Words([""])
    node, way = dense([(1, 2, 591_000_000, 181_000_000, [("dog", "yes")]), (2, 1, 592_000_000, 182_000_000, [])], words), field(3, field(1, 10) + info(1) + tagged([("leisure", "dog_park")], words) + field(8, steps([1, 2])))
    (tmp_path / "a.osm.pbf").write_bytes(header() + stored("OSMData", block([node, way], words)))
    at = 'timestamp="2026-01-01T00:00:00Z"'
    (tmp_path / "a.osm").write_text(f'<osm {at}>\n<node id="1" version="2" {at} lat="59.1" lon="18.1"><tag k="dog" v="yes"/></node><node id="2" version="1" {at} lat="59.2" lon="18.2"/><way id="10" version="1" {at}><nd ref="1"/><nd ref="2"/><tag k="leisure" v="dog_park"/></way></osm>')
    got = [sorted(read(spark, str(tmp_path / name)).collect(), key=repr) for read, name in ((osm_pbf.read_objects, "a.osm.pbf"), (osm_xml.read_objects, "a.osm"))]
    assert got[0] == got[1]
    for name in ("a.osm.pbf", "a.osm"):
        assert refresh.filter_extract(spark, str(tmp_path / name), str(tmp_path / f"{name}.kept")) == "2026-01-01T00:00:00Z"
        assert state.read_text(spark, str(tmp_path / f"{name}.kept.timestamp")) == "2026-01-01T00:00:00Z"
        assert {(r.type, r.id) for r in spark.read.parquet(str(tmp_path / f"{name}.kept")).collect()} == {("node", 1), ("node", 2), ("way", 10)}


def test_what_cannot_be_read_is_an_error(spark, tmp_path):
    words = Words([""])
    good = stored("OSMData", block([dense([(1, 1, 1, 1, [])], words)], words), "raw")
    gone = field(1, varint(1 << 3) + signed(1) + field(4, field(1, 1) + field(6, 0)) + varint(8 << 3) + signed(3) + varint(9 << 3) + signed(3))
    files = {
        "needs": (header(needs=["OsmSchema-V0.6", "HistoricalInformation"]) + good, "asks for HistoricalInformation"),
        "cut": (header() + good[:-3], "length doesn't agree"),
        "marked": (header() + stored("OSMData", block([b""], ["", "a\n\x07OSMData b"]), "raw"), "length doesn't agree"),
        "history": (header() + stored("OSMData", block([gone], [""])), "a history"),
        "codec": (header() + stored("OSMData", b"x", "unknown"), "unknown way"),
    }
    for name, (data, why) in files.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match=why):
            osm_pbf.read_objects(spark, str(tmp_path / name)).collect()
    for name, data in {"undated": header(0) + good, "headless": good, "empty": b""}.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError, match="no timestamp"):
            osm_pbf.header_timestamp(spark, str(tmp_path / name))
    assert osm_pbf.read_objects(spark, str(tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("pieces", [1, 60])
def test_ranges_of_a_file(spark, tmp_path, pieces):
    data, want = extract()
    path = str(tmp_path / "a.osm.pbf")
    (tmp_path / "a.osm.pbf").write_bytes(data)
    df = extracts.read(spark, path, span=len(data) // pieces + 1)
    rows = df.collect()
    assert len(rows) == len(want) and plain(rows) == want
    assert sorted(map(repr, rows)) == sorted(map(repr, osm_pbf.read_objects(spark, path).collect()))
    by_type = extracts.read_by_type(spark, path, span=len(data) // 3)
    for where in ("type = 'way'", "type IN ('relation', 'way')", "type <> 'node' AND id > 10"):
        assert plain(by_type.where(where).collect()) == plain(r for r in rows if {"type = 'way'": r.type == "way", "type IN ('relation', 'way')": r.type != "node"}.get(where, r.type != "node" and r.id > 10))
    few = extracts.read(spark, path, "id long, refs array<bigint>", span=len(data) // 5)
    assert few.columns == ["id", "refs"] and sorted(r.id for r in few.collect()) == sorted(r.id for r in rows)
    assert extracts.read(spark, path, types=()).count() == by_type.where("type = 'way' AND type = 'node'").count() == 0
    pair = by_type.where("type = 'way'").select("id").alias("a").join(by_type.where("type = 'relation'").select("id").alias("b"), F.expr("a.id < b.id"))
    assert sorted(map(tuple, pair.collect())) == [(10, 20), (11, 20)]
    assert extracts.header_timestamp(path) == "2026-01-01T00:00:00Z"


def test_other_types_and_columns_are_not_decoded(spark, tmp_path):
    """Nodes whose tags and ids can't be read do no harm where ways alone are asked for, and only
    the scan of ways stays in the plan."""
    words = Words([""])
    broken = field(2, field(1, b"\xff"))  # an integer that doesn't end
    way = field(3, field(1, 10) + tagged([("a", "b")], words) + field(8, steps([1, 2])))
    (tmp_path / "a").write_bytes(header() + stored("OSMData", block([broken, way], words)))
    ways = extracts.read_by_type(spark, str(tmp_path / "a")).where("type = 'way'")
    assert [(r.id, r.refs) for r in ways.collect()] == [(10, [1, 2])]
    assert ways._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1
    with pytest.raises(Exception):
        extracts.read(spark, str(tmp_path / "a")).collect()
    untold = field(3, field(1, 11) + field(2, b"\x63") + field(3, b"\x63"))  # texts that the block lacks
    (tmp_path / "b").write_bytes(header() + stored("OSMData", block([untold], [""])))
    assert [r.id for r in extracts.read(spark, str(tmp_path / "b"), "type string, id long").collect()] == [11]
    with pytest.raises(Exception):
        extracts.read(spark, str(tmp_path / "b")).collect()


def test_what_ranges_refuse(spark, tmp_path):
    words = Words([""])
    good = stored("OSMData", block([dense([(k, 1, 1, 1, []) for k in range(50)], words)], words), "raw")
    # a block that holds a whole file in its texts: marks with lengths that agree
    within = good + good + good
    nested = header() + stored("OSMData", block([b""], ["", "x" * 40]) + field(99, within), "raw") + good
    cases = {"cut": (header() + good + good[:-3], 10_000), "cut in ranges": (header() + good + good[:-3], 64), "other": (b"<osm>" * 50, 64), "needs": (header(needs=["HistoricalInformation"]) + good, 64)}
    for name, (data, span) in cases.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="no block|asks for|cut off"):
            extracts.read(spark, str(tmp_path / name), span=span).collect()
    (tmp_path / "nested").write_bytes(nested)
    assert extracts.read(spark, str(tmp_path / "nested"), span=len(nested)).count() == 50
    with pytest.raises(Exception, match="inside a block"):
        extracts.read(spark, str(tmp_path / "nested"), span=len(header()) + 60).collect()
    (tmp_path / "empty").write_bytes(b"")
    assert extracts.read(spark, str(tmp_path / "empty")).count() == 0
    foreign = header() + stored("Other", b"?") + good + stored("Other", b"?" * 500) + good
    (tmp_path / "foreign").write_bytes(foreign)
    for span in (100, 10_000):
        assert extracts.read(spark, str(tmp_path / "foreign"), span=span).count() == 100
    for name in ("other", "empty"):
        with pytest.raises(ValueError, match="no timestamp"):
            extracts.header_timestamp(str(tmp_path / name))


def test_a_file_is_dealt_to_many_tasks(tmp_path):
    """Bytes are packed tight: ranges of 128 MB left most of a cluster idle."""
    path = tmp_path / "big.osm.pbf"
    with open(path, "wb") as f:
        f.truncate(48 << 20)
    reader = extracts.ExtractReader(extracts.StructType([]), {"path": f"file:{path}"})
    assert len(reader.partitions()) >= 12


def test_a_message_is_its_fields():
    rng = np.random.default_rng(4)
    whole = b"".join(osm_pbf._field(int(n), int(v)) + osm_pbf._field(int(n) + 1, bytes(int(v) % 300)) for n, v in rng.integers(1, 1 << 40, (200, 2)) % [40, 1 << 40])
    whole = whole + b"\x09" + bytes(8) + b"\x15" + bytes(4)
    assert osm_pbf._message(whole) == {k: v if isinstance(v, int) else bytes(v) for k, v in osm_pbf.fields(whole)}
    for broken in (whole[:-1], b"\x0b", b"\x0a\x05abc"):
        with pytest.raises(ValueError):
            osm_pbf._message(broken)


def test_lists_are_packed_as_one_by_one():
    """Whole arrays give the bytes of plain steps, with empty lists, negative numbers and very long ones."""
    rng = np.random.default_rng(5)
    lists = [[], [5], [], [], [-3, 1 << 40, 7], rng.integers(-(1 << 62), 1 << 62, 70_000).tolist(), []]
    x, ends = np.array([v for own in lists for v in own], np.int64), np.cumsum([len(own) for own in lists])
    assert osm_pbf._packed_lists(x, ends) == [b"".join(map(osm_pbf._coded, own)) for own in lists]
    assert osm_pbf._packed_lists(osm_pbf._steps_of_lists(x, ends), ends) == [osm_pbf._packed_steps(own) for own in lists]
    assert osm_pbf._packed_lists(np.zeros(0, np.int64), np.zeros(3, np.int64)) == [b""] * 3

