import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.functions.errors import ServiceError
from wayfold.operators import objects
from wayfold.plans import refresh
from wayfold.sources import buckets, fixes, state
from wayfold.streaming import policy, session

HERE, NEAR, FAR = {"lat": 59.33, "lon": 18.06}, {"lat": 59.331, "lon": 18.06}, {"lat": 59.335, "lon": 18.06}
SPOT = {"id": "node/1", "lat": 59.3, "lon": 18.0}


def play(*events):
    s, log = dict(session.START), []
    for kind, payload in events:
        s, effects = session.step(s, kind, payload)
        log.append([e["kind"] for e in effects])
    return s, log


def test_first_fix_drift_and_walk():
    s, log = play(("location-requested", {}), ("position-fixed", HERE), ("search-succeeded", {"spots": [SPOT], "radius": 3000}), ("position-fixed", NEAR), ("position-fixed", FAR))
    assert log == [["watch-location"], ["search"], ["frame-results"], [], ["search"]]
    assert s["phase"] == "searching" and s["spots"] == [SPOT] and s["source"] == "gps"


def test_answers():
    start = [("position-fixed", HERE)]
    assert play(*start, ("search-succeeded", {"spots": []}))[0]["phase"] == "empty"
    s, _ = play(*start, ("search-succeeded", {"spots": [SPOT]}), ("retry-requested", {}), ("search-failed", {}))
    assert s["phase"] == "failed" and s["spots"] == [SPOT]
    s, log = play(*start, ("search-failed", {}), ("search-succeeded", {"spots": [SPOT]}))
    assert s["phase"] == "failed" and log[-1] == []


def test_bathing_layer():
    s, log = play(("bathing-toggled", {}), ("position-fixed", HERE), ("bathing-toggled", {}), ("bathing-search-failed", {}), ("bathing-retry-requested", {}), ("bathing-search-succeeded", {"spots": [SPOT], "radius": 1}), ("position-fixed", FAR))
    assert log == [[], ["search"], ["search-bathing"], [], ["search-bathing"], [], ["search", "search-bathing"]]
    assert s["bathing"] == "loading" and s["bathing_spots"] == [SPOT]
    assert session.step(s, "bathing-toggled", {})[0]["bathing_spots"] == []


def test_picking_and_following():
    s, log = play(("pick-requested", {}), ("position-picked", HERE), ("position-fixed", FAR), ("follow-requested", {}), ("position-fixed", FAR))
    assert log == [["open-picker"], ["close-picker", "stop-watching", "frame-map", "search"], [], ["watch-location"], ["frame-map", "search"]]
    s, log = play(("position-picked", HERE), ("follow-requested", {}), ("location-failed", {"reason": "TIMEOUT"}))
    assert s["source"] == "picked" and log[-1] == ["stop-watching"]
    s, log = play(("location-requested", {}), ("location-failed", {"reason": "TIMEOUT"}), ("location-retry-requested", {}))
    assert s["phase"] == "locating" and log[-1] == ["watch-location"]


def test_selection():
    start = [("position-picked", HERE), ("search-succeeded", {"spots": [SPOT]})]
    s, log = play(*start, ("spot-selected", {"id": "node/1"}), ("directions-requested", {"id": "node/1"}))
    assert s["selected"] == "node/1" and log[-2:] == [["frame-spot"], ["open-directions"]]
    assert session.step(s, "directions-requested", {"id": "node/1"})[1][0]["origin"] == (59.33, 18.06)
    assert play(*start, ("spot-selected", {"id": "node/2"}))[0]["selected"] is None
    assert session.step(s | {"phase": "searching"}, "search-succeeded", {"spots": []})[0]["selected"] is None


def events(spark):
    kinds = ["location-requested", "position-fixed", "search-succeeded", "bathing-toggled", "spot-selected", "position-fixed", "nonsense", "search-failed"]
    rows = [(f"s{k % 3}", k, kinds[(k // 3) % len(kinds)], json.dumps(HERE | {"lat": 59.33 + k / 500, "spots": [SPOT], "id": "node/1"}) if k % 7 else "no json") for k in range(72)]
    return spark.createDataFrame(rows, "session string, seq long, kind string, payload string")


def test_stream_equals_batch(spark, tmp_path):
    df = events(spark)
    for part in range(3):
        df.where((F.col("seq") >= part * 24) & (F.col("seq") < part * 24 + 24)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = session.run_stream(stream).writeStream.format("memory").queryName("machine").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, session.run_batch(df).collect()), key=lambda r: r[1])
    assert sorted(map(tuple, spark.table("machine").collect()), key=lambda r: r[1]) == want and len(want) == 72


def test_events_out_of_order_across_batches(spark, tmp_path):
    """Events that come up to 20 minutes late, in later batches than their successors, give
    the rows of one sorted batch; what the watermark hasn't passed waits."""
    df = events(spark).withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("seq") * 60))
    shown = F.floor((F.col("seq") + F.pmod(F.xxhash64("seq"), F.lit(20))) / 24)  # arrives so many minutes later
    for part in range(4):
        df.where(shown == part).orderBy(F.xxhash64("seq", "kind")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    moved = df.select(F.max("seq").over(Window.partitionBy("session").orderBy(shown, "seq").rowsBetween(Window.unboundedPreceding, -1)).alias("before"), "seq").where("before > seq")
    assert moved.count() > 10  # by batches alone they would be out of order

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = session.run_stream(stream, "20 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=lambda r: r[1])

    want = sorted(map(tuple, session.run_batch(df).collect()), key=lambda r: r[1])
    first = run()
    assert 0 < len(first) < 72 and all(r[1] <= 71 - 20 for r in first) and set(first) < set(want)
    last = spark.createDataFrame([("end", 1000, "nonsense", None)], "session string, seq long, kind string, payload string")
    last.withColumn("at", F.lit("2030-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == want  # started again from its checkpoint, with events waiting there


def obj(type_, id_, version, lat=None, lon=None, refs=None, tags=None):
    return type_, id_, version, None, lat, lon, refs, None, tags


PARK = {"leisure": "dog_park", "name": "New"}


def changes(spark, rows):
    return spark.createDataFrame(rows, objects.SCHEMA + ", op string, seq long")


def test_refresh_from_files(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    spark.createDataFrame([obj("node", 1, 1, 59.0, 18.0, tags=PARK)], objects.SCHEMA).write.parquet(at("state"))
    meta = {"schema": 1, "filterVersion": 2, "sequenceNumber": 5061, "timestamp": "2026-07-22T00:00:00Z", "seededFrom": []}
    state.write_text(spark, at("meta.json"), json.dumps(meta))
    new = changes(spark, [(*obj("way", 9001, 2, refs=[8001, 8002], tags=PARK), "modify", 5062), (*obj("node", 1, 2), "delete", 5063), (*obj("node", 7, 1, 1.0, 1.0, tags=PARK), "create", 5061)])
    source = spark.createDataFrame([obj("way", 9001, 2, refs=[8001, 8002], tags=PARK), obj("node", 8001, 1, 59.34, 18.05), obj("node", 8002, 1, 59.342, 18.052)], objects.SCHEMA)
    got = refresh.refresh(spark, at("meta.json"), at("state"), new, source, (5063, "2026-07-24T00:00:00Z"), at("state2"), at("meta2.json"), at("out.json"), gate=False)
    assert got == {"passes": 1, "fetched": 1, "gone": 0, "diffs": 2, "kinds": {"dog_park": 1}}
    out = json.loads((tmp_path / "out.json").read_text())
    assert [(s["id"], s["lat"], s["lon"], s["name"]) for s in out["spots"]] == [("way/9001", 59.341, 18.051, "New")]
    assert state.read_meta(spark, at("meta2.json"))["sequenceNumber"] == 5063
    # at the head: nothing to replay, but everything is rebuilt
    again = refresh.refresh(spark, at("meta2.json"), at("state2"), new, source, (5063, "2026-07-24T00:00:00Z"), at("state3"), at("meta3.json"), at("out2.json"), gate=False)
    assert again["diffs"] == 0 and json.loads((tmp_path / "out2.json").read_text())["spots"] == out["spots"]
    with pytest.raises(ValueError):
        refresh.refresh(spark, at("meta2.json"), at("state2"), new, source, (5063, "x"), at("s4"), at("m4"), at("o4"))
    assert not (tmp_path / "m4").exists()


def test_seed(spark):
    a = spark.createDataFrame([obj("node", 1, 1, 59.0, 18.0, tags=PARK), obj("node", 2, 1, tags={"a": "b"})], objects.SCHEMA)
    b = spark.createDataFrame([obj("node", 1, 2, 60.0, 18.0, tags=PARK)], objects.SCHEMA)
    days = spark.createDataFrame([(5, "2026-07-20"), (6, "2026-07-21"), (7, "2026-07-22")], "seq long, d string").select("seq", F.col("d").cast("timestamp").alias("ts"))
    merged, start = refresh.seed([a, b], days.where("seq > 5"), days)
    assert [(r.id, r.version) for r in merged.collect()] == [(1, 2)] and start.first()[0] == 5


def test_stream_refresh(spark, tmp_path):
    """Each batch is replayed, preselected, repaired and published; late changes don't win."""
    at = lambda n: str(tmp_path / n)
    refresh.empty_state(spark, at("states"))
    rows = [
        (*obj("node", 1, 2, 2.0, 2.0, tags=PARK), "create", 5),
        (*obj("node", 2, 1, 3.0, 3.0, tags=PARK), "create", 6),
        (*obj("way", 7, 1, refs=[71, 72], tags=PARK), "create", 6),
        (*obj("node", 2, 2), "delete", 8),
        (*obj("node", 1, 1, 1.0, 1.0, tags=PARK), "modify", 4),  # late
        (*obj("node", 2, 1, 9.0, 9.0, tags=PARK), "modify", 7),  # late, after the deletion
        (*obj("node", 3, 1, 4.0, 4.0, tags={"a": "b"}), "create", 8),  # never preselected
    ]
    for k, r in enumerate(rows):
        changes(spark, [r]).coalesce(1).write.mode("append").parquet(at("in"))
    source = spark.createDataFrame([obj("way", 7, 1, refs=[71, 72], tags=PARK), obj("node", 71, 1, 5.0, 5.0), obj("node", 72, 1, 5.2, 5.2)], objects.SCHEMA)
    stream = spark.readStream.schema(changes(spark, rows).schema).option("maxFilesPerTrigger", 2).parquet(at("in"))
    refresh.stream_refresh(stream, source, at("states"), at("cp"), at("out.json"), gate=False).awaitTermination()
    assert {(r.type, r.id, r.version) for r in refresh.streamed_state(spark, at("states")).collect()} == {("node", 1, 2), ("way", 7, 1), ("node", 71, 1), ("node", 72, 1)}
    spots = json.loads((tmp_path / "out.json").read_text())["spots"]
    assert [(s["id"], s["lat"]) for s in spots] == [("node/1", 2.0), ("way/7", 5.1)]
    assert json.loads((tmp_path / "states" / "cursor").read_text())["sequenceNumber"] == 8


def test_a_run_in_place_survives_its_own_failure(spark, tmp_path, monkeypatch):
    """Old and new state share their paths; a crash before the commit leaves the old pair."""
    at = lambda n: str(tmp_path / n)
    spark.createDataFrame([obj("node", 1, 1, 59.0, 18.0, tags=PARK)], objects.SCHEMA).write.parquet(at("state"))
    meta = {"schema": 1, "filterVersion": 2, "sequenceNumber": 10, "timestamp": "2026-07-22T00:00:00Z", "seededFrom": []}
    state.write_text(spark, at("meta"), json.dumps(meta))
    new = changes(spark, [(*obj("node", 2, 1, 60.0, 18.0, tags=PARK), "create", 11), (*obj("node", 1, 2), "delete", 12)])
    none = spark.createDataFrame([], objects.SCHEMA)

    def run(head):
        return refresh.refresh(spark, at("meta"), at("state"), new, none, (head, "2026-07-24T00:00:00Z"), at("state"), at("meta"), at("out"), gate=False)

    with monkeypatch.context() as m:
        m.setattr(state, "advanced", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run(11)
    assert state.read_meta(spark, at("meta")) == meta
    assert run(11)["kinds"] == {"dog_park": 2} and run(12)["kinds"] == {"dog_park": 1}
    now = state.read_meta(spark, at("meta"))
    assert now["sequenceNumber"] == 12 and [r.id for r in spark.read.parquet(f"{at('state')}/{now['state']}").collect()] == [2]
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("0000000")]) == 2  # the failed run's and the present one


def test_a_state_in_buckets_writes_what_changed(spark, tmp_path, monkeypatch):
    at = lambda n: str(tmp_path / n)
    parks = [obj("node", k, 1, 59.0 + k / 1000, 18.0, tags=PARK) for k in range(300)]
    spark.createDataFrame(parks, objects.SCHEMA).write.parquet(at("state"))
    meta = {"schema": 1, "filterVersion": 2, "sequenceNumber": 10, "timestamp": "2026-07-22T00:00:00Z", "seededFrom": []}
    state.write_text(spark, at("meta"), json.dumps(meta))
    new = changes(spark, [(*obj("node", 7, 2, 60.0, 18.0, tags=PARK), "modify", 12), (*obj("node", 8, 2), "delete", 13)])
    none = spark.createDataFrame([], objects.SCHEMA)

    def run(head):
        return refresh.refresh(spark, at("meta"), at("state"), new, none, (head, "2026-07-24T00:00:00Z"), at("state"), at("meta"), at("out"), gate=False, bucketed=20)["written"]

    def now():
        return {r.id: (r.version, r.lat) for r in buckets.read(spark, at("state"), state.read_meta(spark, at("meta"))["state"], objects.SCHEMA).collect()}

    size = lambda: sum(f.stat().st_size for f in (tmp_path / "state").glob("*/bucket=*/*.parquet"))
    with monkeypatch.context() as m:
        m.setattr(state, "advanced", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run(11)
    assert run(11) == list(range(20)) and now() == {p[1]: (1, p[4]) for p in parks}
    whole = size()  # twice the state, for the failed run left its own
    assert run(11) == [] and size() == whole and len(now()) == 300
    with monkeypatch.context() as m:
        m.setattr(state, "advanced", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run(12)
    assert state.read_meta(spark, at("meta"))["sequenceNumber"] == 11 and now()[7] == (1, 59.007)
    one = run(12)
    assert len(one) == 1 and now() == {p[1]: (1, p[4]) for p in parks} | {7: (2, 60.0)}
    assert size() < whole * 1.1  # with the one bucket of the second failed run
    gone = run(13)
    assert len(gone) == 1 and gone != one and set(now()) == set(range(300)) - {8}


def test_digests_tell_rows_apart(spark):
    rows = [obj("node", 1, 1, 59.0, None, tags={"a": "b", "c": "d"}), obj("node", 1, 1, None, 59.0, tags={"a": "b", "c": "d"}), obj("node", 1, 1, 59.0, None, tags={"a": "b"}), obj("node", 1, 1, 59.0, None, refs=[1, None]), obj("node", 1, 1, 59.0, None, refs=[None, 1])]
    of = lambda *r: buckets.digests(spark.createDataFrame(list(r), objects.SCHEMA), 4)
    assert len({json.dumps(of(r)) for r in rows} | {json.dumps(of(rows[0], rows[0]))}) == 6
    assert of(*rows) == of(*rows[::-1]) and of(rows[0]) == of(obj("node", 1, 1, 59.0, None, tags={"c": "d", "a": "b"}))
    assert of() == {}


def test_text_files_are_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "f")
    state.write_text(spark, path, "old")
    with pytest.raises(ZeroDivisionError):
        with state.TextFile(spark, path) as f:
            f.write("half")
            1 / 0
    assert state.read_text(spark, path) == "old"
    state.write_text(spark, path, "new")
    assert state.read_text(spark, path) == "new" and state.read_text(spark, str(tmp_path / "none")) is None
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".part")]


def test_extracts_are_filtered_with_their_time(spark, tmp_path):
    head = '<osm version="0.6" osmosis_replication_timestamp="{}">'
    node = '<node id="{0}" version="{1}" timestamp="2026-01-01T00:00:00Z" lat="59" lon="18"><tag k="leisure" v="{2}"/></node>'
    files = {"b.osm": ("2026-07-21T12:00:00Z", node.format(1, 2, "dog_park")), "a.osm": ("2026-07-23T00:00:00Z", node.format(1, 1, "dog_park") + node.format(2, 1, "pitch"))}
    for name, (stamp, body) in files.items():
        (tmp_path / name).write_text(head.format(stamp) + "\n" + body + "\n</osm>")
    (tmp_path / "none.osm").write_text("<osm>" + node.format(1, 1, "dog_park") + "</osm>")
    days = spark.createDataFrame([(5, "2026-07-20"), (6, "2026-07-21"), (7, "2026-07-22")], "seq long, d string").select("seq", F.col("d").cast("timestamp").alias("ts"))
    merged, start = refresh.seed_from(spark, [str(tmp_path / n) for n in files], str(tmp_path / "work"), days)
    assert [(r.id, r.version) for r in merged.collect()] == [(1, 2)] and start.first()[0] == 5
    assert state.read_text(spark, str(tmp_path / "work" / "00001.timestamp")) == "2026-07-21T12:00:00Z"
    for bad in ("none.osm",):
        with pytest.raises(ValueError, match="no timestamp"):
            refresh.filter_extract(spark, str(tmp_path / bad), str(tmp_path / "x"))
        assert not (tmp_path / "x").exists()


def test_fixes_become_events(spark, tmp_path):
    rows = [{"session": "s", "seq": 1, "lat": 59.0, "lon": 18.0, "accuracy": 12.5}, {"session": "s", "seq": 2, "lat": 59.1, "lon": 18.0, "accuracy": "NaN"}, {"session": "s", "seq": 3, "error_code": 1}, {"session": "s", "seq": 4, "error_code": 9}, {"session": "s", "seq": 5}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    at_rest = sorted(map(tuple, fixes.events(fixes.read_fixes(spark, str(tmp_path / "in"))).collect()), key=lambda r: r[1])
    assert [(r[1], r[2], json.loads(r[3])) for r in at_rest] == [(1, "position-fixed", {"lat": 59.0, "lon": 18.0, "accuracy": 12.5}), (2, "position-fixed", {"lat": 59.1, "lon": 18.0}), (3, "location-failed", {"reason": "PERMISSION_DENIED"}), (4, "location-failed", {"reason": "POSITION_UNAVAILABLE"})]
    q = fixes.events(fixes.stream_fixes(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("fixes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("fixes").collect()), key=lambda r: r[1]) == at_rest


def test_a_batch_equals_a_plain_replay(spark):
    """Every row of the batch form against the machine stepped by hand, a session at a time."""
    df = events(spark)
    got = {(r.session, r.seq): r for r in session.run_batch(df).collect()}
    for name in {r.session for r in got.values()}:
        now = dict(session.START)
        for e in df.where(F.col("session") == name).orderBy("seq").collect():
            try:
                now, effects = session.step(now, e.kind, json.loads(e.payload))
            except ValueError:
                effects = []
            r = got[name, e.seq]
            assert (r.phase, r.source, r.picker, r.bathing, r.selected, r.n_spots, r.n_bathing) == (now["phase"], now["source"], now["picker"], now["bathing"], now["selected"], len(now["spots"]), len(now["bathing_spots"]))
            assert (r.lat, r.lon) == (now["at"] or (None, None)) and json.loads(r.effects) == json.loads(json.dumps(effects))


def failing(errors, answer="ok"):
    left = list(errors)

    def ask(*args):
        if left:
            raise left.pop(0)
        return answer

    return ask


def test_policies():
    waits = []
    E = ServiceError
    assert policy.fair(failing([E("busy"), E("rate-limited", retry_after_ms=500)]), waits.append)() == "ok" and waits == [2.0, 0.5]
    for errors in ([E("busy")] * 3, [E("timeout")], [E("busy", retry_after_ms=30_001)]):
        with pytest.raises(ServiceError):
            policy.fair(failing(errors), lambda s: None)()
    assert policy.with_mirror(failing([E("busy")]), failing([], "mirror"))() == "mirror"
    for first, second, kind in ((E("timeout"), None, "timeout"), (E("busy"), E("network-unavailable"), "busy"), (E("busy"), E("rate-limited"), "busy")):
        with pytest.raises(ServiceError) as e:
            policy.with_mirror(failing([first]), failing([second] if second else []))()
        assert e.value.kind == kind
    route = policy.offline_first(lambda *a: "local", lambda *a: "live", lambda lat, lon, r: r < 10)
    assert (route("k", 0, 0, 5), route("k", 0, 0, 15)) == ("local", "live")


def test_answers_through_a_cache():
    kept, clock, asked = {}, [0.0], []

    def ask(*args):
        asked.append(args)
        if args[0] == "fails":
            raise ServiceError("busy")
        return [] if args[0] == "empty" else [args]

    cached = policy.with_cache(ask, kept.get, kept.__setitem__, lambda *a: "/".join(map(str, a)), lambda: clock[0], ttl_ms=100)
    assert cached("k", 1) == cached("k", 1) == [("k", 1)] and len(asked) == 1
    assert cached("empty", 1) == cached("empty", 1) == [] and len(asked) == 2
    for _ in range(2):
        with pytest.raises(ServiceError):
            cached("fails", 1)
    assert len(asked) == 4
    clock[0] = 100.0  # too old
    assert cached("k", 1) and len(asked) == 5
    clock[0] = 50.0  # from the future
    assert cached("k", 1) and len(asked) == 6
    broken = policy.with_cache(ask, lambda k: 1 / 0, lambda k, v: 1 / 0, str, lambda: 0.0)
    assert broken("k") == [("k",)]


def test_a_load_has_a_deadline_and_is_shared(spark, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor
    from time import sleep

    from wayfold.sources import dataset

    asked = []

    def slow(spark, path):
        asked.append(path)
        sleep(0.3)
        return {"path": path}, None

    monkeypatch.setattr(dataset, "read_dataset", slow)
    assert dataset.Loader(spark, "p", deadline_s=0.05).load() is None
    sleep(0.4)
    asked.clear()
    loader = dataset.Loader(spark, "p")
    with ThreadPoolExecutor(4) as pool:
        assert len({str(x) for x in pool.map(lambda _: loader.load(), range(4))}) == 1
    assert asked == ["p"]
