import math

import pytest
from pyspark.sql import functions as F

from wayfold.functions import density, errors, geo, ids, present, seasonal, tags


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def ring(points):
    return geo.ring(points)


L = F.lit
SQUARE = [(58.9, 17.5), (59.7, 17.5), (59.7, 18.7), (58.9, 18.7)]


def test_haversine(spark):
    a = one(spark, geo.haversine_m(L(59.33), L(18.06), L(59.375), L(18.06)), geo.haversine_m(L(59.375), L(18.06), L(59.33), L(18.06)), geo.haversine_m(L(1.0), L(2.0), L(1.0), L(2.0)), geo.haversine_m(L(None).cast("double"), L(2.0), L(1.0), L(2.0)))
    assert a[0] == pytest.approx(5003.8, abs=0.5) and a[0] == a[1] and a[2] == 0 and a[3] is None


def test_rings(spark):
    hole = [(59.4, 18.0), (59.4, 18.1), (59.45, 18.05)]
    df = spark.createDataFrame([(59.33, 18.06), (58.0, 18.0), (59.41, 18.05), (59.33, 17.45)], "lat double, lon double")
    inside = geo.in_ring(F.col("lat"), F.col("lon"), ring(SQUARE))
    got = df.select(inside, F.expr(geo.in_fixed_ring("lat", "lon", SQUARE)), geo.in_ring(F.col("lat"), F.col("lon"), ring([])), geo.in_ring(F.col("lat"), F.col("lon"), ring([*SQUARE, SQUARE[0]]))).collect()
    assert [tuple(r) for r in got] == [(x, x, False, x) for x in (True, False, True, False)]
    within = lambda r, include, exclude: geo.circle_within(F.col("lat"), F.col("lon"), L(r), F.array(*map(ring, include)).cast(f"array<{geo.RING_TYPE}>"), F.array(*map(ring, exclude)).cast(f"array<{geo.RING_TYPE}>"))
    got = df.select(within(25_000.0, [SQUARE], []), within(60_000.0, [SQUARE], []), within(1.0, [SQUARE], [hole]), within(1.0, [], []), within(12_000.0, [SQUARE], [hole])).collect()
    assert [r[0] for r in got] == [True, False, True, False]
    assert [r[1] for r in got] == [False] * 4
    assert [r[2] for r in got] == [True, False, False, False]
    assert [r[3] for r in got] == [False] * 4
    assert got[0][4] is False  # the hole's boundary is nearer than that
    assert one(spark, geo.ring_distance_m(L(1.0), L(1.0), ring([])))[0] == math.inf
    assert one(spark, geo.ring_distance_m(L(0.0), L(0.0), ring([(0.0, 1.0)])))[0] == pytest.approx(111194.9, abs=1)


CITIES = [("Stockholm", 59.33, 18.07, "dense"), ("Berlin", 52.52, 13.4, "dense"), ("London", 51.51, -0.13, "dense"), ("Denver", 39.74, -104.99, "dense"), ("Honolulu", 21.31, -157.86, "dense"), ("Sydney", -33.87, 151.21, "dense"), ("Toronto", 43.65, -79.38, "dense"), ("Auckland", -36.85, 174.76, "dense"), ("Dublin", 53.35, -6.26, "dense"), ("Prague", 50.09, 14.42, "sparse"), ("Paris", 48.86, 2.35, "sparse"), ("Tallinn", 59.44, 24.75, "sparse"), ("Tijuana", 32.51, -117.04, "sparse"), ("Tokyo", 35.68, 139.69, "sparse"), ("Sea", 0.0, 0.0, "sparse")]


def test_density(spark):
    df = spark.createDataFrame(CITIES, "city string, lat double, lon double, want string")
    for r in df.withColumn("got", density.mapping_density("lat", "lon")).collect():
        assert r.got == r.want, r.city


TAGS = [
    ({"leisure": "dog_park"}, True, False, "name-match", (None, None, None, None)),
    ({"natural": "beach", "dog": "yes", "lit": "24/7"}, False, True, "permitted", (None, None, True, None)),
    ({"leisure": "bathing_place", "dog": "designated", "surface": ""}, False, True, "designated", (None, None, None, None)),
    ({"natural": "water", "name": "Stora HundBadet"}, False, True, "name-match", (None, None, None, None)),
    ({"highway": "x", "name": "hundbad"}, False, False, "name-match", (None, None, None, None)),
    ({"natural": "beach", "dog": "leashed", "fenced": "no", "barrier": "fence"}, False, False, "permitted", (True, False, None, None)),
    ({"dog": "no", "lit": "no", "barrier": "fence"}, False, False, None, (None, True, False, None)),
    ({"dog": "unleashed", "lit": "", "surface": "fine_gravel"}, False, False, "permitted", (False, None, None, "fine_gravel")),
]


def test_tags(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TAGS)], "n int, tags map<string,string>")
    tag = tags.of_map("tags")
    for r in df.select("n", tags.is_dog_park(tag), tags.is_bathing_candidate(tag), tags.provenance(tag), tags.display_tags(tag)).collect():
        assert (r[1], r[2], r[3], tuple(r[4])) == TAGS[r.n][1:], TAGS[r.n]
    names = spark.createDataFrame([({"name": n},) for n in ("Hundbad", "HUNDBAD", "HuNdBaD", None)], "tags map<string,string>")
    assert [r[0] for r in names.select(tags.is_preselected(tag)).collect()] == [True, True, False, False]
    kept = F.struct(L(None).cast("boolean").alias("leash_required"), L(False).alias("fenced"), L(None).cast("boolean").alias("lit"), L("grass").alias("surface"))
    dropped = F.struct(L(True).alias("leash_required"), L(True).alias("fenced"), L(None).cast("boolean").alias("lit"), L("sand").alias("surface"))
    assert tuple(one(spark, tags.adopt_silent(kept, dropped))[0]) == (True, False, None, "grass")


RULES = {
    "no @ (Jun 1-Aug 31)": (601, 831),
    "NO @ jun 1 - AUGUST 31": (601, 831),
    "no @ (Jan-Feb)": (101, 229),
    "leashed @ (May 1-Sep 30); no @ (Oct-Mar)": (1001, 331),
    "no @ (Jun 31-Aug 31)": None,
    "no @ (Su 10:00-18:00)": None,
    "no @ (Dec 24)": None,
    "no": None,
    "   ": None,
    "yes @ (a;b); no @ (May)": None,
    "x @ (a;no @ Jun-Jul)": None,
    ") ; no @ Jun-Jul": (601, 731),
    "no @ (Jun-Jul) (x)": None,
    "no @ ( Jun 1 - Jul 2 )": (601, 702),
    " no @ Jun-Jul﻿": (601, 731),
    "no@Nov 15-Mar 2": (1115, 302),
}


def test_seasonal(spark):
    df = spark.createDataFrame([(v,) for v in [*RULES, "", None]], "v string")
    for r in df.select("v", seasonal.parse_conditional(F.col("v")).alias("r")).collect():
        if not r.v:
            assert r.r is None
        elif RULES[r.v] is None:
            assert tuple(r.r) == ("unparsed", None, None), r.v
        else:
            assert (r.r.kind, r.r["from"].month * 100 + r.r["from"].day, r.r.to.month * 100 + r.r.to.day) == ("ban", *RULES[r.v]), r.v


@pytest.mark.parametrize("rule,day,want", [("no @ Jun 1-Aug 31", "2026-06-01", True), ("no @ Jun 1-Aug 31", "2026-08-31", True), ("no @ Jun 1-Aug 31", "2026-09-01", False), ("no @ Nov-Feb", "2026-01-10", True), ("no @ Nov-Feb", "2026-11-01", True), ("no @ Nov-Feb", "2026-07-01", False), ("no", "2026-07-01", False)])
def test_banned(spark, rule, day, want):
    r = seasonal.parse_conditional(L(rule))
    got = one(spark, seasonal.banned_on(r, L(day).cast("date")), seasonal.caption(r, L(day).cast("date")))
    assert got[0] is want and got[1].banned_now is want
    if rule == "no @ Jun 1-Aug 31":
        assert got[1].text == ("Dogs banned now (1 Jun – 31 Aug)" if want else "Dogs banned 1 Jun – 31 Aug")


def test_presentation(spark):
    for m, text in ((0.4, "0 m"), (999.6, "1000 m"), (1000.0, "1.0 km"), (9949.0, "9.9 km"), (10_000.0, "10 km"), (12_600.0, "13 km")):
        assert one(spark, present.format_distance(L(m)))[0] == text
    assert one(spark, present.cache_key(L("dog_park"), L(59.33349), L(-18.0685), L(3000.2)))[0] == "dog-parks-v1-59.333,-18.068,3000"
    assert one(spark, present.cache_key(L("bathing_spot"), L(-0.0004), L(0.0), L(1.0)))[0] == "bathing-v1-0.000,0.000,1"
    assert one(spark, present.spot_label(L("  "), L("dog_park")), present.spot_label(L(" x "), L("dog_park")))[:] == ("Unnamed dog park", " x ")
    assert one(spark, present.directions_url(L("1,2"), L(None).cast("string"), L("Android")))[0] == "geo:1,2?q=1,2"
    assert one(spark, present.accuracy_text(L(12.4)), present.accuracy_text(L(None).cast("double")), present.accuracy_text(L(float("inf"))))[:] == ("±12 m", None, None)
    assert one(spark, present.format_delta(L(-3.6)), present.format_delta(L(0.2)))[:] == ("-4", "+0")
    note = one(spark, present.layer_note(L("failed"), L(0), L(None).cast("double"), L(1.0), L(True)), present.layer_note(L("off"), L(0), L(None).cast("double"), L(1.0), L(True)))
    assert note[0].retry and note[0].text.endswith("out of date.") and note[1].text is None
    assert one(spark, present.empty_message(L(25_000.0), "0D", "0D"))[0].title == "No dog parks mapped within 25 km"


def test_ids(spark):
    want = {"n4711": "node/4711", "a1406597530": "way/703298765", "a247": "relation/123", "w9": "way/9", "r5": "relation/5", "x999": None, "n": None, "N1": None, "n1x": None, "": None}
    for r in spark.createDataFrame([(x,) for x in want], "f string").select("f", ids.spot_id(F.col("f")).alias("id")).collect():
        assert r.id == want[r.f], r.f
    assert one(spark, ids.diff_url(L(5061)))[0].endswith("/day/000/005/061.osc.gz")
    assert one(spark, ids.repair_url(L("way"), L(7)))[0].endswith("/way/7/full")
    with pytest.raises(Exception, match="not a replication sequence number"):
        one(spark, ids.sequence_path(L(-1)))


def test_errors(spark):
    now = L("2026-07-22 10:00:00").cast("timestamp")
    got = one(spark, errors.retry_after_ms(L("120"), now), errors.retry_after_ms(L("Wed, 22 Jul 2026 10:00:05 GMT"), now), errors.retry_after_ms(L("Wed, 22 Jul 2026 09:00:00 GMT"), now), errors.retry_after_ms(L("soon"), now))
    assert tuple(got) == (120_000, 5_000, 0, None)
    wait = lambda kind, n, after: errors.wait_before_retry_ms(L(kind), L(n), L(after).cast("double"))
    assert tuple(one(spark, wait("busy", 0, None), wait("busy", 1, None), wait("busy", 2, None), wait("timeout", 0, None), wait("rate-limited", 0, 30_000), wait("rate-limited", 0, 30_001))) == (2000, 4000, None, None, 30_000, None)
    assert tuple(one(spark, errors.kind_of_remark(L("runtime error: Query Timed Out")), errors.kind_of_remark(L("x")), errors.kind_of_remark(L("")))) == ("timeout", "malformed-response", None)
    assert one(spark, errors.failure_title(errors.failure_key(L("http-error"), L(503))))[0] == "The map data service is struggling"
    assert errors.ServiceError("http-error", status=500).retryable and not errors.ServiceError("http-error", status=400).retryable
