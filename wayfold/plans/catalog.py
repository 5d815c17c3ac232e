"""Every query by name, with its DuckDB twin.

Each query runs an operator of the library over a relation derived from the whole tables
(derive.py); the twin says the same in plain SQL, by other means where there is a choice
(rings by unnested edges, pairs by a plain distance condition).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import density, errors, geo, ids, present, seasonal, tags
from wayfold.operators import objects, places
from wayfold.operators import sequences as seqs
from wayfold.operators.durable import durable, shared_path
from wayfold.plans import refresh
from wayfold.plans.derive import oracle, relation
from wayfold.sources import dataset, extracts, features, fixes, live, osm_pbf, state, store
from wayfold.streaming import session

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

STOCKHOLM = (59.33, 18.06)
COORD = {"leisure": "leisure", "natural": "nature", "dog": "dog", "name": "name", "fenced": "fenced", "barrier": "barrier", "lit": "lit", "surface": "surface", "dog:conditional": "dog_conditional"}
TAG = tags.of_columns(COORD)
DAY = "2026-07-15"
SQUARE = [(59.0, 17.6), (59.75, 17.6), (59.75, 18.6), (59.0, 18.6)]
HOLE = [(59.4, 18.0), (59.45, 18.05), (59.4, 18.1), (59.35, 18.05)]


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return keep


def hav(a: str, b: str, c: str, d: str) -> str:
    """Metres between (a, b) and (c, d) in SQL."""
    la, lo = f"sin(radians({c} - {a}) / 2)", f"sin(radians({d} - {b}) / 2)"
    return f"(12742000.0 * asin(sqrt({la} * {la} + cos(radians({a})) * cos(radians({c})) * {lo} * {lo})))"


def dist(m: str) -> str:
    """A formatted distance in SQL. Tenths are those of the exact binary value, which printing
    has, but for exact ties: they go up."""
    km, up = f"({m} / 1000)", lambda x: f"CAST(CAST(floor({x} + 0.5) AS BIGINT) AS VARCHAR)"
    tie = f"({km} * 4 = floor({km} * 4) AND CAST(floor({km} * 4) AS BIGINT) % 2 = 1)"
    return f"CASE WHEN {m} < 1000 THEN {up(m)} || ' m' WHEN {km} >= 10 THEN {up(km)} || ' km' ELSE printf('%.1f', CASE WHEN {tie} THEN {km} + 0.01 ELSE {km} END) || ' km' END"


def _rings(rings: list[list[tuple[float, float]]]) -> str:
    """Edges of constant rings as a table ring(ring, lat_a, lon_a, lat_b, lon_b)."""
    rows = [f"({k}, {p[i - 1][0]!r}, {p[i - 1][1]!r}, {p[i][0]!r}, {p[i][1]!r})" for k, p in enumerate(rings) for i in range(len(p))]
    return f"(SELECT ring, CAST(lat_a AS DOUBLE) AS lat_a, CAST(lon_a AS DOUBLE) AS lon_a, CAST(lat_b AS DOUBLE) AS lat_b, CAST(lon_b AS DOUBLE) AS lon_b FROM (VALUES {', '.join(rows)}) AS r(ring, lat_a, lon_a, lat_b, lon_b))"


def _inside(points: str, rings: list[list[tuple[float, float]]]) -> str:
    """query_id, ring of the points inside, by counting crossed edges."""
    return f"""SELECT query_id, ring FROM {points} p, {_rings(rings)} e
  WHERE (lat_b > at_lat) <> (lat_a > at_lat) AND at_lon < lon_b + (at_lat - lat_b) * (lon_a - lon_b) / (lat_a - lat_b)
  GROUP BY query_id, ring HAVING count(*) % 2 = 1"""


def at(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return relation(spark, sf_dir, name)


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation twins in the canonical columns of places."""
    t = at(spark, sf_dir, "twins")
    season = F.when(F.col("season").isNotNull(), F.struct(F.col("season").alias("kind"), F.lit(None).alias("from"), F.lit(None).alias("to")).cast(seasonal.RULE_TYPE))
    return t.select("id", "kind", "name", "lat", "lon", F.struct("leash_required", "fenced", "lit", "surface").alias("tags"), F.lit("designated").alias("provenance"), season.alias("seasonal"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dog parks within 50 km of central Stockholm, nearest first."""
    near = places.within(at(spark, sf_dir, "spots"), *STOCKHOLM, 50_000, "dog_park")
    return near.orderBy("meters", "id").select("id", present.spot_label(F.col("name"), F.col("kind")).alias("label"), F.round("meters", 3).alias("meters"), present.format_distance(F.col("meters")).alias("distance"))


# --- radius, rank, expanding search ------------------------------------------------------


@query("radius_filter", f"SELECT id, kind, round({hav('59.33', '18.06', 'lat', 'lon')}, 3) AS meters FROM {{spots}} WHERE kind = 'dog_park' AND {hav('59.33', '18.06', 'lat', 'lon')} <= 10000")
def radius_filter(spark, d):
    return places.within(at(spark, d, "spots"), *STOCKHOLM, 10_000, "dog_park").select("id", "kind", F.round("meters", 3).alias("meters"))


@query("nearest_ten", f"SELECT id, kind, round(m, 3) AS meters FROM (SELECT id, kind, {hav('59.33', '18.06', 'lat', 'lon')} AS m FROM {{spots}}) ORDER BY m, CASE kind WHEN 'dog_park' THEN 0 ELSE 1 END, id LIMIT 10")
def nearest_ten(spark, d):
    spots = at(spark, d, "spots").withColumn("meters", geo.haversine_m(F.lit(STOCKHOLM[0]), F.lit(STOCKHOLM[1]), F.col("lat"), F.col("lon")))
    layer = F.when(F.col("kind") == "dog_park", 0).otherwise(1)
    return spots.orderBy("meters", layer, "id").limit(10).select("id", "kind", F.round("meters", 3).alias("meters"))


NEAR = f"SELECT p.query_id, s.*, {hav('p.at_lat', 'p.at_lon', 's.lat', 's.lon')} AS m FROM {{points}} p JOIN {{spots}} s ON {hav('p.at_lat', 'p.at_lon', 's.lat', 's.lon')} <= 5000"


@query("nearest_rank", f"SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY m, CASE kind WHEN 'dog_park' THEN 0 ELSE 1 END, id) AS INTEGER) AS rank, round(m, 3) AS meters FROM ({NEAR})")
def nearest_rank(spark, d):
    return places.nearest(at(spark, d, "spots"), at(spark, d, "points"), 5_000, digits=3)


def _collapsed(by: str, rows: str) -> str:
    """CTEs pairs (best target of each node) and kept (rows that stay), by a plain distance condition."""
    same = " AND ".join(f"n.{c} = a.{c}" for c in by.split(", ") if c)
    lead = f"n.{by.replace(', ', ', n.')}, " if by else ""
    part = f"{by}, " if by else ""
    anti = " AND ".join(f"g.{c} = r.{c}" for c in [*(c for c in by.split(", ") if c), "kind"])
    d = hav("n.lat", "n.lon", "a.lat", "a.lon")
    return f"""pairs AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part}kind, node_id ORDER BY gap, area_id) AS best FROM (
    SELECT {lead}n.kind, n.id AS node_id, a.id AS area_id, {d} AS gap
    FROM {rows} n JOIN {rows} a ON {same + ' AND ' if same else ''}n.kind = a.kind AND starts_with(n.id, 'node/') AND NOT starts_with(a.id, 'node/')
      AND abs(n.lat - a.lat) < 0.001 AND {d} <= 50 AND (n.name IS NULL OR a.name IS NULL OR lower(trim(n.name)) = lower(trim(a.name)))
  )) WHERE best = 1
), kept AS (
  SELECT r.* FROM {rows} r WHERE NOT EXISTS (SELECT 1 FROM pairs g WHERE {anti} AND g.node_id = r.id)
)"""


def _expanding(kind: str, enough: int) -> str:
    m = hav("p.at_lat", "p.at_lon", "s.lat", "s.lon")
    return f"""WITH each AS (
  SELECT p.query_id, r.radius_m, s.id, s.kind, s.name, s.lat, s.lon
  FROM {{points}} p JOIN {{twins}} s ON s.kind = '{kind}' AND abs(s.lat - p.at_lat) < 0.25 AND {m} <= 25000
  JOIN (VALUES (3000), (10000), (25000)) AS r(radius_m) ON {m} <= r.radius_m
), {_collapsed('query_id, radius_m', 'each')}, counts AS (
  SELECT query_id, radius_m, count(*) AS n FROM kept GROUP BY query_id, radius_m
), reached AS (
  SELECT query_id, coalesce(min(radius_m) FILTER (WHERE n >= {enough}), 25000) AS radius_m FROM counts GROUP BY query_id
)
SELECT p.query_id, CAST(coalesce(c.radius_m, 25000) AS INTEGER) AS searched_radius_m, coalesce(c.n, 0) AS n
FROM {{points}} p LEFT JOIN reached r ON r.query_id = p.query_id LEFT JOIN counts c ON c.query_id = r.query_id AND c.radius_m = r.radius_m"""


@query("expanding_search_parks", _expanding("dog_park", 5))
def expanding_search_parks(spark, d):
    return places.expanding_counts(twins(spark, d), at(spark, d, "points"), "dog_park")


@query("expanding_search_bathing", _expanding("bathing_spot", 3))
def expanding_search_bathing(spark, d):
    return places.expanding_counts(twins(spark, d), at(spark, d, "points"), "bathing_spot")


@query("expanding_rows", _expanding("dog_park", 5).split("SELECT p.query_id, CAST")[0] + "SELECT k.query_id, k.radius_m AS searched_radius_m, k.id FROM kept k JOIN reached r ON r.query_id = k.query_id AND r.radius_m = k.radius_m")
def expanding_rows(spark, d):
    return places.expanding(twins(spark, d), at(spark, d, "points"), "dog_park").select("query_id", "searched_radius_m", "id")


@query("collapse_pairs", f"WITH {_collapsed('', '{twins}').split(', kept AS')[0]} SELECT kind, node_id, area_id, round(gap, 3) AS meters FROM pairs")
def collapse_pairs(spark, d):
    return places.collapse_pairs(twins(spark, d)).select("kind", "node_id", "area_id", F.round("meters", 3).alias("meters"))


def _first(column: str) -> str:
    return f"(SELECT min_by(t.{column}, g.gap) FROM pairs g JOIN {{twins}} t ON t.id = g.node_id AND t.kind = g.kind WHERE g.kind = k.kind AND g.area_id = k.id AND t.{column} IS NOT NULL)"


@query("collapse_result", f"WITH {_collapsed('', '{twins}')} SELECT id, kind, lat, lon, " + ", ".join(f"coalesce(k.{c}, {_first(c)}) AS {c}" for c in ("name", "leash_required", "fenced", "lit", "surface", "season")) + " FROM kept k")
def collapse_result(spark, d):
    out = places.collapse(twins(spark, d))
    return out.select("id", "kind", "lat", "lon", "name", "tags.leash_required", "tags.fenced", "tags.lit", "tags.surface", F.col("seasonal.kind").alias("season"))


@query("layer_union_dedup", """WITH shifted AS (
  SELECT 'node/' || CAST(CAST(split_part(id, '/', 2) AS BIGINT) % 700 AS VARCHAR) AS id, kind, lat, lon FROM {spots}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE kind WHEN 'dog_park' THEN 0 ELSE 1 END, lat, lon) AS n FROM shifted
) SELECT id, kind, lat, lon FROM ranked WHERE n = 1""")
def layer_union_dedup(spark, d):
    n = F.split_part(F.col("id"), F.lit("/"), F.lit(2)).cast("long") % 700
    rows = at(spark, d, "spots").withColumn("id", F.concat(F.lit("node/"), n.cast("string")))
    return places.union_layers(rows.where("kind = 'dog_park'"), rows.where("kind = 'bathing_spot'")).select("id", "kind", "lat", "lon")


@query("marker_diff", """WITH a AS (SELECT id, lat, lon FROM {spots} WHERE CAST(split_part(id, '/', 2) AS BIGINT) % 3 <> 0),
b AS (SELECT id, CASE WHEN CAST(split_part(id, '/', 2) AS BIGINT) % 4 = 0 THEN lat + 1 ELSE lat END AS lat, lon FROM {spots} WHERE CAST(split_part(id, '/', 2) AS BIGINT) % 5 <> 0)
SELECT b.id, 'create' AS action FROM b WHERE b.id NOT IN (SELECT id FROM a)
UNION ALL SELECT a.id, 'remove' FROM a WHERE a.id NOT IN (SELECT id FROM b)
UNION ALL SELECT a.id, 'move' FROM a JOIN b ON a.id = b.id WHERE a.lat <> b.lat OR a.lon <> b.lon""")
def marker_diff(spark, d):
    rows = at(spark, d, "spots").select("id", "lat", "lon", F.split_part(F.col("id"), F.lit("/"), F.lit(2)).cast("long").alias("n"))
    new = rows.where("n % 5 <> 0").withColumn("lat", F.when(F.col("n") % 4 == 0, F.col("lat") + 1).otherwise(F.col("lat")))
    return places.marker_plan(rows.where("n % 3 <> 0"), new)


@query("viewport_extent", "SELECT kind, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM {spots} GROUP BY kind")
def viewport_extent(spark, d):
    return places.extent(at(spark, d, "spots"), ["kind"])


# --- coverage and density ----------------------------------------------------------------

_X, _Y = "radians({1} - at_lon) * cos(radians(at_lat)) * 6371000.0", "radians({0} - at_lat) * 6371000.0"


def _gaps(points: str, rings: list) -> str:
    """query_id, ring, gap: metres from each point to each ring's boundary."""
    return f"""SELECT query_id, ring, min(sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy))) AS gap FROM (
    SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) END AS t FROM (
      SELECT query_id, ring, ax, ay, bx - ax AS dx, by_ - ay AS dy FROM (
        SELECT query_id, ring, {_X.format('', 'lon_a')} AS ax, {_Y.format('lat_a')} AS ay, {_X.format('', 'lon_b')} AS bx, {_Y.format('lat_b')} AS by_
        FROM {points} p, {_rings(rings)} e))) GROUP BY query_id, ring"""


def coverage(spark: SparkSession) -> DataFrame:
    rows = [("include", 0, [{"lat": a, "lon": o} for a, o in SQUARE]), ("exclude", 0, [{"lat": a, "lon": o} for a, o in HOLE])]
    return spark.createDataFrame(rows, f"role string, ring_no int, points {geo.RING_TYPE}")


@query("coverage_admission", f"""WITH inside AS ({_inside('{points}', [SQUARE, HOLE])}), gaps AS ({_gaps('{points}', [SQUARE, HOLE])})
SELECT p.query_id, ok AS covered, CASE WHEN ok THEN 'local' ELSE 'live' END AS answer_source FROM (
  SELECT p.query_id, EXISTS (SELECT 1 FROM inside i WHERE i.query_id = p.query_id AND ring = 0) AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.query_id = p.query_id AND ring = 1)
    AND (SELECT min(gap) FROM gaps g WHERE g.query_id = p.query_id) >= 3000 AS ok FROM {{points}} p) p""")
def coverage_admission(spark, d):
    return places.admit(at(spark, d, "points"), coverage(spark), 3_000).select("query_id", "covered", "answer_source")


@query("ring_distance", f"SELECT query_id, round(gap, 3) AS meters FROM ({_gaps('{globe}', [HOLE])})")
def ring_distance(spark, d):
    return at(spark, d, "globe").select("query_id", F.round(geo.ring_distance_m(F.col("at_lat"), F.col("at_lon"), geo.ring(HOLE)), 3).alias("meters"))


@query("mapping_density", f"SELECT p.query_id, CASE WHEN i.query_id IS NULL THEN 'sparse' ELSE 'dense' END AS density FROM {{globe}} p LEFT JOIN (SELECT DISTINCT query_id FROM ({_inside('{globe}', list(density.DENSE_REGIONS.values()))})) i ON i.query_id = p.query_id")
def mapping_density(spark, d):
    return at(spark, d, "globe").select("query_id", density.mapping_density("at_lat", "at_lon").alias("density"))


@query("empty_message", f"""SELECT p.query_id, CASE WHEN i.query_id IS NULL THEN 'No dog parks mapped within 25 km' ELSE 'No dog parks within 25 km' END AS title,
  CASE WHEN i.query_id IS NULL THEN '{present.EMPTY_DETAILS["sparse"]}' ELSE '{present.EMPTY_DETAILS["dense"]}' END AS detail
FROM {{globe}} p LEFT JOIN (SELECT DISTINCT query_id FROM ({_inside('{globe}', list(density.DENSE_REGIONS.values()))})) i ON i.query_id = p.query_id""")
def empty_message(spark, d):
    return at(spark, d, "globe").select("query_id", F.explode(F.array(present.empty_message(F.lit(25_000.0), "at_lat", "at_lon"))).alias("m")).select("query_id", "m.*")


# --- tags --------------------------------------------------------------------------------

_LEASH = "CASE dog WHEN 'leashed' THEN true WHEN 'unleashed' THEN false END"
_FENCED = "CASE WHEN fenced = 'yes' THEN true WHEN fenced = 'no' THEN false WHEN barrier = 'fence' THEN true WHEN barrier = 'no' THEN false END"
_LIT = "CASE WHEN lit IS NULL OR lit = '' THEN NULL ELSE lit <> 'no' END"
_GRADE = "CASE WHEN dog = 'designated' THEN 'designated' WHEN dog IN ('yes', 'leashed', 'unleashed') THEN 'permitted' WHEN dog = 'no' THEN NULL ELSE 'name-match' END"
_PARK = "coalesce(leisure = 'dog_park', false)"
_BATH = "(coalesce((leisure IN ('bathing_place', 'swimming_area') OR nature = 'beach') AND dog IN ('yes', 'designated'), false) OR coalesce((leisure IS NOT NULL OR nature IS NOT NULL) AND lower(name) LIKE '%hundbad%', false))"


@query("tag_display", f"SELECT n, {_LEASH} AS leash_required, {_FENCED} AS fenced, {_LIT} AS lit, nullif(surface, '') AS surface FROM {{tagged}}")
def tag_display(spark, d):
    return at(spark, d, "tagged").select("n", F.explode(F.array(tags.display_tags(TAG))).alias("t")).select("n", "t.*")


@query("provenance_grade", f"SELECT n, {_GRADE} AS grade FROM {{tagged}}")
def provenance_grade(spark, d):
    return at(spark, d, "tagged").select("n", tags.provenance(TAG).alias("grade"))


@query("bathing_candidates", f"SELECT n, {_PARK} AS park, {_BATH} AS bathing FROM {{tagged}}")
def bathing_candidates(spark, d):
    return at(spark, d, "tagged").select("n", tags.is_dog_park(TAG).alias("park"), tags.is_bathing_candidate(TAG).alias("bathing"))


@query("preselect_superset", f"SELECT n FROM {{tagged}} WHERE {_PARK} OR dog IS NOT NULL OR coalesce(name LIKE '%undbad%' OR name LIKE '%UNDBAD%', false)")
def preselect_superset(spark, d):
    return at(spark, d, "tagged").where(tags.is_preselected(TAG)).select("n")


_ID = "CASE left(feature, 1) WHEN 'n' THEN 'node/' || substr(feature, 2) WHEN 'w' THEN 'way/' || substr(feature, 2) WHEN 'r' THEN 'relation/' || substr(feature, 2) ELSE CASE WHEN n % 2 = 0 THEN 'way/' ELSE 'relation/' END || CAST(n // 2 AS VARCHAR) END"


@query("area_id_decode", f"SELECT n, {_ID} AS id FROM {{tagged}}")
def area_id_decode(spark, d):
    return at(spark, d, "tagged").select("n", ids.spot_id(F.col("feature")).alias("id"))


@query("convert_flatmap", f"""SELECT {_ID} AS id, 'dog_park' AS kind, nullif(name, '') AS name, 'designated' AS provenance FROM {{tagged}} WHERE {_PARK}
UNION ALL SELECT {_ID}, 'bathing_spot', nullif(name, ''), {_GRADE} FROM {{tagged}} WHERE {_BATH} AND ({_GRADE}) IS NOT NULL""")
def convert_flatmap(spark, d):
    rows = at(spark, d, "tagged").withColumn("id", ids.spot_id(F.col("feature")))
    return places.from_features(rows, TAG).select("id", "kind", "name", "provenance")


_MONTHS = " ".join(f"WHEN '{m[:3].lower()}' THEN {k}" for k, m in enumerate(seasonal.MONTH_NAMES, 1))
_BAN = r"(?i)^\s*no\s*@\s*\(?\s*(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s*(\d{1,2})?\s*-\s*(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s*(\d{1,2})?\s*\)?\s*$"
_PARSED = f"""parsed AS (
  SELECT n, dog_conditional AS v, ban, CASE lower(left(regexp_extract(ban, '{_BAN}', 1), 3)) {_MONTHS} END AS m1, regexp_extract(ban, '{_BAN}', 2) AS d1,
         CASE lower(left(regexp_extract(ban, '{_BAN}', 3), 3)) {_MONTHS} END AS m2, regexp_extract(ban, '{_BAN}', 4) AS d2
  FROM (SELECT n, dog_conditional, list_filter(string_split(dog_conditional, ';'), lambda c: regexp_matches(c, '{_BAN}'))[1] AS ban FROM {{tagged}})
), lengths AS (SELECT [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31] AS len), rules AS (
  SELECT n, v, m1, m2, CASE WHEN d1 = '' THEN 1 ELSE TRY_CAST(d1 AS INTEGER) END AS day1, CASE WHEN d2 = '' THEN len[m2] ELSE TRY_CAST(d2 AS INTEGER) END AS day2, len FROM parsed, lengths
), ruled AS (
  SELECT n, CASE WHEN v IS NULL OR v = '' THEN NULL WHEN m1 IS NOT NULL AND m2 IS NOT NULL AND day1 BETWEEN 1 AND len[m1] AND day2 BETWEEN 1 AND len[m2] THEN 'ban' ELSE 'unparsed' END AS kind, m1, day1, m2, day2 FROM rules
)"""


@query("seasonal_parse", f"""WITH {_PARSED}
SELECT n, kind, CASE WHEN kind = 'ban' THEN CAST(m1 * 100 + day1 AS VARCHAR) END AS from_md, CASE WHEN kind = 'ban' THEN CAST(m2 * 100 + day2 AS VARCHAR) END AS to_md FROM ruled""")
def seasonal_parse(spark, d):
    rows = at(spark, d, "tagged").select("n", seasonal.parse_conditional(F.col("dog_conditional")).alias("r"))
    md = lambda c: (F.col(f"r.{c}.month") * 100 + F.col(f"r.{c}.day")).cast("string").alias(f"{c}_md")
    return rows.select("n", F.col("r.kind").alias("kind"), md("from"), md("to"))


_TODAY = "(month(day) * 100 + dayofmonth(day))"
_HOLDS = f"CASE WHEN m1 * 100 + day1 > m2 * 100 + day2 THEN {_TODAY} >= m1 * 100 + day1 OR {_TODAY} <= m2 * 100 + day2 ELSE {_TODAY} BETWEEN m1 * 100 + day1 AND m2 * 100 + day2 END"


@query("banned_on", f"""WITH {_PARSED}, days AS (SELECT *, DATE '2026-01-01' + CAST(n % 365 AS INTEGER) AS day FROM ruled)
SELECT n, CASE WHEN kind = 'ban' THEN {_HOLDS} WHEN kind = 'unparsed' THEN false END AS banned FROM days""")
def banned_on(spark, d):
    rows = at(spark, d, "tagged").select("n", seasonal.parse_conditional(F.col("dog_conditional")).alias("r"))
    return rows.select("n", seasonal.banned_on(F.col("r"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("n") % 365).cast("int"))).alias("banned"))


def _md(m: str, day: str) -> str:
    return f"CAST({day} AS VARCHAR) || ' ' || ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][{m}]"


@query("seasonal_caption", f"""WITH {_PARSED}, days AS (SELECT *, DATE '{DAY}' AS day FROM ruled), held AS (SELECT *, kind = 'ban' AND ({_HOLDS}) AS now, {_md('m1', 'day1')} || ' – ' || {_md('m2', 'day2')} AS win FROM days)
SELECT n, CASE WHEN kind IS NULL THEN 'Verify signage on site' WHEN kind = 'unparsed' THEN 'Seasonal rules apply — check signs on site' WHEN now THEN 'Dogs banned now (' || win || ')' ELSE 'Dogs banned ' || win END AS text, coalesce(now, false) AS banned_now FROM held""")
def seasonal_caption(spark, d):
    rows = at(spark, d, "tagged").select("n", seasonal.parse_conditional(F.col("dog_conditional")).alias("r"))
    return rows.select("n", seasonal.caption(F.col("r"), F.lit(DAY).cast("date")).alias("c")).select("n", "c.*")


@query("describe_tags", f"""SELECT n, concat_ws(' · ', CASE WHEN {_LEASH} THEN 'Leash required' WHEN NOT ({_LEASH}) THEN 'Off-leash OK' END, CASE WHEN {_FENCED} THEN 'Fenced' WHEN NOT ({_FENCED}) THEN 'Not fenced' END,
  CASE WHEN {_LIT} THEN 'Lit' WHEN NOT ({_LIT}) THEN 'Not lit' END, 'Surface: ' || replace(nullif(surface, ''), '_', ' ')) AS line FROM {{tagged}}""")
def describe_tags(spark, d):
    return at(spark, d, "tagged").select("n", present.describe_tags(tags.display_tags(TAG)).alias("line"))


# --- presentation ------------------------------------------------------------------------


@query("spot_labels", "SELECT id, CASE WHEN trim(coalesce(name, '')) <> '' THEN name WHEN kind = 'dog_park' THEN 'Unnamed dog park' ELSE 'Unnamed bathing spot' END AS label, CASE WHEN kind = 'bathing_spot' THEN 'Dog bathing area' END AS grade FROM {spots}")
def spot_labels(spark, d):
    return at(spark, d, "spots").select("id", present.spot_label(F.col("name"), F.col("kind")).alias("label"), present.provenance_label(F.lit("designated"), F.col("kind")).alias("grade"))


@query("format_distance", f"SELECT session, seq, {dist('at_ms')} AS text FROM {{marks}}")
def format_distance(spark, d):
    return at(spark, d, "marks").select("session", "seq", present.format_distance(F.col("at_ms")).alias("text"))


_AGENTS = ["iPhone OS", "Android 14", "Windows"]


@query("directions_url", """WITH l AS (SELECT seq, CAST(seq AS VARCHAR) || ',' || CAST(session AS VARCHAR) AS dest, CASE WHEN seq % 2 = 0 THEN '59,18' END AS o, seq % 3 AS a FROM {fixes})
SELECT seq, CASE a WHEN 0 THEN 'https://maps.apple.com/?daddr=' || dest || coalesce('&saddr=' || o, '') WHEN 1 THEN CASE WHEN o IS NULL THEN 'geo:' || dest || '?q=' || dest ELSE 'https://www.google.com/maps/dir/?api=1&destination=' || dest || '&origin=' || o END
  ELSE 'https://www.google.com/maps/dir/?api=1&destination=' || dest || coalesce('&origin=' || o, '') END AS url FROM l""")
def directions_url(spark, d):
    to = present.pair(F.col("seq"), F.col("session"))
    agent = F.get(F.array(*map(F.lit, _AGENTS)), (F.col("seq") % 3).cast("int"))
    return at(spark, d, "fixes").select("seq", present.directions_url(to, F.when(F.col("seq") % 2 == 0, "59,18"), agent).alias("url"))


def _cell(x: str) -> str:
    n = f"CAST(floor({x} * 1000 + 0.5) AS BIGINT)"
    return f"CASE WHEN {n} < 0 THEN '-' ELSE '' END || CAST(abs({n}) // 1000 AS VARCHAR) || '.' || lpad(CAST(abs({n}) % 1000 AS VARCHAR), 3, '0')"


@query("cache_key", f"SELECT query_id, 'dog-parks-v1-' || {_cell('at_lat')} || ',' || {_cell('at_lon')} || ',3000' AS key FROM {{globe}}")
def cache_key(spark, d):
    return at(spark, d, "globe").select("query_id", present.cache_key(F.lit("dog_park"), F.col("at_lat"), F.col("at_lon"), F.lit(3000.4)).alias("key"))


@query("cache_ttl", "SELECT event_id FROM {events} WHERE epoch_ms(TIMESTAMP '2024-01-20 00:00:00') - epoch_ms(ts) >= 0 AND epoch_ms(TIMESTAMP '2024-01-20 00:00:00') - epoch_ms(ts) < 604800000")
def cache_ttl(spark, d):
    entries = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("stored_at"))
    return seqs.fresh(entries, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")


@query("layer_note", f"""WITH near AS (SELECT p.query_id, count(s.id) AS n, min({hav('p.at_lat', 'p.at_lon', 's.lat', 's.lon')}) AS m FROM {{points}} p LEFT JOIN {{spots}} s ON s.kind = 'bathing_spot' AND {hav('p.at_lat', 'p.at_lon', 's.lat', 's.lon')} <= 5000 GROUP BY p.query_id)
SELECT query_id, CASE WHEN n = 0 THEN 'No bathing spots within 5.0 km.' ELSE CASE WHEN n = 1 THEN '1 bathing spot' ELSE CAST(n AS VARCHAR) || ' bathing spots' END || CASE WHEN m < 1000 THEN '' ELSE ', nearest ' || {dist('m')} END || '.' END AS text, n = 0 OR m > 3000 AS invite FROM near""")
def layer_note(spark, d):
    points = at(spark, d, "points")
    near = places.near_points(at(spark, d, "spots").where("kind = 'bathing_spot'"), points, 5_000).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("meters").alias("m"))
    got = points.select("query_id").join(near, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    note = present.layer_note(F.lit("ready"), F.col("n"), F.col("m"), F.lit(5000.0), F.lit(False))
    return got.select("query_id", note.alias("t")).select("query_id", "t.text", "t.invite")


# --- versioned objects -------------------------------------------------------------------


@query("newest_version_wins", "SELECT type, id, version, payload FROM (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY version DESC, seq DESC, payload DESC) AS n FROM {objects}) WHERE n = 1")
def newest_version_wins(spark, d):
    rows = at(spark, d, "objects").withColumn("ts", F.timestamp_seconds("seq"))
    # any number of snapshots: three, by the change number
    return objects.newest(*(rows.where(F.col("seq") % 3 == k) for k in range(3))).select("type", "id", "version", "payload")


@query("diff_replay", """WITH state AS (SELECT type, id, version, payload, CAST(0 AS BIGINT) AS seq, 'keep' AS op FROM {objects} WHERE seq % 3 = 0),
base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY version DESC, payload DESC) AS n FROM state) WHERE n = 1),
every AS (SELECT type, id, version, payload, seq, op FROM base UNION ALL SELECT type, id, version, payload, seq, op FROM {objects} WHERE seq % 3 <> 0),
last AS (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY seq DESC, version DESC, payload DESC) AS n FROM every)
SELECT type, id, version, payload FROM last WHERE n = 1 AND op <> 'delete'""")
def diff_replay(spark, d):
    rows = at(spark, d, "objects")
    state = objects._pick(rows.where("seq % 3 = 0").select("type", "id", "version", "payload"), ["type", "id"], ["version", "payload"])
    return objects.replay(state, rows.where("seq % 3 <> 0"), 0).select("type", "id", "version", "payload")


def way_objects(spark: SparkSession, d: str) -> DataFrame:
    """Ways of line items over the nodes of parts, as objects."""
    none = lambda t: F.lit(None).cast(t)
    ways = at(spark, d, "way_nodes").groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]).alias("refs"))
    ways = ways.select(F.lit("way").alias("type"), F.col("way").alias("id"), none("double").alias("lat"), none("double").alias("lon"), "refs", none("array<struct<type:string,ref:bigint,role:string>>").alias("members"), F.map_from_arrays(F.array(F.lit("leisure")), F.array(F.when(F.col("way") % 4 == 0, "dog_park").otherwise("park"))).alias("tags"))
    nodes = at(spark, d, "nodes").select(F.lit("node").alias("type"), F.col("node").alias("id"), "lat", "lon", none("array<bigint>").alias("refs"), none("array<struct<type:string,ref:bigint,role:string>>").alias("members"), none("map<string,string>").alias("tags"))
    return ways.unionByName(nodes)


@query("check_refs", "SELECT DISTINCT 'node' AS child_type, node AS child_id, 'way' AS parent_type, way AS parent_id FROM {way_nodes} WHERE node NOT IN (SELECT node FROM {nodes})")
def check_refs(spark, d):
    return objects.missing_references(way_objects(spark, d))


@query("missing_counts", "SELECT count(*) AS missing, count(DISTINCT way) AS parents FROM (SELECT DISTINCT node, way FROM {way_nodes} WHERE node NOT IN (SELECT node FROM {nodes}))")
def missing_counts(spark, d):
    gone = objects.missing_references(way_objects(spark, d))
    return gone.agg(F.count(F.lit(1)).alias("missing"), F.count_distinct("parent_type", "parent_id").alias("parents"))


@query("closure_semi", "SELECT 'way' AS type, way AS id FROM (SELECT DISTINCT way FROM {way_nodes}) WHERE way % 4 = 0 UNION ALL SELECT 'node', node FROM {nodes} WHERE node IN (SELECT node FROM {way_nodes} WHERE way % 4 = 0)")
def closure_semi(spark, d):
    return objects.closure(way_objects(spark, d), tags.is_dog_park(tags.of_map("tags"))).select("type", "id")


@query("geometry_assembly", "SELECT 'way' AS type, way AS id, round((min(lat) + max(lat)) / 2, 7) AS lat, round((min(lon) + max(lon)) / 2, 7) AS lon FROM {way_nodes} w LEFT JOIN {nodes} p ON p.node = w.node WHERE way % 4 = 0 GROUP BY way HAVING count(*) = count(lat)")
def geometry_assembly(spark, d):
    return objects.assemble(way_objects(spark, d), tags.is_dog_park(tags.of_map("tags"))).select("type", "id", "lat", "lon")


@query("bbox_center", "SELECT way, round((min(lat) + max(lat)) / 2, 7) AS lat, round((min(lon) + max(lon)) / 2, 7) AS lon FROM {way_nodes} w LEFT JOIN {nodes} p ON p.node = w.node GROUP BY way HAVING count(*) = count(lat)")
def bbox_center(spark, d):
    """The middle of every way whose nodes are all there."""
    out = objects.assemble(way_objects(spark, d), F.col("type") == "way")
    return out.select(F.col("id").alias("way"), "lat", "lon")


def nested_objects(spark: SparkSession, d: str) -> DataFrame:
    """The ways and nodes, with relations of three levels above them: customers hold their
    orders' ways, nations their customers, regions their nations; every ninth nation holds
    its region too, so relations refer to each other in circles."""
    none = lambda t: F.lit(None).cast(t)
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    member = lambda kind, ref: F.struct(F.lit(kind).alias("type"), ref.cast("long").alias("ref"), F.lit("").alias("role")).alias("m")
    nation, region = F.col("n_nationkey") + 1_000_000_000, F.col("n_regionkey") + 2_000_000_000
    ways = spark.sql("SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS o_orderkey FROM {lineitem}", lineitem=read("lineitem"))
    held = read("orders").join(ways, "o_orderkey").select(F.col("o_custkey").cast("long").alias("id"), member("way", F.col("o_orderkey")))
    held = held.unionByName(read("customer").select((F.col("c_nationkey") + 1_000_000_000).cast("long").alias("id"), member("relation", F.col("c_custkey"))))
    held = held.unionByName(read("nation").select(region.cast("long").alias("id"), member("relation", nation)))
    held = held.unionByName(read("nation").where("n_nationkey % 9 = 0").select(nation.cast("long").alias("id"), member("relation", region)))
    relations = held.groupBy("id").agg(F.array_sort(F.collect_list("m")).alias("members"))
    park = F.when((F.col("id") >= 2_000_000_000) & (F.col("id") % 2 == 0), "dog_park").otherwise("garden")
    relations = relations.select(F.lit("relation").alias("type"), "id", none("double").alias("lat"), none("double").alias("lon"), none("array<bigint>").alias("refs"), "members", F.map_from_arrays(F.array(F.lit("leisure")), F.array(park)).alias("tags"))
    plain = way_objects(spark, d).withColumn("tags", none("map<string,string>"))
    return plain.unionByName(relations.select(*plain.columns))


@query("closure_nested", """WITH w AS (SELECT DISTINCT way FROM {way_nodes}), r AS (SELECT n_regionkey AS k FROM {nation} WHERE n_regionkey % 2 = 0 GROUP BY 1),
back AS (SELECT DISTINCT n_nationkey, n_regionkey FROM {nation} WHERE n_regionkey IN (SELECT k FROM r)),
c AS (SELECT DISTINCT CAST(c_custkey AS BIGINT) AS id FROM {customer} WHERE c_nationkey IN (SELECT n_nationkey FROM back)),
held AS (SELECT DISTINCT CAST(o_orderkey AS BIGINT) AS way, CAST(o_custkey AS BIGINT) AS id FROM {orders} WHERE o_orderkey IN (SELECT way FROM w)),
taken AS (SELECT DISTINCT way FROM held WHERE id IN (SELECT id FROM c))
SELECT 'relation' AS type, CAST(k + 2000000000 AS BIGINT) AS id FROM r UNION ALL SELECT 'relation', CAST(n_nationkey + 1000000000 AS BIGINT) FROM back WHERE n_nationkey IN (SELECT c_nationkey FROM {customer}) OR n_nationkey % 9 = 0
UNION ALL SELECT 'relation', id FROM c WHERE id IN (SELECT id FROM held) UNION ALL SELECT 'way', way FROM taken
UNION ALL SELECT 'node', node FROM {nodes} WHERE node IN (SELECT node FROM {way_nodes} WHERE way IN (SELECT way FROM taken))""")
def closure_nested(spark, d):
    return objects.closure(nested_objects(spark, d), tags.is_dog_park(tags.of_map("tags"))).select("type", "id")


@query("relation_assembly", """WITH ways AS (SELECT way, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM {way_nodes} w LEFT JOIN {nodes} p ON p.node = w.node GROUP BY way HAVING count(*) = count(lat)),
held AS (SELECT CAST(o_orderkey AS BIGINT) AS way, CAST(o_custkey AS BIGINT) AS id FROM {orders} WHERE o_orderkey IN (SELECT way FROM {way_nodes}))
SELECT id, round((min(a) + max(b)) / 2, 7) AS lat, round((min(c) + max(d)) / 2, 7) AS lon FROM held h LEFT JOIN ways w ON w.way = h.way GROUP BY id HAVING count(*) = count(a)""")
def relation_assembly(spark, d):
    """The middle of every customer's ways, where all of them are whole."""
    rows = nested_objects(spark, d)
    return objects.assemble(rows, (F.col("type") == "relation") & (F.col("id") < 1_000_000_000)).select("id", "lat", "lon")


@query("binary_extract", """WITH held AS (SELECT CAST(o_custkey AS BIGINT) AS id, 'way' AS kind, CAST(o_orderkey AS BIGINT) AS ref FROM {orders} WHERE o_orderkey IN (SELECT way FROM {way_nodes})
  UNION ALL SELECT CAST(c_nationkey + 1000000000 AS BIGINT), 'relation', CAST(c_custkey AS BIGINT) FROM {customer}
  UNION ALL SELECT CAST(n_regionkey + 2000000000 AS BIGINT), 'relation', CAST(n_nationkey + 1000000000 AS BIGINT) FROM {nation}
  UNION ALL SELECT CAST(n_nationkey + 1000000000 AS BIGINT), 'relation', CAST(n_regionkey + 2000000000 AS BIGINT) FROM {nation} WHERE n_nationkey % 9 = 0),
every AS (SELECT 'node' AS type, node AS id, lat, lon, NULL AS refs, NULL AS members, NULL AS leisure FROM {nodes}
  UNION ALL SELECT 'way', way, NULL, NULL, string_agg(CAST(node AS VARCHAR), ',' ORDER BY w.at, node), NULL, NULL FROM {way_nodes} w GROUP BY way
  UNION ALL SELECT 'relation', id, NULL, NULL, NULL, string_agg(kind || '/' || CAST(ref AS VARCHAR), ',' ORDER BY kind, ref), CASE WHEN id >= 2000000000 AND id % 2 = 0 THEN 'dog_park' ELSE 'garden' END FROM held GROUP BY id)
SELECT type, id, CASE WHEN id % 5 <> 0 THEN CAST(id % 7 + 1 AS INTEGER) END AS version, CASE WHEN id % 3 <> 0 THEN 1700000000 + id % 1000000 END AS stamp, lat, lon, refs, members, leisure FROM every""")
def binary_extract(spark, d):
    """Objects written as a binary extract and read again."""
    path, i = shared_path(spark, "extract"), F.col("id")
    rows = nested_objects(spark, d).withColumns({"version": F.when(i % 5 != 0, i % 7 + 1).cast("int"), "ts": F.when(i % 3 != 0, F.timestamp_seconds(i % 1_000_000 + 1_700_000_000))})
    osm_pbf.write_objects(rows, path)
    named = F.transform("members", lambda m: F.concat_ws("/", m["type"], m["ref"].cast("string")))
    listed = lambda c: F.when(c.isNotNull(), F.array_join(c, ","))
    return extracts.read(spark, path).select("type", "id", "version", F.unix_seconds("ts").alias("stamp"), "lat", "lon", listed(F.col("refs").cast("array<string>")).alias("refs"), listed(named).alias("members"), F.try_element_at("tags", F.lit("leisure")).alias("leisure"))


_NEAR_STHLM = hav("59.3293", "18.0686", "lat", "lon")


@query("publish_gate_counts", f"""WITH c AS (SELECT count(*) AS a, count(*) FILTER (WHERE kind = 'dog_park') AS p, count(*) FILTER (WHERE kind = 'dog_park' AND {_NEAR_STHLM} <= 3000) AS s, count(*) FILTER (WHERE kind = 'bathing_spot') AS b FROM {{spots}})
SELECT g.no, g.gate, n, g.least, n >= g.least AS passed FROM (
  SELECT 0 AS no, 'any' AS gate, a AS n, CAST(1 AS BIGINT) AS least FROM c UNION ALL SELECT 1, 'dog parks', p, 200 FROM c UNION ALL SELECT 2, 'dog parks near Stockholm', s, 20 FROM c UNION ALL SELECT 3, 'bathing spots', b, 5 FROM c) g""")
def publish_gate_counts(spark, d):
    return seqs.gate_counts(at(spark, d, "spots"), "europe/sweden")


@query("kind_counts", "SELECT kind, count(*) AS n FROM {spots} GROUP BY kind")
def kind_counts(spark, d):
    return seqs.kind_counts(at(spark, d, "spots"))


@query("safety_timestamp", "SELECT min(o_orderdate) - INTERVAL 24 HOURS AS safety_ts FROM {orders}")
def safety_timestamp(spark, d):
    return objects.safety_timestamp(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").alias("ts")))


@query("asof_sequence", "SELECT max_by(o_orderkey, (o_orderdate, o_orderkey)) AS seq FROM {orders} WHERE o_orderdate <= TIMESTAMP '1996-03-01 12:00:00'")
def asof_sequence(spark, d):
    history = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").cast("long").alias("seq"))
    return objects.sequence_as_of(history, F.lit("1996-03-01 12:00:00").cast(history.schema["ts"].dataType))


@query("diff_plan", """WITH s AS (SELECT CAST(c_custkey AS BIGINT) AS region, CAST(c_custkey * 3 AS BIGINT) AS stored, CAST(c_custkey * 3 + c_nationkey * 2 - 3 AS BIGINT) AS current FROM {customer})
SELECT region, CAST(unnest(range(stored + 1, current + 1)) AS BIGINT) AS seq, NULL AS refused FROM s WHERE current - stored BETWEEN 1 AND 40
UNION ALL SELECT region, NULL, CASE WHEN current < stored THEN 'behind' ELSE 'seed anew' END FROM s WHERE current < stored OR current - stored > 40""")
def diff_plan(spark, d):
    """The change files that the state of each customer (as a region) needs."""
    key = F.col("c_custkey").cast("long")
    states = spark.read.parquet(f"{d}/customer.parquet").select(key.alias("region"), (key * 3).alias("stored"), (key * 3 + F.col("c_nationkey") * 2 - 3).alias("current"))
    return objects.diff_plans(states).select("region", "seq", "refused")


def _numbered(n: Column) -> Column:
    """A change number made of n: the first nine digits of n * 977, as the twins have it, since
    replication has no more and the operator refuses what is beyond."""
    return F.substring((n * 977).cast("string"), 1, 9).cast("long")


@query("sequence_path", "SELECT n, CASE n % 2 WHEN 0 THEN '' ELSE '' END || substr(lpad(CAST(n * 977 AS VARCHAR), 9, '0'), 1, 3) || '/' || substr(lpad(CAST(n * 977 AS VARCHAR), 9, '0'), 4, 3) || '/' || substr(lpad(CAST(n * 977 AS VARCHAR), 9, '0'), 7, 3) AS path FROM {tagged}")
def sequence_path(spark, d):
    return at(spark, d, "tagged").select("n", ids.sequence_path(_numbered(F.col("n"))).alias("path"))


# --- sequences and policies --------------------------------------------------------------


@query("first_mark", "SELECT session, milestone, at_ms, detail FROM (SELECT *, row_number() OVER (PARTITION BY session, milestone ORDER BY at_ms, seq) AS n FROM {marks}) WHERE n = 1")
def first_mark(spark, d):
    return seqs.first_marks(at(spark, d, "marks"))


@query("timeline_deltas", """WITH f AS (SELECT session, milestone, at_ms, detail FROM (SELECT *, row_number() OVER (PARTITION BY session, milestone ORDER BY at_ms, seq) AS n FROM {marks}) WHERE n = 1),
t AS (SELECT *, at_ms - coalesce(lag(at_ms) OVER (PARTITION BY session ORDER BY at_ms, milestone), 0) AS delta_ms FROM f)
SELECT session, milestone, delta_ms, milestone || chr(9) || CAST(CAST(floor(at_ms + 0.5) AS BIGINT) AS VARCHAR) || 'ms' || chr(9) || '(+' || CAST(CAST(floor(delta_ms + 0.5) AS BIGINT) AS VARCHAR) || 'ms)' || coalesce(chr(9) || detail, '') AS line FROM t""")
def timeline_deltas(spark, d):
    return seqs.step_deltas(seqs.first_marks(at(spark, d, "marks"))).select("session", "milestone", "delta_ms", "line")


@query("movement_requery", f"""SELECT session, seq, round(m, 3) AS moved_m, coalesce(m >= 250, true) AS asks FROM (SELECT session, seq, {hav('la', 'lo', 'lat', 'lon')} AS m FROM (
  SELECT *, lag(lat) OVER (PARTITION BY session ORDER BY seq) AS la, lag(lon) OVER (PARTITION BY session ORDER BY seq) AS lo FROM {{fixes}}))""")
def movement_requery(spark, d):
    out = seqs.moves(at(spark, d, "fixes"), order=("seq",))
    return out.select("session", "seq", F.round("moved_m", 3).alias("moved_m"), "asks")


@query("latest_token", "SELECT session, layer, token, seq FROM (SELECT *, max(token) OVER (PARTITION BY session, layer) AS newest FROM {answers}) WHERE token = newest")
def latest_token(spark, d):
    return seqs.latest_answers(at(spark, d, "answers")).select("session", "layer", "token", "seq")


@query("rate_gate", """SELECT session, seq, max(at_ms - n * 1000) OVER (PARTITION BY session ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING) + n * 1000 AS go_at_ms
FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY at_ms, seq) AS n FROM {marks})""")
def rate_gate(spark, d):
    return seqs.rate_gate(at(spark, d, "marks"), "session").select("session", "seq", "go_at_ms")


_KIND = "CASE seq % 4 WHEN 0 THEN 'rate-limited' WHEN 1 THEN 'busy' WHEN 2 THEN 'http-error' ELSE 'timeout' END"


@query("retry_wait", f"""SELECT seq, CASE WHEN {_KIND} IN ('rate-limited', 'busy') AND seq % 3 < 2 AND w <= 30000 THEN w END AS wait_ms FROM (
  SELECT seq, coalesce(CASE WHEN seq % 5 = 0 THEN CAST(seq % 50 AS DOUBLE) * 1000 END, 2000.0 * pow(2, seq % 3)) AS w FROM {{fixes}})""")
def retry_wait(spark, d):
    seq = F.col("seq")
    kind = F.get(F.array(*map(F.lit, ("rate-limited", "busy", "http-error", "timeout"))), (seq % 4).cast("int"))
    header = F.when(seq % 5 == 0, (seq % 50).cast("string"))
    after = errors.retry_after_ms(header, F.lit("2026-01-01").cast("timestamp"))
    return at(spark, d, "fixes").select("seq", errors.wait_before_retry_ms(kind, seq % 3, after).alias("wait_ms"))


_STATUS = "[200, 400, 404, 429, 500, 503, 504][seq % 7 + 1]"


@query("error_map", f"""SELECT seq, k AS kind, k IS NOT NULL AND (k IN ('rate-limited', 'busy') OR s >= 500) AS retryable, CASE WHEN k <> 'http-error' THEN k WHEN s >= 500 THEN 'server-error' WHEN k IS NOT NULL THEN 'request-error' END AS message, s IN (404, 410) AS gone
FROM (SELECT seq, s, CASE WHEN s = 200 THEN NULL WHEN s = 429 THEN 'rate-limited' WHEN s = 504 THEN 'busy' ELSE 'http-error' END AS k FROM (SELECT seq, {_STATUS} AS s FROM {{fixes}}))""")
def error_map(spark, d):
    status = F.get(F.array(*map(F.lit, (200, 400, 404, 429, 500, 503, 504))), (F.col("seq") % 7).cast("int"))
    rows = at(spark, d, "fixes").select("seq", status.alias("s")).withColumn("kind", errors.kind_of_status(F.col("s")))
    key = F.when(F.col("kind").isNotNull(), errors.failure_key(F.col("kind"), F.col("s")))
    return rows.select("seq", "kind", F.coalesce(errors.retryable(F.col("kind"), F.col("s")), F.lit(False)).alias("retryable"), key.alias("message"), errors.is_gone(F.col("s")).alias("gone"))


@query("geocode_limit", "SELECT p_name AS label, CAST(p_partkey AS DOUBLE) / 100 AS lat, CAST(p_size AS DOUBLE) AS lon FROM {part} WHERE p_size % 3 <> 0 AND p_name ILIKE '%a%' ORDER BY p_retailprice DESC, p_name, lat, lon LIMIT 5")
def geocode_limit(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    rows = part.select(F.col("p_name").alias("label"), F.col("p_retailprice").alias("importance"), (F.col("p_partkey") / 100).cast("string").alias("lat"), F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_size").cast("string")).alias("lon"))
    return seqs.geocode(rows, "a")


# --- repair, sessions, whole conversion ---------------------------------------------------


@query("repair_loop", """WITH w AS (SELECT DISTINCT way FROM {way_nodes}), broken AS (SELECT DISTINCT way FROM {way_nodes} WHERE node NOT IN (SELECT node FROM {nodes})),
fetched AS (SELECT way FROM broken WHERE way % 5 <> 0), brought AS (SELECT DISTINCT node FROM {way_nodes} WHERE way IN (SELECT way FROM fetched) AND node % 34 <> 0),
report AS (SELECT 1 AS passes, (SELECT count(*) FROM fetched) AS fetched, (SELECT count(*) FROM broken) - (SELECT count(*) FROM fetched) AS gone)
SELECT 'way' AS type, way AS id, CASE WHEN way IN (SELECT way FROM fetched) THEN 2 ELSE 1 END AS version, passes, fetched, gone FROM w, report
UNION ALL SELECT 'node', node, CASE WHEN node IN (SELECT node FROM brought) THEN 2 ELSE 1 END, passes, fetched, gone FROM (SELECT node FROM {nodes} UNION SELECT node FROM brought) n, report""")
def repair_loop(spark, d):
    """Ways with missing nodes, repaired in up to two passes. The source lacks every fifth way
    (gone) and some nodes, whose ways stay incomplete but aren't asked for again."""
    none = lambda t: F.lit(None).cast(t)
    state = durable(way_objects(spark, d).withColumns({"version": F.lit(1), "ts": none("timestamp")}).select("type", "id", "version", "ts", "lat", "lon", "refs", "members", "tags"), "state")
    part = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 34 <> 0").select(F.lit("node").alias("type"), F.col("p_partkey").cast("long").alias("id"), F.lit(2).alias("version"), none("timestamp").alias("ts"), F.lit(59.0).alias("lat"), F.lit(18.0).alias("lon"), none("array<bigint>").alias("refs"), none("array<struct<type:string,ref:bigint,role:string>>").alias("members"), none("map<string,string>").alias("tags"))
    source = state.where("type = 'way' AND id % 5 <> 0").withColumn("version", F.lit(2)).unionByName(part)
    # the budget of a daily run is far below what line items leave to repair
    fixed, report = objects.repair(state, source, F.lit(True), budget=1_000_000_000, cut=durable)
    return fixed.select("type", "id", "version", *(F.lit(report[k]).cast("int" if k == "passes" else "long").alias(k) for k in ("passes", "fetched", "gone")))


@query("repair_budget", """WITH broken AS (SELECT count(DISTINCT way) AS n FROM {way_nodes} WHERE node NOT IN (SELECT node FROM {nodes}))
SELECT CAST(b AS BIGINT) AS budget, n > b AS stopped, CASE WHEN n <= b THEN n END AS gone FROM broken, (SELECT unnest([0, 300]) AS b UNION ALL SELECT n - 1 FROM broken UNION ALL SELECT n FROM broken)""")
def repair_budget(spark, d):
    """A run stops before it asks for anything where more objects than its budget are
    incomplete: budgets of none, of a daily run, of one too few, and of just enough."""
    none = lambda t: F.lit(None).cast(t)
    state = durable(way_objects(spark, d).withColumns({"version": F.lit(1), "ts": none("timestamp")}).select("type", "id", "version", "ts", "lat", "lon", "refs", "members", "tags"), "state")
    broken = durable(objects.incomplete_parents(objects.missing_references(state)), "broken")
    n = broken.count()
    rows = []
    for budget in (0, objects.MAX_REPAIRS, n - 1, n):
        try:
            _, report = objects.repair(state, state.limit(0), F.lit(True), budget=budget, cut=durable, broken=broken)
            rows.append((budget, False, report["gone"]))
        except ValueError:
            rows.append((budget, True, None))
    return spark.createDataFrame(rows, "budget long, stopped boolean, gone long")


def session_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of users as events of sessions: fixes, answers, toggles and choices."""
    f = at(spark, d, "fixes")
    kinds = ["location-requested", "position-fixed", "search-succeeded", "bathing-toggled", "bathing-search-succeeded", "spot-selected", "position-fixed", "search-failed", "retry-requested", "directions-requested"]
    n = F.row_number().over(Window.partitionBy("session").orderBy("seq"))
    kind = F.get(F.array(*map(F.lit, kinds)), ((n - 1) % len(kinds)).cast("int"))
    payload = F.to_json(F.struct("lat", "lon", F.concat(F.lit("node/"), F.col("seq") % 3).alias("id"), F.array(F.struct(F.lit("node/1").alias("id"), "lat", "lon")).alias("spots"), F.lit(3000).alias("radius")))
    return f.select(F.col("session").cast("string").alias("session"), "seq", kind.alias("kind"), payload.alias("payload"))


_SAID = "'node/1'"


@query("session_machine", f"""WITH RECURSIVE e AS (
  SELECT CAST(session AS VARCHAR) AS session, seq, lat, lon, n, (n - 1) % 10 AS k, 'node/' || CAST(seq % 3 AS VARCHAR) AS id FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS n FROM {{fixes}})
), m AS (
  SELECT session, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, 'welcome' AS phase, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, CAST(NULL AS VARCHAR) AS source, 'off' AS bathing, CAST(NULL AS VARCHAR) AS selected, 0 AS n_spots, 0 AS n_bathing, '' AS effects
  FROM (SELECT DISTINCT session FROM e)
  UNION ALL SELECT session, n, seq, phase, lat, lon, source, bathing, CASE WHEN n_spots + n_bathing > 0 THEN chosen END, n_spots, n_bathing, '[' || effects || ']' FROM (
    SELECT session, n, seq, lat, lon, CASE WHEN fix THEN 'gps' ELSE source END AS source,
      CASE WHEN k = 0 AND phase = 'welcome' THEN 'locating' WHEN first OR ask THEN 'searching' WHEN k = 2 AND phase = 'searching' THEN 'ready' WHEN k = 7 AND phase = 'searching' THEN 'failed' ELSE phase END AS phase,
      CASE WHEN ask AND bathing <> 'off' THEN 'loading' WHEN k = 3 AND bathing <> 'off' THEN 'off' WHEN k = 3 AND placed THEN 'loading' WHEN k = 4 AND bathing = 'loading' THEN 'ready' ELSE bathing END AS bathing,
      CASE WHEN k <> 5 THEN selected WHEN id = {_SAID} THEN id END AS chosen,
      CASE WHEN first THEN 0 WHEN k = 2 AND phase = 'searching' THEN 1 ELSE n_spots END AS n_spots,
      CASE WHEN k = 3 AND (bathing <> 'off' OR placed) THEN 0 WHEN k = 4 AND bathing = 'loading' THEN 1 ELSE n_bathing END AS n_bathing,
      CASE WHEN k = 0 AND phase = 'welcome' THEN '{{{{"kind":"watch-location"}}}}'
        WHEN first OR ask AND bathing = 'off' THEN '{{{{"kind":"search","at":' || p || '}}}}' WHEN ask THEN '{{{{"kind":"search","at":' || p || '}}}},{{{{"kind":"search-bathing","at":' || p || '}}}}'
        WHEN k = 2 AND phase = 'searching' THEN '{{{{"kind":"frame-results","ids":["node/1"],"at":' || p || '}}}}' WHEN k = 3 AND bathing = 'off' AND placed THEN '{{{{"kind":"search-bathing","at":' || p || '}}}}'
        WHEN k = 5 AND id = {_SAID} AND n_spots + n_bathing > 0 THEN '{{{{"kind":"frame-spot","id":"node/1","at":' || p || '}}}}' WHEN k = 9 AND id = {_SAID} AND n_spots + n_bathing > 0 THEN '{{{{"kind":"open-directions","id":"node/1","origin":null}}}}' ELSE '' END AS effects
    FROM (SELECT *, '[' || CAST(lat AS VARCHAR) || ',' || CAST(lon AS VARCHAR) || ']' AS p, fix AND NOT placed AS first, placed AND (k = 8 OR fix AND gap >= 250) AS ask FROM (
      SELECT e.session, e.n, e.seq, e.k, e.id, e.k IN (1, 6) AS fix, m.lat IS NOT NULL AS placed, {hav('m.lat', 'm.lon', 'e.lat', 'e.lon')} AS gap,
        CASE WHEN e.k IN (1, 6) THEN e.lat ELSE m.lat END AS lat, CASE WHEN e.k IN (1, 6) THEN e.lon ELSE m.lon END AS lon, m.phase, m.source, m.bathing, m.selected, m.n_spots, m.n_bathing
      FROM m JOIN e ON e.session = m.session AND e.n = m.n + 1))))
SELECT session, seq, phase, lat, lon, source, false AS picker, bathing, selected, n_spots, n_bathing, effects FROM m WHERE n > 0""".replace("{{", "{").replace("}}", "}"))
def session_machine(spark, d):
    return session.run_batch(session_events(spark, d))


_SHAPE = "n % 9"  # which of the nine forms below


@query("geojson_depth", f"""WITH made AS (
  SELECT {_ID} AS id, 'dog_park' AS kind, lat, lon, 'designated' AS provenance FROM {{tagged}} WHERE {_PARK} AND {_SHAPE} <> 8
  UNION ALL SELECT {_ID}, 'bathing_spot', lat, lon, {_GRADE} FROM {{tagged}} WHERE coalesce(leisure IN ('bathing_place', 'swimming_area') AND dog IN ('yes', 'designated'), false) AND {_SHAPE} <> 8
) SELECT id, kind, round(lat, 7) AS lat, round(lon, 7) AS lon, provenance FROM (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY lat, lon, provenance) AS one FROM made) WHERE one = 1""")
def geojson_depth(spark, d):
    """Features of every nesting built from parts, read as GeoJSON and converted: positions
    up to six lists deep, collections up to five deep, and some with an unreadable member."""
    t = at(spark, d, "tagged")
    p = F.concat(F.lit("["), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]"))
    line = F.concat(F.lit("["), p, F.lit(","), p, F.lit("]"))
    shape = lambda kind, c: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), c, F.lit("}"))
    deep = lambda c, k: F.concat(F.lit("[" * k), c, F.lit("]" * k))

    def collection(k: int, *members) -> Column:
        inside = F.concat_ws(",", *members)
        for _ in range(k):
            inside = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), inside, F.lit("]}"))
        return inside

    point = shape("Point", p)
    forms = [point, shape("LineString", line), shape("Polygon", deep(line, 1)), shape("MultiPolygon", deep(line, 2)), shape("Deep", deep(line, 5)), collection(1, point, shape("LineString", line)), collection(3, point, point), collection(5, shape("Deep", deep(line, 4))), collection(2, point, shape("Point", F.lit('["x",1]')))]
    geometry = forms[-1]
    for k, form in enumerate(forms[:-1]):
        geometry = F.when(F.col("n") % len(forms) == k, form).otherwise(geometry)
    properties = F.to_json(F.create_map(F.lit("leisure"), F.coalesce("leisure", F.lit("none")), F.lit("dog"), F.coalesce("dog", F.lit("none"))))
    text = F.concat(F.lit('{"type":"Feature","id":"'), F.col("feature"), F.lit('","properties":'), properties, F.lit(',"geometry":'), geometry, F.lit("}"))
    path = shared_path(spark, "features")
    t.select(text.alias("value")).write.text(path)
    rows = features.read_features(spark, path, lines=True)
    return places.once(places.from_features(rows, tags.of_map("tags"))).select("id", "kind", "lat", "lon", "provenance")


@query("planet_places", "SELECT 'way/' || CAST(way AS VARCHAR) AS id, 'dog_park' AS kind, round((min(lat) + max(lat)) / 2, 7) AS lat, round((min(lon) + max(lon)) / 2, 7) AS lon FROM {way_nodes} w LEFT JOIN {nodes} p ON p.node = w.node WHERE way % 4 = 0 GROUP BY way HAVING count(*) = count(lat)")
def planet_places(spark, d):
    """The whole conversion: preselect with references, assemble, convert, one of each."""
    kept = durable(refresh.preselect(durable(way_objects(spark, d), "objects")), "kept")
    return refresh.to_places(kept).select("id", "kind", "lat", "lon")


# --- published files, stores, answers, runs -----------------------------------------------


@query("published_round_trip", "SELECT id, kind, name, lat, lon, leash_required, fenced, lit, surface, season FROM {twins}")
def published_round_trip(spark, d):
    """Places published as one JSON file, fetched, stored and read back from the stored copy."""
    path = shared_path(spark, "published")
    dataset.publish(twins(spark, d), {"include": [SQUARE], "exclude": [HOLE]}, "test", "2026-07-22T00:00:00Z", f"{path}/out.json", gate=False)
    dataset.Loader(spark, f"{path}/out.json", f"{path}/stored.json", deadline_s=600).load()
    envelope, rows = dataset.Loader(spark, f"{path}/none", f"{path}/stored.json", deadline_s=600).load()
    assert len(envelope["coverage"]["include"]) == len(envelope["coverage"]["exclude"]) == 1
    return rows.select("id", "kind", "name", "lat", "lon", "tags.leash_required", "tags.fenced", "tags.lit", "tags.surface", F.col("seasonal.kind").alias("season"))


@query("refresh_run", "SELECT 'way/' || CAST(way AS VARCHAR) AS id, 'dog_park' AS kind, round((min(lat) + max(lat)) / 2, 7) AS lat, round((min(lon) + max(lon)) / 2, 7) AS lon, CAST(5 AS BIGINT) AS cursor FROM {way_nodes} w LEFT JOIN {nodes} p ON p.node = w.node WHERE way % 12 = 8 GROUP BY way HAVING count(*) = count(lat)")
def refresh_run(spark, d):
    """A whole refresh from files: of the parks (every fourth way) one in three is deleted by a
    change, one in three stops being a park; what is published, and the new cursor."""
    path = shared_path(spark, "run")
    none = lambda t: F.lit(None).cast(t)
    rows = way_objects(spark, d).withColumns({"version": F.lit(1), "ts": none("timestamp")}).select("type", "id", "version", "ts", "lat", "lon", "refs", "members", "tags")
    rows.write.parquet(f"{path}/state")
    changed = durable(rows.where("type = 'way' AND id % 12 IN (0, 4)").withColumns({"version": F.lit(2), "seq": F.when(F.col("id") % 12 == 0, 4).otherwise(5).cast("long"), "op": F.when(F.col("id") % 12 == 0, "delete").otherwise("modify"), "tags": F.map_from_arrays(F.array(F.lit("leisure")), F.array(F.lit("garden")))}), "changes")
    meta = {"schema": state.META_SCHEMA, "filterVersion": state.FILTER_VERSION, "sequenceNumber": 3, "timestamp": "2026-07-20T00:00:00Z", "seededFrom": []}
    state.write_text(spark, f"{path}/meta.json", json.dumps(meta))
    refresh.refresh(spark, f"{path}/meta.json", f"{path}/state", changed, rows.limit(0), (5, "2026-07-22T00:00:00Z"), f"{path}/next", f"{path}/meta.json", f"{path}/out.json", max_repairs=1_000_000_000, gate=False)
    _, out = dataset.read_dataset(spark, f"{path}/out.json")
    cursor = state.read_meta(spark, f"{path}/meta.json")["sequenceNumber"]
    return out.select("id", "kind", "lat", "lon", F.lit(cursor).cast("long").alias("cursor"))


@query("live_answers", f"""SELECT type || '/' || CAST(n AS VARCHAR) AS id, 'bathing_spot' AS kind, nullif(name, '') AS name, round(lat, 7) AS lat, round(lon, 7) AS lon, {_GRADE} AS provenance
FROM {{tagged}}, (VALUES ('node'), ('way')) AS t(type) WHERE ({_GRADE}) IS NOT NULL""")
def live_answers(spark, d):
    """Answers of a live service: positions, centres, an element that repeats, one without a point."""
    t = at(spark, d, "tagged")
    said = F.to_json(F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("dog"), F.col("dog")), lambda k, v: v.isNotNull()))
    n, lat, lon = (F.col(c).cast("string") for c in ("n", "lat", "lon"))
    body = F.format_string('{"elements":[{"type":"node","id":%s,"lat":%s,"lon":%s,"tags":%s},{"type":"node","id":%s,"lat":0,"lon":0,"tags":%s},{"type":"way","id":%s,"lat":1,"center":{"lat":%s,"lon":%s},"tags":%s},{"type":"relation","id":%s,"tags":%s},5]}', n, lat, lon, said, n, said, n, lat, lon, said, n, said)
    got = live.to_places(live.elements(t.select(body.alias("body"))), tags.BATHING)
    return got.select("id", "kind", "name", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "provenance")


@query("spot_validation", """SELECT n, kind, name, lat, lon, leash, fenced, provenance, season, month FROM (
  SELECT n, CASE n % 4 WHEN 0 THEN 'dog_park' WHEN 1 THEN 'bathing_spot' END AS kind, CASE n % 3 WHEN 0 THEN 'A' END AS name, CASE WHEN n % 5 <> 0 THEN lat END AS lat, lon, CASE WHEN n % 2 = 0 THEN true END AS leash, n % 6 = 1 AS fenced,
    CASE WHEN n % 7 <> 0 THEN 'permitted' END AS provenance, CASE n % 6 WHEN 0 THEN 'ban' WHEN 1 THEN 'unparsed' END AS season, CASE n % 6 WHEN 0 THEN 6 END AS month FROM {tagged}
) WHERE kind IS NOT NULL AND lat IS NOT NULL AND provenance IS NOT NULL""")
def spot_validation(spark, d):
    """Published places, some without what a place must have, some with a bad field."""
    n = F.col("n")
    pick = lambda m, *texts: F.get(F.array(*map(F.lit, texts)), (n % m).cast("int"))
    lat, lon = F.col("lat").cast("string"), F.col("lon").cast("string")
    text = F.format_string('{"id":"node/%s","kind":%s,"name":%s,"lat":%s,"lon":%s,"tags":{"leashRequired":%s,"fenced":%s},"provenance":%s,"seasonal":%s}', n.cast("string"), pick(4, '"dog_park"', '"bathing_spot"', '"other"', "5"), pick(3, '"A"', '""', "7"), F.when(n % 5 == 0, F.concat(F.lit('"'), lat, F.lit('"'))).otherwise(lat), lon, pick(2, "true", '"true"'), F.when(n % 6 == 1, "true").otherwise("false"), F.when(n % 7 == 0, '"unknown"').otherwise('"permitted"'),
                           pick(6, '{"kind":"ban","from":{"month":6,"day":1},"to":{"month":8,"day":31}}', '{"kind":"unparsed"}', '{"kind":"ban","from":{"month":13,"day":1},"to":{"month":8,"day":31}}', '{"kind":"ban","from":{"month":1,"day":1}}', '"ban"', "null"))
    rows = dataset.valid_spots(at(spark, d, "tagged").select(F.parse_json(text).alias("s")))
    return rows.select(F.split_part(F.col("id"), F.lit("/"), F.lit(2)).cast("long").alias("n"), "kind", "name", "lat", "lon", F.col("tags.leash_required").alias("leash"), F.col("tags.fenced").alias("fenced"), "provenance", F.col("seasonal.kind").alias("season"), F.col("seasonal.from.month").alias("month"))


@query("cache_answers", """WITH good AS (SELECT 'k' || CAST(n % 50 AS VARCHAR) AS key, max(n) AS n FROM {tagged} WHERE n % 9 <> 0 AND n % 11 <> 0 AND n > 288 AND n <= 456 GROUP BY 1),
asked AS (SELECT DISTINCT 'k' || CAST(n % 60 AS VARCHAR) AS key FROM {tagged})
SELECT a.key, g.n IS NOT NULL AS hit, CAST(1 + g.n % 3 AS INTEGER) AS spots, 'node/' || CAST(g.n AS VARCHAR) AS first FROM asked a LEFT JOIN good g ON g.key = a.key""")
def cache_answers(spark, d):
    """Remembered answers, one a key and hour, some with a spot or a season that refuses them."""
    n = F.col("n")
    day = lambda m: F.struct(m.cast("int").alias("month"), F.lit(1).alias("day"))
    season = F.struct(F.lit("ban").alias("kind"), day(F.when(n % 11 == 0, 13).otherwise(6)).alias("from"), day(F.lit(8)).alias("to"))
    flags = F.struct(*(F.lit(None).cast("boolean").alias(f) for f in ("leash_required", "fenced", "lit")), F.lit(None).cast("string").alias("surface"))
    spot = F.struct(F.concat(F.lit("node/"), n.cast("string")).alias("id"), F.when(n % 9 == 0, "other").otherwise("dog_park").alias("kind"), F.lit(None).cast("string").alias("name"), "lat", "lon", flags.alias("tags"), F.lit("designated").alias("provenance"), season.alias("seasonal"))
    entries = at(spark, d, "tagged").select(F.concat(F.lit("k"), (n % 50).cast("string")).alias("key"), F.timestamp_seconds(F.unix_timestamp(F.lit("2026-07-01 00:00:00").cast("timestamp")) + n * 3600).alias("stored_at"), F.array_repeat(spot, (n % 3 + 1).cast("int")).alias("spots"))
    asked = at(spark, d, "tagged").select(F.concat(F.lit("k"), (n % 60).cast("string")).alias("key")).distinct()
    got = seqs.answer_through_cache(asked, entries, F.lit("2026-07-20 00:00:00").cast("timestamp"))
    return got.select("key", "hit", F.when(F.col("hit"), F.size("spots")).alias("spots"), F.get("spots", F.lit(0))["id"].alias("first"))


@query("key_value", "SELECT id AS key, CASE WHEN id LIKE 'node/%' THEN 'new' ELSE kind END AS value FROM {spots} WHERE id NOT LIKE 'relation/%' AND CAST(split_part(id, '/', 2) AS BIGINT) % 5 <> 0")
def key_value(spark, d):
    """A store after two puts, a deletion and a sweep of old prefixes."""
    kv = store.Store(spark, shared_path(spark, "store"), "value string")
    rows = at(spark, d, "spots").select(F.col("id").alias("key"), F.col("kind").alias("value"))
    kv.put(rows)
    kv.put(rows.where("key LIKE 'node/%'").withColumn("value", F.lit("new")))
    kv.delete(rows.where("CAST(split_part(key, '/', 2) AS BIGINT) % 5 = 0"))
    kv.sweep(("node/", "way/"))
    return kv.rows()


@query("fix_events", """SELECT CAST(session AS VARCHAR) AS session, seq, CASE WHEN seq % 5 = 0 THEN 'location-failed' ELSE 'position-fixed' END AS kind,
  CASE WHEN seq % 5 = 0 THEN '{"reason":"' || CASE (seq // 5) % 5 WHEN 1 THEN 'PERMISSION_DENIED' WHEN 3 THEN 'TIMEOUT' ELSE 'POSITION_UNAVAILABLE' END || '"}'
  ELSE '{"lat":' || CAST(lat AS VARCHAR) || ',"lon":' || CAST(lon AS VARCHAR) || CASE WHEN seq % 4 < 2 THEN '' ELSE ',"accuracy":' || CAST(CAST(seq AS DOUBLE) / 8 AS VARCHAR) END || '}' END AS payload FROM {fixes}""")
def fix_events(spark, d):
    """Fixes and failures as events; an accuracy that is no number isn't told."""
    seq = F.col("seq")
    code = F.when(seq % 5 == 0, ((seq / 5).cast("long") % 5).cast("int"))
    rows = at(spark, d, "fixes").select(F.col("session").cast("string").alias("session"), "seq", "lat", "lon", F.when(seq % 4 == 0, float("nan")).when(seq % 4 > 1, seq / 8).alias("accuracy"), code.alias("error_code"))
    return fixes.events(fixes.clean(rows))


@query("accuracy_text", "SELECT session, seq, CASE WHEN seq % 3 <> 0 THEN '±' || CAST(CAST(floor(at_ms + 0.5) AS BIGINT) AS VARCHAR) || ' m' END AS text FROM {marks}")
def accuracy_text(spark, d):
    m = F.when(F.col("seq") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("at_ms"))
    return at(spark, d, "marks").select("session", "seq", present.accuracy_text(m).alias("text"))


@query("change_urls", """WITH p AS (SELECT n, lpad(CAST(n * 977 AS VARCHAR), 9, '0') AS nine, CASE n % 2 WHEN 0 THEN 'way' ELSE 'relation' END AS kind FROM {tagged})
SELECT n, 'https://planet.osm.org/replication/day/' || substr(nine, 1, 3) || '/' || substr(nine, 4, 3) || '/' || substr(nine, 7, 3) || '.osc.gz' AS diff, 'https://api.openstreetmap.org/api/0.6/' || kind || '/' || CAST(n AS VARCHAR) || '/full' AS repair FROM p""")
def change_urls(spark, d):
    kind = F.when(F.col("n") % 2 == 0, "way").otherwise("relation")
    return at(spark, d, "tagged").select("n", ids.diff_url(_numbered(F.col("n"))).alias("diff"), ids.repair_url(kind, F.col("n")).alias("repair"))


@query("first_guess", "SELECT CAST(o_orderkey AS BIGINT) AS seq, least(CAST(o_orderkey AS BIGINT), greatest(1, CAST(o_orderkey AS BIGINT) - CAST(ceil((o_custkey % 400) / 24.0) AS BIGINT) - 1)) AS guess FROM {orders}")
def first_guess(spark, d):
    """Where the walk back from a change number starts, for a safe time so many hours before."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("ts"), (F.col("o_custkey") % 400).alias("hours"))
    safe = F.timestamp_seconds(F.unix_timestamp("ts") - F.col("hours") * 3600)
    return rows.select("seq", objects.first_guess(F.col("seq"), F.col("ts"), safe).alias("guess"))
