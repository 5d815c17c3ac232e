"""GeoJSON feature collections: rows of id, lat, lon and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geo, ids

#: A JSON number, and a position as it begins: longitude and latitude, whatever follows.
_NUMBER = r"-?[0-9][0-9.]*(?:[eE][+-]?[0-9]+)?"
_POSITION = rf"\[({_NUMBER}),({_NUMBER})(?:,[^\[\]]*+)?\]"


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _members(geometry: Column) -> Column:
    """The geometries that aren't collections, from collections of any depth; a null among
    them stands for one that can't be read. Opens a level at a time, as many times as the
    geometry names collections."""
    none = F.array(F.lit(None).cast("variant"))
    named = F.coalesce(F.to_json(geometry), F.lit(""))
    levels = F.floor((F.length(named) - F.length(F.replace(named, F.lit("GeometryCollection"), F.lit("")))) / len("GeometryCollection")).cast("int")
    rounds = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))

    def opened(g: Column) -> Column:
        within = F.try_variant_get(g, "$.geometries", "array<variant>")
        closed = F.coalesce(F.try_variant_get(g, "$.type", "string") != "GeometryCollection", F.lit(True))
        return F.when(closed, F.array(g)).otherwise(F.coalesce(within, none))

    return F.aggregate(rounds, F.array(geometry), lambda all_, _: F.flatten(F.transform(all_, opened)))


def _positions(coordinates: Column) -> Column:
    """array<struct<lat, lon>> of a ``coordinates`` value nested to any depth; null where any
    entry is no position (or holds lists behind its two numbers), or a list is empty."""
    text = F.to_json(coordinates)
    rest = F.regexp_replace(text, _POSITION, "p")
    whole = rest.rlike(r"^[\[\],p]*p[\[\],p]*$") & ~rest.contains("[]")
    numbers = lambda k: F.transform(F.regexp_extract_all(text, F.lit(_POSITION), F.lit(k)), lambda x: x.cast("double"))
    pairs = F.arrays_zip(numbers(2).alias("lat"), numbers(1).alias("lon"))
    return F.when(F.coalesce(whole, F.lit(False)), pairs)


def centre(geometry: Column) -> Column:
    """struct<lat, lon> of the middle of the bounding box, seven decimals; null if any
    position is unreadable or there is none. ``geometry``: variant."""

    def middle(points: Column) -> Column:
        lat, lon = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
        whole = F.forall(points, lambda p: (F.abs(p["lat"]) < float("inf")) & (F.abs(p["lon"]) < float("inf")))
        at = F.struct(geo.round_coord((F.array_min(lat) + F.array_max(lat)) / 2).alias("lat"), geo.round_coord((F.array_min(lon) + F.array_max(lon)) / 2).alias("lon"))
        return F.when((F.size(points) > 0) & F.coalesce(whole, F.lit(False)), at)

    parts = F.transform(_members(geometry), lambda g: _positions(F.try_variant_get(g, "$.coordinates", "variant")))
    return geo.let(F.when(F.forall(parts, lambda p: p.isNotNull()), F.flatten(parts)), middle)


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """id, lat, lon, tags of every usable feature.

    ``lines``: one feature a line, which splits and scales; otherwise a collection a file,
    whose ``features`` must be a list, or reading fails."""
    if lines:
        raw = spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json("value").alias("f"))
    else:
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
        listed = F.try_variant_get("doc", "$.features", "array<variant>")
        raw = whole.select(F.explode(F.coalesce(listed, F.raise_error(F.lit("features is not a list")).cast("array<variant>"))).alias("f"))
    return to_rows(raw)


def to_rows(features: DataFrame) -> DataFrame:
    """From a variant column ``f``. Only string values of properties are tags."""
    feature_id = F.when(_is(F.try_variant_get("f", "$.id", "variant"), "STRING"), F.try_variant_get("f", "$.id", "string"))
    properties = F.try_variant_get("f", "$.properties", "map<string,variant>")
    texts = F.transform_values(F.map_filter(properties, lambda k, v: _is(v, "STRING")), lambda k, v: F.try_variant_get(v, "$", "string"))
    read = features.select(ids.spot_id(feature_id).alias("id"), centre(F.try_variant_get("f", "$.geometry", "variant")).alias("at"), F.coalesce(texts, F.create_map().cast("map<string,string>")).alias("tags"))
    return read.where("id is not null and at is not null").select("id", "at.lat", "at.lon", "tags")
