"""Identifiers of map objects, replication paths and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where changes and full objects are published.
REPLICATION_BASE = "https://planet.osm.org/replication/day"
OBJECT_BASE = "https://api.openstreetmap.org/api/0.6"


def spot_id(feature_id: Column) -> Column:
    """n, w, r and their number; even area numbers are ways of half, odd ones relations of
    half rounded down. Null for anything else."""
    kind, digits = F.regexp_extract(feature_id, r"^([nwra])([0-9]+)\z", 1), F.regexp_extract(feature_id, r"^([nwra])([0-9]+)\z", 2)
    n = F.nullif(digits, F.lit("")).try_cast("decimal(38,0)")
    half = F.floor((n - n % 2) / 2).cast("string")
    area = F.when(n % 2 == 0, F.concat(F.lit("way/"), half)).otherwise(F.concat(F.lit("relation/"), half))
    plain = F.when(kind == "n", "node/").when(kind == "w", "way/").when(kind == "r", "relation/")
    return F.when(kind == "a", area).when(kind != "", F.concat(plain, digits))


def is_node(id_: Column) -> Column:
    return id_.startswith("node/")


def is_area(id_: Column) -> Column:
    return id_.startswith("way/") | id_.startswith("relation/")


def sequence_path(n: Column) -> Column:
    """Nine digits in three folders; an error outside 0 to 999,999,999."""
    ok = n.between(0, 999_999_999)
    nine = F.lpad(n.cast("string"), 9, "0")
    path = F.concat_ws("/", F.substring(nine, 1, 3), F.substring(nine, 4, 3), F.substring(nine, 7, 3))
    return F.when(ok, path).otherwise(F.raise_error(F.concat(F.lit("not a replication sequence number: "), n.cast("string"))).cast("string"))


def diff_url(n: Column) -> Column:
    return F.concat(F.lit(REPLICATION_BASE + "/"), sequence_path(n), F.lit(".osc.gz"))


def repair_url(kind: Column, id_: Column) -> Column:
    return F.concat(F.lit(OBJECT_BASE + "/"), kind, F.lit("/"), id_.cast("string"), F.lit("/full"))
