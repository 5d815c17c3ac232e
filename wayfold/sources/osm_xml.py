"""Map objects and change files in XML, with explicit schemas (one child or many)."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.objects import SCHEMA, TYPES
from wayfold.sources import change_files

_TAGS = "tag array<struct<_k:string,_v:string>>"
_BASE = f"_id long, _version int, _timestamp timestamp, {_TAGS}"
_OBJECT = {
    "node": f"{_BASE}, _lat double, _lon double",
    "way": f"{_BASE}, nd array<struct<_ref:long>>",
    "relation": f"{_BASE}, member array<struct<_type:string,_ref:long,_role:string>>",
}


def _shape(df: DataFrame, kind: str) -> DataFrame:
    """The common columns of one type's rows. The last of repeated keys wins."""
    pairs = F.array_compact(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.when(t["_k"].isNotNull(), F.struct(t["_k"], t["_v"]))))
    last = F.filter(pairs, lambda t, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda u: u["_k"] == t["_k"]))
    none = lambda t: F.lit(None).cast(t)
    return df.select(
        F.lit(kind).alias("type"),
        F.col("_id").alias("id"),
        F.col("_version").alias("version"),
        F.col("_timestamp").alias("ts"),
        F.col("_lat").alias("lat") if kind == "node" else none("double").alias("lat"),
        F.col("_lon").alias("lon") if kind == "node" else none("double").alias("lon"),
        F.transform("nd", lambda n: n["_ref"]).alias("refs") if kind == "way" else none("array<bigint>").alias("refs"),
        F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))).alias("members") if kind == "relation" else none("array<struct<type:string,ref:bigint,role:string>>").alias("members"),
        F.map_from_entries(last).alias("tags"),
        *(c for c in ("op", "seq") if c in df.columns),
    )


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """All objects of plain or compressed XML files."""
    out = None
    for kind in TYPES:
        rows = _shape(spark.read.format("xml").option("rowTag", kind).schema(_OBJECT[kind]).load(path), kind)
        out = rows if out is None else out.unionByName(rows)
    return out


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Objects of change files with op and seq, the number in each file's name (its path's
    nine digits in threes count too); one scan a file (``change_files``)."""
    return change_files.read(spark, path)


def header_timestamp(spark: SparkSession, path: str) -> str:
    """When an extract was cut from the database, from the attributes of its first element;
    an error where it doesn't say, or not as a time."""
    lines = spark.read.text(path).limit(20).collect()
    head = re.search(r"<osm\b[^>]*>", " ".join(r[0] for r in lines))
    found = re.search(r'\b(?:osmosis_replication_)?timestamp="([^"]*)"', head[0]) if head else None
    if not found:
        raise ValueError(f"{path}: no timestamp in its header")
    dt.datetime.fromisoformat(found[1].replace("Z", "+00:00"))
    return found[1]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
