"""A table kept in buckets of (type, id), of which a new version writes only those that differ.

A version is a folder with a manifest: how many buckets there are, and for each that isn't empty
the folder that holds it (its own or that of an earlier version) and a digest of its rows. A
digest is the number of rows, the sum and the exclusive or of their hashes, aggregated where the
rows lie: one short line a bucket reaches the driver, however many rows there are. Rows of
a bucket count as a set with repeats; an order doesn't matter.

A change of some rows writes the buckets that hold them, and all other buckets are named
again. The bytes written follow the change as long as it meets few buckets, so take as many
buckets as make one small (a bucket is written by one task)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, TimestampType

from wayfold.operators.durable import delete
from wayfold.sources import state

MANIFEST = "manifest.json"


def bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("type", "id"), F.lit(n)).cast("int")


def _plain(rows: DataFrame) -> Column:
    """A row as text that differs where rows do: nulls apart from values, maps in the order of keys."""
    def of(f):
        if isinstance(f.dataType, MapType):
            return F.array_sort(F.map_entries(f.name))
        return F.unix_micros(f.name) if isinstance(f.dataType, TimestampType) else F.col(f.name)

    return F.to_json(F.struct(*(of(f).alias(f.name) for f in rows.schema)))


def digests(rows: DataFrame, n: int) -> dict[str, str]:
    """Digest of each bucket that holds rows."""
    hashed = rows.select(bucket(n).alias("bucket"), F.xxhash64(_plain(rows)).alias("h"))
    parts = hashed.groupBy("bucket").agg(F.count("h").alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.bit_xor("h").alias("x"))
    return {str(r["bucket"]): f"{r['n']}:{r['s']}:{r['x']}" for r in parts.collect()}


def manifest(spark: SparkSession, root: str, version: str | None) -> dict | None:
    """What a version consists of; None where it is a plain folder of files."""
    text = state.read_text(spark, f"{root}/{version}/{MANIFEST}") if version else None
    return json.loads(text) if text else None


def read(spark: SparkSession, root: str, version: str | None, schema: str) -> DataFrame:
    """The rows of a version, or of a plain folder (``root`` itself without a version)."""
    of = manifest(spark, root, version)
    if of is None:
        return spark.read.schema(schema).parquet(f"{root}/{version}" if version else root)
    paths = [f"{root}/{folder}/bucket={b}" for b, (folder, _) in of["at"].items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write(rows: DataFrame, root: str, version: str, before: str | None, n: int) -> list[int]:
    """Write a version, given the one before; the buckets that were written. Its name is a new
    one, and starts with ``_`` where plain files lie in ``root`` too, so that readers of these skip it.

    ``rows`` is read twice, so it should be a written frame. The manifest comes last: a version
    without one isn't whole and nothing may name it."""
    spark, now = rows.sparkSession, digests(rows, n)
    old = manifest(spark, root, before)
    kept = old["at"] if old and old["buckets"] == n else {}
    changed = sorted(int(b) for b, digest in now.items() if kept.get(b, [None, None])[1] != digest)
    if changed:
        rows.withColumn("bucket", bucket(n)).where(F.col("bucket").isin(changed)).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{version}")
    at = {b: [version if int(b) in changed else kept[b][0], digest] for b, digest in now.items()}
    state.write_text(spark, f"{root}/{version}/{MANIFEST}", json.dumps({"buckets": n, "at": at}))
    return changed


def drop_unnamed(spark: SparkSession, root: str, old: str, new: str) -> None:
    """Delete what version ``old`` names and ``new`` doesn't: once nothing reads ``old`` any more."""
    was, now = manifest(spark, root, old), manifest(spark, root, new)
    if was is None:
        delete(spark, f"{root}/{old}")
        return
    named = {(b, folder) for b, (folder, _) in (now["at"] if now else {}).items()}
    in_use = {folder for _, folder in named} | {new}
    gone = {(b, folder) for b, (folder, _) in was["at"].items()} - named
    for b, folder in sorted(gone):
        if folder in in_use:
            delete(spark, f"{root}/{folder}/bucket={b}")
    for folder in sorted({f for _, f in gone} | {old}):
        if folder not in in_use:
            delete(spark, f"{root}/{folder}")
