"""A key-value table on a shared folder: remembered answers, and small values by key.

A store is a folder of numbered Parquet versions and a pointer file that names the current
one. A change writes a new version and then replaces the pointer, so a reader sees the old
or the new state, and a job that dies in between leaves the old one. One writer at a time."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.durable import delete
from wayfold.operators.sequences import current_prefix
from wayfold.sources.state import read_text, write_text


class Store:
    """Rows ``key`` and the given columns; a later put of a key replaces the earlier."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"key string, {schema}"

    def rows(self) -> DataFrame:
        name = read_text(self.spark, f"{self.path}/current")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}") if name else self.spark.createDataFrame([], self.schema)

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys that are there."""
        return self.rows().join(keys.select("key").distinct(), "key", "left_semi")

    def put(self, entries: DataFrame) -> None:
        """Add entries; of several with a key in one call, an arbitrary but fixed one stays."""
        columns = self.rows().columns
        new = entries.select(*columns).groupBy("key").agg(F.max_by(F.struct(*columns), F.xxhash64(*columns)).alias("r")).select("r.*")
        self._become(self.rows().join(new.select("key"), "key", "left_anti").select(*columns).unionByName(new))

    def delete(self, keys: DataFrame) -> None:
        self._become(self.rows().join(keys.select("key").distinct(), "key", "left_anti"))

    def sweep(self, prefixes: tuple[str, ...]) -> int:
        """Delete the keys that start with no current prefix; how many there were."""
        gone = self.rows().where(~current_prefix(F.col("key"), prefixes)).count()
        if gone:
            self._become(self.rows().where(current_prefix(F.col("key"), prefixes)))
        return gone

    def _become(self, rows: DataFrame) -> None:
        old, name = read_text(self.spark, f"{self.path}/current"), uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{name}")
        write_text(self.spark, f"{self.path}/current", name)
        if old:
            delete(self.spark, f"{self.path}/{old}")


#: What a store of answers holds for each key.
ANSWERS = "stored_at timestamp, spots array<struct<id:string,kind:string,name:string,lat:double,lon:double,tags:struct<leash_required:boolean,fenced:boolean,lit:boolean,surface:string>,provenance:string,seasonal:struct<kind:string,from:struct<month:int,day:int>,to:struct<month:int,day:int>>>>"


def remember(store: Store, answers: DataFrame, now: Column) -> bool:
    """Keep the answers (key, spots) as of ``now``; empty ones count, failures (null spots)
    don't. Never raises: an answer that can't be kept is still an answer."""
    try:
        store.put(answers.where("spots is not null").withColumn("stored_at", now))
        return True
    except Exception:  # out of space, or no right to write
        return False
