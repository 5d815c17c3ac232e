"""Keeping the state and the published places current.

``refresh`` is one idempotent run: validate the metadata, plan the change files, replay them,
preselect with referenced objects, repair, assemble, convert, gate, publish, and write the
metadata last. ``stream_refresh`` does the same for each batch of a stream of change rows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import tags
from wayfold.operators import objects, places
from wayfold.operators.durable import durable, release
from wayfold.operators.sequences import assert_sane, kind_counts
from wayfold.sources import boundary, buckets, dataset, extracts, osm_xml, state

# Fixed value: the boundary of a whole-planet build.
PLANET = "planet\n1\n   -180 -90\n    180 -90\n    180  90\n   -180  90\nEND\nEND\n"


def selected():
    """The preselection over the objects' tag map."""
    return tags.is_preselected(tags.of_map("tags"))


def to_places(state_rows: DataFrame) -> DataFrame:
    """Objects to places: assembled, converted, one row of each (id, kind)."""
    at = objects.assemble(state_rows, selected())
    rows = at.select(F.concat_ws("/", "type", "id").alias("id"), "lat", "lon", "tags")
    return places.once(places.from_features(rows, tags.of_map("tags")))


def preselect(rows: DataFrame) -> DataFrame:
    """Preselected objects with all they refer to."""
    return objects.closure(rows, selected())


def seed(snapshots: list[DataFrame], stamps: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged state of regional snapshots, and the change file to replay from (one row)."""
    safe = objects.safety_timestamp(stamps).scalar()
    return objects.newest(*map(preselect, snapshots)), objects.sequence_as_of(history, safe)


def filter_extract(spark: SparkSession, path: str, out: str) -> str:
    """Write the preselected objects of one extract (binary or XML, by its name), and beside
    them the time of its header, which is read first: a file without one is refused before the
    costly part."""
    binary = path.endswith(".pbf")
    stamp = extracts.header_timestamp(path) if binary else osm_xml.header_timestamp(spark, path)
    preselect((extracts.read_by_type if binary else osm_xml.read_objects)(spark, path)).write.mode("overwrite").parquet(out)
    state.write_text(spark, f"{out}.timestamp", stamp)
    return stamp


def seed_from(spark: SparkSession, extracts: list[str], work: str, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``seed`` of extract files, in the order of their names, each filtered into ``work``."""
    names = sorted(extracts)
    kept = {name: f"{work}/{k:05d}" for k, name in enumerate(names)}
    stamps = spark.createDataFrame([(name, filter_extract(spark, name, kept[name])) for name in names], "file string, ts string")
    read = [spark.read.schema(objects.SCHEMA).parquet(kept[name]) for name in names]
    safe = objects.safety_timestamp(stamps.select(F.col("ts").cast("timestamp").alias("ts"))).scalar()
    return objects.newest(*read), objects.sequence_as_of(history, safe)


def advance(old: DataFrame, changes: DataFrame, source: DataFrame, after: int, max_repairs: int = objects.MAX_REPAIRS, cut=durable) -> tuple[DataFrame, dict]:
    """The state after all later changes, preselected and repaired from ``source`` (whole objects)."""
    replayed = preselect(objects.replay(old, changes, after))
    return objects.repair(cut(replayed) if cut else replayed, source, selected(), budget=max_repairs, cut=cut)


def _publish(spark: SparkSession, new: DataFrame, region: str, stamp: str, out_dataset: str, gate: bool) -> dict[str, int]:
    """Places of a state, gated and published; how many of each kind."""
    rows, rings = durable(to_places(new), "places"), boundary.parse_boundary(PLANET)
    if gate:
        assert_sane(rows, region, len(rings["include"]))
    dataset.publish(rows, rings, region, stamp, out_dataset, gate=False)
    counts = {r["kind"]: r["n"] for r in kind_counts(rows).collect()}
    release(rows)
    return counts


def refresh(spark: SparkSession, meta_path: str, state_path: str, changes: DataFrame, source: DataFrame, head: tuple[int, str], out_state: str, out_meta: str, out_dataset: str, region: str = "planet", max_diffs: int = objects.MAX_DIFFS, max_repairs: int = objects.MAX_REPAIRS, gate: bool = True, bucketed: int | None = None) -> dict:
    """One run from files; returns its summary. ``head``: newest change number and its time.

    The new state goes to a new folder below ``out_state``, and the metadata, written last,
    name it. So a run that dies leaves the old metadata with the old state, also where old
    and new share their paths; the old folder goes once the new metadata stand. With
    ``bucketed`` the state is kept in so many buckets, and where old and new share
    their paths only those that changed are written (``sources.buckets``)."""
    meta = state.read_meta(spark, meta_path)
    plan = objects.plan_diffs(meta["sequenceNumber"], head[0], max_diffs)
    old_name = meta.get("state")
    old = buckets.read(spark, state_path, old_name, objects.SCHEMA)
    wanted = changes.where(F.col("seq").between(meta["sequenceNumber"] + 1, head[0]))
    new, report = advance(old, wanted, source, meta["sequenceNumber"], max_repairs)
    kinds = _publish(spark, new, region, head[1], out_dataset, gate)
    name = f"{'_' if bucketed else ''}{head[0]:09d}-{uuid.uuid4().hex}"
    in_place, written = (meta_path, state_path) == (out_meta, out_state), {}
    if bucketed:
        written = {"written": buckets.write(new, out_state, name, old_name if in_place else None, bucketed)}
    else:
        new.repartitionByRange("type", "id").write.parquet(f"{out_state}/{name}")
    state.write_text(spark, out_meta, json.dumps(state.advanced(meta, *head) | {"state": name}))
    release(new)
    if old_name and in_place:
        buckets.drop_unnamed(spark, state_path, old_name, name)
    return report | {"diffs": len(plan), "kinds": kinds} | written


#: Objects of a streamed state: op and seq are those of the change that made them.
STREAM_SCHEMA = f"{objects.SCHEMA}, op string, seq long"


def stream_refresh(changes: DataFrame, source: DataFrame, state_dir: str, checkpoint: str, out_dataset: str, region: str = "planet", stamp: str | None = None, max_repairs: int = objects.MAX_REPAIRS, gate: bool = True, late: int = objects.MAX_DIFFS):
    """Keep a state and its published places current from a stream of change rows.

    Batch n reads folder n of ``state_dir``, replays, preselects, repairs, publishes and
    writes folder n + 1, then the cursor (``state_dir``/cursor: folder and newest change
    number) as the commit point; a batch that runs again after a failure gives the same.

    Changes may arrive late: each object keeps the number of its last change, and what was
    deleted or fell out of the preselection is remembered for ``late`` change numbers, so an
    older change never wins over a newer one within that span. Returns the started query."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(STREAM_SCHEMA).parquet(f"{state_dir}/{number:09d}")
        last = durable(objects.latest(old.unionByName(batch.select(*old.columns))), "latest")
        newest = last.agg(F.max("seq")).first()[0] or 0
        there = last.where("op not in ('delete', 'gone')")
        new, _ = objects.repair(durable(preselect(there.drop("op", "seq")), "kept"), source, selected(), budget=max_repairs, cut=durable)
        _publish(spark, new, region, stamp or str(newest), out_dataset, gate)
        of = last.select("type", "id", "op", "seq")
        kept = new.join(of, ["type", "id"], "left").withColumns({"op": F.when(F.col("op").isin("delete", "gone"), "repair").otherwise(F.coalesce("op", F.lit("repair"))), "seq": F.coalesce("seq", F.lit(0).cast("long"))})
        gone = last.where(F.col("seq") > newest - late).join(new.select("type", "id"), ["type", "id"], "left_anti")
        gone = gone.withColumn("op", F.when(F.col("op") == "delete", F.col("op")).otherwise(F.lit("gone")))
        out = kept.select(*old.columns).unionByName(gone.select(*old.columns))
        out.write.mode("overwrite").parquet(f"{state_dir}/{number + 1:09d}")
        state.write_text(spark, f"{state_dir}/cursor", json.dumps({"folder": f"{number + 1:09d}", "sequenceNumber": newest}))
        release(last, new)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The objects of the state that the cursor names."""
    folder = json.loads(state.read_text(spark, f"{state_dir}/cursor"))["folder"]
    return spark.read.schema(STREAM_SCHEMA).parquet(f"{state_dir}/{folder}").where("op not in ('delete', 'gone')").drop("op", "seq")


def empty_state(spark: SparkSession, state_dir: str) -> None:
    spark.createDataFrame([], STREAM_SCHEMA).write.mode("overwrite").parquet(f"{state_dir}/000000000")
