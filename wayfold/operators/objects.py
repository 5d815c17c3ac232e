"""Versioned map objects: newest version, change replay, references, repair, assembly.

Objects: type (node, way, relation), id, version, ts, lat, lon, refs (array of node ids of
a way), members (array<struct<type, ref, role>>), tags (map). Changes also carry op
(create, modify, delete) and seq (the number of their file).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.durable import durable

TYPES = ["node", "way", "relation"]
SCHEMA = "type string, id long, version int, ts timestamp, lat double, lon double, refs array<long>, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>"

# Limits of a refresh.
MAX_DIFFS, MAX_REPAIRS, MAX_REPAIR_PASSES, REWIND_HOURS = 40, 300, 2, 24


def _pick(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order``; partly aggregated before the shuffle.

    The other columns break ties, but maps, which have no order."""
    rest = [c for c in rows.columns if c not in keys]
    plain = [f.name for f in rows.schema.fields if f.name in rest and "map<" not in f.dataType.simpleString()]
    by = F.struct(*order, *(c for c in plain if c not in order))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*rows.columns)


def newest(*snapshots: DataFrame) -> DataFrame:
    """Newest version of each (type, id) over all snapshots, later timestamp among equal ones."""
    every = snapshots[0]
    for s in snapshots[1:]:
        every = every.unionByName(s)
    return _pick(every, ["type", "id"], ["version", "ts"])


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each (type, id): the greatest (seq, version)."""
    return _pick(changes, ["type", "id"], ["seq", "version"])


def replay(state: DataFrame, changes: DataFrame, after: int = 0) -> DataFrame:
    """State with all changes of files later than ``after``: the latest (seq, version) wins,
    and objects whose latest change deletes them go."""
    base = state.withColumns({"op": F.lit("keep"), "seq": F.lit(after).cast("long")})
    later = changes.where(F.col("seq") > after).select(*base.columns)
    return latest(base.unionByName(later)).where("op <> 'delete'").select(*state.columns)


def references(objects: DataFrame) -> DataFrame:
    """child_type, child_id, parent_type, parent_id: one row a reference."""
    ways = objects.where("type = 'way'").select(F.lit("node").alias("child_type"), F.explode("refs").alias("child_id"), F.col("type").alias("parent_type"), F.col("id").alias("parent_id"))
    relations = objects.where("type = 'relation'").select(F.explode("members").alias("m"), F.col("type").alias("parent_type"), F.col("id").alias("parent_id"))
    relations = relations.select(F.col("m.type").alias("child_type"), F.col("m.ref").alias("child_id"), "parent_type", "parent_id")
    return ways.unionByName(relations)


def missing_references(objects: DataFrame) -> DataFrame:
    """Distinct references to objects that aren't there; nested relations aren't followed.

    References are moved once, by child; only the missing ones, which are few, are made distinct."""
    wanted = references(objects).where("child_type <> 'relation'")
    there = objects.select(F.col("type").alias("child_type"), F.col("id").alias("child_id"))
    return wanted.join(there, ["child_type", "child_id"], "left_anti").select("child_type", "child_id", "parent_type", "parent_id").distinct()


def incomplete_parents(missing: DataFrame) -> DataFrame:
    return missing.select(F.col("parent_type").alias("type"), F.col("parent_id").alias("id")).distinct()


def reach(objects: DataFrame, start: DataFrame) -> DataFrame:
    """Objects of ``start`` (type, id) and all that they refer to, however deep.

    Only relations nest, so relations in relations are followed until none is new (a round
    for each level, the edges written once); their ways, and then the ways' nodes, follow."""
    edge = references(objects)
    inner = edge.where("child_type = 'relation'").select("parent_id", "child_id")
    relations = start.where("type = 'relation'").select("id").distinct()
    if inner.limit(1).count():
        inner = durable(inner, "nested")
        found = new = durable(relations, "reached")
        while True:
            new = durable(inner.join(new.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select(F.col("child_id").alias("id")).distinct().join(found, "id", "left_anti"), "reached")
            if not new.limit(1).count():
                break
            found = found.unionByName(new)
        relations = found
    wanted = start.select("type", "id").unionByName(relations.select(F.lit("relation").alias("type"), "id")).distinct()

    def below(kind: str, of: DataFrame) -> DataFrame:
        step = edge.where((F.col("parent_type") == kind) & (F.col("child_type") != "relation"))
        parents = of.where(F.col("type") == kind).select(F.col("id").alias("parent_id"))
        return step.join(parents, "parent_id", "left_semi").select(F.col("child_type").alias("type"), F.col("child_id").alias("id"))

    wanted = wanted.unionByName(below("relation", wanted)).distinct()
    wanted = wanted.unionByName(below("way", wanted)).distinct()
    return objects.join(wanted, ["type", "id"], "left_semi").select(*objects.columns)


def closure(objects: DataFrame, kept: Column) -> DataFrame:
    """Objects that meet ``kept`` and all that they refer to: relations in relations to any
    depth, their ways, and the ways' nodes."""
    return reach(objects, objects.where(kept).select("type", "id"))


def repair(state: DataFrame, source: DataFrame, kept: Column, passes: int = MAX_REPAIR_PASSES, budget: int = MAX_REPAIRS, cut: Callable[[DataFrame], DataFrame] | None = None, broken: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """Fetch incomplete objects whole from ``source`` and merge them, at most ``passes`` times.

    The budget counts all incomplete parents, though only untried ones are fetched; going
    over it raises. Parents that the source doesn't have are gone: skipped and counted.
    ``cut`` may write a frame and read it back between passes. ``broken``: the incomplete
    parents of ``state``, where the caller has them. Objects of a state are one a key, so a pass that
    the source has nothing for leaves the state as it is, with no parent untried."""
    cut = cut or (lambda df: df)
    tried, report = None, {"passes": 0, "fetched": 0, "gone": 0}
    for _ in range(passes):
        parents = broken if broken is not None else cut(incomplete_parents(missing_references(state)))
        n, broken = parents.limit(budget + 1).count(), None
        if n > budget:
            raise ValueError(f"more than {budget} parents need repair")
        todo = cut(parents.join(tried, ["type", "id"], "left_anti")) if tried is not None else parents
        asked = todo.count()
        if not asked:
            break
        have = source.join(todo, ["type", "id"], "left_semi").count()
        report = {"passes": report["passes"] + 1, "fetched": report["fetched"] + have, "gone": report["gone"] + asked - have}
        if not have:
            break
        whole = reach(source, todo)
        tried = todo if tried is None else tried.unionByName(todo)
        state = cut(newest(state, whole.select(*state.columns)))
    return state, report


def assemble(objects: DataFrame, kept: Column) -> DataFrame:
    """type, id, lat, lon, tags of the kept objects: a node's own position, the middle of
    the bounding box of a way's nodes or of a relation's nodes and ways' nodes. Objects with
    a reference that can't be resolved, or none at all, are skipped."""
    nodes = objects.where("type = 'node'").select(F.col("id").alias("node"), "lat", "lon")
    box = [F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"), F.count("lat").alias("n"), F.count(F.lit(1)).alias("m")]
    ways = objects.where("type = 'way'").select("id", F.explode("refs").alias("node")).join(nodes, "node", "left").groupBy("id").agg(*box)
    boxes = ways.where("n = m").select(F.lit("way").alias("type"), "id", "a", "b", "c", "d").unionByName(nodes.select(F.lit("node").alias("type"), F.col("node").alias("id"), F.col("lat").alias("a"), F.col("lat").alias("b"), F.col("lon").alias("c"), F.col("lon").alias("d")))
    members = objects.where("type = 'relation'").select(F.col("id").alias("of"), F.explode("members").alias("m")).where("m.type <> 'relation'").select("of", F.col("m.type").alias("type"), F.col("m.ref").alias("id"))
    relations = members.join(boxes, ["type", "id"], "left").groupBy(F.col("of").alias("id")).agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("c").alias("c"), F.max("d").alias("d"), F.count("a").alias("n"), F.count(F.lit(1)).alias("m"))
    every = boxes.unionByName(relations.where("n = m").select(F.lit("relation").alias("type"), "id", "a", "b", "c", "d"))
    middle = every.select("type", "id", geo.round_coord((F.col("a") + F.col("b")) / 2).alias("__lat"), geo.round_coord((F.col("c") + F.col("d")) / 2).alias("__lon"))
    wanted = objects.where(kept).select("type", "id", "tags")
    return wanted.join(middle, ["type", "id"]).select("type", "id", F.col("__lat").alias("lat"), F.col("__lon").alias("lon"), "tags")


def plan_diffs(stored: int, current: int, most: int = MAX_DIFFS) -> list[int]:
    """Numbers of the change files to replay, oldest first."""
    if current < stored:
        raise ValueError(f"the head {current} is behind the state's {stored}")
    if current - stored > most:
        raise ValueError(f"{current - stored} change files are more than {most}; seed anew")
    return list(range(stored + 1, current + 1))


def diff_plans(states: DataFrame, most: int = MAX_DIFFS) -> DataFrame:
    """``plan_diffs`` for many states (columns stored and current): a row for each change file
    that one needs, with its number as ``seq``; a state that may not go on has one row with
    what is wrong as ``refused``, and one that is at the head has none."""
    span = F.col("current") - F.col("stored")
    why = F.when(span < 0, "behind").when(span > most, "seed anew")
    wanted = F.when(why.isNotNull(), F.array(F.lit(None).cast("long"))).when(span > 0, F.sequence(F.col("stored") + 1, F.col("current"))).otherwise(F.array().cast("array<long>"))
    return states.withColumn("refused", why).withColumn("seq", F.explode(wanted))


def first_guess(head_seq: Column, head_ts: Column, safe: Column) -> Column:
    """Where a walk back to ``safe`` may start: whole days behind the head and one more, from
    1 to the head."""
    days = F.ceil((F.unix_millis(head_ts) - F.unix_millis(safe)) / 86_400_000)
    return F.least(F.greatest(head_seq - days - 1, F.lit(1)), head_seq).cast("long")


def safety_timestamp(stamps: DataFrame) -> DataFrame:
    """The oldest ``ts`` less a day, as one row; no row at all raises when read."""
    oldest = F.min("ts") - F.expr(f"interval {REWIND_HOURS} hours")
    return stamps.agg(F.coalesce(oldest, F.raise_error(F.lit("no timestamps to seed from")).cast("timestamp")).alias("safety_ts"))


def sequence_as_of(history: DataFrame, at: Column) -> DataFrame:
    """The newest ``seq`` whose ``ts`` is at or before ``at``; the head where at is later than
    all; raises when read if at is before all of the history."""
    best = F.max(F.when(F.col("ts") <= at, F.struct("ts", "seq")))["seq"]
    return history.agg(F.coalesce(best, F.raise_error(F.lit("before the history of changes")).cast("long")).alias("seq"))
