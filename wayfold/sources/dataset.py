"""The published dataset: validated reading, loading with a stored copy, and publishing."""

from __future__ import annotations

import json
import math
import threading
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import curve
from wayfold.functions.seasonal import RULE_TYPE
from wayfold.operators import places
from wayfold.operators.durable import delete, shared_path
from wayfold.operators.sequences import assert_sane
from wayfold.sources.files import copy_file, join_parts

# Fixed values of the envelope.
DATASET_SCHEMA = 1
# and seconds that fetching it may take.
DEADLINE_S = 10.0
ATTRIBUTION, LICENSE = "© OpenStreetMap contributors", "ODbL-1.0"


def valid_spots(raw: DataFrame) -> DataFrame:
    """Places from a variant column ``s``: a row without what a place must have is dropped, a
    bad name, tag or season only loses that field. Booleans and strings aren't converted."""
    kind_of = lambda p: F.schema_of_variant(F.try_variant_get("s", p, "variant"))
    text = lambda p: F.when(kind_of(p) == "STRING", F.try_variant_get("s", p, "string"))
    flag = lambda p: F.when(kind_of(p) == "BOOLEAN", F.try_variant_get("s", p, "boolean"))
    number = lambda p: F.when(kind_of(p).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get("s", p, "double"))
    whole = lambda p: F.when(kind_of(p).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get("s", p, "int"))
    day = lambda p: F.when(whole(f"{p}.month").between(1, 12) & whole(f"{p}.day").between(1, 31), F.struct(whole(f"{p}.month").alias("month"), whole(f"{p}.day").alias("day")))
    kind = text("$.seasonal.kind")
    start, end = day("$.seasonal.from"), day("$.seasonal.to")
    ban = F.when((kind == "ban") & start.isNotNull() & end.isNotNull(), F.struct(kind.alias("kind"), start.alias("from"), end.alias("to")).cast(RULE_TYPE))
    unparsed = F.when(kind == "unparsed", F.struct(kind.alias("kind"), F.lit(None).alias("from"), F.lit(None).alias("to")).cast(RULE_TYPE))
    read = raw.select(
        text("$.id").alias("id"),
        text("$.kind").alias("kind"),
        F.nullif(text("$.name"), F.lit("")).alias("name"),
        number("$.lat").alias("lat"),
        number("$.lon").alias("lon"),
        F.struct(flag("$.tags.leashRequired").alias("leash_required"), flag("$.tags.fenced").alias("fenced"), flag("$.tags.lit").alias("lit"), text("$.tags.surface").alias("surface")).alias("tags"),
        text("$.provenance").alias("provenance"),
        F.coalesce(ban, unparsed).alias("seasonal"),
    )
    return read.where(F.col("id").isNotNull() & (F.col("id") != "") & F.col("kind").isin("dog_park", "bathing_spot") & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("provenance").isin("designated", "permitted", "name-match"))


def valid_coverage(value: object) -> dict | None:
    """include and exclude rings, or None: one bad ring refuses all; include must not be
    empty; a ring without points is accepted."""

    def point(p: object) -> bool:
        return isinstance(p, list) and len(p) == 2 and all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in p)

    def rings(v: object) -> bool:
        return isinstance(v, list) and all(isinstance(r, list) and all(map(point, r)) for r in v)

    if not isinstance(value, dict) or not rings(value.get("include")) or not rings(value.get("exclude")) or not value["include"]:
        return None
    return {role: [[(float(a), float(o)) for a, o in r] for r in value[role]] for role in ("include", "exclude")}


def valid_envelope(value: object) -> dict | None:
    """The envelope without its spots, or None if the file must be refused."""
    if not isinstance(value, dict) or value.get("schema") != DATASET_SCHEMA or isinstance(value.get("schema"), bool):
        return None
    if not all(isinstance(value.get(k), str) and value[k] for k in ("generatedAt", "region", "attribution", "license")):
        return None
    coverage = valid_coverage(value.get("coverage"))
    return None if coverage is None else {k: value[k] for k in ("schema", "generatedAt", "region", "attribution", "license")} | {"coverage": coverage}


_SPOTS = '"spots":['


def _whole(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The text of a file in any layout, and its spots (variant ``s``): one row, so one task reads it."""
    doc = spark.read.text(path, wholetext=True)
    listed = F.try_variant_get(F.try_parse_json("value"), "$.spots", "array<variant>")
    return doc, doc.select(F.explode(listed).alias("s"))


def _by_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """The text of a file without its spots, and these, where it has publish()'s layout: whole spots in each
    line, the first behind the envelope. Tasks read ranges of the file. None for any other file."""
    v, cut = F.col("value"), lambda c, n: F.left(c, F.length(c) - n)
    at, held = F.instr(v, _SPOTS), lambda c: F.try_parse_json(F.concat(F.lit('{"s":['), c, F.lit('],"end":1}')))
    parsed = lambda c: F.size(F.try_variant_get(held(c), "$", "map<string,variant>")) == 2
    rest = F.substr(v, at + len(_SPOTS))
    body = F.when(v.endswith(",") & parsed(cut(v, 1)), "body")
    role = F.coalesce(body, F.when(v.endswith("]}") & parsed(cut(v, 2)), "tail"), F.when((at > 0) & v.endswith(",") & parsed(cut(rest, 1)), "head"), F.lit("other"))
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("pos"))
    lines = lines.withColumn("role", role)
    of = lambda r, c: F.when(F.col("role") == r, c)
    ends = [F.max(of("head", F.concat(F.left(v, at + len(_SPOTS) - 1), F.lit("]}")))).alias("value"), F.min(of("head", F.col("pos"))) == F.min("pos"), F.max(of("tail", F.col("pos"))) == F.max("pos")]
    seen = lines.agg(*ends, F.count_if(F.col("role") == "head"), F.count_if(F.col("role") == "tail"), F.count_if(F.col("role") == "other")).first()
    if tuple(seen)[1:] != (True, True, 1, 1, 0):
        return None
    spot = F.when(F.col("role") == "head", cut(rest, 1)).otherwise(cut(v, F.when(F.col("role") == "tail", 2).otherwise(1)))
    return spark.createDataFrame([(seen["value"],)], "value string"), lines.select(F.explode(F.variant_get(held(spot), "$.s", "array<variant>")).alias("s"))


def read_dataset(spark: SparkSession, path: str) -> tuple[dict, DataFrame] | None:
    """Envelope and places of one published JSON file; None if it can't be read or is refused.

    Only the envelope, without the spots, comes to the driver. A file as publish() writes it is read by
    ranges in all tasks; one of another layout is one text, which Spark bounds in size."""
    try:
        text, spots = _by_lines(spark, path) or _whole(spark, path)
        doc = text.select(F.try_parse_json("value").alias("d"))
        fields = ("schema", "generatedAt", "region", "attribution", "license", "coverage")
        row = doc.select(*(F.to_json(F.try_variant_get("d", f"$.{f}", "variant")).alias(f) for f in fields), F.try_variant_get("d", "$.spots", "array<variant>").isNotNull().alias("listed")).first()
        envelope = valid_envelope({f: json.loads(row[f]) for f in fields if row[f] is not None}) if row and row["listed"] else None
    except Exception:  # any failure to read means: no dataset
        return None
    if envelope is None:
        return None
    return envelope, valid_spots(spots)


class Loader:
    """Memory, then the stored copy, then the published path. A stored copy answers at once
    and is refreshed once a session; a bad refresh keeps the good copy; failures aren't
    remembered. Callers of one moment share a single load. Nothing raises, and a published
    copy that takes longer than the deadline counts as none."""

    def __init__(self, spark: SparkSession, path: str, stored: str | None = None, deadline_s: float = DEADLINE_S):
        self.spark, self.path, self.stored, self.deadline_s = spark, path, stored, deadline_s
        self.one = threading.RLock()
        self.now: tuple[dict, DataFrame] | None = None
        self.refreshed = False

    def load(self) -> tuple[dict, DataFrame] | None:
        with self.one:
            if self.now is None and self.stored:
                self.now = read_dataset(self.spark, self.stored)
            if self.now is None:
                self.now = self._fetch()
                self.refreshed = self.now is not None
            return self.now

    def refresh(self) -> bool:
        """Once a session: take the published copy if it is good."""
        with self.one:
            if self.refreshed:
                return False
            self.refreshed = True
            new = self._fetch()
            self.now = new or self.now
            return new is not None

    def _fetch(self) -> tuple[dict, DataFrame] | None:
        pool = ThreadPoolExecutor(1)
        try:
            got = pool.submit(read_dataset, self.spark, self.path).result(self.deadline_s)
        except TimeoutError:
            got = None
        pool.shutdown(wait=False)
        if got and self.stored:
            try:
                copy_file(self.spark, self.path, self.stored)
                return read_dataset(self.spark, self.stored) or got  # later reads don't depend on the published path
            except Exception:  # a copy that can't be stored is no failure
                pass
        return got


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object a place, silent fields left out, in the order of (id, kind)."""
    t = F.col("tags")
    tags = F.struct(t["leash_required"].alias("leashRequired"), t["fenced"].alias("fenced"), t["lit"].alias("lit"), t["surface"].alias("surface"))
    return rows.orderBy("id", "kind").select(F.to_json(F.struct("id", "kind", "name", "lat", "lon", tags.alias("tags"), "provenance", "seasonal")).alias("value"))


def publish(rows: DataFrame, coverage: dict, region: str, generated_at: str, path: str, table: str | None = None, gate: bool = True) -> None:
    """Write the single JSON file (and a Parquet table) once the gates have passed.

    The file is for small clients and is one by contract: tasks write its parts in order, and
    one task joins them, byte by byte, into the file; no row passes through the driver. The table
    (``write_table``) is the main store."""
    spark = rows.sparkSession
    if gate:
        assert_sane(rows, region, len(coverage["include"]))
    if table:
        write_table(rows, table)
    head = {"schema": DATASET_SCHEMA, "generatedAt": generated_at, "region": region, "attribution": ATTRIBUTION, "license": LICENSE, "coverage": {k: [[list(p) for p in r] for r in v] for k, v in coverage.items()}}
    start = json.dumps(head, ensure_ascii=False, separators=(",", ":"))[:-1]
    parts, between = shared_path(spark, "published"), ",\n"
    as_json(rows.select(*places.COLUMNS)).write.option("lineSep", between).text(parts)
    join_parts(spark, parts, path, f'{start},"spots":['.encode(), b"]}", len(between))
    delete(spark, parts)


def write_table(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Places in files (``files``, or as many as there are shuffle partitions) along a Hilbert
    curve, each with its range of keys in a table beside them (``path``/_ranges, which Spark's
    readers skip): a row a file."""
    keyed = rows.withColumn("hilbert", curve.hilbert(F.col("lat"), F.col("lon")))
    dealt = keyed.repartitionByRange(files, "hilbert", "id") if files else keyed.repartitionByRange("hilbert", "id")
    dealt.withColumn("file", F.spark_partition_id()).sortWithinPartitions("file", "hilbert").write.mode("overwrite").partitionBy("file").parquet(path)
    ranges = rows.sparkSession.read.schema("hilbert long, file int").parquet(path).groupBy("file").agg(F.min("hilbert").alias("low"), F.max("hilbert").alias("high"))
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{path}/_ranges")


def stored_within(spark: SparkSession, path: str, lat: float, lon: float, radius_m: float, kind: str | None = None) -> DataFrame:
    """``places.within`` of a table of write_table(), from those files only whose keys meet the
    circle's; within a file its statistics leave out more."""
    spans = curve.circle_ranges(lat, lon, radius_m)
    meets = reduce(or_, ((F.col("low") <= b) & (F.col("high") >= a) for a, b in spans))
    files = [r["file"] for r in spark.read.schema("file int, low long, high long").parquet(f"{path}/_ranges").where(meets).select("file").collect()]
    table = spark.read.schema(f"{places.SCHEMA}, hilbert long, file int").parquet(path)
    inside = reduce(or_, (F.col("hilbert").between(a, b) for a, b in spans))
    return places.within(table.where(F.col("file").isin(files) & inside).drop("hilbert", "file"), lat, lon, radius_m, kind)
