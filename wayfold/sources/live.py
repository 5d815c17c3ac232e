"""Answers of a live map query: elements in JSON to places.

An element needs a type, a number and a point: its own position or else its centre, always as
a pair. Of elements that repeat an id the first counts. An answer with a remark is partial and
is refused as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import errors, tags
from wayfold.operators import places

_NUMBER = "^(BIGINT|DOUBLE|DECIMAL|FLOAT)"


def elements(answers: DataFrame) -> DataFrame:
    """n (place in the answer), id, lat, lon, tags from a text column ``body``."""
    doc = answers.select(F.try_parse_json("body").alias("d"))
    remark = errors.kind_of_remark(F.try_variant_get("d", "$.remark", "string"))
    listed = F.try_variant_get("d", "$.elements", "array<variant>")
    refused = F.coalesce(remark, F.when(listed.isNull(), "malformed-response"))
    whole = doc.select(F.when(refused.isNull(), listed).otherwise(F.raise_error(F.concat(F.lit("refused answer: "), refused)).cast("array<variant>")).alias("e"))
    one = whole.select(F.posexplode("e").alias("n", "e"))
    kind = lambda p: F.schema_of_variant(F.try_variant_get("e", p, "variant"))
    number = lambda p: F.when(kind(p).rlike(_NUMBER), F.try_variant_get("e", p, "double"))

    def point(prefix: str):
        lat, lon = number(f"{prefix}.lat"), number(f"{prefix}.lon")
        return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))

    type_ = F.when(kind("$.type") == "STRING", F.try_variant_get("e", "$.type", "string"))
    id_ = F.when(kind("$.id").rlike(_NUMBER), F.try_variant_get("e", "$.id", "string"))
    texts = F.transform_values(F.map_filter(F.try_variant_get("e", "$.tags", "map<string,variant>"), lambda k, v: F.schema_of_variant(v) == "STRING"), lambda k, v: F.try_variant_get(v, "$", "string"))
    read = one.select("n", F.concat(F.nullif(type_, F.lit("")), F.lit("/"), id_).alias("id"), F.coalesce(point("$"), point("$.center")).alias("at"), F.coalesce(texts, F.create_map().cast("map<string,string>")).alias("tags"))
    return read.where("id is not null and at is not null").select("n", "id", "at.lat", "at.lon", "tags")


def to_places(rows: DataFrame, kind: str) -> DataFrame:
    """Places of one layer; the service has chosen the elements, so only denial drops one.

    The first of each id is found by sorting, for rows with tags can't be aggregated by hash; so rows are dealt
    out by id before, or each task would sort all elements of its answers, which are many times their bytes."""
    tag = tags.of_map("tags")
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    first = dealt.groupBy("id").agg(F.min_by(F.struct("lat", "lon", "tags"), "n").alias("r")).select("id", "r.*")
    grade = F.lit("designated") if kind == tags.PARK else tags.provenance(tag)
    season = F.lit(None).cast(places.seasonal.RULE_TYPE) if kind == tags.PARK else places.seasonal.parse_conditional(tag("dog:conditional"))
    made = first.select("id", F.lit(kind).alias("kind"), F.nullif(tag("name"), F.lit("")).alias("name"), "lat", "lon", tags.display_tags(tag).alias("tags"), grade.alias("provenance"), season.alias("seasonal"))
    return made.where("provenance is not null")


def select_live(rows: DataFrame, lat: float, lon: float, radius_m: float, kind: str) -> DataFrame:
    """The question a live service would answer, over a table of id, lat, lon and tags: all
    clauses as one condition, radius in whole metres, coordinates to seven decimals."""
    tag = tags.of_map("tags")
    chosen = tags.is_dog_park(tag) if kind == tags.PARK else tags.is_bathing_candidate(tag)
    near = places.within(rows.where(chosen), round(lat, 7), round(lon, 7), float(int(radius_m + 0.5)))
    return to_places(near.withColumn("n", F.lit(0)), kind)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """elements() of files that hold one answer each."""
    return elements(spark.read.text(path, wholetext=True).select(F.col("value").alias("body")))
