"""Position fixes, at rest or as a stream, as events of the session machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "session string, seq long, ts timestamp, lat double, lon double, accuracy double, error_code int"

# Failure codes of positioning devices, and what stands for any other.
REASONS = {1: "PERMISSION_DENIED", 2: "POSITION_UNAVAILABLE", 3: "TIMEOUT"}
ANY_REASON = "POSITION_UNAVAILABLE"


def read_fixes(spark: SparkSession, path: str) -> DataFrame:
    """Fixes and failures of a folder of JSON lines."""
    return clean(spark.read.schema(SCHEMA).json(path))


def stream_fixes(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """The same as a stream of the files that arrive."""
    return clean(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).json(path))


def accuracy_m(accuracy: Column) -> Column:
    """The accuracy in metres; what a device leaves out or gives as no number is unknown."""
    return F.when(accuracy.isNotNull() & ~F.isnan(accuracy) & (F.abs(accuracy) < float("inf")), accuracy)


def clean(rows: DataFrame) -> DataFrame:
    return rows.withColumn("accuracy", accuracy_m(F.col("accuracy")))


def events(fixes: DataFrame) -> DataFrame:
    """session, seq, kind and payload of each fix or failure; a row that is neither goes."""
    known = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    reason = F.coalesce(F.element_at(known, F.col("error_code")), F.lit(ANY_REASON))
    fixed = F.col("error_code").isNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    kind = F.when(fixed, "position-fixed").when(F.col("error_code").isNotNull(), "location-failed")
    payload = F.when(fixed, F.to_json(F.struct("lat", "lon", "accuracy"))).otherwise(F.to_json(F.struct(reason.alias("reason"))))
    return fixes.select("session", "seq", kind.alias("kind"), payload.alias("payload")).where("kind is not null")
