"""Replication states and the metadata of a filtered state.

The metadata file is written last and is the commit point: a crash before leaves the old
one, and the refresh is replayed."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Versions of the metadata and of the preselection.
META_SCHEMA, FILTER_VERSION = 1, 2


def _instant(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text.replace("Z", "+00:00"))


def parse_state(text: str) -> tuple[int, str]:
    """sequenceNumber and timestamp of a properties text; the last of repeated keys counts."""
    lines = (x.strip() for x in re.split(r"\r?\n", text))
    fields = dict(x.split("=", 1) for x in lines if x and not x.startswith("#") and "=" in x)
    fields = {k: v.replace("\\:", ":") for k, v in fields.items()}
    try:
        number = float(fields["sequenceNumber"].strip() or 0)
        if not number.is_integer():
            raise ValueError
        _instant(fields["timestamp"])
    except (KeyError, ValueError, OverflowError):
        raise ValueError(f"no usable sequence number and timestamp: {text!r}") from None
    return int(number), fields["timestamp"]


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """seq and ts of many state files, read and parsed as a table."""
    lines = F.split("value", r"\r?\n")
    pairs = F.transform(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: ~x.startswith("#") & x.contains("=")), lambda x: F.struct(F.regexp_extract(x, "^([^=]*)=", 1).alias("k"), F.replace(F.regexp_extract(x, "^[^=]*=(.*)$", 1), F.lit("\\:"), F.lit(":")).alias("v")))
    of = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    read = spark.read.text(path, wholetext=True).where(F.size(F.filter(pairs, lambda p: p["k"].isin("sequenceNumber", "timestamp"))) >= 2)
    return read.select(of("sequenceNumber").cast("long").alias("seq"), of("timestamp").cast("timestamp").alias("ts"))


def validate_meta(meta: object) -> dict:
    """The metadata, or an error that says what is wrong with it. ``state``, if it is there,
    names the folder of the state that they belong to."""
    if not isinstance(meta, dict):
        raise ValueError("state metadata is not an object")
    if meta.get("schema") != META_SCHEMA or isinstance(meta.get("schema"), bool):
        raise ValueError(f"state metadata has schema {meta.get('schema')!r}, expected {META_SCHEMA}")
    if meta.get("filterVersion") != FILTER_VERSION:
        raise ValueError(f"filtered under version {meta.get('filterVersion')!r}, now {FILTER_VERSION}: seed anew")
    n = meta.get("sequenceNumber")
    if not isinstance(n, (int, float)) or isinstance(n, bool) or n != int(n) or n < 1:
        raise ValueError(f"no usable sequence number: {n!r}")
    try:
        _instant(meta["timestamp"])
    except (KeyError, ValueError, AttributeError):
        raise ValueError("no usable timestamp") from None
    seeded = meta.get("seededFrom")
    if not isinstance(seeded, list) or not all(isinstance(x, dict) and isinstance(x.get("file"), str) and isinstance(x.get("timestamp"), str) for x in seeded):
        raise ValueError("seededFrom is not a list of {file, timestamp}")
    where = {"state": meta["state"]} if isinstance(meta.get("state"), str) else {}
    return {"schema": META_SCHEMA, "filterVersion": FILTER_VERSION, "sequenceNumber": int(n), "timestamp": meta["timestamp"], "seededFrom": [{"file": x["file"], "timestamp": x["timestamp"]} for x in seeded]} | where


def advanced(meta: dict, sequence: int, timestamp: str) -> dict:
    """The metadata with its cursor moved on; where it was seeded from stays."""
    return meta | {"sequenceNumber": sequence, "timestamp": timestamp}


class TextFile:
    """One file written piece by piece, by Hadoop's file system; it takes the place of an
    earlier one in a single rename when it is closed, and not at all if writing fails."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.jvm, self.gateway, self.conf = jvm, spark.sparkContext._gateway, spark._jsparkSession.sessionState().newHadoopConf()
        self.target, self.part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
        self.fs = self.target.getFileSystem(self.conf)
        self.out = self.fs.create(self.part, True)

    def write(self, text: str | bytes) -> None:
        self.out.write(bytearray(text.encode() if isinstance(text, str) else text))

    def __enter__(self) -> TextFile:
        return self

    def __exit__(self, failed, *_) -> None:
        self.out.close()
        if failed:
            self.fs.delete(self.part, False)
            return
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        context.rename(self.fs.makeQualified(self.part), self.fs.makeQualified(self.target), how)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, replaced by one overwriting rename: readers see the old or the new."""
    with TextFile(spark, path) as f:
        f.write(text)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of one small file, or None where there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(target) else None


def read_meta(spark: SparkSession, path: str) -> dict:
    return validate_meta(json.loads(spark.read.text(path, wholetext=True).first()[0]))
