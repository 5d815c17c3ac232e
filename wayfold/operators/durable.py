"""Lineage cuts: frames written to the folder that all executors share, and read back."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame


#: Folders that durable() has written and nobody has deleted.
_WRITTEN: set[str] = set()


def durable(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a frame that is used more than once to the shared folder and read it back.

    Later reads depend neither on an executor's disk nor on what came before."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._wayfold_path = path  # for release()
    return out


def shared_dir(spark) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a folder in the warehouse serves
    a session on one machine, and is an error on a cluster, whose executors might not share it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return path.rstrip("/")


def shared_path(spark, name: str) -> str:
    """A new path below shared_dir(); clear() deletes what is written there."""
    path = f"{shared_dir(spark)}/wayfold-{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def release(*frames: DataFrame | None) -> None:
    """Delete the folders behind frames that durable() returned, once nothing reads them."""
    for df in frames:
        path = getattr(df, "_wayfold_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
    _WRITTEN.discard(path)


def clear(spark) -> int:
    """Delete what durable() has written in this process and nobody has released. A job calls
    it once its results are written, for they may read some of it."""
    paths = sorted(_WRITTEN)
    for path in paths:
        delete(spark, path)
    return len(paths)
