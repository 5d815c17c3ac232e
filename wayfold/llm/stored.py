"""Files that tasks write and read by themselves in the shared folder: names, commits, ranks.

Tasks reach the folder through ``pyarrow.fs``, so it may be any store that pyarrow knows (a
mounted folder, HDFS, S3, GCS). A file is written under a name of its attempt, in a folder
beside the data, and then moved to its place: a task that dies or runs twice leaves either
no file there or a whole one, and both attempts write the same bytes.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import cut
from wayfold.operators.durable import shared_dir


def new_folder(spark, name: str) -> str:
    """The URI of a new folder under spark.checkpoint.dir, which stays."""
    return f"{shared_dir(spark)}/wayfold-{name}-{uuid.uuid4().hex}"


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, or of an absolute path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def committed(uri: str, attempts: str) -> Iterator:
    """A stream whose bytes are at ``uri`` once the block has ended without an error.

    ``attempts``: a folder beside the data, for what isn't finished."""
    store, path = locate(uri)
    _, work = locate(attempts)
    own = posixpath.join(work, f"{posixpath.basename(path)}.{uuid.uuid4().hex}")
    for folder in (work, posixpath.dirname(path)):
        store.create_dir(folder, recursive=True)
    try:
        with store.open_output_stream(own) as out:
            yield out
    except BaseException:
        if store.get_file_info(own).type == fs.FileType.File:
            store.delete_file(own)
        raise
    store.move(own, path)


def ranks(df: DataFrame, keys: list[str], ranges: int) -> DataFrame:
    """``df`` with ``rank``, from 0 by ``keys``, without a task that holds more than a range.

    The rows are sorted in ranges of the keys and written with their place, a
    running number within their range; the counts of the ranges, of which there are
    ``ranges`` whatever the size of the table, are summed up to where each starts."""
    dealt = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    dealt = cut(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    counts = dealt.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    out = dealt.withColumn("__part", part).join(F.broadcast(starts), "__part")
    rank = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn("rank", rank).drop("__part", "__at", "__start")
