"""Whole files that one task streams, where a format is one file by contract."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

#: Bytes copied at once.
PIECE = 8 << 20


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, or of an absolute path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def listed(uri: str, below: bool = False) -> list[tuple[str, str]]:
    """Name (from the folder on) and path of the files in a folder, and with ``below`` in those
    in it, by name; a file lists itself; none where there is nothing."""
    store, path = locate(uri)
    if store.get_file_info(path).type == fs.FileType.File:
        return [(posixpath.basename(path), path)]
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=below))
    return sorted((f.path.removeprefix(path).lstrip("/"), f.path) for f in found if f.type == fs.FileType.File)


def join_parts(spark: SparkSession, parts: str, target: str, head: bytes, tail: bytes, cut_off: int) -> None:
    """Write ``head``, the bytes of all part files of the folder ``parts`` in the order of
    their names but for the last ``cut_off`` ones, and ``tail``, as the file ``target``.

    One task copies the bytes piece by piece, to a name of its attempt, and moves the file to
    its place when it is whole; the driver sees none of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            store, path = locate(target)
            store.create_dir(posixpath.dirname(path), recursive=True)
            own, source = f"{path}.{uuid.uuid4().hex}.part", locate(parts)[0]
            with store.open_output_stream(own) as out:
                out.write(head)
                held = b""  # what may still have to be cut off
                for name, part in listed(parts):
                    if not name.startswith("part-"):
                        continue
                    with source.open_input_stream(part) as f:
                        while piece := f.read(PIECE):
                            held += piece
                            out.write(held[: len(held) - cut_off])
                            held = held[len(held) - cut_off :]
                out.write(tail)
            store.move(own, path)
            yield batch

    spark.range(1).coalesce(1).mapInArrow(run, "id long").count()


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    """A copy of one file, made by one task, whole or not at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, path), (store, to) = locate(source), locate(target)
            store.create_dir(posixpath.dirname(to), recursive=True)
            own = f"{to}.{uuid.uuid4().hex}.part"
            with a.open_input_stream(path) as f, store.open_output_stream(own) as out:
                while piece := f.read(PIECE):
                    out.write(piece)
            store.move(own, to)
            yield batch

    spark.range(1).coalesce(1).mapInArrow(run, "id long").count()
