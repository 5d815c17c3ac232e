"""Binary extracts through Spark's data source interface.

``spark.read.format("map_extract").load(path)``: a partition is a range of bytes of one file
(option ``span``), so planning reads nothing of the file. A task finds the first block that
starts in its range by the start of its header and walks from block to block by their lengths.
That first block must be followed by another one or the end of the file, and the task of
the range before, which comes to it by lengths, checks that it is the same: so a mark inside
a block, a file that is cut off and any other layout are errors, never lost or wrong rows.

The reader decodes the types of option ``types`` only, and the columns of the given schema:
no node where ways are asked for, no tags where there is no such column. ``read_by_type`` lets
Catalyst choose the types from the filters of a plan. (Spark 4.1 keeps what a Python source's
``pushFilters`` has taken for all scans of one frame, so a self-join with two filters would
lose rows; therefore this source takes none.) Blocks of unknown kinds are passed over."""

from __future__ import annotations

import datetime as dt
import re
import struct
from collections.abc import Collection, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from wayfold.operators.objects import SCHEMA, TYPES
from wayfold.sources import osm_pbf
from wayfold.sources.files import listed, locate

#: Bytes of a range (packed some thirty times as tight as rows, so few bytes are much work); of what
#: is read at once while a block is looked for.
SPAN, PIECE = 4 << 20, 1 << 20
# Fixed values of the format: most bytes of a block's header and of a block.
HEAD_BYTES, BLOCK_BYTES = 64 << 10, 32 << 20
MARK = re.compile(b"\n(?:\x07OSMData|\x09OSMHeader)")
_LONGEST = len(osm_pbf.HEAD)


class Blocks:
    """The blocks of one open file."""

    def __init__(self, stream, size: int):
        self.stream, self.size = stream, size

    def _bytes(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def head(self, at: int) -> tuple[bytes, int, int] | None:
        """Kind, start and end of the block whose header starts at ``at``; None where there is none."""
        raw = self._bytes(at, 4)
        n = struct.unpack(">I", raw)[0] if len(raw) == 4 else 0
        if not 0 < n <= HEAD_BYTES:
            return None
        try:
            m = dict(osm_pbf.fields(self._bytes(at + 4, n)))
            kind, size = bytes(m[1]), m[3]
        except (ValueError, IndexError, KeyError, TypeError):
            return None
        start = at + 4 + n
        return (kind, start, start + size) if 0 <= size <= BLOCK_BYTES and start + size <= self.size else None

    def whole(self, at: int) -> tuple[bytes, int, int]:
        found = self.head(at)
        if not found:
            raise ValueError(f"byte {at}: no block, or its length doesn't agree with the file's")
        return found

    def first(self, a: int, b: int) -> int | None:
        """Where the first block that starts from ``a`` to below ``b`` does, of those that are followed
        by another block or the end."""
        base = a
        while base < b:
            window = self._bytes(base, min(PIECE, b - base) + 4 + _LONGEST)
            for m in MARK.finditer(window, 4):
                at = base + m.start() - 4
                found = self.head(at) if at < b else None
                if found and (found[2] == self.size or self.head(found[2])):
                    return at
            base += PIECE
        return None

    def data(self, a: int, b: int) -> Iterator[bytes]:
        """The blocks of data that start from ``a`` to below ``b``."""
        at = 0 if a == 0 and self.size else self.first(a, b)
        if at is None:
            return
        while at < min(b, self.size):
            kind, start, end = self.whole(at)
            if kind == b"OSMHeader":
                osm_pbf.known_only(osm_pbf.listed_fields(osm_pbf.unpacked(self._bytes(start, end - start))))
            elif kind == b"OSMData":
                yield self._bytes(start, end - start)
            at = end
        while at < self.size and (found := self.whole(at))[0] not in (b"OSMData", b"OSMHeader"):
            at = found[2]
        there = self.first(b, min(at + 1, self.size))
        if there != (at if at < self.size else None):
            raise ValueError(f"lengths lead to byte {at}, marks to {there}: a mark inside a block, or a file that is cut off")


class Range(InputPartition):
    def __init__(self, path: str, a: int, b: int):
        self.path, self.a, self.b = path, a, b


class ExtractReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.span, self.columns = options["path"], int(options.get("span", SPAN)), schema.names
        self.types = [t for t in options.get("types", ",".join(TYPES)).split(",") if t]

    def partitions(self) -> list[Range]:
        store = locate(self.path)[0]
        files = [(p, store.get_file_info(p).size) for name, p in listed(self.path) if not name.startswith((".", "_"))]
        return [Range(p, a, a + self.span) for p, size in files for a in range(0, size, self.span)] if self.types else []

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks so where there is no range at all
            return
        with locate(self.path)[0].open_input_file(partition.path) as f:
            for block in Blocks(f, f.size()).data(partition.a, partition.b):
                yield from osm_pbf.objects_in(block, self.types, self.columns)


class MapExtract(DataSource):
    @classmethod
    def name(cls) -> str:
        return "map_extract"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ExtractReader:
        return ExtractReader(schema, dict(self.options))


def read(spark: SparkSession, path: str, columns: str = SCHEMA, types: Collection[str] = TYPES, span: int = SPAN) -> DataFrame:
    """Objects of an extract, or of all in a folder; ``columns``: those wanted, with their types."""
    spark.dataSource.register(MapExtract)
    return spark.read.format("map_extract").schema(columns).option("types", ",".join(types)).option("span", span).load(path)


def read_by_type(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """The same rows as a union of one scan a type, for plans that filter on ``type``: each
    scan's type is a constant, so Catalyst drops the scans that a filter rules out. Without such a
    filter the file's bytes are read three times."""
    return reduce(DataFrame.unionAll, (read(spark, path, SCHEMA, [t], span).withColumn("type", F.lit(t)) for t in TYPES))


def header_timestamp(path: str) -> str:
    """When an extract was cut from the database, from the first bytes of the file; an error
    where its header doesn't say."""
    store, place = locate(path)
    with store.open_input_file(place) as f:
        found = Blocks(f, f.size()).head(0)
        at = None
        if found and found[0] == b"OSMHeader":
            f.seek(found[1])
            at = osm_pbf.listed_fields(osm_pbf.unpacked(f.read(found[2] - found[1]))).get(32)
    if not at:
        raise ValueError(f"{path}: no timestamp in its header")
    return dt.datetime.fromtimestamp(at[-1], dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
