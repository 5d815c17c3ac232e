"""Map objects in the binary extract format (blocks of protocol buffers), read and written.

A file is a run of blocks, each behind a small header that starts with its kind. That start
serves as the record mark of Spark's text reader, so files of any size and on any file system
are split among tasks, and no index of blocks is made first. A record is what lies between two
marks: the rest of a header, its block, and the four bytes of length before the next
header. Lengths are checked, so a mark inside a block (or another layout) is an error, never a
wrong row.
"""

from __future__ import annotations

import datetime as dt
import itertools
import lzma
import struct
import uuid
import zlib
from collections.abc import Collection, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.durable import delete, shared_path
from wayfold.operators.objects import SCHEMA, TYPES
from wayfold.sources.files import join_parts, locate

# Fixed values of the format: starts of block headers, features that a reader must know.
DATA, HEAD = b"\n\x07OSMData", b"\n\x09OSMHeader"
KNOWN = {"OsmSchema-V0.6", "DenseNodes"}

_BYTES = [bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7]) for n in range(1 << 14)]

#: Objects and bytes of a written block at most (one object may be larger).
BLOCK_ROWS, BLOCK_BYTES = 8_000, 16 << 20

_ARROW = pa.schema(
    {
        "type": pa.string(),
        "id": pa.int64(),
        "version": pa.int32(),
        "ts": pa.timestamp("us", "UTC"),
        "lat": pa.float64(),
        "lon": pa.float64(),
        "refs": pa.list_(pa.int64()),
        "members": pa.list_(pa.struct({"type": pa.string(), "ref": pa.int64(), "role": pa.string()})),
        "tags": pa.map_(pa.string(), pa.string()),
    }
)


def _varint(data: bytes | memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes | memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """Number and value of each field of a message: an unsigned integer or bytes."""
    data, at = memoryview(data), 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            if wire == 2:
                size, at = _varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
            else:
                raise ValueError("a message is broken")
            value, at = data[at : at + size], at + size
            if at > len(data):
                raise ValueError("a message is cut off")
        yield key >> 3, value


def _message(data: bytes | memoryview) -> dict[int, int | bytes]:
    """The last value of each field: as dict(fields(data)), in one loop, since every object is one."""
    data, at, out = bytes(data), 0, {}
    while at < len(data):
        key, at = (data[at], at + 1) if data[at] < 128 else _varint(data, at)
        wire = key & 7
        if wire in (0, 2):
            value, at = (data[at], at + 1) if data[at] < 128 else _varint(data, at)
        elif wire in (1, 5):
            value = 8 if wire == 1 else 4
        else:
            raise ValueError("a message is broken")
        if wire:
            value, at = data[at : at + value], at + value
            if at > len(data):
                raise ValueError("a message is cut off")
        out[key >> 3] = value
    return out


def _integers(data: memoryview | bytes) -> np.ndarray:
    """A packed list of integers."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first).view(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    """Integers whose lowest bit is their sign."""
    u = x.view(np.uint64)
    return (u >> np.uint64(1)).view(np.int64) ^ -(x & 1)


def _steps(data: memoryview | bytes) -> np.ndarray:
    """Integers of which each is given as its difference from the one before."""
    return np.cumsum(_signed(_integers(data)))


def _few(data: memoryview | bytes) -> list[int]:
    """A packed list of integers, by plain steps while it is short."""
    if len(data) > 200:
        return _integers(data).tolist()
    out, at = [], 0
    while at < len(data):
        value, at = _varint(data, at)
        out.append(_one_long(value))
    return out


def _few_steps(data: memoryview | bytes) -> list[int]:
    return list(itertools.accumulate(map(_one_signed, _few(data)))) if len(data) <= 200 else _steps(data).tolist()


def _one_signed(x: int) -> int:
    return ((x & (1 << 64) - 1) >> 1) ^ -(x & 1)


def _one_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def unpacked(blob: bytes | memoryview) -> bytes | memoryview:
    """The message of a block, plain or compressed."""
    m = _message(blob)
    if 1 in m:
        return m[1]
    if 3 in m:
        return zlib.decompress(m[3])
    if 4 in m:
        return lzma.decompress(m[4])
    for number, codec in ((6, "lz4_raw"), (7, "zstd")):
        if number in m:
            return pa.decompress(pa.py_buffer(m[number]), m[2], codec=codec, asbytes=True)
    raise ValueError("a block is compressed in an unknown way")


class _Block:
    """Objects of one block of data; of the ``types`` and with the ``columns`` that are asked
    for, where they are given: what isn't asked for is not taken apart."""

    def __init__(self, data: bytes | memoryview, types: Collection[str] | None = None, columns: Sequence[str] | None = None):
        self.types, self.columns, self.texts = set(TYPES if types is None else types), list(_ARROW.names if columns is None else columns), []
        self.schema, self.groups = pa.schema([_ARROW.field(c) for c in self.columns]), []
        self.grain, self.date_grain, self.lat, self.lon = 100, 1000, 0, 0
        for number, value in fields(data):
            if number == 1:
                self.texts.append(value)
            elif number == 2:
                self.groups.append(value)
            elif number == 17:
                self.grain = value
            elif number == 18:
                self.date_grain = value
            elif number == 19:
                self.lat = _one_long(value)
            elif number == 20:
                self.lon = _one_long(value)

    @cached_property
    def words(self) -> list[str]:
        return [bytes(s).decode("utf-8", "replace") for n, s in fields(self.texts[-1]) if n == 1] if self.texts else []

    def tags(self, keys, values) -> list[tuple[str, str]]:
        """The last of repeated keys wins."""
        return list({self.words[k]: self.words[v] for k, v in zip(keys, values, strict=True)}.items())

    def own_tags(self, m: dict) -> list[tuple[str, str]] | None:
        if "tags" not in self.columns:
            return None
        return self.tags(_few(m.get(2, b"")), _few(m.get(3, b"")))

    def info(self, m: dict) -> tuple[int | None, int | None]:
        """Version and time in microseconds; null where the file doesn't say (a time of zero is none)."""
        i = _message(m.get(4, b""))
        if i.get(6, 1) == 0:
            raise ValueError("deleted objects: this is a history, not an extract")
        version = _one_long(i.get(1, (1 << 64) - 1))
        return (None if version < 0 else version), (_one_long(i.get(2, 0)) * self.date_grain * 1000 or None)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for group in self.groups:
            found = {number: [] for number in range(1, 5)}
            for number, value in fields(group):
                if number in found:
                    found[number].append(value)
            for dense in found.pop(2):
                if "node" in self.types:
                    yield self.dense(_message(dense))
            for number, kind, made in ((1, "node", self.node), (3, "way", self.way), (4, "relation", self.relation)):
                if found[number] and kind in self.types:
                    columns = dict(zip(_ARROW.names, zip(*(made(_message(m)) for m in found[number]))))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in self.schema], schema=self.schema)

    def dense(self, m: dict) -> pa.RecordBatch:
        ids, info = _steps(m.get(1, b"")), _message(m.get(5, b""))
        words = _integers(m.get(10, b"")) if "tags" in self.columns else ()
        n = len(ids)
        if 6 in info and not _integers(info[6]).all():
            raise ValueError("deleted objects: this is a history, not an extract")
        version = _integers(info[1]) if 1 in info else np.full(n, -1)
        when = _steps(info[2]) if 2 in info else np.zeros(n, np.int64)
        ts = pa.array(when * self.date_grain * 1000, _ARROW.types[3], mask=when == 0)
        tags = [[]] * n
        if len(words):
            ends = np.flatnonzero(words == 0)
            starts = np.concatenate([[0], ends[:-1] + 1])
            if len(ends) != n or ((ends - starts) % 2).any():
                raise ValueError("tags and nodes of a block don't agree")
            for k in np.flatnonzero(ends > starts):
                own = words[starts[k] : ends[k]]
                tags[k] = self.tags(own[::2], own[1::2])
        at = [(base + self.grain * _steps(m.get(number, b""))) / 1e9 for number, base in ((8, self.lat), (9, self.lon))]
        fixed = [pa.array(["node"] * n, pa.string()), pa.array(ids), pa.array(version, pa.int32(), mask=version < 0), ts, *map(pa.array, at)]
        made = dict(zip(_ARROW.names, [*fixed, pa.nulls(n, _ARROW.types[6]), pa.nulls(n, _ARROW.types[7]), pa.array(tags, _ARROW.types[8])]))
        return pa.RecordBatch.from_arrays([made[c] for c in self.columns], schema=self.schema)

    def node(self, m: dict) -> tuple:
        lat, lon = ((base + self.grain * _one_signed(m[number])) / 1e9 for number, base in ((8, self.lat), (9, self.lon)))
        return "node", _one_signed(m[1]), *self.info(m), lat, lon, None, None, self.own_tags(m)

    def way(self, m: dict) -> tuple:
        refs = _few_steps(m.get(8, b"")) or None if "refs" in self.columns else None
        return "way", _one_long(m[1]), *self.info(m), None, None, refs, None, self.own_tags(m)

    def relation(self, m: dict) -> tuple:
        columns = (_few(m.get(10, b"")), _few_steps(m.get(9, b"")), _few(m.get(8, b""))) if "members" in self.columns else ((), (), ())
        members = [{"type": TYPES[t], "ref": ref, "role": self.words[role]} for t, ref, role in zip(*columns, strict=True)]
        return "relation", _one_long(m[1]), *self.info(m), None, None, None, members or None, self.own_tags(m)


def _body(rest: memoryview) -> memoryview:
    """The block behind the rest of its header, whose length must agree with the record's."""
    at = size = 0
    while not size:
        key, at = _varint(rest, at)
        value, at = _varint(rest, at)
        if key == 0x18:
            size = value
        elif key == 0x12:
            at += value
        else:
            raise ValueError("a block's header is broken")
    if len(rest) - at - size not in (0, 4):
        raise ValueError("a block's length doesn't agree with its header")
    return rest[at : at + size]


def listed_fields(message: bytes | memoryview) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in fields(message):
        out.setdefault(number, []).append(value)
    return out


def _head(record: bytes) -> dict[int, list]:
    return listed_fields(unpacked(_body(memoryview(record)[4 + len(HEAD) :])))


def known_only(head: dict[int, list]) -> None:
    """An error where a file's header asks for features that this reader lacks."""
    unknown = {bytes(v).decode() for v in head.get(4, [])} - KNOWN
    if unknown:
        raise ValueError(f"the file asks for {', '.join(sorted(unknown))}")


def decode(record: bytes) -> Iterator[pa.RecordBatch]:
    """The objects of one record; none of a file's first, which says what a reader must know."""
    if record[4 : 4 + len(HEAD)] == HEAD:
        known_only(_head(record))
    else:
        yield from _Block(unpacked(_body(memoryview(record)))).rows()


def objects_in(blob: bytes, types: Collection[str] | None = None, columns: Sequence[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The objects of one stored block, of those types and with those columns."""
    yield from _Block(unpacked(blob), types, columns).rows()


def records(spark: SparkSession, path: str) -> DataFrame:
    """value: the records of the files, as bytes."""
    return spark.read.option("lineSep", DATA.decode()).text(path).select(F.col("value").cast("binary").alias("value"))


def objects_of(blocks: DataFrame) -> DataFrame:
    """All objects of records; empty blocks and blocks of other things give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                yield from decode(value.as_py())

    return blocks.mapInArrow(run, SCHEMA)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """All objects of binary extracts."""
    return objects_of(records(spark, path))


def header_timestamp(spark: SparkSession, path: str) -> str:
    """When an extract was cut from the database; an error where its header doesn't say."""
    first = records(spark, path).where(F.substring("value", 5, len(HEAD)) == F.lit(HEAD)).limit(1).collect()
    at = _head(bytes(first[0][0])).get(32) if first else None
    if not at:
        raise ValueError(f"{path}: no timestamp in its header")
    return dt.datetime.fromtimestamp(_one_long(at[-1]), dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _packed_parts(x) -> tuple[bytes, np.ndarray]:
    """A packed list of integers, and the bytes of each; negative ones take ten."""
    u = np.asarray(x, np.int64).view(np.uint64)
    if len(u) > 1 << 16:  # bounded memory for very long lists
        some = [_packed_parts(u[k : k + (1 << 16)].view(np.int64)) for k in range(0, len(u), 1 << 16)]
        return b"".join(b for b, _ in some), np.concatenate([n for _, n in some])
    parts = (u[:, None] >> np.arange(0, 70, 7, dtype=np.uint64).clip(max=np.uint64(63))) & np.uint64(127)
    size = np.maximum(1, 10 - np.argmax(parts[:, ::-1] != 0, axis=1)) * (u > 0) + (u == 0)
    place = np.arange(10)
    return (parts.astype(np.uint8) | (place < size[:, None] - 1).astype(np.uint8) << 7)[place < size[:, None]].tobytes(), size


def _packed(x) -> bytes:
    return _packed_parts(x)[0]


def _packed_lists(x, ends: np.ndarray) -> list[bytes]:
    """Packed lists of integers that lie behind each other in ``x`` up to ``ends``."""
    whole, size = _packed_parts(x)
    cuts = np.append(0, np.cumsum(size))[ends].tolist()
    return [whole[a:b] for a, b in zip([0, *cuts], cuts)]


def _steps_of_lists(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Integers as differences from the one before in their list, with the sign as lowest bit."""
    d = np.diff(x, prepend=0)
    starts = np.append(0, ends[:-1])
    starts = starts[starts < ends]  # lists that aren't empty
    d[starts] = x[starts]
    return d << 1 ^ d >> 63


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of lists behind each other, and where each list ends; a null is an empty list."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return lists.flatten(), np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64))


def _whole(values: pa.Array) -> np.ndarray:
    if values.null_count:
        raise ValueError("a reference to nothing can't be written")
    return values.to_numpy()


def _packed_steps(x) -> bytes:
    d = np.diff(np.asarray(x, np.int64), prepend=0)
    return _packed(d << 1 ^ d >> 63)


def _coded(n: int) -> bytes:
    if 0 <= n < len(_BYTES):
        return _BYTES[n]
    n, out = n & ((1 << 64) - 1), bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _few_packed(x: list[int]) -> bytes:
    return b"".join(map(_coded, x)) if len(x) <= 100 else _packed(x)


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, bytes):
        return _coded(number << 3 | 2) + _coded(len(value)) + value
    return _coded(number << 3) + _coded(value)


def _stored(kind: str, message: bytes) -> bytes:
    body = _field(2, len(message)) + _field(3, zlib.compress(message))
    head = _field(1, kind.encode()) + _field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def _group(kind: str, rows: pa.Table, words: dict[str, int]) -> bytes:
    """The message of some rows of one type; texts are numbered in ``words``."""
    word = lambda w: words.setdefault(w, len(words))
    ids, version = rows["id"].to_numpy(), rows["version"].fill_null(-1).to_numpy()
    when = rows["ts"].cast(pa.int64()).fill_null(0).to_numpy() // 1_000_000
    tags = [[(word(k), word(v)) for k, v in own or ()] for own in rows["tags"].to_pylist()]
    if kind == "node":
        at = [np.rint(rows[c].to_numpy() * 1e7) for c in ("lat", "lon")]
        if not np.isfinite(at).all():
            raise ValueError("a node without a position can't be written")
        flat = [x for own in tags for x in (*(w for pair in own for w in pair), 0)]
        info = _field(1, _packed(version)) + _field(2, _packed_steps(when))
        body = _field(1, _packed_steps(ids)) + _field(5, info) + b"".join(_field(n, _packed_steps(x)) for n, x in zip((8, 9), at))
        return _field(2, body + _field(10, _packed(flat if any(tags) else [])))
    if kind == "way":
        refs, ends = _flat(rows["refs"])
        bodies = [_field(8, x) for x in _packed_lists(_steps_of_lists(_whole(refs), ends), ends)]
    else:
        held, ends = _flat(rows["members"])
        types, refs, roles = (held.field(c) for c in ("type", "ref", "role"))
        lists = [word(x or "") for x in roles.to_pylist()], _steps_of_lists(_whole(refs), ends), [TYPES.index(x) for x in types.to_pylist()]
        bodies = [b"".join(map(_field, (8, 9, 10), x)) for x in zip(*(_packed_lists(x, ends) for x in lists))]
    out = []
    for own, number, v, t, rest in zip(tags, ids.tolist(), version.tolist(), when.tolist(), bodies):
        body = _field(1, number) + _field(2, _few_packed([k for k, _ in own])) + _field(3, _few_packed([w for _, w in own])) + _field(4, _field(1, v) + _field(2, t)) + rest
        out.append(_field(3 if kind == "way" else 4, body))
    return b"".join(out)


def encode(rows: pa.Table) -> Iterator[bytes]:
    """Stored blocks of objects, halved until they are small enough."""
    if rows.num_rows > BLOCK_ROWS:
        for k in range(0, rows.num_rows, BLOCK_ROWS):
            yield from encode(rows.slice(k, BLOCK_ROWS))
        return
    words = {"": 0}
    types = rows["type"].to_numpy()
    groups = [_group(kind, rows.filter(pa.array(types == kind)), words) for kind in TYPES if (types == kind).any()]
    message = _field(1, b"".join(_field(1, w.encode()) for w in words)) + b"".join(_field(2, g) for g in groups)
    if len(message) > BLOCK_BYTES and rows.num_rows > 1:
        half = rows.num_rows // 2
        yield from encode(rows.slice(0, half))
        yield from encode(rows.slice(half))
    else:
        yield _stored("OSMData", message)


def write_objects(df: DataFrame, path: str, stamp: str | None = None) -> None:
    """One binary extract, nodes first, each type by id, with the time of its header.

    Each task writes the blocks of its rows as a part, and as the format is one file, one task
    joins the parts byte by byte; no block passes through the driver. Times are kept in whole
    seconds, positions in seven decimals; a node without a position is an error. An existing
    file is replaced in one rename."""
    spark = df.sparkSession
    parts = shared_path(spark, "extract-parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = locate(parts)
        store.create_dir(folder, recursive=True)
        place, n = f"{folder}/part-{TaskContext.get().partitionId():06d}", 0
        own = f"{folder}/attempt-{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            for batch in batches:
                for block in encode(pa.Table.from_batches([batch])):
                    out.write(block)
                    n += 1
        if store.get_file_info(place).type == fs.FileType.NotFound:  # else an earlier attempt was whole
            store.move(own, place)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["blocks"])

    plain = df.select(*_ARROW.names[:-1], F.map_entries("tags").alias("tags"))
    rank = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type"))
    blocks = plain.orderBy(rank, "id").select(*plain.columns[:-1], F.transform("tags", lambda t: F.array(t["key"], t["value"])).alias("tags")).mapInArrow(run, "blocks long")
    head = b"".join(_field(4, name.encode()) for name in sorted(KNOWN))
    if stamp:
        head += _field(32, int(dt.datetime.fromisoformat(stamp.replace("Z", "+00:00")).timestamp()))
    blocks.agg(F.sum("blocks")).collect()
    join_parts(spark, parts, path, _stored("OSMHeader", head), b"", 0)
    delete(spark, parts)
