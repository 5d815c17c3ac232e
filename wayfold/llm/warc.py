"""WARC archives in seekable Zstandard bundles.

Every row becomes a WARC/1.1 record: a ``response``, or, where its payload was seen before, a
``revisit`` that names the record it repeats. Of equal payloads of at least ``least`` bytes the
row with the smallest key is the response (of rows that share that key, one of them) and all
others revisit it; smaller payloads are all responses. A revisit holds the HTTP header with the
full payload's length and its digest, but not the payload.

A task writes its records to bundles. A bundle is a row of independent Zstandard frames of
whole records, some ``FRAME`` bytes each, so a reader starts at any of them; it ends with the
seek table of the seekable Zstandard format, a skippable frame that lists the frames' sizes
and check sums, so plain Zstandard readers read a bundle as one WARC file. The index maps a record's
identifier to bundle, frame, and offset and length within the frame.

``read`` deals frames, not bundles, to tasks: it needs the seek tables only. ``fetch`` reads
single records by identifier through the index. Both check frames' sums, and ``read``
payloads' digests against the headers.

Rows are numbered and written first, with their digests; which row revisits which is decided
on digests and row numbers alone, classes of copies joined as in ``with_class``, so a payload
that a third of all rows share gathers in no task. Files are committed by a move (``stored``),
under a name of the attempt; the index names those of the attempts that succeeded, so readers
start from it and never from a listing.

A null payload is empty, and empty payloads are equal; a null key is never preferred to others,
and is given back as null; a null url has no target line. Repeated rows are records each. Texts
of any length are one record in one frame. Line breaks in urls are written percent-encoded. An
empty table gives no bundles and no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import cut, drop, with_class
from wayfold.llm.stored import committed, locate

#: Bytes of records in a frame before it is closed, of a bundle before the next is begun, and level.
FRAME, BUNDLE, LEVEL = 1 << 20, 256 << 20, 3
#: Frames that a task reads, about.
PER_TASK = 16
#: Fixed values of the seekable Zstandard format.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def record_id(key: object, row: int) -> str:
    """The identifier of a record: its key (empty for null) and its row."""
    return f"<urn:x-record:{'' if key is None else key}:{row}>"


def key_of(identifier: str) -> str | None:
    """The key in an identifier."""
    return identifier[len("<urn:x-record:") : -1].rpartition(":")[0] or None


def _record(kind: str, identifier: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", identifier), ("WARC-Date", _DATE), *headers, ("Content-Length", str(len(block)))]
    return b"".join((b"WARC/1.1\r\n", "".join(f"{k}: {v}\r\n" for k, v in lines).encode(), b"\r\n", block, b"\r\n\r\n"))


def make_record(identifier: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response, or a revisit of ``refers_to``."""
    target = [] if url is None else [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))]
    about = [*target, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _record("response", identifier, about, http + payload)
    return _record("revisit", identifier, [*about, ("WARC-Refers-To", refers_to), ("WARC-Profile", _REVISIT)], http)


def _headers(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], dict[str, str], bytes]]:
    """offset, length, WARC headers, HTTP headers and payload of each record in whole records."""
    at = 0
    while at < len(data):
        if data[at : at + 9] != b"WARC/1.1\r":
            raise ValueError(f"no record at byte {at} of a frame")
        body = data.index(b"\r\n\r\n", at) + 4
        warc = _headers(data[at : body - 4])
        end = body + int(warc["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record {warc.get('WARC-Record-ID')} ends at another byte than it says")
        http, payload = {}, data[body:end]
        if warc["WARC-Type"] in ("response", "revisit"):
            cut_at = data.index(b"\r\n\r\n", body) + 4
            http, payload = _headers(data[body : cut_at - 4]), data[cut_at:end]
        yield at, end + 4 - at, warc, http, payload
        at = end + 4


class Bundle:
    """Writes records to frames, and the seek table at the end."""

    def __init__(self, out, frame: int = FRAME):
        self.out, self.most, self.held, self.size, self.written = out, frame, [], 0, 0
        self.entries: list[tuple[int, int, int]] = []
        self.code = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.size and self.size + len(record) > self.most:
            self._close()
        place = len(self.entries), self.size
        self.held.append(record)
        self.size += len(record)
        return place

    def _close(self) -> None:
        data = b"".join(self.held)
        packed = self.code.compress(data)
        self.out.write(packed)
        self.written += len(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def end(self) -> None:
        if self.size:
            self._close()
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), 0x80, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)


def seek_table(f) -> list[tuple[int, int, int, int]]:
    """start, packed size, size and check sum of each frame of an open bundle."""
    f.seek(0, io.SEEK_END)
    end = f.tell()
    f.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != _SEEKABLE or flags != 0x80:
        raise ValueError("no seek table at the end of the bundle")
    f.seek(end - 9 - 12 * count)
    out, start = [], 0
    for packed, size, mark in struct.iter_unpack("<III", f.read(12 * count)):
        out.append((start, packed, size, mark))
        start += packed
    return out


def frame_of(f, entry: tuple[int, int, int, int]) -> bytes:
    """The records of one frame."""
    start, packed, size, mark = entry
    f.seek(start)
    data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=size)
    if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != mark:
        raise ValueError("a frame differs from the seek table")
    return data


def _open(path: str):
    store, at = locate(path)
    return store.open_input_file(at)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def revisits(numbered: DataFrame, least: int) -> DataFrame:
    """row, first_key, first_row of the rows that revisit another, of rows with key, row, n, sha1."""
    some = numbered.where(F.col("n") >= least).select("sha1", "row", "key")
    order = F.struct(F.col("key").isNull(), F.col("key"), F.col("row"))
    classes = some.groupBy("sha1").agg(F.min_by(F.struct("key", "row"), order).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return with_class(some, cut(classes, "payloads"), ["sha1"], "copies").where("row <> first.row").select("row", F.col("first.key").alias("first_key"), F.col("first.row").alias("first_row"))


def write(df: DataFrame, folder: str, least: int = 0, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """Writes the bundles to ``folder``/data; the index: record_id, key, bundle, frame, offset, length. Runs when called."""
    payload = F.coalesce(F.col(text), F.lit("")).cast("binary")
    numbered = cut(df.select(F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("payload")).withColumns({"n": F.octet_length("payload"), "sha1": F.sha1("payload"), "row": F.monotonically_increasing_id()}), "pages")
    again = cut(revisits(numbered, least), "revisits")
    rows = numbered.join(again, "row", "left").select("key", "row", "url", "payload", "sha1", "first_key", "first_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ((batch, i) for batch in batches for i in range(batch.num_rows))
        held = next(stream, None)
        while held is not None:
            uri = f"{folder}/data/bundle-{uuid.uuid4().hex}.warc.zst"
            ids, keys, places = [], [], []
            with committed(uri, f"{folder}/attempts") as out:
                bundle = Bundle(out)
                bundle.add(_record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                while held is not None and bundle.written < BUNDLE:
                    batch, i = held
                    k, row, u, body, sha1, first_key, first_row = (c[i].as_py() for c in batch.columns)
                    first = None if first_row is None else record_id(first_key, first_row)
                    record = make_record(record_id(k, row), u, body, base32(sha1), first)
                    places.append((*bundle.add(record), len(record)))
                    ids.append(record_id(k, row))
                    keys.append(k)
                    held = next(stream, None)
                bundle.end()
            columns = [pa.array(ids, pa.string()), pa.array(keys, batch.column(0).type), pa.repeat(uri, len(ids)), *(pa.array(x, t) for x, t in zip(zip(*places), (pa.int32(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["record_id", "key", "bundle", "frame", "offset", "length"])

    kind = df.schema[key].dataType.simpleString()
    index = cut(rows.mapInArrow(run, f"record_id string, key {kind}, bundle string, frame int, offset long, length long"), "index")
    drop(numbered)
    drop(again)
    return index


def _frames(bundles: DataFrame) -> DataFrame:
    """bundle, frame, start, packed, size, mark of all frames of the bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("bundle").to_pylist():
                with _open(uri) as f:
                    table = seek_table(f)
                columns = [pa.repeat(uri, len(table)), pa.array(range(len(table)), pa.int32()), *(pa.array(c, pa.int64()) for c in zip(*table))]
                yield pa.RecordBatch.from_arrays(columns, names=["bundle", "frame", "start", "packed", "size", "mark"])

    return bundles.mapInArrow(run, "bundle string, frame int, start long, packed long, size long, mark long")


def _by_frame(frames: DataFrame, read, schema: str) -> DataFrame:
    """Calls ``read``(row, data) with each row of ``frames`` (written) and the frame's records,
    some ``PER_TASK`` frames a task."""
    parts = max(1, -(-frames.count() // PER_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != path:
                    if f:
                        f.close()
                    path, f = row["bundle"], _open(row["bundle"])
                yield read(row, frame_of(f, (row["start"], row["packed"], row["size"], row["mark"])))
        if f:
            f.close()

    dealt = frames.repartitionByRange(parts, "bundle", "frame").sortWithinPartitions("bundle", "frame")
    return dealt.mapInArrow(run, schema)


def read(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """record_id, key (text), record_type, refers_to (record_id), url, payload_bytes,
    payload_digest and payload (null in revisits, and without ``payloads``) of all records of ``bundles`` (bundle: distinct paths)."""
    fields = [("record_id", pa.string()), ("key", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]

    def one(row: dict, data: bytes) -> pa.RecordBatch:
        out = []
        for _, _, warc, http, payload in parse(data):
            kind, name = warc["WARC-Type"], warc["WARC-Record-ID"]
            if kind not in ("response", "revisit"):
                continue
            digest, n = warc["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
            if kind == "response" and (n != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError(f"the payload of {name} differs from its header")
            out.append((name, key_of(name), kind, warc.get("WARC-Refers-To"), warc.get("WARC-Target-URI"), n, digest, payload if payloads and kind == "response" else None))
        columns = zip(*out) if out else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    schema = "record_id string, key string, record_type string, refers_to string, url string, payload_bytes long, payload_digest string, payload binary"
    frames = cut(_frames(bundles), "frames")
    return _by_frame(frames, one, schema)


def fetch(index: DataFrame, asked: DataFrame) -> DataFrame:
    """record_id and record (its bytes in the archive) of the asked identifiers: each frame
    that holds any is read once, the others not at all."""
    wanted = index.join(asked.select("record_id").distinct(), "record_id").select("record_id", "bundle", "frame", "offset", "length")
    frames = _frames(wanted.select("bundle").distinct())
    listed = wanted.groupBy("bundle", "frame").agg(F.collect_list(F.struct("record_id", "offset", "length")).alias("records"))  # a frame's, so bounded by FRAME

    def one(row: dict, data: bytes) -> pa.RecordBatch:
        some = row["records"]
        return pa.RecordBatch.from_arrays([pa.array([r["record_id"] for r in some]), pa.array([data[r["offset"] : r["offset"] + r["length"]] for r in some], pa.binary())], names=["record_id", "record"])

    both = cut(listed.join(frames, ["bundle", "frame"]), "frames")
    return _by_frame(both, one, "record_id string, record binary")


def digest(df: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read
    back from archives written to ``folder``."""
    index = write(df, folder, least)
    back = read(index.select("bundle").distinct(), payloads=False)
    kind, of = df.schema["page_id"].dataType, F.regexp_extract("refers_to", r"^<urn:x-record:(.*):\d+>$", 1)
    return back.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.nullif(of, F.lit("")).cast(kind).alias("refers_to"))
