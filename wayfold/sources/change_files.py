"""Change files as a source of Spark's, at rest and as a stream.

``spark.read.format("change_files")`` and ``spark.readStream.format("change_files")`` with
the option ``path``: a folder of change files (XML, plain or gzipped), each named by its
number. A file is one partition and is scanned once, as a stream of elements.

As a stream the offset is the number of the last file taken. Files are taken in the order of
their numbers and none is left out: a file that arrives before an earlier one waits until
that one is there. Option ``from``: the number of the last file that needn't be read (0 where it is left
out; a restarted stream goes on from its checkpoint). Option ``gaps``: ``wait`` (as above) or
``fail``, which raises where a number is missing below one that is there. Processed files
may go once ``from`` has moved past them.

Rows: the columns of objects, ``op`` (create, modify, delete) and ``seq``, the file's number.
A file that isn't whole XML is an error, and so is a number that two files have.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wayfold.operators.objects import SCHEMA as OBJECTS
from wayfold.sources.files import listed, locate

SCHEMA = f"{OBJECTS}, op string, seq long"
OPS, KINDS = ("create", "modify", "delete"), ("node", "way", "relation")
#: A file's number: the digits before the ending, with those of folders in threes (000/004/711.osc.gz).
NAME = re.compile(r"(?:^|/)((?:\d{3}/)*\d{3}|\d+)\.osc(\.gz)?$")
#: Rows of a batch.
ROWS = 4096


def numbered(path: str) -> dict[int, str]:
    """The change files of a folder by number."""
    out: dict[int, str] = {}
    for _, file in listed(path, below=True):
        found = NAME.search(file)
        if found:
            number = int(found[1].replace("/", "")[-9:])
            if number in out:
                raise ValueError(f"two change files have the number {number}")
            out[number] = file
    return out


def last_without_gap(numbers, start: int, fail: bool = False) -> int:
    """The greatest number up to which all are there, from ``start`` on."""
    last, there = start, set(numbers)
    while last + 1 in there:
        last += 1
    beyond = [n for n in there if n > last]
    if fail and beyond:
        raise ValueError(f"change file {last + 1} is missing, but {min(beyond)} is there")
    return last


def _number(text: str | None, kind):
    return None if text is None or text == "" else kind(text)


def _time(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc) if text else None


def elements(stream, seq: int) -> Iterator[dict]:
    """Rows of one change file, element by element; what has been read is let go."""
    op = None
    root = None
    for event, e in ElementTree.iterparse(stream, events=("start", "end")):
        if event == "start":
            root = e if root is None else root
            op = e.tag if e.tag in OPS else op
            continue
        if e.tag in OPS:
            op = None
            root.clear()
        elif e.tag in KINDS and op:
            tags = {t.get("k"): t.get("v") for t in e.iter("tag") if t.get("k") is not None}  # the last of repeated keys
            yield {
                "type": e.tag,
                "id": _number(e.get("id"), int),
                "version": _number(e.get("version"), int),
                "ts": _time(e.get("timestamp")),
                "lat": _number(e.get("lat"), float) if e.tag == "node" else None,
                "lon": _number(e.get("lon"), float) if e.tag == "node" else None,
                "refs": [_number(n.get("ref"), int) for n in e.iter("nd")] if e.tag == "way" else None,
                "members": [{"type": m.get("type"), "ref": _number(m.get("ref"), int), "role": m.get("role")} for m in e.iter("member")] if e.tag == "relation" else None,
                "tags": list(tags.items()),
                "op": op,
                "seq": seq,
            }
            e.clear()


class ChangeFile(InputPartition):
    def __init__(self, seq: int, path: str):
        self.seq, self.path = seq, path


class _Reading:
    """What both readers share: a partition is a file."""

    def __init__(self, schema: StructType, options: dict):
        self.path, self.schema = options["path"], schema

    def read(self, partition: ChangeFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks so where there is no file at all
            return
        schema = to_arrow_schema(self.schema)
        store = locate(self.path)[0]
        with store.open_input_stream(partition.path, compression=None) as raw:
            stream, rows = gzip.open(raw) if partition.path.endswith(".gz") else raw, []
            for row in elements(stream, partition.seq):
                rows.append(row)
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


class ChangeReader(_Reading, DataSourceReader):
    def partitions(self) -> list[ChangeFile]:
        return [ChangeFile(n, p) for n, p in sorted(numbered(self.path).items())]


class ChangeStream(_Reading, DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.start, self.fail = int(options.get("from", 0)), options.get("gaps", "wait") == "fail"
        self.taken = self.start

    def initialOffset(self) -> dict:
        return {"seq": self.start}

    def latestOffset(self) -> dict:
        self.taken = last_without_gap(numbered(self.path), max(self.start, self.taken), self.fail)
        return {"seq": self.taken}

    def partitions(self, start: dict, end: dict) -> list[ChangeFile]:
        files = numbered(self.path)
        wanted = range(start["seq"] + 1, end["seq"] + 1)
        missing = [n for n in wanted if n not in files]
        if missing:
            raise ValueError(f"change file {missing[0]} has gone before it was read")
        return [ChangeFile(n, files[n]) for n in wanted]

    def commit(self, end: dict) -> None:
        self.taken = max(self.taken, end["seq"])


class ChangeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "change_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ChangeReader:
        return ChangeReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> ChangeStream:
        return ChangeStream(schema, dict(self.options))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All changes of a folder."""
    spark.dataSource.register(ChangeFiles)
    return spark.read.format("change_files").option("path", path).load()


def read_stream(spark: SparkSession, path: str, after: int = 0, gaps: str = "wait") -> DataFrame:
    """The changes of the files after number ``after``, as they arrive in order."""
    spark.dataSource.register(ChangeFiles)
    return spark.readStream.format("change_files").option("path", path).option("from", after).option("gaps", gaps).load()


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def as_xml(changes: DataFrame) -> DataFrame:
    """seq and xml: each change as an element within that of its op."""
    text = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(f' {name}="'), _escaped(v.cast("string")), F.lit('"'))).otherwise("")
    joined = lambda items: F.coalesce(F.array_join(items, ""), F.lit(""))
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    refs = joined(F.transform("refs", lambda r: F.concat(F.lit("<nd"), text("ref", r), F.lit("/>"))))
    members = joined(F.transform("members", lambda m: F.concat(F.lit("<member"), text("type", m["type"]), text("ref", m["ref"]), text("role", m["role"]), F.lit("/>"))))
    tags = joined(F.transform(F.map_entries("tags"), lambda t: F.concat(F.lit("<tag"), text("k", t["key"]), text("v", t["value"]), F.lit("/>"))))
    c = F.col
    xml = F.concat(F.lit("<"), c("op"), F.lit("><"), c("type"), text("id", c("id")), text("version", c("version")), text("timestamp", ts), text("lat", c("lat")), text("lon", c("lon")), F.lit(">"), refs, members, tags, F.lit("</"), c("type"), F.lit("></"), c("op"), F.lit(">"))
    return changes.select("seq", xml.alias("xml"))


def write(changes: DataFrame, folder: str) -> int:
    """One gzipped change file for each number of ``changes``, each by one task that streams it;
    how many there are. A file is moved to its place when it is whole."""
    rows = as_xml(changes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = locate(folder)
        store.create_dir(path, recursive=True)
        now, out, raw, own = None, None, None, None
        done = []

        def end() -> None:
            out.write(b"</osmChange>\n")
            out.close()
            raw.close()
            store.move(own, f"{path}/{now:09d}.osc.gz")
            done.append(now)

        for batch in batches:
            for seq, xml in zip(batch.column(0).to_pylist(), batch.column(1)):
                if seq != now:
                    if out:
                        end()
                    now, own = seq, f"{path}/.{seq}.{uuid.uuid4().hex}"
                    raw = store.open_output_stream(own, compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0)
                    out.write(b'<?xml version="1.0" encoding="UTF-8"?>\n<osmChange version="0.6">\n')
                out.write(xml.as_py().encode() + b"\n")
        if out:
            end()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["seq"])

    return rows.repartition("seq").sortWithinPartitions("seq").mapInArrow(run, "seq long").count()
