"""Files whose schemas have drifted, rewritten to one schema, file by file.

Columns are known by their Parquet field ids, never by name or place: a file may have them
renamed, in another order, of narrower types, or not at all. ``rewrite`` numbers the files of
a folder by rank (a range-partitioned sort whose per-partition counts are prefix-summed), so
that each task of ``mapInArrow`` owns one file. The task streams its file in batches, rebuilds
each column by its id (taken over, cast to the wider type, or filled with the id's default
where the file has none), and puts a whole new file in place of the old one by one move. Files
that have the schema already stay untouched. Columns without an id, or of an id that the
schema hasn't got, go.

What the files were is written down before the first one is replaced, so a run that dies
can be run again, and a task that runs twice finds a file that it may rebuild once more to
the same rows. Nothing that grows with rows passes through the driver: a row a file does.

``write_sorted`` makes such files: rows in the order of keys, so many to a file, each
file by one task that streams it, in a schema that may depend on the file's number.

Nulls stay nulls (a column that a file hasn't got gets its default in every row). Null keys
sort first; ties of the keys are ordered by a hash of the columns, rows equal in all of them
are interchangeable. An empty table gives no files, an empty folder no rows; a file without
rows is rewritten like others. Values that a cast can't hold are an error, not a wrong value. Texts of
any length are whole. Extra columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain
from math import floor, isfinite

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import cut, drop
from wayfold.llm.stored import committed, locate, ranks

#: Rows that a task reads or writes at once.
BATCH = 16_384
_ID = b"PARQUET:field_id"


@dataclass(frozen=True)
class Column:
    """A column of the schema that files are rewritten to; ``default`` fills its absence."""

    id: int
    name: str
    type: pa.DataType
    default: object = None

    def field(self, name: str | None = None, type: pa.DataType | None = None) -> pa.Field:
        return pa.field(name or self.name, type or self.type, True, {_ID: str(self.id).encode()})


def schema_of(columns: list[Column]) -> pa.Schema:
    return pa.schema([c.field() for c in columns])


def field_id(field: pa.Field) -> int | None:
    got = (field.metadata or {}).get(_ID)
    return None if got is None else int(got)


def _same(a: pa.Schema, b: pa.Schema) -> bool:
    """Whether names, types, order and ids agree."""
    key = lambda s: [(f.name, f.type, f.nullable, field_id(f)) for f in s]
    return key(a) == key(b)


def rebuilt(batch: pa.RecordBatch, columns: list[Column]) -> pa.RecordBatch:
    """A batch of any drifted file in the columns' schema."""
    at = {field_id(f): i for i, f in enumerate(batch.schema)}
    made = []
    for c in columns:
        if c.id in at:
            made.append(batch.column(at[c.id]).cast(c.type))
        elif c.default is None:
            made.append(pa.nulls(batch.num_rows, c.type))
        else:
            made.append(pa.repeat(pa.scalar(c.default, c.type), batch.num_rows))
    return pa.RecordBatch.from_arrays(made, schema=schema_of(columns))


def _opened(uri: str):
    store, path = locate(uri)
    return store.open_input_file(path)


def _streamed(uri: str) -> Iterator[pa.RecordBatch]:
    with _opened(uri) as f:
        yield from pq.ParquetFile(f).iter_batches(BATCH)


def write_sorted(df: DataFrame, keys: list[str], per_file: int, files: int, folder: str, columns: list[Column], drifted: Callable[[int], list[pa.Field]]) -> DataFrame:
    """file_no and path of the files written to ``folder``/data: ``per_file`` rows each, in
    the order of ``keys`` (columns of ``df`` beside those of ``columns``).

    ``drifted``: the fields, with ids, that the file of a number has."""
    names = [c.name for c in columns]
    ranked = ranks(df.select(*keys, *names).withColumn("__rest", F.xxhash64(*names)), [*keys, "__rest"], files)
    dealt = ranked.withColumn("__file", F.floor(F.col("rank") / per_file).cast("int")).select("__file", "rank", *names)
    dealt = dealt.repartitionById(files, F.col("__file")).sortWithinPartitions("__file", "rank")
    plain = schema_of(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (b for b in batches if b.num_rows)
        first = next(stream, None)
        if first is None:
            return
        no = first.column(0)[0].as_py()
        fields = pa.schema(drifted(no))
        uri = f"{folder}/data/file-{no:05d}.parquet"

        def shaped(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = {c.id: batch.column(2 + i).cast(f.type) for i, (c, f) in enumerate(zip(columns, plain))}
            return pa.RecordBatch.from_arrays([own[field_id(f)].cast(f.type, safe=not pa.types.is_float32(f.type)) for f in fields], schema=fields)

        with committed(uri, f"{folder}/attempts") as out, pq.ParquetWriter(out, fields) as writer:
            for batch in chain([first], stream):
                if batch.column(0)[0].as_py() != no or batch.column(0)[-1].as_py() != no:
                    raise ValueError("a task got rows of two files")
                writer.write_batch(shaped(batch))
        yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([uri])], names=["file_no", "path"])

    return cut(dealt.mapInArrow(run, "file_no int, path string"), "written")


def numbered(paths: DataFrame) -> DataFrame:
    """path and number (from 0, in the order of paths) of each path, written."""
    out = ranks(paths.select("path").distinct(), ["path"], 16)
    return cut(out.select("path", F.col("rank").cast("int").alias("number")), "files")


def _one_task_each(files: DataFrame) -> DataFrame:
    """Rows with path and number dealt so that each task owns one."""
    return files.repartitionById(max(1, files.count()), F.col("number"))


def data_files(spark: SparkSession, folder: str) -> DataFrame:
    """path of the data files below ``folder``/data, as Spark lists them; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/data").select("path")


def rewrite(files: DataFrame, folder: str, columns: list[Column]) -> DataFrame:
    """path, number, start_columns, columns, rewritten of every file of ``files`` (numbered),
    which all have the columns' schema then. Runs when called."""
    target = schema_of(columns)
    listed = ",".join(target.names)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, same = [], []
            for uri in batch.column("path").to_pylist():
                with _opened(uri) as f:
                    schema = pq.ParquetFile(f).schema_arrow
                names.append(",".join(schema.names))
                same.append(_same(schema, target))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(same, pa.bool_())], names=["path", "number", "start_columns", "same"])

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, same in zip(batch.column("path").to_pylist(), batch.column("same").to_pylist()):
                if not same:
                    with committed(uri, f"{folder}/attempts") as out, pq.ParquetWriter(out, target) as writer:
                        for piece in _streamed(uri):
                            writer.write_batch(rebuilt(piece, columns))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.repeat(listed, batch.num_rows), pc.invert(batch.column("same"))], names=["path", "number", "start_columns", "columns", "rewritten"])

    before = cut(_one_task_each(files.select("path", "number")).mapInArrow(look, "path string, number int, start_columns string, same boolean"), "before")
    after = cut(_one_task_each(before).mapInArrow(replace, "path string, number int, start_columns string, columns string, rewritten boolean"), "rewritten")
    drop(before)
    return after


def _texts(column: pa.Array, scale: int | None) -> list[str]:
    """Values as text; ``scale``: integer floor(scale * x) of doubles."""
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us")).cast(pa.int64())
    out = column.to_pylist()
    if scale and pa.types.is_floating(column.type):
        return ["?" if x is None else str(floor(scale * x)) if isfinite(x) else str(x) for x in out]
    return ["?" if x is None else str(x) for x in out]


def contents(files: DataFrame, key: str, scale: int) -> DataFrame:
    """path, n_rows, n_nulls, ids_sha256, rows_sha256 of every file, read again as a stream:
    hashes of the values of ``key``, comma-joined, and of the rows, newline-joined (fields
    joined by ``|``, null ``?``, doubles as floor(scale * x), times in microseconds)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                n, nulls, ids, rows = 0, 0, sha256(), sha256()
                for piece in _streamed(uri):
                    texts = [_texts(c, scale) for c in piece.columns]
                    of = texts[piece.schema.get_field_index(key)]
                    ids.update(("," * bool(n) + ",".join(of)).encode())
                    rows.update(("\n" * bool(n) + "\n".join(map("|".join, zip(*texts)))).encode())
                    n, nulls = n + piece.num_rows, nulls + sum(c.null_count for c in piece.columns)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (uri, n, nulls, ids.hexdigest(), rows.hexdigest())], names=["path", "n_rows", "n_nulls", "ids_sha256", "rows_sha256"])

    return _one_task_each(files.select("path", "number")).mapInArrow(run, "path string, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string")


#: The evolved schema of clients: field ids, names, types, and what stands for a missing column.
CLIENTS = [
    Column(1, "client_id", pa.int64()),
    Column(2, "master_id", pa.int64()),
    Column(3, "source", pa.string()),
    Column(4, "updated_at", pa.timestamp("us")),
    Column(5, "name", pa.string()),
    Column(6, "email", pa.string()),
    Column(7, "city", pa.string()),
    Column(8, "nation_id", pa.int64(), -1),
    Column(9, "segment", pa.string(), "none"),
    Column(10, "balance", pa.float64()),
]


def version_of(file_no: int) -> int:
    v = zlib.crc32(f"19:{file_no}".encode()) % 24
    return 0 if v > 15 else v


def drifted_clients(file_no: int) -> list[pa.Field]:
    """The fields of a starting file: bits 1 (two names swapped), 2 (reversed after the
    first), 4 (two columns missing), 8 (two narrower types) of its version."""
    v = version_of(file_no)
    names = {"name": "email", "email": "name"} if v & 1 else {}
    types = {"balance": pa.float32(), "nation_id": pa.int32()} if v & 8 else {}
    fields = [c.field(names.get(c.name), types.get(c.name)) for c in CLIENTS if not (v & 4 and c.name in ("nation_id", "segment"))]
    return [fields[0], *reversed(fields[1:])] if v & 2 else fields


def rewrite_clients(clients: DataFrame, folder: str, most_files: int = 250) -> DataFrame:
    """The digest of a rewrite: clients sorted by the CRC-32 of their ids and written in files
    of drifted schemas, these rewritten in place, and what the final files hold."""
    spark = clients.sparkSession
    rows = clients.select(*(F.col(c.name) for c in CLIENTS)).withColumns({"__crc": F.crc32(F.col("client_id").cast("string").cast("binary")), "__id": F.col("client_id")})
    n = clients.count()
    per_file = 1 + n // most_files
    files = -(-n // per_file)
    if not files:
        return spark.createDataFrame([], "file_no long, version long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean")
    written = write_sorted(rows, ["__crc", "__id"], per_file, files, folder, CLIENTS, drifted_clients)
    names = numbered(written)
    done = rewrite(names, folder, CLIENTS)
    held = cut(contents(names, "client_id", 1 << 20), "contents")
    drop(written)
    drop(names)
    number = F.regexp_extract("path", r"file-(\d+)\.parquet$", 1).cast("long")
    version = F.crc32(F.concat(F.lit("19:"), F.col("file_no").cast("string")).cast("binary")) % 24
    out = done.join(held, "path").withColumn("file_no", number).withColumn("version", F.when(version > 15, F.lit(0).cast("long")).otherwise(version))
    return out.select("file_no", "version", "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten")
