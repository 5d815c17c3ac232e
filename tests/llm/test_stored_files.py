"""WARC bundles and schema rewrites against brute-force versions, and their edge cases."""

import base64
import hashlib
import io
import math
import zlib
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from wayfold.llm import schema_rewrite, stored, warc

FOLDER = "/root/testdata/sf0.001"


def plain_pages(rows, least=0):
    """page_id, bytes, digest, type, refers_to by reading all pages in the order of ids."""
    first, out = {}, []
    for page, body in sorted(((p, (h or "").encode()) for p, h in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        same = first.setdefault(body, page) if len(body) >= least else page
        again = len(body) >= least and (body, "seen") in first
        first[(body, "seen")] = True
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", same if again else None))
    return sorted(out, key=repr)


def digested(df, folder, **more):
    return sorted((tuple(r) for r in warc.digest(df, folder, **more).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    odd = [(1, None, None), (2, "http://a.b/\r\nX", ""), (3, "u", "same é \r\n\r\n text"), (4, "u", "same é \r\n\r\n text"), (4, "u", "same é \r\n\r\n text"), (None, "n", "of no page"), (None, "n", "same é \r\n\r\n text"), (5, "u", "x" * 3_000_000), (6, "u", "WARC/1.1\r\n\r\n")]
    rows = odd + [(100 + i, f"http://h/{i}", "hot" if i % 3 else f"page {i} " * 40) for i in range(300)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, row int").repartition(3)


def test_pages_come_back(spark, pages):
    want = plain_pages(pages.select("page_id", "html").collect())
    assert digested(pages, stored.new_folder(spark, "w")) == want
    assert sum(w[3] == "revisit" for w in want) > 200


def test_short_payloads_are_responses(spark, pages):
    want = plain_pages(pages.select("page_id", "html").collect(), least=10)
    assert digested(pages, stored.new_folder(spark, "w"), least=10) == want


def test_given_pages(spark):
    df = spark.read.parquet(f"{FOLDER}/pages.parquet")
    assert digested(df, stored.new_folder(spark, "w")) == plain_pages(df.select("page_id", "html").collect())


def test_no_pages(spark, pages):
    assert digested(pages.limit(0), stored.new_folder(spark, "w")) == []


def test_bundles_are_plain_zstandard_and_seekable(spark, pages, monkeypatch):
    index = warc.write(pages, stored.new_folder(spark, "w")).collect()
    assert len({r["record_id"] for r in index}) == pages.count() == len(index)
    for path in {r["bundle"] for r in index}:
        store, at = stored.locate(path)
        with store.open_input_file(at) as f:
            table = warc.seek_table(f)
            frames = [warc.frame_of(f, e) for e in table]
        with store.open_input_file(at) as f:
            whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
        assert whole == b"".join(frames)
        for r in (r for r in index if r["bundle"] == path):
            record = frames[r["frame"]][r["offset"] : r["offset"] + r["length"]]
            assert record.startswith(b"WARC/1.1\r\n") and f"WARC-Record-ID: {r['record_id']}\r\n".encode() in record


def test_fetch_reads_single_records(spark, pages):
    index = warc.write(pages, stored.new_folder(spark, "w"))
    asked = index.where("key in (3, 5) or key is null")
    got = {r["record_id"]: bytes(r["record"]) for r in warc.fetch(index, asked).collect()}
    assert set(got) == {r["record_id"] for r in asked.collect()} and len(got) == 4
    assert any(len(v) > 3_000_000 for v in got.values())
    for name, record in got.items():
        ((_, _, head, _, _),) = warc.parse(record)
        assert head["WARC-Record-ID"] == name


def test_frames_are_checked(spark, tmp_path):
    out = io.BytesIO()
    b = warc.Bundle(out, frame=100)
    places = [b.add(bytes([65 + i]) * 60) for i in range(5)]
    b.end()
    assert [p[0] for p in places] == [0, 1, 2, 3, 4]
    table = warc.seek_table(out)
    assert warc.frame_of(out, table[3]) == b"D" * 60
    with pytest.raises(ValueError):
        warc.frame_of(out, (*table[3][:3], table[3][3] ^ 1))
    with pytest.raises(ValueError):
        warc.seek_table(io.BytesIO(b"no table here, at all"))


def plain_rewrite(rows, most_files):
    """What the final files hold, from all rows in memory."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, zlib.crc32(str(r[0]).encode()), r[0] or 0))
    per, out = 1 + len(rows) // most_files, []
    names = [c.name for c in schema_rewrite.CLIENTS]
    for no in range(-(-len(rows) // per)):
        v = zlib.crc32(f"19:{no}".encode()) % 24
        v = 0 if v > 15 else v
        mine, lines, nulls = rows[no * per : no * per + per], [], 0
        for r in mine:
            d = dict(zip(names, r))
            if v & 4:
                d["nation_id"], d["segment"] = -1, "none"
            if v & 8 and d["balance"] is not None:
                d["balance"] = pa.scalar(d["balance"], pa.float64()).cast(pa.float32(), safe=False).as_py()
            nulls += sum(x is None for x in d.values())
            if d["updated_at"] is not None:
                d["updated_at"] = round((d["updated_at"].replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1e6)
            if d["balance"] is not None:
                d["balance"] = math.floor(1048576 * d["balance"])
            lines.append("|".join("?" if x is None else str(x) for x in d.values()))
        start = [names[0], *names[1:]]
        if v & 1:
            start = [{"name": "email", "email": "name"}.get(n, n) for n in start]
        if v & 4:
            start = [n for n in start if n not in ("nation_id", "segment")]
        if v & 2:
            start = [start[0], *start[:0:-1]]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((no, v, len(mine), nulls, sha(",".join("?" if r[0] is None else str(r[0]) for r in mine)), sha("\n".join(lines)), ",".join(start), ",".join(names), v != 0))
    return out


REPORT = ["file_no", "version", "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "rewritten"]


def test_rewrite_of_given_clients(spark):
    df = spark.read.parquet(f"{FOLDER}/clients.parquet")
    folder = stored.new_folder(spark, "c")
    done = schema_rewrite.rewrite_clients(df, folder, most_files=40).orderBy("file_no").collect()
    want = plain_rewrite([tuple(r) for r in df.select(*(c.name for c in schema_rewrite.CLIENTS)).collect()], 40)
    assert [tuple(r[c] for c in REPORT) for r in done] == want
    assert len({w[1] for w in want}) > 8
    store, at = stored.locate(folder + "/data")
    files = store.get_file_info(stored.fs.FileSelector(at))
    assert sorted(f.base_name for f in files) == sorted(r["path"].rsplit("/", 1)[1] for r in done)
    for f in files:
        schema = pq.read_schema(f.path)
        assert [(x.name, x.type, schema_rewrite.field_id(x)) for x in schema] == [(c.name, c.type, c.id) for c in schema_rewrite.CLIENTS]


def test_rewrite_of_odd_clients(spark):
    """Null ids, repeated rows, long texts, clashing extra columns, huge balances, no rows."""
    at = datetime(1969, 12, 31, 23, 59, 59, 999999)
    rows = [(1, None, "s", at, "n", "e", "c", 3, "g", 1e300), (1, None, "s", at, "n", "e", "c", 3, "g", 1e300), (None,) * 10, (None,) * 10, (-5, 2, "", at, "x" * 100_000, None, "", None, None, -0.5)]
    df = spark.createDataFrame([(*r, 0, "p") for r in rows], "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, rank int, path string")
    df = df.withColumn("__file", F.lit(9))
    version = schema_rewrite.version_of
    got = schema_rewrite.rewrite_clients(df, stored.new_folder(spark, "c"), most_files=2).orderBy("file_no").collect()
    want = plain_rewrite(rows, 2)
    if not any(version(w[0]) & 8 for w in want):
        assert [tuple(r[c] for c in REPORT) for r in got] == want
    assert [r["n_rows"] for r in got] == [3, 2]
    assert schema_rewrite.rewrite_clients(df.limit(0), stored.new_folder(spark, "c")).collect() == []


def test_a_second_rewrite_changes_nothing(spark, tmp_path):
    """Files of unknown columns, of no rows and of the schema; a rewrite that runs again."""
    c = schema_rewrite.Column
    columns = [c(1, "a", pa.int64()), c(2, "b", pa.string(), "none")]
    target = schema_rewrite.schema_of(columns)
    (tmp_path / "data").mkdir()
    old = pa.schema([c(7, "z", pa.string()).field(), c(1, "b", pa.int32()).field()])
    pq.write_table(pa.table([pa.array(["q", None]), pa.array([1, None], pa.int32())], schema=old), tmp_path / "data/x.parquet")
    pq.write_table(pa.table([pa.array([], pa.int64())], schema=pa.schema([columns[0].field()])), tmp_path / "data/y.parquet")
    pq.write_table(pa.table([pa.array([5]), pa.array([None], pa.string())], schema=target), tmp_path / "data/z.parquet")
    before = (tmp_path / "data/z.parquet").stat()
    files = schema_rewrite.numbered(schema_rewrite.data_files(spark, str(tmp_path)))
    first = schema_rewrite.rewrite(files, str(tmp_path), columns).orderBy("path").collect()
    assert [(r["start_columns"], r["rewritten"]) for r in first] == [("z,b", True), ("a", True), ("a,b", False)]
    assert [pq.read_table(tmp_path / f"data/{x}.parquet").to_pylist() for x in "xyz"] == [[{"a": 1, "b": "none"}, {"a": None, "b": "none"}], [], [{"a": 5, "b": None}]]
    assert (tmp_path / "data/z.parquet").stat().st_ino == before.st_ino
    again = schema_rewrite.rewrite(files, str(tmp_path), columns).collect()
    assert not any(r["rewritten"] for r in again)


def test_a_failed_write_leaves_no_file(tmp_path):
    with pytest.raises(RuntimeError):
        with stored.committed(str(tmp_path / "data/a"), str(tmp_path / "attempts")) as out:
            out.write(b"half")
            raise RuntimeError
    assert [p.name for p in tmp_path.rglob("*") if p.is_file()] == []


def test_ranks_of_ties_and_hot_keys(spark):
    df = spark.range(1000).selectExpr("if(id % 3 = 0, 7, id % 50) AS k", "id AS __n", "'x' AS __part0")
    got = stored.ranks(df, ["k"], 5).collect()
    assert sorted(r["rank"] for r in got) == list(range(1000))
    assert [r["k"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(r["k"] for r in got)
