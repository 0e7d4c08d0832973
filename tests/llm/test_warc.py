"""Archives: round trip, copies, rolling, equal files from differently split tables, faults."""

import gzip
import hashlib
import os
import random

import pytest

from llm import warc

SCHEMA = "page_id long, url string, html string"


def some_pages():
    rng = random.Random(3)
    rows = [(i, f"http://a.example/{i} é", "".join(rng.choices("abcdefgh <>é", k=rng.randrange(0, 4000)))) for i in range(300)]
    copy, short = "<p>" + "copy " * 40, "<p>small</p>"
    rows += [(i, f"http://b.example/{i}", copy) for i in range(1000, 1400)] + [(i, None, short) for i in range(2000, 2010)]
    rows += [(2500, "u", None), (2501, "line\r\nX-Evil: 1", ""), (None, "n", copy), (None, "n", copy), (1000, "http://b.example/1000", copy),
             (1005, "http://b.example/1005", copy), (None, None, "only without id " * 20), (None, "q", "only without id " * 20)]
    rng.shuffle(rows)
    return rows


def want(rows):
    out = []
    first = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if page_id is not None:
            first[data] = min(page_id, first.get(data, page_id))
    for page_id, _, html in rows:
        data = (html or "").encode()
        to = first.get(data) if len(data) >= 100 and first.get(data) != page_id else None
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def written(spark, rows, folder, parts, **sizes):
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", h long, digest string").repartition(parts)
    warc.write_archive(frame, str(folder), **sizes)
    return {n: (folder / n).read_bytes() for n in sorted(os.listdir(folder)) if n.endswith(".gz")}


def test_round_trip_and_equal_files(spark, tmp_path):
    rows = some_pages()
    one = written(spark, rows, tmp_path / "one", 7, roll_bytes=20_000, shard_bytes=150_000)
    two = written(spark, rows, tmp_path / "two", 2, roll_bytes=20_000, shard_bytes=150_000)
    assert one == two and len({n.split("-")[1] for n in one}) > 2 and any(not n.endswith("-000000.warc.gz") for n in one)
    assert all(len(data) < 20_000 + 8_000 for data in one.values())
    records = warc.read_archive(spark, str(tmp_path / "one")).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=str) == want(rows)
    full = {(r.page_id, bytes(r.payload)) for r in records if r.record_type == "response"}
    assert full <= {(i, (html or "").encode()) for i, _, html in rows}
    ids = {r.record_id for r in records}
    assert len(ids) == len(records) and {r.refers_to_record for r in records if r.refers_to_record} <= ids
    listed = warc.manifest(spark, str(tmp_path / "one")).collect()
    assert {r["name"]: r["sha256"] for r in listed} == {n: hashlib.sha256(d).hexdigest() for n, d in one.items()}
    assert sum(r["records"] for r in listed) == len(rows) and not (tmp_path / "one" / warc.TEMPORARY).exists()


def test_records_are_standard(spark, tmp_path):
    files = written(spark, [(5, "line\r\nX-Evil: 1", "<p>é</p>")], tmp_path / "a", 1)
    (data,) = files.values()
    text = gzip.decompress(data).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: warcinfo\r\n") and "\r\nX-Evil" not in text
    assert text.endswith("\r\nContent-Length: 10\r\n\r\n<p>é</p>\r\n\r\n".replace("10", str(len("<p>é</p>".encode()))))


def test_faults(spark, tmp_path):
    with pytest.raises(Exception):
        warc.read_archive(spark, str(tmp_path / "none")).collect()
    files = written(spark, [(1, "u", "abc" * 100), (2, "u", "abc" * 100)], tmp_path / "b", 1)
    with pytest.raises(FileExistsError):
        written(spark, [(1, "u", "abc")], tmp_path / "b", 1)
    (name, data), = files.items()
    (tmp_path / "b" / "left-over.warc.gz").write_bytes(data)
    assert warc.read_archive(spark, str(tmp_path / "b")).count() == 2
    (tmp_path / "b" / name).write_bytes(data[:-20] + bytes(20))
    with pytest.raises(Exception):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


def test_commit_runs_twice_and_drops_other_attempts(spark, tmp_path):
    folder = tmp_path / "c"
    (folder / warc.TEMPORARY).mkdir(parents=True)
    (folder / warc.TEMPORARY / "part.open").write_bytes(b"new")
    (folder / warc.TEMPORARY / "part.lost").write_bytes(b"lost attempt")
    (folder / "done").write_bytes(b"renamed before the task was repeated")
    rows = [(0, 0, "_temporary/part.open", "part", 3, "x", 1), (1, 0, "_temporary/gone", "done", 3, "x", 1)]
    warc.commit(spark.createDataFrame(rows, warc.FILES), str(folder))
    assert (folder / "part").read_bytes() == b"new" and (folder / "done").exists() and not (folder / warc.TEMPORARY).exists()
    assert warc.manifest(spark, str(folder)).count() == 2


def test_empty_and_long(spark, tmp_path):
    assert written(spark, [], tmp_path / "d", 1) == {}
    assert warc.read_archive(spark, str(tmp_path / "d")).count() == 0
    written(spark, [(1, "u", "long é" * 2_000_000)], tmp_path / "e", 1)
    (row,) = warc.read_archive(spark, str(tmp_path / "e")).collect()
    assert row.payload_bytes == len(("long é" * 2_000_000).encode()) == len(row.payload)
