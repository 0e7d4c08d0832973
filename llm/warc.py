"""Writing and reading sharded WARC archives.

Rows are range-sorted by (page_id, hash of url and payload) into shards whose borders depend on the rows alone: among the rows
with the smallest hashes every few-th key is a border. So the same table gives the same files, byte for byte, however
Spark has split it. A task writes its shards one after the other and rolls a file once its compressed size reaches
``roll_bytes``; every record is a gzip member of its own. Files are written under names of the attempt; the rows of the finished
tasks are fixed by a checkpoint, then tasks rename their files, and last of all the manifest is written. An archive without a
manifest is not committed; files that no manifest names are never read.

NULL html is an empty payload, NULL page_id sorts last and is only a response, or a first occurrence, if all its copies lack
one. Rows that repeat the page_id of a response together with its payload are responses too. Addresses are stored with blanks,
controls and other bytes outside ASCII percent-encoded.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faretrace.session import cut_lineage, ensure_checkpoint_dir

#: payloads below this many bytes are always written in full
LEAST_PAYLOAD = 100
#: a file is closed once it holds so many compressed bytes
ROLL_BYTES = 256 << 20
#: payload bytes of a shard, the unit of work of a task, which streams it; beyond ``MOST_SHARDS`` shards grow
SHARD_BYTES, MOST_SHARDS = 32 << 20, 20_000
#: keys drawn for each border between shards
DRAWN = 16
#: all records carry this time, so that archives do not depend on when they were written
DATE = "2000-01-01T00:00:00Z"
#: bytes of payload in a batch of read records
READ_BYTES = 8 << 20
TEMPORARY, MANIFEST = "_temporary", "_manifest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def storage(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that driver and executors share."""
    plain = re.sub(r"^file:/*", "/", folder)
    if plain.startswith("/"):
        return fs.LocalFileSystem(), plain
    return fs.FileSystem.from_uri(plain)


# ---- records -------------------------------------------------------------


def record_id(page_id: int | None, url: str | None, digest: str, times: int = 0) -> str:
    """``times`` counts equal rows before this one."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, json.dumps([page_id, url, digest, times]))}>"


def address(url: str) -> str:
    return "".join(chr(b) if 0x21 <= b < 0x7F else f"%{b:02X}" for b in url.encode())


def record(kind: str, fields: list[tuple[str, str | None]], block: bytes, level: int) -> bytes:
    """One compressed record; its own length and block digest come last in the header."""
    fields = [("WARC-Type", kind), ("WARC-Date", DATE), *fields,
              ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join((packer.compress(f"WARC/1.1\r\n{head}\r\n".encode()), packer.compress(block),
                     packer.compress(b"\r\n\r\n"), packer.flush()))


def page_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, times: int,
                first: tuple[int, str | None] | None, level: int) -> bytes:
    """A response with its payload, or a revisit of ``first`` (page_id, url) with the same HTTP header and none."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id(page_id, url, digest, times)),
              ("WARC-Target-URI", None if url is None else address(url)), ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("Content-Type", "application/http;msgtype=response"),
              ("X-Page-Id", None if page_id is None else str(page_id))]
    if first is None:
        return record("response", fields, http + payload, level)
    first_id, first_url = first
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
               ("WARC-Refers-To", record_id(first_id, first_url, digest)),
               ("WARC-Refers-To-Target-URI", None if first_url is None else address(first_url)),
               ("X-Refers-To-Page-Id", str(first_id))]
    return record("revisit", fields, http, level)


# ---- placing -------------------------------------------------------------


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, payload_bytes, o, h): (o, h) is the order of records, NULL page_ids last; h also draws
    the borders."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.encode("html", "UTF-8"), 256), "payload_bytes": F.octet_length("html").cast("long")})
    return rows.withColumns({"o": F.coalesce("page_id", F.lit((1 << 63) - 1)), "h": F.xxhash64("page_id", "url", "digest")})


def revisits(keys: DataFrame, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """Keys of the rows that another one stands for, with its ``first_id`` and ``first_url``. The first of each payload comes
    from an aggregate combined before its shuffle; payloads themselves do not take part."""
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNotNull().alias("some"), "url")
    firsts = (keys.where(F.col("payload_bytes") >= least_payload).groupBy(F.col("digest").alias("d"))
              .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
              .where("times > 1 AND first.page_id IS NOT NULL").select("d", "first"))
    return (keys.join(firsts, F.expr("digest = d AND NOT (page_id <=> first.page_id)"))
            .select(*keys.columns, F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")))


def borders(keys: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (o, h) at which shards begin: of the ``DRAWN`` x shards keys with the smallest hashes, in order, every
    ``DRAWN``-th. A shard is one task's work, so the driver holds ``DRAWN`` pairs of numbers a task."""
    if shards < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    drawn = keys.select("o", "h").distinct().orderBy(F.xxhash64("h"), "h", "o").limit(shards * DRAWN).toArrow()
    ids, hashes = (drawn.column(c).to_numpy() for c in ("o", "h"))
    order = np.lexsort((hashes, ids))[::max(1, -(-len(ids) // shards))][1:]
    return ids[order], hashes[order]


def _shard_of(o: np.ndarray, h: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Number of borders at or below each key (o, h)."""
    low, high = np.searchsorted(ids, o, "left"), np.searchsorted(ids, o, "right")
    out = low.copy()
    for i in np.flatnonzero(low < high):
        out[i] += np.searchsorted(hashes[low[i]:high[i]], h[i], "right")
    return out


def _placed(rows: DataFrame, ids: np.ndarray, hashes: np.ndarray) -> DataFrame:
    """Rows with their shard."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o, h = (batch.column(c).to_numpy() for c in ("o", "h"))
            at = pa.array(_shard_of(o, h, ids, hashes), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, at], [*batch.schema.names, "shard"])

    return rows.mapInArrow(put, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", shard int")


# ---- writing -------------------------------------------------------------


FILES = "shard int, number int, temporary string, name string, bytes long, sha256 string, records long"
_FILES_ARROW = pa.schema([("shard", pa.int32()), ("number", pa.int32()), ("temporary", pa.string()), ("name", pa.string()),
                          ("bytes", pa.int64()), ("sha256", pa.string()), ("records", pa.int64())])


class _Roll:
    """One file being written under a name of this attempt."""

    def __init__(self, folder: str, shard: int, number: int, level: int):
        task = TaskContext.get()
        self.name = f"part-{shard:06d}-{number:06d}.warc.gz"
        self.place = (shard, number)
        self.temporary = f"{TEMPORARY}/{self.name}.{task.stageId()}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        system, path = storage(folder)
        self.out = system.open_output_stream(posixpath.join(path, self.temporary), compression=None)
        self.size, self.records, self.digest = 0, 0, hashlib.sha256()
        info = "software: faretrace\r\nformat: WARC File Format 1.1\r\n".encode()
        self.put(record("warcinfo", [("WARC-Record-ID", record_id(None, self.name, "warcinfo")), ("WARC-Filename", self.name),
                                     ("Content-Type", "application/warc-fields")], info, level))
        self.records = 0

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        return *self.place, self.temporary, self.name, self.size, self.digest.hexdigest(), self.records


def write_archive(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES,
                  least_payload: int = LEAST_PAYLOAD, level: int = 6) -> None:
    """Write ``pages`` (page_id, url, html) as an archive into ``folder``, which all executors reach and which holds none yet.

    Payloads are shuffled once, to their shard; what is known of copies meets them there.
    """
    system, path = storage(folder)
    if system.get_file_info(posixpath.join(path, MANIFEST)).type != fs.FileType.NotFound:
        raise FileExistsError(f"{folder} already holds an archive")
    system.create_dir(posixpath.join(path, TEMPORARY), recursive=True)
    rows = page_rows(pages)
    keys = cut_lineage(rows.drop("html"))
    total = keys.agg(F.sum("payload_bytes")).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-total // shard_bytes)))
    ids, hashes = borders(keys, shards)
    both = (_placed(rows, ids, hashes).withColumn("is_row", F.lit(True))
            .unionByName(_placed(revisits(keys, least_payload), ids, hashes).withColumn("is_row", F.lit(False)), True))
    order = ["shard", "o", "h", "page_id", "url", "digest", "is_row"]
    ordered = both.repartitionById(shards, F.col("shard")).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "page_id", "url", "digest", "is_row", "payload_bytes", "first_id", "first_url", "html"]
        done: list[tuple] = []
        roll, before, times, first = None, None, 0, None
        for batch in batches:
            for shard, page_id, url, digest, is_row, size, first_id, first_url, html in zip(
                    *(batch.column(n).to_pylist() for n in names), strict=True):
                if (page_id, url, digest) != before:
                    before, times, first = (page_id, url, digest), 0, None
                if not is_row:
                    first = first_id, first_url
                    continue
                if roll and (shard != roll.place[0] or roll.size >= roll_bytes):
                    done.append(roll.close())
                    roll = _Roll(folder, shard, roll.place[1] + 1 if shard == roll.place[0] else 0, level)
                roll = roll or _Roll(folder, shard, 0, level)
                roll.put(page_record(page_id, url, html.encode(), size, digest, times, first, level))
                times += 1
        if roll:
            done.append(roll.close())
        if done:
            yield _packed(done, _FILES_ARROW)

    commit(cut_lineage(ordered.mapInArrow(write, FILES)), folder)


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)],
                                      schema=schema)


def commit(files: DataFrame, folder: str) -> None:
    """Give the files their names, drop what other attempts left, and write the manifest. A repeated task finds its files
    renamed already, so each step may run again."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = storage(folder)
        for batch in batches:
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist(), strict=True):
                source, target = posixpath.join(path, temporary), posixpath.join(path, name)
                if system.get_file_info(source).type != fs.FileType.NotFound:
                    system.move(source, target)
            yield batch

    named = cut_lineage(files.repartition("shard").mapInArrow(rename, FILES))
    system, path = storage(folder)
    system.delete_dir(posixpath.join(path, TEMPORARY))
    named.drop("temporary").write.parquet(f"{folder}/{MANIFEST}")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, number, name, bytes, sha256, records), one row a file of a committed archive."""
    return spark.read.parquet(f"{folder}/{MANIFEST}")


# ---- reading -------------------------------------------------------------


def members(source: Iterator[bytes]) -> Iterator[bytes]:
    """Contents of the gzip members of a stream, one at a time."""
    inflate, out, left = zlib.decompressobj(31), [], b""
    while True:
        data = left or next(source, b"")
        if not data:
            if out:
                raise ValueError("archive ends inside a record")
            return
        out.append(inflate.decompress(data))
        left = b""
        if inflate.eof:
            left = inflate.unused_data
            yield b"".join(out)
            inflate, out = zlib.decompressobj(31), []


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; its length and digests must hold."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    block = rest[:size]
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"bad record {fields.get('WARC-Record-ID')}")
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"block digest differs in {fields['WARC-Record-ID']}")
    return fields, block


RECORDS = """page_id long, url string, record_type string, record_id string, refers_to_record string, refers_to long,
payload_bytes long, payload_digest string, payload binary"""
_RECORDS_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()),
                            ("refers_to_record", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("payload", pa.binary())])


def page_of(fields: dict[str, str], block: bytes) -> tuple:
    """A row of ``RECORDS``; the digest of a response is computed from its payload."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    full = fields["WARC-Type"] == "response"
    if full and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload differs in {fields['WARC-Record-ID']}")
    number = lambda key: int(fields[key]) if key in fields else None
    return (number("X-Page-Id"), fields.get("WARC-Target-URI"), fields["WARC-Type"], fields["WARC-Record-ID"],
            fields.get("WARC-Refers-To"), number("X-Refers-To-Page-Id"), size, digest, payload if full else None)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a committed archive with their payloads, NULL for revisits. Tasks stream the files of the manifest;
    a file, record or payload that does not have its digest fails the read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = storage(folder)
        held: list[tuple] = []
        weight = 0
        for batch in batches:
            for name, sha256 in zip(batch.column("name").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                total = hashlib.sha256()

                def chunks() -> Iterator[bytes]:
                    with system.open_input_stream(posixpath.join(path, name), compression=None) as source:
                        while data := source.read(1 << 20):
                            total.update(data)
                            yield data

                for member in members(chunks()):
                    fields, block = parsed(member)
                    if fields["WARC-Type"] != "warcinfo":
                        held.append(page_of(fields, block))
                        weight += len(block)
                    if weight >= READ_BYTES or len(held) == 4096:
                        yield _packed(held, _RECORDS_ARROW)
                        held, weight = [], 0
                if total.hexdigest() != sha256:
                    raise ValueError(f"{name} is not the file of the manifest")
        if held:
            yield _packed(held, _RECORDS_ARROW)

    files = manifest(spark, folder)
    return files.repartition("name").mapInArrow(read, RECORDS)


def archive_folder(spark: SparkSession) -> str:
    """A new name in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
