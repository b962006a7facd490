"""Deterministic sharded WARC archives.

Records are cut into shards by ranges of their id that depend on the ids and payload sizes alone, sorted inside a shard, and written one gzip
member a record; a file is rolled when its compressed size would pass the limit. Headers, record ids and digests are made from the
record itself, so the same rows give the same files byte for byte, whichever task writes them. A task writes under a temporary name of its
own and reports what it wrote; only files that a finished task reported are renamed to their names, by a second pass that may be
repeated; the manifest is written last and makes the archive complete. A lost executor leaves at most temporary files.

Of records with equal payloads (by SHA-1) of at least `least_bytes`, the one with the greatest id is a `response`, the others are `revisit` records that refer to
it and hold no payload. Only digests go into that decision; a digest's greatest id is found by partial aggregation.

Defined results: a null payload is an empty one; a null url is written as `urn:page:<id>`; rows without an id come first and are written
without one (if a payload has no other rows, all of them are responses); repeated rows of an id and payload are alike, so they are all
responses or all revisits; an empty table gives an archive without files; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.session import cut, work_path

from .catalog import query, table
from .ranges import even_cuts, range_of

MANIFEST = "shard int, file string, temporary string, records bigint, bytes bigint, sha256 string"
READ = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, intact boolean"


def filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}/{digest}'.encode()).digest())}>"


def member(lines: list[str], block: bytes) -> bytes:
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(head) + gz.compress(block) + gz.compress(b"\r\n\r\n") + gz.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    digest = base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = f"urn:page:{page_id}" if url is None else quote(url, safe="".join(map(chr, range(0x21, 0x7F))))
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
             "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
             f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return member(lines, block)


def info(name: str, date: str) -> bytes:
    return member(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=hashlib.md5(name.encode()).digest())}>", f"WARC-Date: {date}", f"WARC-Filename: {name}",
                   "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


class Roller:
    """Writes the records of one task: a new file for each shard and whenever the compressed size would pass the limit."""

    def __init__(self, root: str, roll_bytes: int, date: str):
        self.fs, self.root = filesystem(root)
        self.roll, self.date, self.done, self.out, self.shard, self.number = roll_bytes, date, [], None, None, 0

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        elif self.out and self.size + len(data) > self.roll and self.records:
            self.close()
            self.number += 1
        if not self.out:
            self.name = f"part-{shard:06d}-{self.number:05d}.warc.gz"
            self.temp = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sum = self.fs.open_output_stream(f"{self.root}/{self.temp}", compression=None), 0, 0, hashlib.sha256()
            self.put(info(self.name, self.date))
        self.put(data)
        self.records += 1

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.done.append((self.shard, self.name, self.temp, self.records, self.size, self.sum.hexdigest()))
            self.out = None


def decided(pages: DataFrame, page_id: str, url: str, payload: str, least_bytes: int, small: int = 200_000) -> DataFrame:
    """page_id, url, payload, bytes, revisit and refers_to. Only digests that occur twice matter; while they are at most `small` (some
    20 MB) they are sent to the pages, else the pages are dealt out by digest to meet them."""
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload")) \
        .select("*", F.length("payload").cast("bigint").alias("bytes"), F.sha1("payload").alias("digest"))
    top = cut(rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("top")).where("n > 1 and top is not null").select("digest", "top"))
    met = rows.join(F.broadcast(top) if top.count() <= small else top, "digest", "left")
    return met.withColumn("revisit", F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))).withColumn("refers_to", F.when(F.col("revisit"), F.col("top"))).drop("top")


def write_archive(pages: DataFrame, root: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, shard_bytes: int = 128 << 20, roll_bytes: int = 32 << 20,
                  date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes the archive under `root` (a folder that all executors share) and returns its manifest."""
    spark = pages.sparkSession
    fs, base = filesystem(root)
    fs.create_dir(f"{base}/_temporary", recursive=True)
    least = pages.agg(F.min(F.col(page_id).cast("bigint"))).first()[0]
    key = F.coalesce(F.col(page_id).cast("bigint"), F.lit(0 if least is None else least))
    cuts = even_cuts(pages.select(key.alias("key"), (F.octet_length(F.coalesce(F.col(payload), F.lit(""))) + 512).cast("bigint").alias("weight")), shard_bytes)
    rows = decided(pages, page_id, url, payload, least_bytes)
    shard = range_of(F.coalesce("page_id", F.lit(0 if least is None else least)), cuts) - 1
    sorted_ = rows.withColumn("shard", shard).repartitionByRange(max(1, len(cuts)), "shard").sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "digest", F.asc_nulls_first("url"))

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = Roller(root, roll_bytes, date)
        for part in parts:
            for row in part.itertuples(index=False):
                whole = lambda x: None if pd.isna(x) else int(x)
                files.add(int(row.shard), record(whole(row.page_id), row.url, bytes(row.payload), whole(row.refers_to), bool(row.revisit), date))
        files.close()
        yield pd.DataFrame(files.done, columns=["shard", "file", "temporary", "records", "bytes", "sha256"])

    def commit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs
        shared, where = filesystem(root)
        for part in parts:
            for row in part.itertuples(index=False):
                if shared.get_file_info(f"{where}/{row.temporary}").type == pafs.FileType.File:
                    shared.move(f"{where}/{row.temporary}", f"{where}/{row.file}")
                elif shared.get_file_info(f"{where}/{row.file}").size != row.bytes:
                    raise OSError(f"{row.file}: neither its temporary file nor the file is there")
            yield part

    # ids leave Arrow as nullable integers, so large ones stay exact
    as_text = sorted_.select("shard", F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"), "revisit")
    written = cut(as_text.mapInPandas(write, MANIFEST))
    moved = cut(written.mapInPandas(commit, MANIFEST))
    moved.drop("temporary").write.mode("overwrite").json(f"{root}/_manifest")
    fs.delete_dir(f"{base}/_temporary")
    return spark.read.schema(MANIFEST.replace("temporary string, ", "")).json(f"{root}/_manifest")


# ---- reading -----------------------------------------------------------------------------------------------------------------------

def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    unzip, out, left = zlib.decompressobj(31), [], b""
    while True:
        data = left or stream.read(chunk)
        left = b""
        if not data:
            if out or not unzip.eof and unzip.unconsumed_tail:
                raise ValueError("the file ends inside a record")
            return
        out.append(unzip.decompress(data))
        if unzip.eof:
            yield b"".join(out)
            left, unzip, out = unzip.unused_data, zlib.decompressobj(31), []


def parse(data: bytes) -> tuple | None:
    """The columns of READ of a response or revisit record; None for others."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(re.split(r":\s*", x, maxsplit=1) for x in lines[1:])
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    block = rest[:int(fields["Content-Length"])]
    intact = rest[len(block):] == b"\r\n\r\n" and fields["WARC-Block-Digest"] == "sha1:" + base32(hashlib.sha1(block).digest())
    digest, size, payload = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"]), None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        intact = intact and len(payload) == size and base32(hashlib.sha1(payload).digest()) == digest
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Page-Id"), fields["WARC-Target-URI"], payload, size, digest, fields["WARC-Type"], number("X-Refers-To-Page-Id"), intact


def read_archive(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the files that the manifest names. `intact` says whether its digests and lengths hold."""
    files = spark.read.schema(MANIFEST.replace("temporary string, ", "")).json(f"{root}/_manifest").select("file")

    def read(parts):
        import pyarrow as pa
        shared, where = filesystem(root)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                            ("refers_to", pa.int64()), ("intact", pa.bool_())])
        for part in parts:
            for name in part.column(0).to_pylist():
                rows, held = [], 0
                with shared.open_input_stream(f"{where}/{name}", compression=None) as stream:
                    for data in members(stream):
                        row = parse(data)
                        if row is None:
                            continue
                        row = row if with_payload else (*row[:2], None, *row[3:])
                        rows.append(row)
                        held += len(row[2] or b"") + 500
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
    return files.repartitionByRange(max(1, files.count()), "file").mapInArrow(read, READ)     # a stated number is kept: a task for each file


@query("op8_warc_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), root)
    return read_archive(spark, root, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
