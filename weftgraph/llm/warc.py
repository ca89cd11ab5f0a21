"""A deterministic sharded WARC writer, and a reader for its archives.

Write. Pages are dealt to shards by ranges of the key; shard borders are quantiles of a sample that
hashes of the key choose, so they do not depend on how the input is partitioned. Each shard is
sorted by key and written as gzip members, one a record; a file is closed once its compressed size
reaches ``roll_bytes`` and the next of the shard begins. A shard holds SHARD_BYTES of payloads, or more
once there are MAX_RANGES shards, and files roll at a ROLL_SHARE-th of what a shard holds, so that a shard
compressed to no less than that makes several files and their number stays bounded at any size.

Files begin with a warcinfo record, go to names that start with ``.tmp`` and are renamed when whole; a
task that runs again writes the same bytes, and finds or replaces the file of its first run. The manifest
(a folder of JSON lines with file, records, bytes, SHA-1, first and last key, places at which a reader may
start) is written by the tasks and renamed into place last; readers see only files that it lists. Record
ids, dates and digests follow from the content alone.

Of records with equal payloads of ``revisit_from`` bytes or more, that with the largest page_id is a
response and the others are revisits (identical-payload-digest) that name it.

Read. Each stretch between two starting places is one task's work and is streamed record by record;
digests are computed again from responses' payloads and compared with their headers.

Files are opened through pyarrow's file systems by the URI of the shared folder.

Defined cases: a null html is an empty payload; a null url becomes ``urn:page:<id>``; a null page_id
is written without an id (-) and sorts first; of repeated rows with the largest page_id each is a
response, and each has a record id of its own; an empty table gives a manifest without files and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_RANGES, borders, materialise, range_of, read, scratch_path, text_of

SHARD_BYTES, ROLL_SHARE, CHUNK_BYTES = 16 << 20, 8, 8 << 20
#: Digests with more than so many equal payloads are met by a broadcast, if they are at most HEAVY_DIGESTS.
HEAVY_ROWS, HEAVY_DIGESTS = 100_000, 100_000
REVISIT_FROM = 1000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
MANIFEST = "file string, records long, bytes long, sha1 string, first long, last long, starts array<long>"


def _open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, kind: str, digest: str, again: int = 0) -> uuid.UUID:
    """The id of a record; again counts the rows before it that repeat its page, kind and payload."""
    name = "-" if page_id is None else str(page_id)
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{name} {kind} {digest}" + (f" {again}" if again else ""))


def warcinfo(name: str) -> bytes:
    """The first record of a file."""
    block = b"format: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    head = [
        "WARC/1.1",
        "WARC-Type: warcinfo",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Filename: {name}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/warc-fields",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, again: int = 0) -> bytes:
    """One WARC record with regenerated headers."""
    name = "-" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    kind = "revisit" if revisit else "response"
    payload_digest = base64.b32encode(bytes.fromhex(digest)).decode()
    uri = (url or f"urn:page:{name}").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{record_id(page_id, kind, digest, again)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Page-ID: {name}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{record_id(refers_to, 'response', digest)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    """One archive under a temporary name until commit()."""

    def __init__(self, where: fs.FileSystem, folder: str, name: str):
        self.where, self.final = where, f"{folder}/{name}"
        self.temporary = f"{folder}/.tmp-{uuid.uuid4().hex}-{name}"
        self.out = where.open_output_stream(self.temporary, compression=None)
        self.name, self.records, self.bytes, self.sha1 = name, 0, 0, hashlib.sha1()
        self.first = self.last = None
        self.starts = [0]
        self._put(warcinfo(name))

    def _put(self, data: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # 31: a gzip member; no file time in it
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.sha1.update(member)
        self.bytes += len(member)

    def add(self, key: int | None, data: bytes) -> None:
        if self.bytes - self.starts[-1] >= CHUNK_BYTES:
            self.starts.append(self.bytes)
        self._put(data)
        self.records += 1
        self.first, self.last = key if self.records == 1 else self.first, key

    def commit(self) -> dict:
        """Renames the file. One that is there comes from another run of this task: it stays if it is whole."""
        self.out.close()
        there = self.where.get_file_info(self.final)
        if there.type == fs.FileType.File and there.size == self.bytes:
            self.where.delete_file(self.temporary)
        else:
            if there.type == fs.FileType.File:
                self.where.delete_file(self.final)
            try:
                self.where.move(self.temporary, self.final)
            except OSError:  # a run beside this one was first
                if self.where.get_file_info(self.final).size != self.bytes:
                    raise
                self.where.delete_file(self.temporary)
        return {"file": self.name, "records": self.records, "bytes": self.bytes, "sha1": self.sha1.hexdigest(), "first": self.first, "last": self.last, "starts": [*self.starts, self.bytes]}

    def abandon(self) -> None:
        try:
            self.out.close()
            self.where.delete_file(self.temporary)
        except OSError:
            pass


def _write_part(batches: Iterator[pa.RecordBatch], uri: str, roll_bytes: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shard and key; a shard lies in one partition. A note tells what the pages after it refer to."""
    where, folder = _open_fs(uri)
    current, shard, number, note, last, again = None, None, 0, None, None, 0
    try:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "page_id", "url", "html", "digest", "refers_to", "note")]
            for s, page_id, url, html, digest, refers_to, is_note in zip(*columns, strict=True):
                if is_note:
                    note = (page_id, digest, refers_to)
                    continue
                revisit = note is not None and note[:2] == (page_id, digest)
                if current is not None and (s != shard or current.bytes >= roll_bytes):
                    number = number + 1 if s == shard else 0
                    yield _manifest_row(current.commit())
                    current = None
                if current is None:
                    number = number if s == shard else 0
                    shard = s
                    current = _File(where, folder, f"part-{s:05d}-{number:05d}.warc.gz")
                again = again + 1 if last == (page_id, digest) else 0  # repeated rows are neighbours
                last = (page_id, digest)
                current.add(page_id, record(page_id, url, (html or "").encode(), digest, note[2] if revisit else None, revisit, again))
        if current is not None:
            whole, current = current, None
            yield _manifest_row(whole.commit())
    finally:
        if current is not None:
            current.abandon()


def _manifest_row(row: dict) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))


def _revisits(big: DataFrame, same: DataFrame) -> DataFrame:
    """Rows of big (page_id, digest) with the top of their digest. A digest that very many rows share does not gather them in one task."""
    same = same.select(F.col("digest").alias("_digest"), "top", "n")
    on = big["digest"] == same["_digest"]
    heavy = same.where(F.col("n") > HEAVY_ROWS)
    if heavy.count() > HEAVY_DIGESTS:
        return big.join(same, on)
    few = F.broadcast(heavy)
    rest = big.join(F.broadcast(heavy.select("_digest")), on, "left_anti").join(same.where(F.col("n") <= HEAVY_ROWS), on)
    return rest.union(big.join(few, on))


def write(pages: DataFrame, uri: str, roll_bytes: int | None = None, revisit_from: int = REVISIT_FROM, shard_bytes: int = SHARD_BYTES) -> None:
    """Archives of pages(page_id, url, html) in the folder uri, which must not exist yet."""
    where, folder = _open_fs(uri)
    where.create_dir(folder, recursive=True)
    payload = text_of("html").cast("binary")
    slim = materialise(pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes")), "warc-slim")
    size = slim.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    shards = int(min(MAX_RANGES, max(1, -(-size["b"] // shard_bytes))))
    roll_bytes = roll_bytes or max(shard_bytes, size["b"] // shards) // ROLL_SHARE
    cuts = borders(slim, "page_id", shards, size["n"])
    # Large equal payloads: the largest id of each digest (combined on the map side), then back to the rows.
    big = slim.where(F.col("bytes") >= revisit_from)
    same = materialise(big.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1"), "warc-equal")
    later = _revisits(big, same).where("page_id < top OR page_id IS NULL AND top IS NOT NULL")
    later = later.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("top").alias("refers_to")).distinct()
    # Notes on revisits travel to the shards beside the pages and sort before them: payloads move once.
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("note"))
    notes = later.select(F.col("_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), F.col("_digest").alias("digest"), "refers_to", F.lit(True).alias("note"))
    shard = range_of(F.col("page_id"), cuts)
    parts = max(1, min(len(cuts) + 1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4))
    dealt = rows.union(notes).withColumn("shard", shard).repartitionById(parts, F.pmod(F.col("shard"), F.lit(parts)))
    dealt = dealt.sortWithinPartitions("shard", "page_id", "digest", F.desc("note"), "url")
    manifest = dealt.mapInArrow(lambda it: _write_part(it, uri, roll_bytes), MANIFEST)
    temporary = f".tmp-manifest-{uuid.uuid4().hex}"
    manifest.write.json(f"{uri}/{temporary}", ignoreNullFields=False)
    where.move(f"{folder}/{temporary}", f"{folder}/manifest")


def manifest(spark: SparkSession, uri: str) -> DataFrame:
    """The rows of MANIFEST: a file each."""
    return spark.read.schema(MANIFEST).json(f"{uri}/manifest")


def _members(where: fs.FileSystem, path: str, start: int, end: int) -> Iterator[bytes]:
    """The decompressed gzip members of a stretch of a file."""
    with where.open_input_file(path) as source:
        source.seek(start)
        left, data = end - start, b""
        while left or data:
            packer, parts = zlib.decompressobj(31), []
            while not packer.eof:
                if not data:
                    data = source.read(min(left, 1 << 20))
                    left -= len(data)
                    if not data:
                        raise OSError(f"{path} ends inside a record")
                parts.append(packer.decompress(data))
                data = packer.unused_data
            yield b"".join(parts)


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None] | None:
    """The result columns from one record, None from a warcinfo; raises ValueError if a digest disagrees."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"record {fields['WARC-Record-ID']}: the block differs from its digest")
    if fields["WARC-Type"] == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload differs from its digest")
    page_id, to = fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID")
    return None if page_id == "-" else int(page_id), size, digest, kind, None if to is None else int(to)


def _read_part(batches: Iterator[pd.DataFrame], uri: str) -> Iterator[pd.DataFrame]:
    where, folder = _open_fs(uri)
    for batch in batches:
        for name, start, end in zip(batch["file"], batch["start"], batch["end"], strict=True):
            rows = [r for m in _members(where, f"{folder}/{name}", int(start), int(end)) if (r := parse(m))]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_back(spark: SparkSession, uri: str) -> DataFrame:
    """A row for each record of the archives that the manifest lists."""
    # A stretch between two starting places is a row; they are dealt evenly, as few make one file.
    listed = manifest(spark, uri).select("file", F.posexplode("starts").alias("_i", "start"), "starts")
    stretches = listed.select("file", "start", F.get("starts", F.col("_i") + 1).alias("end")).where("end IS NOT NULL")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stretches.repartition(parts, "file", "start").mapInPandas(lambda it: _read_part(it, uri), SCHEMA)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch_path(spark, "warc")
    write(read(spark, sf_dir, "pages"), uri)
    return read_back(spark, uri)


QUERIES = {"op6_warc": op6_warc}
ORACLE_SQL = {
    "op6_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS payload_digest FROM pages),
s AS (SELECT *, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM s)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_FROM} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_FROM} AND page_id < top THEN top END AS refers_to
FROM t
"""
}
