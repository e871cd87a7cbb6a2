"""WARC archives with their index written first.

Every task writes its records to archives of its own (a gzip member for each record) in a folder that the
cluster shares, and hands back an index row for each: file, offset, length, URL, digest. The index is a
table; records are read by it: the selected rows, sorted by file and offset, dealt by range, and
neighbouring byte ranges joined into one read each.

Of records with equal payloads of at least `least` bytes the one with the smallest id is a response and
the others are revisits, without a payload, that refer to it. Files of a task that was lost are never in
the index; a task that runs again writes new ones.

Null payloads count as empty. Rows of one id and one payload are of one kind (all responses, or all
revisits); null ids sort last. Very large payloads are archived and read back whole, one record at a time in a
worker's memory; an empty table writes no archive and gives an empty report. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.shared import materialise, new_path

DATE = "2024-01-01T00:00:00Z"
#: An archive is closed after so many bytes.
ROLL = 64 << 20
#: Ranges this close are read at once, up to so many bytes.
GAP, READ = 64 << 10, 8 << 20
_SPACE = uuid.UUID("6a1c5b6e-6f0f-4f43-9a0e-2c7c6a3e9d10")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def _record_id(id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{id}/{digest}')}>"


def record(id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record's bytes, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{id}")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class _Archives:
    """Archives of one task."""

    def __init__(self, root: str):
        self.fs, self.root = _open(root)
        self.uri, self.out, self.at, self.name = root, None, 0, ""

    def add(self, member: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= ROLL:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)  # members are gzip already
        at = self.at
        self.out.write(member)
        self.at += len(member)
        return f"{self.uri}/{self.name}", at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_archives(spark: SparkSession, pages: DataFrame, root: str, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 100) -> DataFrame:
    """Write archives below root; the index as a table: id, url, file, offset, length, bytes, digest, record_type, refers_to."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    first = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialise(first, "warc-first")
    typed = rows.join(first, "digest", "left").withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))).select("id", "url", "body", "digest", "bytes", "refers_to")
    kind = rows.schema["id"].dataType.simpleString()
    at, path = _open(root)
    at.create_dir(path, recursive=True)
    columns = ["id", "url", "file", "offset", "length", "bytes", "digest", "record_type", "refers_to"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives(root)
        try:
            for batch in batches:
                files, offsets, lengths, types = [], [], [], []
                for i, u, b, d, ref in zip(*(batch.column(c) for c in ("id", "url", "body", "digest", "refers_to")), strict=True):
                    member = record(i.as_py(), u.as_py(), b.as_py().encode(), d.as_py(), ref.as_py())
                    file, offset = archives.add(member)
                    files.append(file)
                    offsets.append(offset)
                    lengths.append(len(member))
                    types.append("response" if ref.as_py() is None else "revisit")
                made = [pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), *made, batch.column("bytes"), batch.column("digest"), pa.array(types, pa.string()), batch.column("refers_to")], columns)
        finally:
            archives.close()

    schema = f"id {kind}, url string, file string, offset long, length long, bytes long, digest string, record_type string, refers_to {kind}"
    return materialise(typed.mapInArrow(of, schema), "warc-index")


def read_records(selected: DataFrame) -> DataFrame:
    """(id, url, record_type, record_id, refers_to_id, digest, payload) of the selected index rows: id and url as the index has them, the rest as the records say; payload null for revisits."""

    def ranges(offsets: list[int], lengths: list[int], files: list[str]) -> Iterator[tuple[int, int]]:
        begin = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or files[i] != files[begin] or offsets[i] - offsets[i - 1] - lengths[i - 1] > GAP or offsets[i] + lengths[i] - offsets[begin] > READ:
                yield begin, i
                begin = i

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle, name = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            for a, b in ranges(offsets, lengths, files):
                if files[a] != name:
                    if handle is not None:
                        handle.close()
                    at, path = _open(files[a])
                    handle, name = at.open_input_file(path), files[a]
                block = handle.read_at(offsets[b - 1] + lengths[b - 1] - offsets[a], offsets[a])
                types, names, refers, digests, payloads = [], [], [], [], []
                for i in range(a, b):
                    fields, payload = parse(block[offsets[i] - offsets[a] : offsets[i] - offsets[a] + lengths[i]])
                    types.append(fields["warc-type"])
                    names.append(fields["warc-record-id"])
                    refers.append(fields.get("warc-refers-to"))
                    digests.append(fields["warc-payload-digest"].removeprefix("sha256:"))
                    payloads.append(payload if fields["warc-type"] == "response" else None)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), *[pa.array(c, pa.string()) for c in (types, names, refers, digests)], pa.array(payloads, pa.binary())], ["id", "url", "record_type", "record_id", "refers_to_id", "digest", "payload"]
                )
        if handle is not None:
            handle.close()

    kind = selected.schema["id"].dataType.simpleString()
    dealt = selected.select("id", "url", "file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(of, f"id {kind}, url string, record_type string, record_id string, refers_to_id string, digest string, payload binary")


def archive_report(spark: SparkSession, pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 100) -> DataFrame:
    """Archive all pages, read every record back, and tell what was read; a revisit's payload is its response's."""
    index = write_archives(spark, pages, new_path(spark, "warc"), id, url, payload, least)
    read = read_records(index).select("id", "record_type", "record_id", "refers_to_id", "digest", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    read = materialise(read, "warc-read")
    if not read.where("record_type = 'response' and not payload_digest <=> digest").isEmpty():
        raise ValueError("a payload isn't what its record's digest says")
    none = F.lit(None).cast(read.schema["id"].dataType).alias("refers_to")
    whole = read.where("record_type = 'response'").select("id", "payload_bytes", "payload_digest", "record_type", none)
    source = read.where("record_type = 'response'").select(F.col("id").alias("refers_to"), F.col("record_id").alias("refers_to_id"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to_id"])
    again = read.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(source, "refers_to_id", "left")
    lost = F.col("payload_digest").isNull() | (F.col("payload_digest") != F.col("digest"))
    again = again.withColumn("payload_digest", F.when(lost, F.raise_error(F.lit("a revisit refers to no response of its digest"))).otherwise(F.col("payload_digest")))
    return whole.union(again.select(*whole.columns)).withColumnRenamed("id", id)
