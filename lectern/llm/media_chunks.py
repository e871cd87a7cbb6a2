"""Media columns as content-defined chunks.

A text's bytes become 8-bit samples of a mono wave file. A gear hash that rolls over the file's bytes cuts
it where the content says so, so that a passage which files share is cut alike in each. Chunk digests are
counted by Spark joins: a chunk of one file only stays in that file's container; a chunk that several
files (or places) hold is stored once, in the chunk table, by its least holder. An ordered list of chunks
per file tells how to rebuild it; a rebuilt file is checked against its digest before it is used.

Equal texts are one file. What tells the holders apart is a table of the files that share something; it is
broadcast up to a stated number of rows and joined by shuffle beyond, with the same result.

Null text counts as empty: a file of 64 zero samples. Repeated rows give repeated rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.shared import broadcast_if_small, new_path, materialise

LEAST, MOST = 1024, 16384
_CUT = np.uint32(((1 << 11) - 1) << 21)  # of the bits that depend on the most bytes: a cut every 2 KiB or so
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, np.uint32)
RATE = 8000


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The number of bytes, and they with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def to_wave(payload: bytes) -> bytes:
    """An 8-bit mono PCM wave file whose samples are the bytes (of an even number)."""
    n = len(payload)
    if n > (1 << 32) - 64:
        raise ValueError("a wave file has no more than 4 GiB")
    head = b"RIFF" + (36 + n).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little")
    head += b"".join(v.to_bytes(k, "little") for v, k in ((1, 2), (1, 2), (RATE, 4), (RATE, 4), (1, 2), (8, 2)))
    return head + b"data" + n.to_bytes(4, "little") + payload


def from_wave(media: bytes) -> bytes:
    at = media.index(b"data", 12)
    return media[at + 8 : at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")]


def cuts(media: bytes, least: int = LEAST, most: int = MOST) -> list[int]:
    """The end of each chunk. A cut follows a byte where the gear hash of the last 32 bytes has the cut's bits zero."""
    n = len(media)
    if n <= least:
        return [n]
    h = _GEAR[np.frombuffer(media, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # h[i] = sum of gear[i-j] << j, over windows that double
        h[k:] += h[:-k] << np.uint32(k)
    at = np.flatnonzero((h & _CUT) == 0) + 1
    out, begin = [], 0
    while n - begin > least:
        i = np.searchsorted(at, begin + least)
        end = min(int(at[i]) if i < len(at) else n, begin + most, n)
        out.append(end)
        begin = end
    if begin < n:
        out.append(n)
    return out


def features(payload: bytes) -> str:
    """Of the samples around 128: number, mean, root mean square, zero crossings, entropy in bits."""
    s = np.frombuffer(payload, np.uint8)
    x = s.astype(np.float64) - 128
    p = np.bincount(s, minlength=256) / len(s)
    p = p[p > 0]
    return f"n={len(s)};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};cross={int((np.diff(np.signbit(x)) != 0).sum())};bits={-(p * np.log2(p)).sum() + 0.0:.4f}"


def _digest(chunk: bytes) -> bytes:
    """A chunk's address: the first 128 bits of its SHA-256."""
    return hashlib.sha256(chunk).digest()[:16]


def _parts(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


_LIST = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.int32())]))


def chunk_lists(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, object, chunks) for each row; object addresses the text (128 bits of its SHA-256), chunks: the file's ordered list."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[{"digest": _digest(c), "bytes": len(c)} for c in _parts(to_wave(payload_of(t.as_py())[1]))] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, _LIST)], ["id", "object", "chunks"])

    rows = _rows(docs, id, text)
    return rows.mapInArrow(of, f"id {rows.schema['id'].dataType.simpleString()}, object binary, chunks array<struct<digest:binary,bytes:int>>")


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).alias("id"), F.unhex(F.substring(F.sha2(t, 256), 1, 32)).alias("object"), t.alias("text"))


_CHUNKS = "array<struct<digest:binary,bytes:int,shared:boolean>>"
_CHUNK = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.int32()), ("shared", pa.bool_())]))


@dataclass(frozen=True)
class MediaStore:
    """Files below a path, in three tables: containers, shared chunks and copies.

    A container has its row's id, the file's address and digest, its number of bytes unpadded, the ordered list of its chunks
    (digest, bytes, and whether the chunk is a shared one) and the bytes of its own chunks, one behind the other.
    """

    spark: SparkSession
    path: str

    @property
    def id_type(self) -> str:
        return self.spark.read.parquet(f"{self.path}/copies").schema["id"].dataType.simpleString()

    def _table(self, kind: int, id_type: str) -> DataFrame:
        schema = f"id {id_type}, object binary, media_sha256 binary, n_bytes long, chunks {_CHUNKS}, body binary"
        return self.spark.read.schema(schema).parquet(f"{self.path}/files/kind={kind}").where("object is not null")

    def containers(self) -> DataFrame:
        """(id, object, media_sha256, n_bytes, chunks, body)."""
        return self._table(0, self.id_type)

    def shared(self) -> DataFrame:
        """(digest, bytes) of every chunk that several files or places hold."""
        return self._table(1, self.id_type).select(F.col("object").alias("digest"), F.col("body").alias("bytes"))

    def copies(self) -> DataFrame:
        """(id, object) of rows whose file is in another row's container."""
        return self.spark.read.parquet(f"{self.path}/copies").where("object is not null")


def store(spark: SparkSession, docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", broadcast_rows: int = 500_000) -> MediaStore:
    """Write the files of docs below path, each distinct chunk once.

    Rows of one id and one text can't be told apart: each of them has a container.
    """
    small = lambda df: broadcast_if_small(df, broadcast_rows)
    lists = materialise(chunk_lists(docs, id, text), "media-lists")
    copies = materialise(lists.groupBy("object").agg(F.min("id").alias("holder"), F.count("*").alias("rows")).where("rows > 1").select("object", "holder"), "media-copies")
    met = lists.select("id", "object", "chunks").join(small(copies), "object", "left")
    single = F.col("holder").isNull() | F.col("id").eqNullSafe(F.col("holder"))
    second = lists.select("id", "object").join(small(copies), "object").where(~F.col("id").eqNullSafe(F.col("holder")) & F.col("holder").isNotNull()).select("id", "object")
    second.write.option("compression", "zstd").parquet(f"{path}/copies")
    media = MediaStore(spark, path)
    # rows whose id repeats may give a place twice; a place is an object and a number
    places = met.where(single).select("object", F.posexplode("chunks").alias("seq", "c")).select("object", "seq", "c.digest")
    places = materialise(places, "media-places")
    owners = places.groupBy("digest").agg(F.min(F.struct("object", "seq")).alias("own"), F.max(F.struct("object", "seq")).alias("other")).where("own <> other").select("digest", "own")
    owners = materialise(owners, "media-owners")
    owned = (F.col("own.object") == F.col("object")) & (F.col("own.seq") == F.col("seq"))
    common = places.join(small(owners), "digest").select("object", "seq", owned.alias("owned")).distinct()
    # a file's chunks that are shared and written here, and those that another file writes; all others are its own
    numbers = lambda of: F.collect_list(F.when(of, F.col("seq")))
    sharing = materialise(common.groupBy("object").agg(numbers(F.col("owned")).alias("here"), numbers(~F.col("owned")).alias("elsewhere")), "media-sharing")
    rows = _rows(docs, id, text)
    gone = small(media.copies().distinct())
    rows = rows.join(gone, rows["object"].eqNullSafe(gone["object"]) & rows["id"].eqNullSafe(gone["id"]), "left_anti")
    rows = rows.join(small(sharing), "object", "left").select("id", "object", "text", "here", "elsewhere")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, address, t, here, elsewhere in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, payload = payload_of(t)
                media = to_wave(payload)
                parts, here = _parts(media), set(here or ())
                shared = here.union(elsewhere or ())
                chunks = [{"digest": _digest(p), "bytes": len(p), "shared": i in shared} for i, p in enumerate(parts)]
                body = b"".join(p for i, p in enumerate(parts) if i not in shared) if shared else media
                out.append((0, key, address, hashlib.sha256(media).digest(), n, chunks, body))
                out += [(1, None, chunks[i]["digest"], None, None, None, parts[i]) for i in sorted(here)]
            kinds = (pa.int32(), batch.schema.field(0).type, pa.binary(), pa.binary(), pa.int64(), _CHUNK, pa.binary())
            names = ["kind", "id", "object", "media_sha256", "n_bytes", "chunks", "body"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    written = rows.mapInArrow(of, f"kind int, id {rows.schema['id'].dataType.simpleString()}, object binary, media_sha256 binary, n_bytes long, chunks {_CHUNKS}, body binary")
    none = [(k, None, None, None, None, None, None) for k in (0, 1)]  # both folders exist, whatever is in them
    spark.createDataFrame(none, written.schema).write.partitionBy("kind").parquet(f"{path}/files")
    written.write.mode("append").option("compression", "zstd").partitionBy("kind").parquet(f"{path}/files")
    return media


def _rebuilt(body: bytes, chunks: list[dict] | None, shared: dict[bytes, bytes]) -> bytes:
    """The file: its chunks in order, its own from the body, the others by digest. Without a list the body is the file."""
    if not chunks:
        return body
    at, pieces = 0, []
    for c in chunks:
        if c["shared"]:
            if c["digest"] not in shared:
                raise ValueError(f"shared chunk {c['digest'].hex()} is missing")
            pieces.append(shared[c["digest"]])
        else:
            pieces.append(body[at : at + c["bytes"]])
            at += c["bytes"]
    return b"".join(pieces)


def read_back(media: MediaStore) -> DataFrame:
    """(id, object, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every container.

    Files that share nothing are read from their containers, without a shuffle. A file that isn't what
    was stored raises an error.
    """
    fields = [("object", pa.binary()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.binary()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.binary()), ("feature", pa.string())]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for address, sha, n, chunks, body, parts in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                file = _rebuilt(body, chunks, {p["digest"]: p["bytes"] for p in parts or () if p["bytes"] is not None})
                if hashlib.sha256(file).digest() != sha:
                    raise ValueError(f"stored media {address.hex()} can't be rebuilt")
                payload = from_wave(file)
                rows.append((address, n, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-64:]), len(file), sha, features(payload)))
            made = [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", *(n for n, _ in fields)])

    files, shares = media.containers(), F.expr("exists(chunks, c -> c.shared)")
    order = ["id", "object", "media_sha256", "n_bytes", "chunks", "body", "parts"]
    plain = files.where(~shares).withColumns({"chunks": F.lit(None).cast(_CHUNKS), "parts": F.lit(None).cast("array<struct<digest:binary,bytes:binary>>")})
    asked = files.where(shares).select("object", F.explode(F.expr("array_distinct(transform(filter(chunks, c -> c.shared), c -> c.digest))")).alias("digest")).distinct()
    parts = asked.join(media.shared(), "digest", "left").groupBy("object").agg(F.collect_list(F.struct("digest", "bytes")).alias("parts"))
    mixed = files.where(shares).join(parts, "object", "left").select(*order)
    out = f"id {media.id_type}, object binary, n_bytes long, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"
    return plain.select(*order).union(mixed).mapInArrow(of, out)


def media_features(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """Every row's payload stored as a chunked file, read back and measured; the columns of read_back() by id, digests in hex."""
    media = store(spark, docs, new_path(spark, "media-store"), id, text, broadcast_rows)
    measured, copies = materialise(read_back(media), "media-measured"), media.copies()
    copied = measured.join(broadcast_if_small(copies.select("object").distinct(), broadcast_rows), "object", "left_semi")
    copied = materialise(copied.drop("id").dropDuplicates(["object"]), "media-copied")
    again = copies.join(broadcast_if_small(copied, broadcast_rows // 5), "object").select(*measured.columns)
    text_of = lambda c: F.lower(F.hex(c)).alias(c)
    return measured.union(again).select(
        F.col("id").alias(id), "n_bytes", "payload_bytes", text_of("payload_sha256"), "tail_crc32", "media_bytes", text_of("media_sha256"), "feature", text_of("object")
    )
