"""Line deduplication over a sharded minimal perfect hash.

The distinct hashes of long lines are counted; those that reach the threshold are cut into shards by
hash. Each shard's task builds a minimal perfect hash over its hashes and, addressed by it, two compact
arrays: a fingerprint (the half of the 128-bit line hash that the perfect hash doesn't use) and the count,
with the largest document that holds the line. Documents are read again and probe the arrays; a line
is a member if the fingerprint at its slot is its own.

Shards of a measured total under `broadcast_bytes` go to every executor, and no line is shuffled. Beyond
that, a bit filter of a tenth of the arrays' size goes to the executors, and lines that pass it are routed to their shards;
a shard has as many copies as the number of its hits asks for, so a line which a third of all documents hold is probed
by many tasks. The result is the same.

A document is its id: rows of one id are the same document, and lose or keep a line together. Null ids
are one document, smaller than any other. Null or empty text is one empty line, and comes out as an empty text. A line of
the largest document that holds it stays, repeats included. Very long texts are split whole; an empty table stays
empty. Other columns pass as they are, whatever their names; an added column whose name is taken gets underscores behind it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.predicates import fresh
from lectern.shared import materialise, release_memory

_SPACE = b" \t\n\x0b\x0c\r"
_NONE = -(1 << 63)
#: Rewritten texts leave the worker so many at a time.
_ROWS = 500


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space at both ends, A-Z lower-cased (UTF-8)."""
    return line.strip(_SPACE).lower()


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _hashes(text: str | None, least: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """The lines, which of them are long enough, and the 128-bit hashes of those."""
    lines = (text or "").encode().split(b"\n")
    digest = xxhash.xxh3_128_digest
    where, out = [], []
    for i, line in enumerate(lines):
        if len(line) >= least and _long(key := line_key(line), least):
            where.append(i)
            out.append(digest(key))
    return lines, where, out


# --- the minimal perfect hash -------------------------------------------------------------------------


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Minimal perfect hash of distinct uint64 by cascaded bit arrays: a key lives in the first level where it is alone.

    Its slot is the number of set bits before its own. A key that isn't a member gets any slot.
    """

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.n = int(self.before[-1])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        left, sizes, parts, level = keys, [], [], 0
        while len(left):
            m = -(-max(64, int(gamma * len(left))) // 64) * 64
            at = (_mix(left, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(m)
            left = left[~alone[at]]
            level += 1
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A member's slot in 0..n-1; -1 where no level has the key's bit."""
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, m in enumerate(self.sizes):
            at = base + (_mix(keys[todo], level) % np.uint64(m)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            rank = self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = rank[hit]
            todo, base = todo[~hit], base + m
        return out


def _keys(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """What the perfect hash tells apart: 64 bits of both halves. Seed 0: the first half itself."""
    return a if not seed else _mix(a ^ _mix(b, seed), seed)


class Shard:
    """The perfect hash of a shard and its arrays, in slot order."""

    def __init__(self, seed: int, hash: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.seed, self.hash, self.prints, self.counts, self.last = seed, hash, prints, counts, last

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray, last: np.ndarray) -> Shard:
        """Of distinct lines' halves. Where two lines agree in the first half, the next seed mixes in the second."""
        seed = 0
        while len(np.unique(keys := _keys(a, b, seed))) < len(a):
            seed += 1
        hash = PerfectHash.build(keys)
        order = np.empty(len(keys), np.int64)
        order[hash.slots(keys)] = np.arange(len(keys))
        return cls(seed, hash, b[order], counts[order].astype(np.uint32), last[order])

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a member, and the largest document that holds its line."""
        slot = self.hash.slots(_keys(a, b, self.seed))
        if not self.hash.n:
            return np.zeros(len(slot), bool), np.zeros(len(slot), np.int64)
        safe = np.maximum(slot, 0)
        return (slot >= 0) & (self.prints[safe] == b), self.last[safe]

    def pack(self) -> bytes:
        head = np.array([len(self.hash.sizes), len(self.hash.words), self.hash.n, self.seed], np.int64)
        return b"".join(a.tobytes() for a in (head, np.array(self.hash.sizes, np.int64), self.hash.words, self.prints, self.last, self.counts))

    @classmethod
    def unpack(cls, blob: bytes) -> Shard:
        levels, words, n, seed = np.frombuffer(blob, np.int64, 4)
        at, out = 32, []
        for kind, count in ((np.int64, levels), (np.uint64, words), (np.uint64, n), (np.int64, n), (np.uint32, n)):
            out.append(np.frombuffer(blob, kind, count, at))
            at += int(count) * np.dtype(kind).itemsize
        return cls(int(seed), PerfectHash(out[0].tolist(), out[1]), out[2], out[4], out[3])


class Filter:
    """Bits of hashes: every member passes, and one in a hundred others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(b: np.ndarray, n: int) -> list[np.ndarray]:
        return [(_mix(b, 0xF117E4 + k) % np.uint64(n)).astype(np.int64) for k in range(3)]

    @classmethod
    def build(cls, b: np.ndarray) -> Filter:
        bits = np.zeros(-(-max(64, 12 * len(b)) // 64), np.uint64)
        for at in cls._places(b, 64 * len(bits)):
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return cls(bits)

    def passes(self, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(b), bool)
        for at in self._places(b, 64 * len(self.bits)):
            ok &= (self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return ok


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _shard_of(slot_half: np.ndarray, n: int) -> np.ndarray:
    return (_mix(slot_half, 0x5EED) % np.uint64(n)).astype(np.int64)


# --- the operator ------------------------------------------------------------------------------------


def line_hashes(docs: DataFrame, least: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, a, b): each document row's distinct hashes of lines of at least so many code points."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = set(_hashes(t.as_py(), least)[2])
                ids += [i] * len(found)
                digests += found
            a, b = _halves(digests)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["id", "a", "b"])

    rows = docs.select(F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_NONE)).alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(of, "id long, a long, b long")


def build_index(docs: DataFrame, least: int = 40, min_docs: int = 5, per_shard: int = 200_000, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """(shard, n, hits, blob, filter) for each shard, as a table, and the number of shards. hits: documents over all of its lines."""
    held = line_hashes(docs, least, id, text).groupBy("a", "b", "id").agg(F.count("*").alias("n"))
    common = materialise(held.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs), "line-common")
    shards = max(1, -(-common.count() // per_shard))

    @F.pandas_udf("int")
    def shard(a: pd.Series) -> pd.Series:
        return pd.Series(_shard_of(a.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        a, b = (part[c].to_numpy(np.int64).view(np.uint64) for c in ("a", "b"))
        made = Shard.build(a, b, part["n"].to_numpy(np.int64), part["last"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [key[0]], "n": [len(part)], "hits": [part["n"].sum()], "blob": [made.pack()], "filter": [Filter.build(b).bits.tobytes()]})

    table = common.withColumn("shard", shard("a")).groupBy("shard").applyInPandas(build, "shard int, n long, hits long, blob binary, filter binary")
    return materialise(table, "line-shards"), shards


def _rewrite(text: str | None, least: int, decide) -> tuple[str, int, int]:
    """(kept text, lines, dropped lines); decide(digests) tells which of the long lines go."""
    lines, where, digests = _hashes(text, least)
    gone = {i for i, g in zip(where, decide(digests), strict=True) if g} if digests else set()
    if not gone:
        return text or "", len(lines), 0
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode(), len(lines), len(gone)


def dedup_lines(
    spark: SparkSession, docs: DataFrame, least: int = 40, min_docs: int = 5, id: str = "doc_id", text: str = "text", broadcast_bytes: int = 64 << 20, per_shard: int = 200_000, hits_per_task: int = 500_000
) -> DataFrame:
    """docs with `text` replaced by its kept lines, and columns __n_lines, __n_dropped (long) added, their names with underscores behind if taken.

    Lines whose key has at least `least` code points and is in at least `min_docs` documents go, but
    from the largest document that holds them. Other columns pass as they are.
    """
    index, shards = build_index(docs, least, min_docs, per_shard, id, text)
    total = index.agg(F.coalesce(F.sum(F.length("blob")), F.lit(0))).first()[0]
    names = docs.columns
    rows = docs.select(
        F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_NONE)).alias("id"), F.col(f"`{text}`").alias("text"), F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text]).alias("row")
    )
    if total <= broadcast_bytes:
        kept = _by_broadcast(spark, rows, index, shards, least)
    else:
        kept = _by_route(spark, rows, index, shards, least, hits_per_task, broadcast_bytes)
    added = fresh(names, "__n_lines", "__n_dropped")
    return kept.select(*[F.col("o.kept").alias(c) if c == text else F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("o.lines").alias(added[0]), F.col("o.dropped").alias(added[1]))


_OUT = "kept string, lines long, dropped long"


def _by_broadcast(spark: SparkSession, rows: DataFrame, index: DataFrame, shards: int, least: int) -> DataFrame:
    packed = spark.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in index.select("shard", "blob").toLocalIterator()})

    @F.pandas_udf(_OUT)
    def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        arrays = {k: Shard.unpack(v) for k, v in packed.value.items()}
        for ids, texts in ((i.iloc[at : at + _ROWS], t.iloc[at : at + _ROWS]) for i, t in batches for at in range(0, len(t), _ROWS)):
            out = []
            for doc, t in zip(ids, texts, strict=True):

                def decide(digests: list[bytes], doc: int = doc) -> np.ndarray:
                    a, b = _halves(digests)
                    of, gone = _shard_of(a, shards), np.zeros(len(a), bool)
                    for s in np.unique(of).tolist() if shards > 1 else [0]:
                        if s in arrays:
                            at = np.flatnonzero(of == s)
                            member, last = arrays[s].probe(a[at], b[at])
                            gone[at] = member & (last != doc)
                    return gone

                out.append(_rewrite(t, least, decide))
            yield pd.DataFrame(out, columns=["kept", "lines", "dropped"])
        release_memory()

    return rows.select("row", probe("id", "text").alias("o"))


def _by_route(spark: SparkSession, rows: DataFrame, index: DataFrame, shards: int, least: int, hits_per_task: int, broadcast_bytes: int) -> DataFrame:
    """Lines go to salted copies of their shard; what must go comes back as a list per document."""

    @F.pandas_udf("int")
    def shard(a: pd.Series) -> pd.Series:
        return pd.Series(_shard_of(a.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    copies = F.greatest(F.lit(1), F.ceil(F.col("hits") / hits_per_task)).cast("int")
    index = materialise(index.withColumn("copies", copies), "line-index")
    lines = line_hashes(rows, least, "id", "text").withColumn("shard", shard("a"))
    if index.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0] <= broadcast_bytes:
        packed = spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in index.select("shard", "filter").toLocalIterator()})

        @F.pandas_udf("boolean")
        def may_be(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            filters = {k: Filter(np.frombuffer(v, np.uint64)) for k, v in packed.value.items()}
            for of, b in batches:
                b, of, ok = b.to_numpy(np.int64).view(np.uint64), of.to_numpy(), np.zeros(len(of), bool)
                for k in np.unique(of).tolist():
                    if k in filters:
                        ok[of == k] = filters[k].passes(b[of == k])
                yield pd.Series(ok)

        lines = lines.where(may_be("shard", "b"))
    salted = lines.join(F.broadcast(index.select("shard", "copies")), "shard")  # a row per shard of per_shard lines
    lines = salted.withColumn("salt", F.pmod(F.xxhash64("id", "b"), F.col("copies")).cast("int")).drop("copies")
    copies = index.select("shard", "blob", F.explode(F.expr("sequence(0, copies - 1)")).alias("salt"))

    def probe(asked: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        if packed.empty or asked.empty:
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "digest": pd.Series([], dtype="object")})
        a, b = (asked[c].to_numpy(np.int64).view(np.uint64) for c in ("a", "b"))
        member, last = Shard.unpack(packed["blob"].iloc[0]).probe(a, b)
        gone = member & (last != asked["id"].to_numpy(np.int64))
        both = np.stack([a[gone], b[gone]], axis=1)
        return pd.DataFrame({"id": asked["id"].to_numpy()[gone], "digest": [x.tobytes() for x in both]})

    gone = lines.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(probe, "id long, digest binary")
    per_doc = materialise(gone.groupBy("id").agg(F.collect_set("digest").alias("gone")), "line-gone")

    @F.pandas_udf(_OUT)
    def rewrite(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for t, g in zip(texts, gone, strict=True):
            drop = {bytes(x) for x in g} if g is not None else ()
            out.append(_rewrite(t, least, lambda digests, drop=drop: [x in drop for x in digests]))
        return pd.DataFrame(out, columns=["kept", "lines", "dropped"])

    return rows.join(per_doc, "id", "left").select("row", rewrite("text", "gone").alias("o"))
