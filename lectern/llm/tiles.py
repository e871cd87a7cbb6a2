"""Tiles: groups of documents that hold one key, compared exactly, without a row for each pair.

A tile is cut by size bands (what is alike is in a band or in neighbouring ones) and, if it holds more than BLOCK_SHINGLES, into blocks of
members; each pair of blocks is a unit of work, so a tile with a third of all documents is many tasks. In it, members are compared by hashed bitmaps of
their sets: every bit that differs is at least one element of the symmetric difference, which bounds the overlap from above. Only what passes is intersected
exactly, as sorted arrays, and what is connected within the tile already is not compared again: a tile of k copies costs k intersections, and gives at most k - 1 edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lectern.llm.bit_filter import passing
from lectern.operators.components import connected_components
from lectern.shared import broadcast_if_small, discard, materialise, release_memory

#: Elements of a block of members; a set with more is a block of its own.
BLOCK_SHINGLES = 400_000
#: The second screen's bitmaps have 2^_WIDER times the bits.
_WIDER = 3
_MIX = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them (multiplications and shifts)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The sorted distinct shingles as 64-bit hashes: words by XXH64, sequences of words by mixing theirs in order."""
    words = (text or "").encode().lower().split()  # of bytes, both know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.fromiter(map(digest, words), np.uint64, len(words))
    k = min(shingle, len(w))
    h = np.full(len(w) - k + 1, k * _MIX % (1 << 64), np.uint64)
    for i in range(k):
        h = _mixed((h + w[i : len(w) - k + 1 + i]) * np.uint64(_MIX))
    return np.unique(h)


def set_digest(own: np.ndarray) -> bytes | None:
    """What tells sets apart; null for the empty one."""
    return xxhash.xxh128_digest(own) if len(own) else None


@dataclass(frozen=True)
class Likeness:
    """When two sets are alike; percent: 100 times the least likeness."""

    percent: int

    def met(self, overlap, m, n):
        """Whether sets of m and n elements are alike that have so many in common (numbers or arrays; grows with overlap)."""
        raise NotImplementedError

    def least(self, n: int) -> int:
        """The least overlap of a set of n with any that is like it."""
        return self.smallest(n)

    def smallest(self, n: int) -> int:
        """The least size of a set that is like one of n, and no larger."""
        raise NotImplementedError

    def share(self) -> float:
        """The least ratio of two sizes."""
        raise NotImplementedError


class Jaccard(Likeness):
    """Intersection by union."""

    def met(self, overlap, m, n):
        return 100 * overlap >= self.percent * (m + n - overlap)

    def smallest(self, n: int) -> int:
        return -(-n * self.percent // 100)

    def share(self) -> float:
        return self.percent / 100


class Cosine(Likeness):
    """Intersection by the root of the sizes' product."""

    def met(self, overlap, m, n):
        return 10_000.0 * overlap * overlap >= float(self.percent**2) * m * n

    def smallest(self, n: int) -> int:
        return -(-n * self.percent**2 // 10_000)

    def share(self) -> float:
        return (self.percent / 100) ** 2


def bitmap(own: np.ndarray, wider: int = 0) -> np.ndarray:
    """2^k bits, the power of two at or above the size, at least 64 (and 2^wider times as many): bit h mod 2^k for every element."""
    bits = 1 << (max(6, (len(own) - 1).bit_length()) + wider)
    out = np.zeros(bits, np.uint8)
    out[(own >> np.uint64(20)) & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of fewer words with the same elements."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _elements(texts: DataFrame, make: Callable[[str | None], np.ndarray]) -> DataFrame:
    """texts(tid, text) -> (tid, s): the set's elements as bytes, of those whose digest is tid."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = [(tid, s) for tid, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if set_digest(s := make(t)) == tid]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.binary()), pa.array([x[1].tobytes() for x in made], pa.binary())], names=["tid", "s"])
        release_memory()

    return texts.select("tid", "text").mapInArrow(of, "tid binary, s binary")


class _Tile:
    """Members of a tile's group by size: which of those before one may be alike, by sizes and bitmaps; pairs count whose larger set is in `band`, of
    different labels, and of different sides unless there is one only."""

    def __init__(self, sizes: list[int], bitmaps: list[np.ndarray], sides: list[int], bands: list[int], labels: list, band: int, likeness: Likeness, one: bool):
        n = np.array(sizes)
        self.order = np.argsort(n, kind="stable")
        self.n, self.sides, self.bands = n[self.order], np.array(sides)[self.order], np.array(bands)[self.order]
        words = min(map(len, bitmaps))
        self.bits = np.stack([_folded(bitmaps[i], words) for i in self.order])
        numbers = {x: k for k, x in enumerate(dict.fromkeys(labels))}
        self.root = np.array([numbers[labels[i]] for i in self.order])
        self.band, self.likeness, self.one = band, likeness, one

    def near(self, j: int) -> np.ndarray:
        n = self.n
        low = int(np.searchsorted(n, self.likeness.smallest(int(n[j]))))
        if self.bands[j] != self.band or low >= j:
            return np.zeros(0, np.int64)
        near = np.flatnonzero((self.root[low:j] != self.root[j]) & (self.one | (self.sides[low:j] != self.sides[j]))) + low
        if not len(near):
            return near
        apart = np.bitwise_count(self.bits[near] ^ self.bits[j]).sum(axis=1)
        return near[self.likeness.met((n[near] + n[j] - apart) / 2, n[near], n[j])]  # at most that overlap


def tile_marks(sizes: list[int], bitmaps: list[np.ndarray], sides: list[int], bands: list[int], labels: list, band: int, likeness: Likeness, one: bool) -> list[int]:
    """The members of which some other may be alike, as far as bitmaps tell."""
    tile, marked = _Tile(sizes, bitmaps, sides, bands, labels, band, likeness, one), set()
    for j in range(1, len(sizes)):
        near = tile.near(j)
        if len(near):
            marked.add(j)
            marked.update(near.tolist())
    return [int(tile.order[i]) for i in sorted(marked)]


def tile_edges(sets: list[np.ndarray], sides: list[int], bands: list[int], labels: list, band: int, likeness: Likeness, one: bool) -> Iterator[tuple[int, int]]:
    """Edges (i, j) enough to connect what is alike in a tile's group, exactly."""
    tile = _Tile([len(s) for s in sets], [bitmap(s) for s in sets], sides, bands, labels, band, likeness, one)
    n, root, order = tile.n, tile.root, tile.order
    for j in range(1, len(order)):
        for i in tile.near(j)[::-1]:
            if root[i] == root[j]:
                continue
            overlap = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
            if likeness.met(overlap, n[i], n[j]):
                root[root == root[i]] = root[j]
                yield int(order[i]), int(order[j])


_KEYS = ["tile", "band", "x", "y"]


def _grouped(rows: DataFrame, columns: list[str], work: Callable[[tuple, list[tuple]], Iterator[tuple[Any, Any]]], schema: str) -> DataFrame:
    """What work(key, members' columns) gives for each group (tile, band, x, y) of two members or more. A group is at most two blocks; rows stream in groups' order."""
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def made(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds)

        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != key:
                    if len(group) > 1:
                        found += work(key, group)
                    key, group = row[:4], []
                group.append(row[4:])
            if found:
                yield made(found)
        if len(group) > 1 and (found := list(work(key, group))):
            yield made(found)
        release_memory()

    return rows.select(*_KEYS, *columns).repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(of, schema)


def _screened(rows: DataFrame, likeness: Likeness) -> DataFrame:
    """rows(tile, band, x, y, side, own_band, tid, label, n, bits) -> (tile, tid) that may have something alike in the tile."""
    kind = rows.schema["tile"].dataType.simpleString()

    def work(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        sides, bands, tids, labels, sizes, bits = zip(*group, strict=True)
        for i in tile_marks(list(sizes), [np.frombuffer(b, np.uint64) for b in bits], list(sides), list(bands), list(labels), key[1], likeness, key[2] == key[3]):
            yield key[0], tids[i]

    return _grouped(rows, ["side", "own_band", "tid", "label", "n", "bits"], work, f"tile {kind}, tid binary").distinct()


def _compared(rows: DataFrame, likeness: Likeness) -> DataFrame:
    """rows(tile, band, x, y, side, own_band, tid, label, s) -> edges (u, v)."""

    def work(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        sides, bands, tids, labels, sets = zip(*group, strict=True)
        for i, j in tile_edges([np.frombuffer(s, np.uint64) for s in sets], list(sides), list(bands), list(labels), key[1], likeness, key[2] == key[3]):
            yield tids[i], tids[j]

    return _grouped(rows, ["side", "own_band", "tid", "label", "s"], work, "u binary, v binary")


def _blocked(members: DataFrame, likeness: Likeness, block: int) -> DataFrame:
    """members(tile, tid, n, label) dealt to (tile, band, x, y) groups: a band of sizes and the one below it, in pairs of blocks."""
    share = likeness.share()
    own = F.floor(F.log(F.col("n").cast("double")) / -log(share) + 1e-9).cast("long") if share < 1 else F.col("n")
    banded = members.withColumn("own_band", own).withColumn("band", F.explode(F.array(F.col("own_band"), F.col("own_band") + 1)))
    sums = materialise(
        banded.groupBy("tile", "band").agg(F.sum("n").alias("total"), F.max("own_band").alias("top"), F.count("*").alias("m")).where("m > 1 and top = band").select("tile", "band", F.greatest(F.lit(1), F.ceil(F.col("total") / block)).cast("int").alias("blocks")), "tile-bands"
    )
    told = banded.join(broadcast_if_small(sums), ["tile", "band"])
    mine = F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(mine, o).alias("x"), F.greatest(mine, o).alias("y")))
    return told.withColumn("p", F.explode(pairs)).select("tile", "band", "p.x", "p.y", mine.alias("side"), "own_band", "tid", "label", "n")


def _links(members: DataFrame, elements: DataFrame, likeness: Likeness, block: int, name: str) -> DataFrame:
    dealt = materialise(_blocked(members, likeness, block), f"{name}-dealt")
    out = materialise(_compared(elements.join(broadcast_if_small(dealt), "tid"), likeness), name)
    discard(dealt)
    return out


def _wide(elements: DataFrame) -> DataFrame:
    """elements(tid, s) with wider bitmaps in place of the sets, an eighth to a fourth of their size: few elements share a bit, so the bound on the overlap is close."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [bitmap(np.frombuffer(s, np.uint64), _WIDER).tobytes() for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["tid", "bits"])

    return elements.select("tid", "s").mapInArrow(of, "tid binary, bits binary")


def _screen(members: DataFrame, bits: DataFrame, likeness: Likeness, block: int, name: str) -> DataFrame:
    """A table (tile, m, tid) of members(tile, tid, n, label) that may be like something of another label in the tile; of tiles in which the same are left, one. block: elements of a block of members."""
    dealt = materialise(_blocked(members, likeness, block), f"{name}-dealt")
    marked = materialise(_screened(bits.join(broadcast_if_small(dealt), "tid"), likeness), f"{name}-marked")
    sealed = marked.groupBy("tile").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("tid")).alias("seal"), F.bit_xor(F.xxhash64(F.lit(1), "tid")).alias("seal2"))
    one = materialise(sealed.groupBy("m", "seal", "seal2").agg(F.min("tile").alias("tile")).select("tile", "m"), f"{name}-one")
    out = materialise(marked.join(broadcast_if_small(one), "tile"), name)
    discard(dealt, marked, one)
    return out


def tile_components(members: DataFrame, rows: DataFrame, keyed: DataFrame, make: Callable[[str | None], np.ndarray], likeness: Likeness, block: int = BLOCK_SHINGLES, name: str = "tiles", linked: DataFrame | None = None) -> DataFrame:
    """(node, root) over linked(u, v) and what is alike within tiles, exactly.

    members(tile, tid, n): the tiles' different sets by tid, the digest of the set (of n elements); rows(id, text) and keyed(id, tid, bits): where to find them and their
    bitmaps; make: the sorted distinct elements of a text. First the bitmaps alone, which are some fortieth of the sets, tell who has anyone in a tile that may be alike; only these sets are made
    and sent. Then two rounds: each set goes to the largest and to the smallest tile it has left, and then all tiles whose members are not of one component yet, screened
    again by wider bitmaps, compare what is in different ones.
    """
    bits = keyed.groupBy("tid").agg(F.min("bits").alias("bits"))  # equal sets have equal ones
    bits = materialise(bits.join(broadcast_if_small(materialise(members.select("tid").distinct(), f"{name}-some")), "tid", "left_semi"), f"{name}-bits")
    left = _screen(members.withColumn("label", F.col("tid")), bits, likeness, 40 * block, f"{name}-screened")
    left = materialise(left.join(members.select("tile", "tid", "n"), ["tile", "tid"]), f"{name}-left")
    ends = left.groupBy("tid").agg(F.array_distinct(F.array(F.max_by("tile", F.struct("m", "tile")), F.min_by("tile", F.struct("m", "tile")))).alias("tiles"), F.min("n").alias("n"))
    met = materialise(ends.select("tid", "n", F.explode("tiles").alias("tile")), f"{name}-met")
    wanted = materialise(keyed.join(broadcast_if_small(met.select("tid").distinct()), "tid", "left_semi").groupBy("tid").agg(F.min("id").alias("of")), f"{name}-wanted")
    few = broadcast_if_small(wanted)
    if few is wanted:  # texts are shuffled then: of those that may be wanted
        rows = passing(rows, "id", wanted, "of")
    # rows of one id and text give a set twice, which then is in its tiles twice, under one label
    elements = materialise(_elements(rows.join(few, rows["id"].eqNullSafe(few["of"])).select("tid", "text"), make), f"{name}-elements")
    first = _links(met.select("tile", "tid", "n", F.col("tid").alias("label")), elements, likeness, block, f"{name}-first")
    if linked is not None:
        first = materialise(first.union(linked), f"{name}-first")
    roots = materialise(connected_components(first, name), f"{name}-roots")
    labelled = materialise(left.join(roots, left["tid"] == roots["node"], "left").select("tile", "tid", "n", F.coalesce("root", "tid").alias("label")), f"{name}-labelled")
    mixed = materialise(labelled.groupBy("tile").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a <> z").select("tile"), f"{name}-mixed")
    open_ones = materialise(labelled.join(broadcast_if_small(mixed), "tile"), f"{name}-open")
    again = _screen(open_ones, _wide(elements), likeness, 4 * block, f"{name}-again")
    second = _links(open_ones.join(again.drop("m"), ["tile", "tid"]), elements, likeness, block, f"{name}-second")
    out = materialise(connected_components(first.union(second), name), f"{name}-linked")
    discard(bits, left, open_ones, again, met, wanted, elements, first, second, roots, labelled, mixed)
    return out
