"""Exact Jaccard join of documents' shingle sets: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A document's set is that of its distinct shingles. Documents of equal sets are one class, compared once. Two sets of sizes m <= n with
a Jaccard index of J or more share, in any order of all shingles, one of the first n - ceil(J n) + 1 of each (the rest of
both is too small for the overlap they need). So every link is between classes that hold some shingle among their first: these are a *tile*.
Common shingles come last in the order, so tiles are small; which ones are common each task finds among its own
documents, and Spark adds up. The order decides what is compared, never what is linked.

Tiles with the very same members are one, so a pair of copies meets once, not once for every shingle. A tile is cut by size bands of ratio J
(links are within a band or between neighbours) and, if it holds more than BLOCK_SHINGLES, into blocks of members; each pair of blocks is a
task's unit of work, so a tile with a third of all documents is many tasks. In it, members are compared by their bitmaps: every bit that differs is at least
one element of the symmetric difference, so m + n - popcount bounds twice the overlap from above. Only what passes is
intersected exactly, as sorted arrays, and what is connected within the tile already is not compared again: a tile of k copies
costs k intersections, and gives at most k - 1 edges.

A shingle that one class alone has among its first is no tile. Which ones two have is told by bits of their hashes (bit_filter), so the others are
not shuffled with their documents; a place of bits that several share lets some of these through, and they are dropped where tiles are counted.

Bitmaps go to the tiles first, and sets are made and sent only where these leave something. Two rounds: each class goes to its largest and its smallest tile alone, then all tiles
whose members are not of one component yet, screened again by wider bitmaps, compare what is in different ones. The result is exact: no cap, no sampling, no probability.

Words are maximal runs outside [\\x20\\x09-\\x0D]; A-Z is lower-cased. With fewer words than a shingle has, the whole sequence is the one
element. Null, empty and wordless texts have no elements and link with nothing. Rows that repeat are equal sets; of rows of one id each is told its own.
Very long texts are taken whole. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bit_filter import CHUNK, MOST, SCHEMA, Bits, chunked, chunks, width
from lectern.llm.tiles import BLOCK_SHINGLES, Jaccard, Likeness, _mixed, bitmap, set_digest, shingle_set, tile_components
from lectern.shared import broadcast_if_small, discard, materialise, release_memory

#: Shingles of so many documents of one task at least are candidates for common ones; those with the most documents, at most COMMON, come last in the order.
SEEN, COMMON = 3, 1 << 18


def prefix(own: np.ndarray, likeness: Likeness, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - least + 1 of a set: by hash, the common ones (sorted, with their ranks) last."""
    n = len(own) - likeness.least(len(own)) + 1 if len(own) else 0
    if not len(common) or not n:
        return own[:n]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    hot = common[at] == own
    if not hot.any():
        return own[:n]
    cold = own[~hot][:n]
    return cold if len(cold) == n else np.concatenate([cold, own[hot][np.argsort(rank[at[hot]], kind="stable")][: n - len(cold)]])


def common_shingles(spark: SparkSession, docs: DataFrame, text: str, shingle: int, seen: int = SEEN, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, their ranks from rare to frequent) of the `most` most frequent ones. Every task counts all its documents of different sets and tells
    of shingles that `seen` of them have, at least; Spark adds up."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies: set[bytes] = set()
        held, size = [], 0

        def told() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = counts >= seen
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["h", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                own = shingle_set(t, shingle)
                if (digest := xxhash.xxh128_digest(own)) not in copies:
                    copies.add(digest)
                    held.append(own)
                    size += len(own)
                if size > 4_000_000:
                    yield told()
                    size = 0
        yield told()
        release_memory()

    counts = docs.select(F.col(text).alias("text")).mapInArrow(of, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "h").limit(most).toPandas()  # `most` rows at most, 16 bytes each
    rows = rows.iloc[::-1]
    keys = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.arange(len(keys))[order]


def _sets(docs: DataFrame, text: str, shingle: int, likeness: Likeness, common) -> DataFrame:
    """docs' id with a number of the row, n, tid (a digest of the set; null for the empty one), its bitmap and the prefix."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = common.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingle_set(t, shingle) for t in part.column(1).to_pylist()]
                firsts = [prefix(s, likeness, keys, ranks).view(np.int64) for s in sets]
                tids = [set_digest(s) for s in sets]
                offsets = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts)))
                numbers = pa.array(np.arange(row, row + len(sets)))
                row += len(sets)
                yield pa.RecordBatch.from_arrays([part.column(0), numbers, pa.array([len(s) for s in sets], pa.int64()), pa.array(tids, pa.binary()), pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary()), lists], names=["id", "row", "n", "tid", "bits", "firsts"])
        release_memory()

    return docs.select(F.col("id"), F.col(text).alias("text")).mapInArrow(of, "id long, row long, n long, tid binary, bits binary, firsts array<long>")


def _rows_and_firsts(batches: Iterator[pa.RecordBatch], chosen: Bits | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of every batch (row, firsts), the number of the row for each of its firsts, and these; chosen: only of such rows."""
    for batch in batches:
        rows, firsts = batch.column(0).to_numpy(), batch.column(1)
        lengths = firsts.value_lengths().to_numpy()
        values = firsts.flatten().to_numpy().view(np.uint64)
        if chosen is not None:
            own = chosen.holds(rows)
            values, rows, lengths = values[np.repeat(own, lengths)], rows[own], lengths[own]
        yield np.repeat(rows, lengths), values


def _shared(sets: DataFrame, chosen, postings: int, most: int) -> tuple[DataFrame, int]:
    """Chunks of the bits of shingles that two classes have among their firsts, and the bits' width: the first so many of the mixed hash are the place. A task's
    shingles go out packed, 32 bits each beside the part that they are dealt by; two that agree in all of these count as one."""
    size = width(postings, most)
    parts = min(size - CHUNK, 12, max(4, (postings // 50_000).bit_length()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def told() -> pa.RecordBatch:
            own = np.sort(_mixed(np.concatenate(held)) >> np.uint64(32 - parts)) if held else np.zeros(0, np.uint64)
            held.clear()
            own = own[np.concatenate([np.ones(min(2, len(own)), bool), own[2:] != own[:-2]])]  # twice tells as much as more often
            part, first = np.unique(own >> np.uint64(32), return_index=True)
            packed = [x.tobytes() for x in np.split(own.astype(np.uint32), first[1:])] if len(own) else []
            return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(packed, pa.binary())], names=["part", "own"])

        for _, values in _rows_and_firsts(batches, chosen and chosen.value):
            held.append(values)
            n += len(values)
            if n > 4_000_000:
                yield told()
                n = 0
        yield told()
        release_memory()

    def build(rows: pa.Table) -> pa.Table:
        own = np.sort(np.frombuffer(b"".join(rows.column("own").to_pylist()), np.uint32)).astype(np.int64)
        twice = np.unique(own[1:][own[1:] == own[:-1]]) | (rows.column("part")[0].as_py() << 32)
        made = list(chunks(twice >> (parts + 32 - size)))
        return pa.table({"chunk": pa.array([k for k, _ in made], pa.int64()), "bits": pa.array([b for _, b in made], pa.binary())})

    return sets.select("row", "firsts").mapInArrow(of, "part long, own binary").groupBy("part").applyInArrow(build, SCHEMA), size


def _held(sets: DataFrame, classes: DataFrame, likeness: Likeness, most: int) -> DataFrame:
    """(row, h): of one row of each class the firsts that another class has too, and some more."""
    sc = sets.sparkSession.sparkContext
    n, elements = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    chosen = None
    if n <= 1 << most:  # a bit for each row
        chosen = sc.broadcast(Bits.gathered(chunked(classes.select(F.col("row").alias("v")))))
    else:
        sets = sets.join(classes.select("row"), "row", "left_semi")
    made, size = _shared(sets, chosen, n + int(elements * (1 - likeness.share())), most)
    shared = sc.broadcast(Bits.gathered(made))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, values in _rows_and_firsts(batches, chosen and chosen.value):
            ok = shared.value.holds((_mixed(values) >> np.uint64(64 - size)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(rows[ok]), pa.array(values[ok].view(np.int64))], names=["row", "h"])
        release_memory()

    return sets.select("row", "firsts").mapInArrow(of, "row long, h long")


def jaccard_components(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text", block: int = BLOCK_SHINGLES, seen: int = SEEN, common: int = COMMON, bits: int = MOST) -> DataFrame:
    """(id, n_shingles, component_id) of each row: the set's size, and the least id reachable over links of percent / 100 Jaccard or more, its own included."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    likeness = Jaccard(percent)
    hot = spark.sparkContext.broadcast(common_shingles(spark, rows, "text", shingle, seen, common))
    sets = materialise(_sets(rows, "text", shingle, likeness, hot), "jaccard-sets")
    classes = materialise(sets.where("tid is not null").groupBy("tid").agg(F.min("id").alias("first"), F.min("n").alias("n"), F.min("row").alias("row")), "jaccard-classes")
    # one row of each class, told by its number
    held = materialise(_held(sets, classes, likeness, bits), "jaccard-held")
    # tiles of the very same members are one: the least of their shingles
    seals = held.groupBy("h").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("row")).alias("seal"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("seal2")).where("m > 1")
    tiles = materialise(seals.groupBy("m", "seal", "seal2").agg(F.min("h").alias("h")).select("h"), "jaccard-tiles")
    members = materialise(held.join(broadcast_if_small(tiles), "h").join(classes.select("row", "tid", "n"), "row").select(F.col("h").alias("tile"), "tid", "n"), "jaccard-members")
    linked = tile_components(members, rows, sets, lambda t: shingle_set(t, shingle), likeness, block, "jaccard")
    rooted = materialise(classes.join(linked, classes["tid"] == linked["node"], "left").select("tid", "first", F.coalesce("root", "tid").alias("root")), "jaccard-rooted")
    named = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "jaccard-named")
    of_class = materialise(rooted.join(named, "root").select("tid", "component_id"), "jaccard-of-class")
    discard(held, tiles, members, rooted, named)
    out: list[Column] = [F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")]
    return sets.join(of_class, "tid", "left").select(*out)
