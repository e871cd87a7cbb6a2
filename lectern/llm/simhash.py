"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing.

A random map sends each of the 64 bit positions to a nonzero vector of r+1 bits. Each of the 2^(r+1)-1
nonzero vectors v gives a table whose mask keeps the positions that are not orthogonal to v. Two
fingerprints that differ in at most r positions differ, for some v, only in positions orthogonal to it
(r equations over r+1 unknowns have a nonzero solution), so they share a key in that table: recall is 1,
not a probability.

Fingerprints that share a key are compared. A small group compares its pairs; a large one compares
through midpoints: two fingerprints are within r bits exactly if some value is within r/2 bits of both,
so linking every fingerprint to the least one around the same midpoint costs a row per midpoint instead
of a row per pair, with the same components.

Words are maximal runs outside [\\x20\\x09-\\x0D]; A-Z is lower-cased. Null, empty and wordless texts have
fingerprint 0 and link like any other. Rows that repeat give repeated rows; very long texts are hashed whole, a slice
of shingles at a time; an empty table gives an empty result. Other columns are ignored by near_duplicates() and kept by
keep_one(), whatever their names.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.tiles import BLOCK_SHINGLES, Cosine, bitmap, set_digest, tile_components
from lectern.operators.components import connected_components
from lectern.shared import broadcast_if_small, discard, materialise, release_memory

BITS = 64
#: Groups of more fingerprints than this are compared through midpoints.
PAIRS_UP_TO = 32
_SLICE = 1 << 16


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode().lower().split()  # of bytes, both know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, seed) for g in grams), np.uint64, n)


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint: a bit is 1 if it is set in over half the shingles' XXH64."""
    return _majority(shingle_hashes(text, shingle, seed))


def _majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _SLICE):
        part = hashes[at : at + _SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n).view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return of(text)


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """The masks of the 2^(radius+1)-1 tables, as signed longs."""
    vectors = list(range(1, 2 ** (radius + 1)))
    of_bit = [vectors[i % len(vectors)] for i in range(BITS)]
    random.Random(seed).shuffle(of_bit)
    masks = [sum(1 << i for i in range(BITS) if bin(of_bit[i] & v).count("1") % 2) for v in vectors]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _flips(radius: int) -> list[int]:
    values = [sum(1 << i for i in c) for k in range(radius // 2 + 1) for c in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in values]


def links(distinct: DataFrame, radius: int = 2, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """distinct(fp) -> (u, v): edges between fingerprints within an even radius, enough for their components.

    In groups of at most pairs_up_to every close pair is an edge; in larger ones edges go to the least
    fingerprint around a midpoint, and a path joins any two fingerprints that are close.
    """
    if radius % 2:
        raise ValueError("midpoints need an even radius")
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(covering_masks(radius))]))
    keyed = distinct.select("fp", tables.alias("k")).select("k.t", "k.key", "fp")
    sizes = materialise(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-groups")
    members = materialise(keyed.join(sizes, ["t", "key"]), "simhash-members")
    few = members.where(F.col("n") <= pairs_up_to).drop("n")
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius))
    near = pairs.select(F.col("b.fp").alias("u"), F.col("a.fp").alias("v"))
    around = F.explode(F.transform(F.array(*[F.lit(x) for x in _flips(radius)]), lambda x: F.col("fp").bitwiseXOR(x)))
    middles = members.where(F.col("n") > pairs_up_to).select("fp").distinct().select("fp", around.alias("middle"))
    least = materialise(middles.groupBy("middle").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "simhash-middles")
    via = middles.join(least, "middle").where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    return near.union(via).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = 2, shingle: int = 3, id: str = "doc_id", text: str = "text", pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """(id, fp, component_id) for each row: the least id reachable over links of at most radius bits. Null ids never name a component that has another id."""
    prints = materialise(docs.select(F.col(id).alias("id"), fingerprints(F.col(text), shingle).alias("fp")), "simhash-prints")
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-classes")
    edges = materialise(links(classes.select("fp"), radius, pairs_up_to), "simhash-links")
    roots = connected_components(edges, "simhash")
    rooted = materialise(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    named = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-named")
    of_class = materialise(rooted.join(named, "root").select("fp", "component_id"), "simhash-of-class")
    return prints.join(of_class, "fp").select(F.col("id").alias(id), "fp", "component_id")


#: Classes of shingles are so large, about, and so many of them are tables. Two texts of one size n whose cosine is 0.8 differ in 0.4 n
#: shingles, 1.2 for each class: a class is the same in both, and not empty, in 0.29 of cases, one of 20 in 0.999.
CLASS_SIZE, CLASSES = 3, 20


def class_fingerprints(hashes: np.ndarray, size: int = CLASS_SIZE, classes: int = CLASSES) -> list[tuple[int, int, int]]:
    """(number of classes, class, its fingerprint): SimHashes of the distinct shingles, parted by their hash into small classes.

    Of similar texts some class is likely to be the same in both, where the whole texts' fingerprints are some ten bits
    apart. The number of classes is a power of two that goes with the number of shingles; near a step both sides'
    numbers are used, so that texts whose numbers of shingles are as 1 to 1.56 at most have one in common.
    """
    own = np.unique(hashes)
    if not len(own):
        return []
    out = []
    for c in sorted({1 << max(0, int(np.log2(max(1.0, len(own) * f / size)))) for f in (0.8, 1.25)}):
        of = (own >> np.uint64(7)) & np.uint64(c - 1)
        keep = of < classes
        order = np.argsort(of[keep], kind="stable")
        held, of = own[keep][order], of[keep][order]
        if not len(held):
            continue
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        bits = np.add.reduceat(np.unpackbits(held.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32), starts, axis=0)
        n = np.diff(np.append(starts, len(held)))
        prints = np.packbits(2 * bits > n[:, None], axis=1).view(np.int64).ravel()
        out += [(c, k, p) for k, p in zip(of[starts].tolist(), prints.tolist(), strict=True)]
    return out


def _signatures(rows: DataFrame, shingle: int) -> DataFrame:
    """rows(id, tid, text) -> (id, tid, fp, sid, n, bits, parts array<struct<n,c,fp>>): fingerprint, digest, size and bitmap of the text's set of shingles (no bytes for the empty one), class fingerprints.

    Texts go through a task a few at a time and don't come back, so that a task's memory doesn't go with its rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                prints, sids, sizes, bits, parts, ends = [], [], [], [], [], [0]
                for t in part.column(2):
                    h = shingle_hashes(t.as_py(), shingle)
                    own = np.unique(h)
                    prints.append(_majority(h))
                    sids.append(set_digest(own) or b"")
                    sizes.append(len(own))
                    bits.append(bitmap(own).tobytes() if len(own) else b"")
                    parts += class_fingerprints(own)
                    ends.append(len(parts))
                flat = [pa.array([p[k] for p in parts], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int64()))]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, ["n", "c", "fp"]))
                made = [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["id", "tid", "fp", "sid", "n", "bits", "parts"])
        release_memory()

    return rows.select("id", "tid", "text").mapInArrow(of, f"id {kinds['id']}, tid binary, fp long, sid binary, n long, bits binary, parts array<struct<n:int,c:int,fp:long>>")


def keep_one(spark: SparkSession, docs: DataFrame, radius: int = 2, shingle: int = 5, similarity: float = 0.8, id: str = "doc_id", text: str = "text", block: int = BLOCK_SHINGLES) -> DataFrame:
    """docs with one row of each near-duplicate group: the one of the least id (null ids last), ties by text.

    Linked are texts whose fingerprints are within `radius` bits, by the covering tables, and texts whose sets of shingles have at least that cosine (which is what
    fingerprints' bits estimate) and that share a class fingerprint. Texts of one class fingerprint are a tile: whatever its size, what may be alike in it is compared
    exactly (tiles.tile_components), so no link within a tile is lost. All columns stay as they are, whatever they are called.
    Null text is like an empty one; of rows of one id and text one stays; an empty table stays empty.
    """
    names = docs.columns
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id).alias("id"), body.alias("text")).withColumn("tid", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    keys = materialise(_signatures(rows, shingle), "keep-keys")
    # sets of one fingerprint hang on the least of them, and those on each other by the fingerprints' links
    classes = materialise(keys.groupBy("fp").agg(F.min("sid").alias("head")), "keep-classes")
    near = materialise(links(classes.select("fp"), radius), "keep-near")
    heads = lambda c: classes.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    edges = near.join(heads("u"), "u").join(heads("v"), "v").select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))
    same = keys.select("fp", F.col("sid").alias("u")).join(classes, "fp").where("u <> head").select("u", F.col("head").alias("v")).distinct()
    sets = materialise(keys.dropDuplicates(["sid"]).select("sid", "n", "parts"), "keep-sets")
    parts = materialise(sets.select("sid", "n", F.explode("parts").alias("p")).select("sid", "n", F.xxhash64("p.n", "p.c", "p.fp").alias("g")).distinct(), "keep-parts")
    # tiles of the very same members are one
    seals = parts.groupBy("g").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("sid")).alias("seal"), F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("seal2")).where("m > 1")
    tiles = materialise(seals.groupBy("m", "seal", "seal2").agg(F.min("g").alias("g")).select("g"), "keep-tiles")
    members = materialise(parts.join(broadcast_if_small(tiles), "g").select(F.col("g").alias("tile"), F.col("sid").alias("tid"), "n"), "keep-members")
    linked = materialise(edges.union(same), "keep-linked")
    roots = tile_components(members, rows.select("id", "text"), keys.select("id", F.col("sid").alias("tid"), "bits"), lambda t: np.unique(shingle_hashes(t, shingle)), Cosine(round(100 * similarity)), block, "keep", linked)
    firsts = materialise(keys.groupBy("sid").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "tid")).alias("first")), "keep-firsts")
    winners = materialise(
        firsts.join(roots, firsts["sid"] == roots["node"], "left").groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("first").alias("first")).select("first.id", "first.tid"), "keep-winners"
    )
    discard(classes, near, sets, parts, tiles, members, linked, roots, firsts, keys)
    kept = rows.join(broadcast_if_small(winners), rows["id"].eqNullSafe(winners["id"]) & (rows["tid"] == winners["tid"]), "left_semi")
    copies = Window.partitionBy("id", "tid").orderBy(F.lit(1))  # rows of one id and text: one stays
    return kept.withColumn("copy", F.row_number().over(copies)).where("copy = 1").select("row.*")
