"""Sets of numbers as bits, which tell tasks what is not worth a shuffle.

Bits come in chunks of 2^CHUNK, made by Spark's tasks. At most 2^MOST of them (32 MiB) are gathered and broadcast, however many numbers there
are: more share places then, so more pass than should, and nothing is ever lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, MOST = 14, 28
SCHEMA = "chunk long, bits binary"


def width(n: float, most: int = MOST) -> int:
    """The power of two at or above n as an exponent, from 20 to `most`."""
    return min(max(20, ceil(log2(max(1.0, n)))), most)


def chunks(values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(number, bits) of the chunks of sorted values."""
    if not len(values):  # numpy splits nothing into one part
        return
    of, first = np.unique(values >> CHUNK, return_index=True)
    for k, own in zip(of.tolist(), np.split(values, first[1:]), strict=True):
        alone = np.zeros(1 << CHUNK, np.uint8)
        alone[own & ((1 << CHUNK) - 1)] = 1
        yield k, np.packbits(alone, bitorder="little").tobytes()


def chunked(values: DataFrame) -> DataFrame:
    """values(v), not negative -> (chunk, bits)."""

    def build(rows: pa.Table) -> pa.Table:
        made = list(chunks(np.sort(rows.column("v").to_numpy())))
        return pa.table({"chunk": pa.array([k for k, _ in made], pa.int64()), "bits": pa.array([b for _, b in made], pa.binary())})

    return values.select("v", F.shiftright("v", CHUNK).alias("of")).groupBy("of").applyInArrow(build, SCHEMA)


class Bits:
    """Chunks by number."""

    def __init__(self, found: dict[int, bytes]):
        self.of = np.array(sorted(found), np.int64)
        self.bits = np.frombuffer(b"".join(found[k] for k in self.of.tolist()), np.uint8).reshape(len(found), 1 << (CHUNK - 3))
        self.dense = bool(len(found)) and int(self.of[-1]) == len(found) - 1

    @classmethod
    def gathered(cls, made: DataFrame) -> Bits:
        found = made.toArrow()
        return cls(dict(zip(found.column("chunk").to_pylist(), found.column("bits").to_pylist(), strict=True)))

    def holds(self, values: np.ndarray) -> np.ndarray:
        if not len(self.of):
            return np.zeros(len(values), bool)
        chunk = values >> CHUNK
        at = np.minimum(chunk if self.dense else np.searchsorted(self.of, chunk), len(self.of) - 1)
        own = values & ((1 << CHUNK) - 1)
        return (self.of[at] == chunk) & ((self.bits[at, own >> 3] >> (own & 7).astype(np.uint8)) & 1).astype(bool)


def passing(rows: DataFrame, column: str, keys: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """rows whose column is among keys' (nulls are equal), and a few others."""
    size = width(16 * keys.count(), most)
    place = lambda name: F.shiftrightunsigned(F.xxhash64(name), 64 - size)
    bits = rows.sparkSession.sparkContext.broadcast(Bits.gathered(chunked(keys.select(place(key).alias("v")))))

    @F.pandas_udf("boolean")
    def known(places: pd.Series) -> pd.Series:
        return pd.Series(bits.value.holds(places.to_numpy()))

    return rows.where(known(place(column)))
