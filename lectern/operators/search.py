"""Approximate search of many passages in a library: all texts that hold a passage within a number of errors.

A match with at most k errors leaves one of any k+1 disjoint pieces of the passage unchanged (pigeonhole). The pieces are grams of one
length, chosen for each passage so that together they are as rare in the texts as k+1 disjoint ones can be: a common gram is passed over for another, never
cut off, so the search stays exact. Seeds meet the texts' grams in an equi-join; what meets is a place where a match may be, and neighbouring
places are one stretch of text, which bit-parallel verification looks through once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.align import _masks
from lectern.shared import broadcast_if_small, discard, materialise


def errors_allowed(text: Column, share: float, least: int) -> Column:
    return F.greatest(F.floor(F.length(text) * share), F.lit(least)).cast("int")


def rarest_pieces(costs: list[int], size: int, pieces: int) -> list[int]:
    """Places of `pieces` disjoint grams of that size, of the least sum of costs (a cost for each place); the first of the best."""
    n = len(costs)
    # best[p][i]: the least cost of p pieces among places before i
    before, taken = [0] * (n + size), []
    for _ in range(pieces):
        now, took = [1 << 62] * (n + size), [-1] * (n + size)
        for i in range(n):
            now[i + size], took[i + size] = now[i + size - 1], took[i + size - 1]
            found = before[i] + costs[i]
            if found < now[i + size]:
                now[i + size], took[i + size] = found, i
        taken.append(took)
        before = now
    out, end = [], n + size - 1
    for took in reversed(taken):
        out.append(took[end])
        end = took[end]
    return out[::-1]


def least_match(needle: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(start, end, distance) of the part of text nearest to needle: of the nearest the first to end, and of these the shortest; None beyond `most`."""

    def scan(pattern: str, along: str, anywhere: bool) -> tuple[int, int]:
        """(distance, end) where the distance is least, the first of these: a column of the distance table is two integers of its differences (Myers)."""
        n, masks = len(pattern), _masks(pattern)
        full, top, edge = (1 << n) - 1, 1 << (n - 1), int(not anywhere)
        up, down, score, least, end = full, 0, n, n, 0
        of = masks.get
        for j, ch in enumerate(along, 1):
            same = of(ch, 0)
            v = same | down
            h = (((same & up) + up) ^ up) | same
            plus, minus = down | (full & ~(h | up)), up & h
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
                if score < least:
                    least, end = score, j
            plus, minus = plus << 1 | edge, minus << 1
            up, down = (minus | ~(v | plus)) & full, plus & v & full
        return least, end

    if not needle:
        return 0, 0, 0
    distance, end = scan(needle, text, True)
    if distance > most:
        return None
    begin = text[max(0, end - len(needle) - distance) : end][::-1]
    back = scan(needle[::-1], begin, False)[1]
    return end - back, end, distance


def _grams(text: Column, size: Column) -> Column:
    @F.pandas_udf("array<string>")
    def of(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([[t[i : i + k] for i in range(len(t) - k + 1)] for t, k in zip(texts, sizes, strict=True)])

    return of(text, size)


class _Wanted:
    """Grams looked for in texts: hashes that roll over the code points of many texts at once tell where one may be, and these places are compared."""

    _BASE, _SPREAD, _GAP = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), 0x110000  # no code point

    def __init__(self, grams: list[str], sizes: list[int]):
        self.grams, self.sizes = frozenset(grams), sizes
        self.shift = np.uint64(64 - max(10, min(24, (16 * len(grams)).bit_length())))
        self.marks = {k: np.zeros(1 << (64 - int(self.shift)), bool) for k in sizes if any(len(g) == k for g in grams)}
        for k, marks in self.marks.items():
            own = np.frombuffer("".join(g for g in grams if len(g) == k).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, k)
            h = np.zeros(len(own), np.uint64)
            for column in own.T:
                h = h * self._BASE + column
            marks[(h * self._SPREAD) >> self.shift] = True

    def places(self, texts: list[str]) -> Iterator[tuple[int, int, str]]:
        """(text's number, place, gram) of all grams in the texts."""
        points = np.full(sum(map(len, texts)) + len(texts), self._GAP, np.uint64)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        for t, at in zip(texts, starts.tolist()[:-1], strict=True):
            points[at : at + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(points) + 1, np.uint64)
        for k in range(1, max(self.marks, default=0) + 1):
            h = h[:-1] * self._BASE + points[k - 1 :]
            if k not in self.marks:
                continue
            at = np.flatnonzero(self.marks[k][(h * self._SPREAD) >> self.shift])
            which = np.searchsorted(starts, at, "right") - 1
            for w, i in zip(which.tolist(), (at - starts[which]).tolist(), strict=True):
                gram = texts[w][i : i + k]
                if len(gram) == k and gram in self.grams:
                    yield w, i, gram


def _met(texts: DataFrame, wanted: DataFrame, sizes: list[int], most: int, some: int = 100_000) -> DataFrame:
    """(text_id, at, gram): where the texts have wanted grams. Up to `most` of them go to all tasks, which tell of these alone; beyond, tasks tell of all grams, and a join keeps the wanted.

    Texts are looked through in parts of `some` places, and short ones together.
    """
    few = wanted.count() <= most
    known = wanted.sparkSession.sparkContext.broadcast([r["gram"] for r in wanted.collect()]) if few else None
    schema = f"text_id {texts.schema['text_id'].dataType.simpleString()}, at int, gram string"
    beyond = max(sizes, default=1) - 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = _Wanted(known.value, sizes) if known else None

        def told(ids: pa.Array, rows: list[int], begins: list[int], parts: list[str]) -> Iterator[pa.RecordBatch]:
            if keep:
                found = [(rows[w], begins[w] + i, g) for w, i, g in keep.places(parts) if i < some]
            else:
                found = [(row, begin + i, t[i : i + k]) for row, begin, t in zip(rows, begins, parts, strict=True) for k in sizes for i in range(min(some, len(t) - k + 1))]
            if found:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([f[0] for f in found])), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string())], ["text_id", "at", "gram"])

        for batch in batches:
            rows, begins, parts, size = [], [], [], 0
            for row in range(batch.num_rows):
                t = batch.column(1)[row].as_py() or ""
                for begin in range(0, len(t), some):  # small results, however long a text is
                    rows.append(row)
                    begins.append(begin)
                    parts.append(t[begin : begin + some + beyond])
                    size += len(parts[-1])
                    if size >= some:
                        yield from told(batch.column(0), rows, begins, parts)
                        rows, begins, parts, size = [], [], [], 0
            yield from told(batch.column(0), rows, begins, parts)

    made = texts.select("text_id", "text").mapInArrow(of, schema)
    return made if few else made.join(wanted, "gram").select("text_id", "at", "gram")


def search(needles: DataFrame, texts: DataFrame, share: float = 0.1, least: int = 1, wanted_rows: int = 500_000) -> DataFrame:
    """(needle_id, text_id, start, end, distance): every text in which needles(needle_id, needle) is within max(floor(share * length), least) errors, with its least_match().

    texts(text_id, text): ids tell rows apart. A needle of no more characters than its errors raises an error, as it is everywhere; null needles and texts
    match nothing. Very long texts are cut into their grams and looked through where seeds are.
    """
    n = needles.where("needle is not null").select("needle_id", "needle", errors_allowed(F.col("needle"), share, least).alias("k"))
    size = F.floor(F.length("needle") / (F.col("k") + 1)).cast("int")
    n = n.withColumn("size", F.when(size < 1, F.raise_error(F.lit("the needle must be longer than the errors allowed")).cast("int")).otherwise(size))
    n = materialise(n, "search-needles")
    sizes = [r["size"] for r in n.select("size").distinct().orderBy("size").collect()]  # at most 1 / share of them for long needles, and short needles' lengths
    asked = materialise(n.select("needle_id", "size", F.posexplode(_grams(F.col("needle"), F.col("size"))).alias("at", "gram")), "search-asked")
    held = materialise(_met(texts, materialise(asked.select("gram").distinct(), "search-wanted"), sizes, wanted_rows), "search-met")
    counts = materialise(held.groupBy("gram").agg(F.count("*").alias("n")), "search-counts")
    priced = asked.join(broadcast_if_small(counts), "gram", "left").groupBy("needle_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0).cast("long")).alias("n")))), lambda x: x["n"]).alias("costs"))

    @F.pandas_udf("array<int>")
    def chosen(costs: pd.Series, size: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([rarest_pieces([int(x) for x in c], s, e + 1) for c, s, e in zip(costs, size, k, strict=True)])

    seeds = n.join(priced, "needle_id").select("needle_id", "needle", "size", "k", F.explode(chosen("costs", "size", "k")).alias("at"))
    seeds = materialise(seeds.select("needle_id", F.col("at").alias("of"), F.length("needle").alias("length"), "k", F.substring("needle", F.col("at") + 1, F.col("size")).alias("gram")), "search-seeds")
    met = held.join(broadcast_if_small(seeds), "gram").select("needle_id", "text_id", "length", "k", F.floor((F.col("at") - F.col("of")) / F.col("length")).alias("stretch"))
    places = materialise(met.distinct(), "search-places")
    begin = F.greatest(F.lit(0), F.col("stretch") * F.col("length") - F.col("k"))
    far = F.col("stretch") * F.col("length") + 2 * F.col("length") + F.col("k")
    parts = texts.join(broadcast_if_small(places), "text_id").select("needle_id", "text_id", begin.alias("begin"), F.substring("text", (begin + 1).cast("int"), (far - begin).cast("int")).alias("part"))
    parts = parts.join(broadcast_if_small(n.select("needle_id", "needle", "k")), "needle_id")

    @F.pandas_udf("start int, end int, distance int")
    def verified(needle: pd.Series, part: pd.Series, k: pd.Series) -> pd.DataFrame:
        rows = [least_match(x, t, e) or (None,) * 3 for x, t, e in zip(needle, part, k, strict=True)]
        return pd.DataFrame(rows, columns=["start", "end", "distance"]).astype("Int32")

    found = parts.select("needle_id", "text_id", "begin", verified("needle", "part", "k").alias("m")).where("m.distance is not null")
    placed = F.struct(F.col("m.distance").alias("distance"), (F.col("begin") + F.col("m.end")).cast("int").alias("end"), (-(F.col("begin") + F.col("m.start"))).cast("int").alias("back"))
    best = materialise(found.groupBy("needle_id", "text_id").agg(F.min(placed).alias("b")), "search-found")
    discard(n, asked, held, counts, seeds, places)
    return best.select("needle_id", "text_id", (-F.col("b.back")).alias("start"), F.col("b.end").alias("end"), F.col("b.distance").alias("distance"))
