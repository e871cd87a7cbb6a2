"""Numbering and running sums over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lectern.shared import materialise


def global_index(df: DataFrame, *order: Column | str, name: str = "index") -> DataFrame:
    """df with a dense 0-based number in the given (total) order.

    Rows are dealt by range; each part numbers its own, and only a row per part meets in one task to add
    up where the parts begin.
    """
    placed = materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordering")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + own - 1).drop("__part", "__start")


class Ranged:
    """A table in the order of (by, order), dealt by ranges, so that a key with a large part of all rows is many tasks' work.

    by and order: column names; together they should tell rows apart (equal rows come in any order). What a range needs to
    know of those before it is a row for each key and range, which the methods carry over. Null keys are a key.
    """

    def __init__(self, df: DataFrame, by: str, *order: str):
        self.by, self.order = by, order
        self.rows = materialise(df.repartitionByRange(by, *order).withColumn("__part", F.spark_partition_id()), "ranged")

    def _inside(self) -> Window:
        return Window.partitionBy(self.by, "__part").orderBy(*self.order)

    def _with(self, carried: DataFrame) -> DataFrame:
        """rows, each with its range's __carry."""
        c = carried.select(F.col(self.by).alias("__c_by"), F.col("__part").alias("__c_part"), "__carry")
        return self.rows.join(c, F.col(self.by).eqNullSafe(F.col("__c_by")) & (F.col("__part") == F.col("__c_part"))).drop("__c_by", "__c_part")

    def _parts(self, value: Column) -> DataFrame:
        return self.rows.groupBy(self.by, "__part").agg(value.alias("__of"))

    def _before(self) -> Window:
        return Window.partitionBy(self.by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)

    def previous(self, value: Column, name: str) -> DataFrame:
        """rows with value of the key's row before, null for the first."""
        last = self._parts(F.max_by(F.struct(value.alias("v")), F.struct(*self.order)))
        carried = last.withColumn("__carry", F.lag("__of").over(Window.partitionBy(self.by).orderBy("__part")))
        before = F.coalesce(F.lag(F.struct(value.alias("v"))).over(self._inside()), "__carry")
        return self._with(carried).withColumn(name, before["v"]).drop("__part", "__carry")

    def sum_before(self, value: Column, name: str, total: str | None = None) -> DataFrame:
        """rows with the sum of value over the key's rows before, 0 for the first; total: a column with the sum over all of them."""
        sums = self._parts(F.sum(value))
        zero = F.lit(0).cast(sums.schema["__of"].dataType)
        carried = sums.withColumn("__carry", F.struct(F.coalesce(F.sum("__of").over(self._before()), zero).alias("before"), F.sum("__of").over(Window.partitionBy(self.by)).alias("total")))
        own = F.coalesce(F.sum(value).over(self._inside().rowsBetween(Window.unboundedPreceding, -1)), zero)
        found = self._with(carried).withColumn(name, F.col("__carry.before") + own)
        return (found if total is None else found.withColumn(total, F.col("__carry.total"))).drop("__part", "__carry")

    def number(self, name: str, total: str | None = None) -> DataFrame:
        """rows with their 0-based number in the key; total: a column with how many the key has."""
        return self.sum_before(F.lit(1).cast("long"), name, total)

    def last_known(self, value: Column, name: str) -> DataFrame:
        """rows with the last value that isn't null among the key's rows up to each."""
        last = self._parts(F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order))))
        carried = last.withColumn("__carry", F.last("__of", ignorenulls=True).over(self._before()))
        own = F.last(value, ignorenulls=True).over(self._inside().rowsBetween(Window.unboundedPreceding, 0))
        return self._with(carried).withColumn(name, F.coalesce(own, "__carry")).drop("__part", "__carry")


def in_turn(df: DataFrame, by: str, order: str, step: Callable[[Any, tuple], tuple[Any, tuple | None]], schema: str) -> DataFrame:
    """What step makes of each key's rows in turn, where each depends on what became of the one before.

    step(state, row) -> (state, made row or None); state is None at a key's first row; row has df's columns. Rows flow
    through a task in order, and a key's state is all that is held of it; one key is one task's work.
    """
    at = df.columns.index(by)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, kinds = of, None, target
        for batch in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[at] != key or key is of:
                    key, state = row[at], None
                state, out = step(state, row)
                if out is not None:
                    made.append(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True) if made else [[]] * len(kinds), kinds, strict=True)], schema=kinds)

    target = to_arrow_schema(_parse_datatype_string(schema))
    return df.repartition(by).sortWithinPartitions(by, order).mapInArrow(of, schema)


def blocks_with_ahead(df: DataFrame, by: str, pos: str, ahead: int, size: int = 8192) -> DataFrame:
    """df, its dense 0-based pos cut into blocks of `size`, each with the `ahead` rows behind it: (.., __block, __own). A window over (by, __block) sees all that its own rows need."""
    own = F.floor(F.col(pos) / size).cast("long")
    both = F.when((F.col(pos) % size < ahead) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return df.withColumn("__block", F.explode(both)).withColumn("__own", F.col("__block") == own)


def chain(rows: DataFrame, by: str, pos: str, nxt: str, size: int = 8192) -> DataFrame:
    """The rows(by, pos, nxt) that following nxt from pos 0 on comes to, as (by, pos, nxt). pos is dense and 0-based in its key, nxt greater than pos, or null at the end.

    So what a row decides about those behind it, as where a page that begins with it ends, is folded in parallel: each block of `size` rows of a key is
    a task's work of its own, which tells for every place that it can be entered at where it is left; one task then follows a key through these
    entries, a few for each block, and the blocks mark their rows.
    """
    kind = rows.schema[by].dataType.simpleString()
    block = lambda c: F.floor(F.col(c) / size).cast("long")
    table = materialise(rows.select(F.col(by).alias("k"), F.col(pos).cast("long").alias("p"), F.col(nxt).cast("long").alias("n")), "chain-rows")
    entries = table.where(block("n") > block("p")).select("k", F.col("n").alias("p")).distinct()
    entries = materialise(entries.withColumn("in", F.lit(True)), "chain-entries")
    long = entries.select("k").distinct()
    first = F.when(F.col("p") == 0, True).otherwise(F.coalesce("in", F.lit(False)))
    asked = table.join(long, "k", "left_semi").join(entries, ["k", "p"], "left").select(F.struct("k", block("p").alias("b")).alias("g"), (-F.col("p")).alias("back"), "p", "n", first.alias("in"))

    def leave(left: dict | None, row: tuple) -> tuple[dict, tuple | None]:
        g, _, p, n, asked = row
        left = {} if left is None else left
        left[p] = left.get(n, n)
        return left, (g["k"], p, left[p]) if asked else None

    def walk(now: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        k, p, out = row
        if now is None or p == now[0]:
            return (out,), (k, p)
        return now, None

    def follow(now: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        g, p, n, entry = row
        now = (entry,) if now is None else now
        return ((n,), (g["k"], p, n)) if p == now[0] else (now, None)

    exits = in_turn(asked, "g", "back", leave, f"k {kind}, p long, out long")
    taken = materialise(in_turn(exits, "k", "p", walk, f"k {kind}, entry long"), "chain-taken").withColumn("b", block("entry"))
    entered = table.withColumn("b", block("p")).join(taken, ["k", "b"], "left").where((F.col("b") == 0) | F.col("entry").isNotNull())
    marked = in_turn(entered.select(F.struct("k", "b").alias("g"), "p", "n", F.coalesce("entry", F.lit(0).cast("long")).alias("entry")), "g", "p", follow, f"k {kind}, p long, n long")
    return marked.select(F.col("k").alias(by), F.col("p").alias(pos), F.col("n").alias(nxt))
