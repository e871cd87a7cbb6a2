"""Breaking line boxes into pages: forced breaks, breaks to avoid, orphans and widows.

Where the page that begins with a line ends depends on that line alone: behind the last line that still fits, at a place where a break is best. So every
line is asked as if a page began there, by as-of lookups over the running height, and the pages there are come from following these answers
(`ordering.chain`). Nothing is folded line by line, so a chapter with a third of all lines is many tasks' work. Chapters of up to LONG lines are
whole in one task, which asks the lines of many of them at once, in the order in which they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lectern.operators.lookups import asof
from lectern.operators.ordering import Ranged, chain
from lectern.shared import broadcast_if_small, discard, materialise

#: Of break-before and break-after that force a break, and that speak against one.
FORCED = ("always", "page", "left", "right", "recto", "verso", "column", "all")
AVOIDED = ("avoid", "avoid-page", "avoid-column")
#: Heights count in 64ths of a pixel, as layout engines do, so sums are exact.
UNIT = 64
#: Kinds of places, the best first: free; one to avoid; one that leaves too few lines before or behind it.
FREE, AVOID, LONELY = 1, 2, 3
#: Lines of a chapter that one task takes whole.
LONG = 100_000


def break_kinds(lines: DataFrame, orphans: int = 2, widows: int = 2) -> DataFrame:
    """lines as a table with __n, the line's number in its chapter, and __kind of the place behind it: 0 forced, FREE, AVOID, LONELY; null behind the last line.

    A place is forced by the line's break_after or the next one's break_before; to avoid, if these say so or both lines are of one box that is kept together
    (inside, null for none); lonely, if it leaves fewer than `orphans` lines of its block before it or fewer than `widows` behind it.
    """
    numbered = Ranged(lines, "chapter_id", "ord").number("__n", "__of")
    numbered = materialise(numbered.withColumn("__key", F.struct("chapter_id", "block_id")), "fragments-numbered")
    placed = Ranged(numbered, "__key", "ord").number("__in", "__lines")
    placed = materialise(placed.withColumn("__ahead", F.struct("block_id", "break_before", "inside")), "fragments-placed")
    nxt = placed.select("chapter_id", (F.col("__n") - 1).alias("__n"), F.col("__ahead").alias("__next"))
    both = placed.drop("__ahead").join(nxt, ["chapter_id", "__n"], "left")
    said = lambda values: F.coalesce(F.lower("break_after").isin(*values), F.lit(False)) | F.coalesce(F.lower("__next.break_before").isin(*values), F.lit(False))
    same = lambda c: F.coalesce(F.col(c) == F.col(f"__next.{c}"), F.lit(False))
    lonely = F.col("block_id").eqNullSafe(F.col("__next.block_id")) & ((F.col("__in") + 1 < orphans) | (F.col("__lines") - F.col("__in") - 1 < widows))
    kind = F.when(F.col("__n") + 1 == F.col("__of"), F.lit(None)).when(said(FORCED), 0).when(lonely, LONELY).when(said(AVOIDED) | same("inside"), AVOID).otherwise(FREE)
    return materialise(both.withColumn("__kind", kind.cast("int")).drop("__next", "__key", "__lines", "__in"), "fragments-kinds")


def paginate(lines: DataFrame, page_height: float, orphans: int = 2, widows: int = 2, long: int = LONG) -> DataFrame:
    """lines with page_in_chapter, line_on_page (both from 0) and page_y, the line's top on its page.

    lines(chapter_id, ord, block_id, height, space, break_before, break_after, inside): line boxes in order; space is the distance to the line before, which a page
    doesn't begin with unless the break there is forced. A page ends at the first forced break, or else behind the last line that fits where
    a break is free; if there is none, where one is to be avoided; if there is none, where it leaves lonely lines. A line higher than a page is alone on one.
    Null and negative heights and spaces are 0, null hints say nothing. Ties in ord come in any order. An empty table gives no pages. Other columns stay.
    """
    known = lines.where("chapter_id is not null")
    sizes = known.groupBy("chapter_id").agg(F.count("*").alias("n")).where(F.col("n") > long)
    many = materialise(sizes.select("chapter_id"), "fragments-long")
    if many.isEmpty():
        return _short(known, page_height, orphans, widows)
    apart = broadcast_if_small(many)
    return _short(known.join(apart, "chapter_id", "left_anti").select(lines.columns), page_height, orphans, widows).union(_long(known.join(apart, "chapter_id", "left_semi").select(lines.columns), page_height, orphans, widows))


def _units(c: str) -> Column:
    return F.round(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)) * UNIT).cast("long")


def _short(lines: DataFrame, page_height: float, orphans: int, widows: int) -> DataFrame:
    """paginate() of chapters that are whole in a task."""
    said = lambda c, values: F.coalesce(F.lower(c).isin(*values), F.lit(False))
    hints = {f"__{c}_{name}": said(f"break_{c}", values) for c in ("before", "after") for name, values in (("forced", FORCED), ("avoided", AVOIDED))}
    dealt = lines.withColumns({"__h": _units("height"), "__s": _units("space"), **hints}).repartition("chapter_id").sortWithinPartitions("chapter_id", "ord")
    names, room = lines.columns, round(page_height * UNIT)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # a chapter that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("chapter_id")
            changes = np.flatnonzero(_differ(key))
            last = int(changes[-1]) + 1 if len(changes) else 0
            if last or (held and held[-1].column("chapter_id")[0] != key[0]):
                yield paged(held + [batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield paged(held)

    def paged(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.concat_batches(batches)
        column = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
        n, place = rows.num_rows, np.arange(rows.num_rows)
        begins = np.concatenate([[True], _differ(rows.column("chapter_id"))])
        chapter = np.cumsum(begins) - 1
        begin = np.flatnonzero(begins)
        end = np.append(begin[1:], n)[chapter]  # behind the chapter's last line
        block = rows.column("block_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
        order = np.lexsort((place, block, chapter))
        opens = np.concatenate([[True], (np.diff(block[order]) != 0) | (np.diff(chapter[order]) != 0)])
        first = np.flatnonzero(opens)
        run = np.cumsum(opens) - 1
        inside, size = np.empty(n, np.int64), np.empty(n, np.int64)
        inside[order], size[order] = place - first[run], np.diff(np.append(first, n))[run]
        ahead = np.minimum(place + 1, n - 1)
        forced = column("__after_forced") | column("__before_forced")[ahead]
        lonely = (block == block[ahead]) & ((inside + 1 < orphans) | (size - inside - 1 < widows))
        box = rows.column("inside")
        kept = np.append(pc.equal(box.slice(0, n - 1), box.slice(1)).fill_null(False).to_numpy(zero_copy_only=False).astype(bool), False)
        avoided = column("__after_avoided") | column("__before_avoided")[ahead] | kept
        kind = np.where(place + 1 == end, -1, np.where(forced, 0, np.where(lonely, LONELY, np.where(avoided, AVOID, FREE))))
        high, space = column("__h"), column("__s")
        bottom = np.cumsum(high + space)
        tops = begins | np.concatenate([[False], kind[:-1] == 0])
        top = bottom - high - np.where(tops, space, 0)
        full = top + room
        stops = np.append(np.flatnonzero(kind == 0), n)
        stop = stops[np.searchsorted(stops, place)]
        stop = np.where(stop < end, stop, n)  # n: none
        nxt = np.where(place + 1 < end, place + 1, -1)
        for k in (LONELY, AVOID, FREE):
            ends = np.flatnonzero(kind == k)
            near = np.append(-1, ends)[np.minimum(np.searchsorted(bottom[ends], full, "right"), np.searchsorted(ends, end))]
            nxt = np.where((near >= place) & (near < stop), near + 1, nxt)
        nxt = np.where(stop < n, np.where(bottom[np.minimum(stop, n - 1)] <= full, stop + 1, nxt), np.where(bottom[end - 1] <= full, -1, nxt)).tolist()
        firsts = []
        for p in begin.tolist():
            while p != -1:
                firsts.append(p)
                p = nxt[p]
        firsts = np.array(firsts)
        page = np.searchsorted(firsts, place, "right") - 1
        made = page - page[begin][chapter], place - firsts[page], (bottom - high - top[firsts[page]]) / UNIT
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *map(pa.array, made)], [*names, "page_in_chapter", "line_on_page", "page_y"])

    return dealt.mapInArrow(of, StructType([*lines.schema.fields, StructField("page_in_chapter", LongType()), StructField("line_on_page", LongType()), StructField("page_y", DoubleType())]))


def _differ(key: pa.Array) -> np.ndarray:
    """Whether each but the first differs from the one before."""
    return pc.not_equal(key.slice(1), key.slice(0, max(len(key) - 1, 0))).to_numpy(zero_copy_only=False).astype(bool)


def _long(lines: DataFrame, page_height: float, orphans: int, widows: int) -> DataFrame:
    """paginate() of chapters that are many tasks' work."""
    names = lines.columns
    kinds = break_kinds(lines.withColumns({"__h": _units("height"), "__s": _units("space")}), orphans, widows)
    room = round(page_height * UNIT)
    ranged = Ranged(kinds, "chapter_id", "__n")
    # a line's bottom in one endless column, and its top without the space before it
    tall = ranged.sum_before(F.col("__h") + F.col("__s"), "__above")
    forced = kinds.where("__kind = 0").select("chapter_id", (F.col("__n") + 1).alias("__n"), F.lit(True).alias("__opens"))
    tall = tall.join(forced, ["chapter_id", "__n"], "left").withColumn("__opens", F.coalesce("__opens", F.col("__n") == 0))
    tall = tall.withColumns({"__top": F.col("__above") + F.when(F.col("__opens"), 0).otherwise(F.col("__s")), "__bottom": F.col("__above") + F.col("__h") + F.col("__s")})
    tall = materialise(tall.withColumn("__full", F.col("__top") + room), "fragments-tall")
    ends = materialise(tall.where("__kind is not null").select("chapter_id", "__bottom", "__n", "__kind"), "fragments-ends")
    asked: DataFrame = tall.select("chapter_id", "__n", "__full")
    # lines without height may share a bottom: the last of them is nearest
    for kind in (FREE, AVOID, LONELY):
        asked = asof(asked, ends.where(F.col("__kind") == kind), "chapter_id", "__full", "__bottom", "__n", ["__n"]).withColumnRenamed("found___n", f"__end{kind}")
    asked = asof(asked, ends.where("__kind = 0").withColumnRenamed("__n", "__at"), "chapter_id", "__n", "__at", "__at", ["__at"], forward=True).withColumnRenamed("found___at", "__stop")
    last = materialise(tall.groupBy("chapter_id").agg(F.max(F.struct("__n", "__bottom")).alias("__last")), "fragments-last")
    # a forced break, or the chapter's end, that comes before the page is full
    stops = tall.where("__kind = 0").select("chapter_id", F.col("__n").alias("__stop"), F.col("__bottom").alias("__stop_bottom"))
    told = asked.join(stops, ["chapter_id", "__stop"], "left").join(last, "chapter_id")
    fits = lambda c: F.when((F.col(c) >= F.col("__n")) & (F.col("__stop").isNull() | (F.col(c) < F.col("__stop"))), F.col(c) + 1)
    nxt = (
        F.when(F.col("__stop").isNotNull() & (F.col("__stop_bottom") <= F.col("__full")), F.col("__stop") + 1)
        .when(F.col("__stop").isNull() & (F.col("__last.__bottom") <= F.col("__full")), F.lit(None))
        .otherwise(F.coalesce(fits(f"__end{FREE}"), fits(f"__end{AVOID}"), fits(f"__end{LONELY}"), F.when(F.col("__n") < F.col("__last.__n"), F.col("__n") + 1)))
    )
    firsts = chain(told.withColumn("__next", nxt).select("chapter_id", "__n", "__next"), "chapter_id", "__n", "__next")
    firsts = firsts.select("chapter_id", "__n", F.lit(1).alias("__first"))
    marked = materialise(tall.join(firsts, ["chapter_id", "__n"], "left"), "fragments-marked")
    paged = Ranged(marked.withColumn("__one", F.coalesce("__first", F.lit(0))), "chapter_id", "__n")
    opened = paged.last_known(F.when(F.col("__first") == 1, F.struct(F.col("__n").alias("n"), F.col("__top").alias("top"))), "__page")
    # pages are numbered among themselves: there are far fewer
    numbers = Ranged(marked.where("__first = 1").select("chapter_id", F.col("__n").alias("__page_n")), "chapter_id", "__page_n").number("page_in_chapter")
    out = opened.withColumn("__page_n", F.col("__page.n")).join(numbers, ["chapter_id", "__page_n"])
    # what keeps its space at a page's top has it above the line
    top = F.col("__bottom") - F.col("__h") - F.col("__page.top")
    discard(kinds, ends)
    return out.select(*[F.col(f"`{c}`") for c in names], "page_in_chapter", (F.col("__n") - F.col("__page_n")).alias("line_on_page"), (top / UNIT).alias("page_y"))


def page_column(page_in_chapter: Column, width: Column, gap: Column) -> Column:
    """Where a page's column begins when a chapter's pages lie beside each other."""
    return page_in_chapter * (width + gap)
