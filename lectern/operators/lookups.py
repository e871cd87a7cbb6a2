"""As-of, interval, point-in-rectangle and fallback lookups, planned as equi-joins or windows over ranges, never as nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.ordering import Ranged
from lectern.shared import broadcast_if_small, materialise


def asof(points: DataFrame, spans: DataFrame, by: str, at: str, on: str, tie: str, payload: list[str], forward: bool = False, strict: bool = False) -> DataFrame:
    """points with `payload` of the nearest span whose `on` is at or before `at` (at or after, if forward).

    strict excludes equality. Among equal `on` the highest tie is nearest backward, the lowest forward.
    Points without one have nulls. Points and spans are dealt together by ranges of key and time, so a key with a large
    part of all rows is many tasks; each is told the nearest span of the ranges before.
    """
    sign = -1 if forward else 1
    t = lambda c: (F.col(f"`{c}`") * sign).cast("double")
    names = points.columns
    left = points.select(F.col(f"`{by}`").alias("__by"), t(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    right = spans.where(F.col(on).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("__by"), t(on).alias("__t"), F.lit(2 if strict else 0).alias("__side"), (F.col(tie) * sign).alias("__tie"), F.struct(*payload).alias("__s"))
    # a span of the very time stands before the point, or behind it
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    rows = left.select("__by", "__t", "__side", none("__tie", right), none("__s", right), "__row").union(right.select("__by", "__t", "__side", "__tie", "__s", none("__row", left)))
    found = Ranged(rows, "__by", "__t", "__side", "__tie").last_known(F.col("__s"), "__found").where("__row is not null")
    return found.select("__row.*", *[F.col("__found").getField(c).alias(f"found_{c}") for c in payload])


def _level(extent: Column, least: float) -> Column:
    """0 for what is no longer than `least`, 1 up to twice that, and so on; what has no end is of the last level."""
    return F.least(F.lit(50), F.greatest(F.lit(0), F.coalesce(F.ceil(F.log2(extent / least)).cast("long"), F.lit(50)))).cast("int")


def _cells(begin: Column, end: Column, size: Column) -> Column:
    """The one or two cells that something no longer than `size` touches."""
    first = F.floor(begin / size)
    return F.when(F.floor(end / size) > first, F.array(first, first + 1)).otherwise(F.array(first))


def _levels(rows: DataFrame) -> Column:
    """The levels that there are, at most 51, as an array."""
    found = sorted(r["__level"] for r in rows.select("__level").distinct().collect())
    return F.array(*map(F.lit, found)) if found else F.array().cast("array<int>")


def interval_first(points: DataFrame, spans: DataFrame, by: str, at: str, begin: str, end: str, order: str, payload: list[str], least: float = 16_384.0) -> DataFrame:
    """Distinct points, each with `payload` of the first span by `order` with begin <= at < end; nulls without one.

    A span is dealt to the one or two buckets of time that it touches, of a width that goes with its length (`least`, or twice that,
    and so on); a point asks the bucket of each width that there is. So the join is an equi-join, however long a span is.
    """
    live = spans.where(F.col(end) > F.col(begin)).withColumn("__level", _level(F.col(end) - F.col(begin), least))
    size = F.lit(least) * F.pow(F.lit(2.0), F.col("__level"))
    right = live.select(F.col(by).alias("__by"), "__level", F.explode(_cells(F.col(begin), F.col(end), size)).alias("__b"), F.col(begin).alias("__begin"), F.col(end).alias("__end"), F.struct(F.col(order).alias("o"), F.struct(*payload).alias("p")).alias("__s"))
    names = points.columns
    whole = points.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(by).alias("__by"), F.col(at).alias("__t")).distinct()
    asked = whole.select("*", F.explode(_levels(live)).alias("__level")).withColumn("__b", F.floor(F.col("__t") / size))
    near = asked.join(right, ["__by", "__level", "__b"]).where((F.col("__begin") <= F.col("__t")) & (F.col("__t") < F.col("__end")))
    best = near.groupBy("__row").agg(F.min("__s").alias("__s")).withColumnRenamed("__row", "__hit")
    found = whole.join(best, F.col("__row").eqNullSafe(F.col("__hit")), "left")
    return found.select("__row.*", *[F.col("__s.p").getField(c).alias(f"found_{c}") for c in payload])


def point_in_rect(taps: DataFrame, rects: DataFrame, x: str = "tap_x", y: str = "tap_y", least: float = 64.0) -> DataFrame:
    """taps(page_index, tap_id, x, y), each with the first span by (span_pos, rect_pos) whose rectangle holds it, edges included.

    A rectangle is dealt to the cells of a page that it touches, four at most, of a size that goes with its own; a tap asks
    the cell of each size that there is. Rectangles on pages without a tap are left out before anything is dealt.
    """
    tapped = broadcast_if_small(materialise(taps.where("page_index is not null").select("page_index").distinct(), "tapped-pages"))
    live = rects.join(tapped, "page_index", "left_semi").where("w >= 0 and h >= 0").withColumn("__level", _level(F.greatest("w", "h"), least))
    size = F.lit(least) * F.pow(F.lit(2.0), F.col("__level"))
    right = live.select("page_index", "__level", F.explode(_cells(F.col("x"), F.col("x") + F.col("w"), size)).alias("__cx"), "span_id", "span_pos", "x", "y", "w", "h")
    right = right.select("page_index", "__level", "__cx", F.explode(_cells(F.col("y"), F.col("y") + F.col("h"), size)).alias("__cy"), "span_id", "span_pos", "x", "y", "w", "h")
    asked = taps.select("page_index", "tap_id", F.col(x).alias("__x"), F.col(y).alias("__y"), F.explode(_levels(live)).alias("__level")).withColumns({"__cx": F.floor(F.col("__x") / size), "__cy": F.floor(F.col("__y") / size)})
    held = (F.col("__x") >= F.col("x")) & (F.col("__x") <= F.col("x") + F.col("w")) & (F.col("__y") >= F.col("y")) & (F.col("__y") <= F.col("y") + F.col("h"))
    hit = asked.join(right, ["page_index", "__level", "__cx", "__cy"]).where(held)
    best = hit.groupBy("tap_id").agg(F.min_by("span_id", "span_pos").alias("span_id"))
    return taps.join(best, "tap_id", "left")


def span_by_id(rows: DataFrame, spans: DataFrame, by: str, order: str = "ord", id: str = "id") -> DataFrame:
    """rows(by, span_id) with `found`, the span of that id, null without one; of spans of one id the last."""
    last = spans.groupBy(by, F.col(id).alias("span_id")).agg(F.max_by(F.struct(*spans.columns), order).alias("found"))
    return rows.join(last, [by, "span_id"], "left")


def page_at(rows: DataFrame, pages: DataFrame, by: str, order: str = "page_index") -> DataFrame:
    """rows(by, place) with `found`, the page at that 0-based place among its book's pages in order; null outside."""
    placed = Ranged(pages, by, order).number("place").select(by, "place", F.struct(*pages.columns).alias("found"))
    return rows.join(placed, [by, "place"], "left")


def first_timed_on_page(rects: DataFrame, spans: DataFrame) -> DataFrame:
    """Per page the first timed span by its position there."""
    from lectern.predicates import timed

    live = spans.where(timed()).select(F.col("id").alias("span_id"), "clip_begin_ms")
    at = F.struct("span_pos", "span_id")
    return rects.join(live, "span_id").groupBy("page_index").agg(F.min_by("span_id", at).alias("span_id"), F.min_by("clip_begin_ms", at).alias("clip_begin_ms"))


def fallback_lookup(rows: DataFrame, table: DataFrame, probes: list[Column], keys: list[Column], value: str, order: str, name: str = "found", by: tuple[str, ...] = ()) -> DataFrame:
    """rows with the value whose any key equals the first probe that has one; of values with one key the last by order wins. by: columns, as the book, that both sides must agree in."""
    index = table.select(*by, F.explode(F.array_distinct(F.array(*keys))).alias("__key"), value, order).groupBy(*by, "__key").agg(F.max_by(value, order).alias("__value"))
    out, columns = rows, rows.columns
    for i, probe in enumerate(probes):
        out = out.withColumn(f"__probe{i}", probe)
    for i in range(len(probes)):
        out = out.join(index.select(*by, F.col("__key").alias(f"__probe{i}"), F.col("__value").alias(f"__value{i}")), [*by, f"__probe{i}"], "left")
    return out.select(*columns, F.coalesce(*[F.col(f"__value{i}") for i in range(len(probes))]).alias(name))
