"""Statistics of a bundle: durations, gaps, pages, spans on several pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.ordering import Ranged
from lectern.predicates import timed


def duration_stats(spans: DataFrame) -> DataFrame:
    """One row: timed and untimed counts; sum, min, max, mean of timed durations (0 where there are none)."""
    d = F.when(timed(), F.col("clip_end_ms") - F.col("clip_begin_ms"))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return spans.agg(
        F.count_if(timed()).alias("timed"), F.count_if(~timed()).alias("untimed"), zero(F.sum(d), "total_ms"), zero(F.min(d), "min_ms"), zero(F.max(d), "max_ms"), zero(F.avg(d), "mean_ms")
    )


def gaps(spans: DataFrame, book: str = "book_id") -> DataFrame:
    """Positive gaps between a timed span and its immediate predecessor by (begin, ord), not the furthest end so far."""
    live = spans.where(timed()).select(book, "ord", "id", "clip_begin_ms", "clip_end_ms")
    near = Ranged(live, book, "clip_begin_ms", "ord").previous(F.struct("id", "clip_end_ms"), "__before")
    near = near.select(book, "ord", "clip_begin_ms", F.col("__before.id").alias("from_id"), F.col("id").alias("to_id"), (F.col("clip_begin_ms") - F.col("__before.clip_end_ms")).alias("gap_ms"))
    return near.where("gap_ms > 0")


def gap_summary(spans: DataFrame, book: str = "book_id") -> DataFrame:
    """Per book: number and sum of gaps, and the first of the largest."""
    best = F.max_by(F.struct("from_id", "to_id"), F.struct("gap_ms", -F.col("clip_begin_ms"), -F.col("ord")))
    return gaps(spans, book).groupBy(book).agg(F.count("*").alias("gaps"), F.sum("gap_ms").alias("total_gap_ms"), F.max("gap_ms").alias("largest_ms"), best.alias("b")).select(
        book, "gaps", "total_gap_ms", "largest_ms", F.col("b.from_id").alias("largest_from"), F.col("b.to_id").alias("largest_to")
    )


def first_page_of_spans(rects: DataFrame) -> DataFrame:
    """The page on which each span appears first."""
    return rects.groupBy("span_id").agg(F.min("page_index").alias("page_index"))


def assign_pages(spans: DataFrame, rects: DataFrame) -> DataFrame:
    """spans with page_index; -1 for those on no page."""
    first = first_page_of_spans(rects).withColumnRenamed("span_id", "id")
    return spans.join(first, "id", "left").withColumn("page_index", F.coalesce("page_index", F.lit(-1)))


def page_stats(assigned: DataFrame) -> DataFrame:
    """Timed and untimed spans per page, page -1 included; first: the place of the page's first span."""
    return assigned.groupBy("page_index").agg(F.count_if(timed()).alias("timed"), F.count_if(~timed()).alias("untimed"), F.min("ord").alias("first"))


def top_untimed_pages(stats: DataFrame, k: int = 5) -> DataFrame:
    return stats.where("page_index >= 0").orderBy(F.desc("untimed"), "first").limit(k)


def multi_page_spans(rects: DataFrame, k: int | None = None) -> DataFrame:
    """Spans on several pages, with all their pages in order; the k of most pages if k is given (ties by id)."""
    found = rects.groupBy("span_id").agg(F.sort_array(F.collect_set("page_index")).alias("pages")).where(F.size("pages") > 1).withColumn("n_pages", F.size("pages"))
    return found if k is None else found.orderBy(F.desc("n_pages"), "span_id").limit(k)


def spans_without_rects(spans: DataFrame, rects: DataFrame) -> DataFrame:
    return spans.join(rects.select(F.col("span_id").alias("id")), "id", "left_anti")


def pages_without_spans(pages: DataFrame, rects: DataFrame) -> DataFrame:
    return pages.join(rects.select("page_index"), "page_index", "left_anti")


def pages_without_timed_spans(pages: DataFrame, stats: DataFrame) -> DataFrame:
    """Pages with no timed span (no span at all included)."""
    return pages.join(stats.select("page_index", "timed"), "page_index", "left").where(F.coalesce("timed", F.lit(0)) == 0).select("page_index")


def ends(spans: DataFrame, book: str = "book_id") -> DataFrame:
    """First and last timed span of each book by (begin, ord)."""
    at = F.struct("clip_begin_ms", "ord")
    return spans.where(timed()).groupBy(book).agg(F.min_by("id", at).alias("first_id"), F.max_by("id", at).alias("last_id"))


def report(spans: DataFrame, rects: DataFrame, pages: DataFrame) -> DataFrame:
    """The whole inspection as (metric, value)."""
    assigned = assign_pages(spans, rects)
    stats = page_stats(assigned)
    one = duration_stats(spans)
    metrics = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns])).alias("m")).select("m.*")
    number = lambda df, name: df.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    found = gaps(spans)
    total = found.agg(F.coalesce(F.sum("gap_ms"), F.lit(0.0)).alias("value")).select(F.lit("total_gap_ms").alias("metric"), "value")
    rest = [number(found, "gaps"), total, number(multi_page_spans(rects), "multi_page_spans"), number(spans_without_rects(spans, rects), "spans_without_rects"), number(pages_without_spans(pages, rects), "pages_without_spans"), number(pages_without_timed_spans(pages, stats), "pages_without_timed_spans")]
    for df in rest:
        metrics = metrics.union(df)
    return metrics
