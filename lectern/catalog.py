"""The queries of the engine over the driver's tables, each with the ANSI SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import bindings as B
from lectern.functions import clip, color, css, markup, paths, player
from lectern.operators import align, anchors, fragments, inspect, lookups, pages, search, spans, toc, validate
from lectern.operators.ordering import Ranged
from lectern.predicates import timed
from lectern.shared import materialise

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- inspection --------------------------------------------------------------------------------------


@query(_with(B.SPAN) + """SELECT count(*) FILTER (ok) AS timed, count(*) FILTER (NOT ok) AS untimed, coalesce(sum(d) FILTER (ok), 0) AS total_ms, coalesce(min(d) FILTER (ok), 0) AS min_ms,
  coalesce(max(d) FILTER (ok), 0) AS max_ms, coalesce(round(avg(d) FILTER (ok), 4), 0) AS mean_ms FROM (SELECT clip_end_ms - clip_begin_ms AS d, clip_begin_ms >= 0 AND clip_end_ms > clip_begin_ms AS ok FROM span)""")
def inspect_duration_stats(spark: SparkSession, d: str) -> DataFrame:
    return inspect.duration_stats(B.spans(spark, d)).withColumn("mean_ms", F.round("mean_ms", 4))


_GAPS = "g AS (SELECT * FROM (SELECT book_id, ord, clip_begin_ms, lag(id) OVER w AS from_id, id AS to_id, clip_begin_ms - lag(clip_end_ms) OVER w AS gap_ms FROM timed WINDOW w AS (PARTITION BY book_id ORDER BY clip_begin_ms, ord)) WHERE gap_ms > 0)"


@query(_with(B.SPAN, _GAPS) + "SELECT book_id, ord, from_id, to_id, gap_ms FROM g")
def inspect_gaps(spark: SparkSession, d: str) -> DataFrame:
    return inspect.gaps(B.spans(spark, d)).select("book_id", "ord", "from_id", "to_id", "gap_ms")


@query(_with(B.SPAN, _GAPS) + """SELECT book_id, max(n) AS gaps, max(total) AS total_gap_ms, max(gap_ms) AS largest_ms, max(from_id) FILTER (k = 1) AS largest_from, max(to_id) FILTER (k = 1) AS largest_to
FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY gap_ms DESC, clip_begin_ms, ord) AS k, count(*) OVER (PARTITION BY book_id) AS n, sum(gap_ms) OVER (PARTITION BY book_id) AS total FROM g) GROUP BY book_id""")
def inspect_largest_gap(spark: SparkSession, d: str) -> DataFrame:
    return inspect.gap_summary(B.spans(spark, d))


_ASSIGNED = "assigned AS (SELECT o.*, coalesce(f.page_index, -1) AS page_index FROM ospan o LEFT JOIN (SELECT span_id, min(page_index) AS page_index FROM rect GROUP BY 1) f ON f.span_id = o.id)"
_STATS = "stats AS (SELECT page_index, count(*) FILTER (clip_begin_ms >= 0 AND clip_end_ms > clip_begin_ms) AS timed, count(*) FILTER (NOT (clip_begin_ms >= 0 AND clip_end_ms > clip_begin_ms)) AS untimed, min(ord) AS first FROM assigned GROUP BY 1)"


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return inspect.assign_pages(B.order_spans(spark, d), B.rects(spark, d))


@query(_with(B.RECT, B.ORDER_SPAN, _ASSIGNED, _STATS) + "SELECT page_index, timed, untimed FROM stats")
def inspect_page_stats(spark: SparkSession, d: str) -> DataFrame:
    return inspect.page_stats(_assigned(spark, d)).drop("first")


@query(_with(B.RECT, B.ORDER_SPAN, _ASSIGNED, _STATS) + "SELECT page_index, timed, untimed FROM stats WHERE page_index >= 0 ORDER BY untimed DESC, first LIMIT 5")
def inspect_top_untimed_pages(spark: SparkSession, d: str) -> DataFrame:
    return inspect.top_untimed_pages(inspect.page_stats(_assigned(spark, d))).drop("first")


_MULTI = "m AS (SELECT span_id, list_sort(list(DISTINCT page_index)) AS pages, count(DISTINCT page_index) AS n_pages FROM rect GROUP BY 1 HAVING count(DISTINCT page_index) > 1)"


@query(_with(B.RECT, _MULTI) + "SELECT span_id, array_to_string(pages, ',') AS pages, n_pages::INT AS n_pages FROM m")
def inspect_multi_page_spans(spark: SparkSession, d: str) -> DataFrame:
    return inspect.multi_page_spans(B.rects(spark, d)).withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query(_with(B.RECT, _MULTI) + "SELECT span_id, array_to_string(pages[1:6], ',') AS pages, n_pages::INT AS n_pages FROM m ORDER BY n_pages DESC, span_id LIMIT 10")
def inspect_top_multi_page_spans(spark: SparkSession, d: str) -> DataFrame:
    return inspect.multi_page_spans(B.rects(spark, d), 10).withColumn("pages", F.array_join(F.slice("pages", 1, 6).cast("array<string>"), ","))


@query(_with(B.RECT, B.ORDER_SPAN) + "SELECT id FROM ospan WHERE id NOT IN (SELECT span_id FROM rect)")
def spans_missing_rects(spark: SparkSession, d: str) -> DataFrame:
    return inspect.spans_without_rects(B.order_spans(spark, d), B.rects(spark, d)).select("id")


@query(_with(B.RECT, B.PAGE) + "SELECT page_index FROM page WHERE page_index NOT IN (SELECT page_index FROM rect)")
def pages_without_spans(spark: SparkSession, d: str) -> DataFrame:
    return inspect.pages_without_spans(B.pages(spark, d), B.rects(spark, d))


@query(_with(B.RECT, B.ORDER_SPAN, _ASSIGNED, _STATS, B.PAGE) + "SELECT page_index FROM page WHERE page_index NOT IN (SELECT page_index FROM stats WHERE timed > 0)")
def pages_without_timed_spans(spark: SparkSession, d: str) -> DataFrame:
    return inspect.pages_without_timed_spans(B.pages(spark, d), inspect.page_stats(_assigned(spark, d)))


@query(_with(B.SPAN) + """SELECT book_id, arg_min(id, (clip_begin_ms, ord)) AS first_id, arg_max(id, (clip_begin_ms, ord)) AS last_id FROM timed GROUP BY 1""")
def first_last_timed_span(spark: SparkSession, d: str) -> DataFrame:
    return inspect.ends(B.spans(spark, d))


@query()
def inspect_report(spark: SparkSession, d: str) -> DataFrame:
    """The inspection of the order bundle as one table of metrics."""
    return inspect.report(B.order_spans(spark, d).withColumn("book_id", F.col("id") % 50), B.rects(spark, d), B.pages(spark, d))


_SQL["inspect_report"] = _with(B.RECT, B.ORDER_SPAN, _ASSIGNED, _STATS, B.PAGE, _MULTI) + """,
t AS (SELECT *, clip_end_ms - clip_begin_ms AS d FROM ospan WHERE clip_begin_ms >= 0 AND clip_end_ms > clip_begin_ms),
g AS (SELECT * FROM (SELECT clip_begin_ms - lag(clip_end_ms) OVER (PARTITION BY id % 50 ORDER BY clip_begin_ms, ord) AS gap_ms FROM t) WHERE gap_ms > 0),
r AS (SELECT 'timed' AS metric, (SELECT count(*) FROM t)::DOUBLE AS value UNION ALL SELECT 'untimed', (SELECT count(*) FROM ospan) - (SELECT count(*) FROM t)
UNION ALL SELECT 'total_ms', (SELECT coalesce(sum(d), 0) FROM t) UNION ALL SELECT 'min_ms', (SELECT coalesce(min(d), 0) FROM t) UNION ALL SELECT 'max_ms', (SELECT coalesce(max(d), 0) FROM t)
UNION ALL SELECT 'mean_ms', (SELECT coalesce(avg(d), 0) FROM t) UNION ALL SELECT 'gaps', (SELECT count(*) FROM g) UNION ALL SELECT 'total_gap_ms', (SELECT coalesce(sum(gap_ms), 0) FROM g)
UNION ALL SELECT 'multi_page_spans', (SELECT count(*) FROM m) UNION ALL SELECT 'spans_without_rects', (SELECT count(*) FROM ospan WHERE id NOT IN (SELECT span_id FROM rect))
UNION ALL SELECT 'pages_without_spans', (SELECT count(*) FROM page WHERE page_index NOT IN (SELECT page_index FROM rect))
UNION ALL SELECT 'pages_without_timed_spans', (SELECT count(*) FROM page WHERE page_index NOT IN (SELECT page_index FROM stats WHERE timed > 0)))
SELECT metric, value FROM r"""


# --- audio and spans ---------------------------------------------------------------------------------

_MANIFEST = "manifest AS (SELECT b.book_id, a.n AS ord, 'a' || a.n AS href FROM (SELECT DISTINCT book_id FROM span) b CROSS JOIN (SELECT unnest(range(0, 9)) AS n) a)"


@query(_with(B.SPAN, _MANIFEST) + """, used AS (SELECT t.book_id, t.audio_src AS href, min(t.ord) AS ord, 0 AS part FROM timed t WHERE t.audio_src IN (SELECT href FROM manifest) GROUP BY 1, 2),
rest AS (SELECT m.book_id, m.href, m.ord, 1 AS part FROM manifest m LEFT JOIN used u USING (book_id, href) WHERE u.href IS NULL)
SELECT book_id, href, (row_number() OVER (PARTITION BY book_id ORDER BY part, ord) - 1)::INT AS position FROM (SELECT * FROM used UNION ALL SELECT * FROM rest)""")
def audio_first_use_order(spark: SparkSession, d: str) -> DataFrame:
    s = B.spans(spark, d)
    n = F.explode(F.sequence(F.lit(0), F.lit(8)))
    manifest = s.select("book_id").distinct().select("book_id", n.alias("n")).select("book_id", F.col("n").cast("long").alias("ord"), F.concat(F.lit("a"), F.col("n").cast("string")).alias("href"))
    return spans.audio_order(s, manifest)


_OFFSETS = "offsets AS (SELECT *, coalesce(sum(duration_ms) OVER (PARTITION BY book_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms, sum(duration_ms) OVER (PARTITION BY book_id) AS total_ms FROM track)"


@query(_with(B.TRACK, _OFFSETS) + "SELECT book_id, ord, href, duration_ms, start_ms, start_ms + duration_ms AS end_ms, total_ms FROM offsets")
def audio_offsets(spark: SparkSession, d: str) -> DataFrame:
    return spans.audio_offsets(B.tracks(spark, d))


@query(_with(B.SPAN, "f AS (SELECT 'a' || n AS audio_src, n * 100000.0::DOUBLE AS start_ms FROM (SELECT unnest(range(0, 5)) AS n))") + """SELECT ord, id, clip_begin_ms + shift AS clip_begin_ms, clip_end_ms + shift AS clip_end_ms
FROM (SELECT s.*, CASE WHEN clip_begin_ms >= 0 AND clip_end_ms >= 0 THEN coalesce(start_ms, 0) ELSE 0 END AS shift FROM span s LEFT JOIN f USING (audio_src))""")
def apply_audio_offsets(spark: SparkSession, d: str) -> DataFrame:
    f = spark.range(5).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("audio_src"), (F.col("id") * 100000.0).alias("start_ms"))
    return spans.apply_audio_offsets(B.spans(spark, d), f).select("ord", "id", "clip_begin_ms", "clip_end_ms")


@query(_with(B.RECT) + "SELECT span_id, min(page_index) AS page_index FROM rect GROUP BY 1")
def span_first_page(spark: SparkSession, d: str) -> DataFrame:
    return inspect.first_page_of_spans(B.rects(spark, d))


@query(_with(B.RECT) + "SELECT span_id % 40 AS chapter_id, min(page_index) AS page_index FROM rect GROUP BY 1")
def chapter_first_page(spark: SparkSession, d: str) -> DataFrame:
    return pages.first_page_of_chapters(B.rects(spark, d).withColumn("chapter_id", F.col("span_id") % 40)).select("chapter_id", "page_index")


@query(_with(B.RECT, B.ORDER_SPAN, _ASSIGNED) + "SELECT id, page_index FROM assigned")
def span_page_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("id", "page_index")


_DIGITS = "'0123456789abcdefghijklmnopqrstuvwxyz'"


@query(_with(B.SPAN, "n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ord) - 1 AS n FROM span)") + f"""SELECT book_id, id, 's' || CASE WHEN n >= 46656 THEN substr({_DIGITS}, (n // 46656 % 36 + 1)::INT, 1) ELSE '' END
|| CASE WHEN n >= 1296 THEN substr({_DIGITS}, (n // 1296 % 36 + 1)::INT, 1) ELSE '' END || CASE WHEN n >= 36 THEN substr({_DIGITS}, (n // 36 % 36 + 1)::INT, 1) ELSE '' END || substr({_DIGITS}, (n % 36 + 1)::INT, 1) AS new_id FROM n""")
def compact_span_ids(spark: SparkSession, d: str) -> DataFrame:
    return spans.compact_ids(B.spans(spark, d)).select("book_id", "id", "new_id")


_METRICS = """metrics AS (SELECT span_id, page_index, coalesce(chars, 0) AS chars, coalesce(area, 0) AS area FROM (SELECT span_id, page_index, sum(chars) AS chars FROM run WHERE span_id IS NOT NULL GROUP BY 1, 2)
FULL JOIN (SELECT span_id, page_index, sum(w * h) AS area FROM rect GROUP BY 1, 2) USING (span_id, page_index))"""
_SPLIT = """w AS (SELECT o.id, m.page_index, clip_begin_ms AS b, clip_end_ms AS e, count(*) OVER p AS n, CASE WHEN sum(chars) OVER p > 0 THEN greatest(chars::DOUBLE, 1.0) WHEN sum(area) OVER p > 0 THEN greatest(area, 1.0) ELSE 1.0 END AS weight
  FROM ospan o JOIN metrics m ON m.span_id = o.id WHERE clip_begin_ms >= 0 AND clip_end_ms > clip_begin_ms WINDOW p AS (PARTITION BY o.id)),
c AS (SELECT *, CASE WHEN row_number() OVER q = n THEN e ELSE b + (e - b) * sum(weight) OVER (PARTITION BY id ORDER BY page_index ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY id) END AS cut FROM w WHERE n > 1 WINDOW q AS (PARTITION BY id ORDER BY page_index)),
parts AS (SELECT id, page_index, id || '__p' || page_index AS new_id, coalesce(lag(cut) OVER (PARTITION BY id ORDER BY page_index), b) AS clip_begin_ms, cut AS clip_end_ms FROM c)"""


@query(_with(B.RECT, B.RUN, _METRICS) + "SELECT span_id, page_index, chars::BIGINT AS chars, round(area, 3) AS area FROM metrics")
def span_page_metrics(spark: SparkSession, d: str) -> DataFrame:
    return spans.page_metrics(B.rects(spark, d), B.runs(spark, d)).withColumn("area", F.round("area", 3))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return spans.split_over_pages(B.order_spans(spark, d), spans.page_metrics(B.rects(spark, d), B.runs(spark, d)))


@query(_with(B.RECT, B.RUN, B.ORDER_SPAN, _METRICS, _SPLIT) + "SELECT id, page_index, new_id, round(clip_begin_ms, 4) AS clip_begin_ms, round(clip_end_ms, 4) AS clip_end_ms FROM parts")
def split_spans_across_pages(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).withColumns({c: F.round(c, 4) for c in ("clip_begin_ms", "clip_end_ms")})


@query(_with(B.RECT, B.RUN, B.ORDER_SPAN, _METRICS, _SPLIT) + "SELECT r.page_index, r.span_pos, coalesce(p.new_id, r.span_id::VARCHAR) AS span_id FROM rect r LEFT JOIN parts p ON p.id = r.span_id AND p.page_index = r.page_index")
def remap_split_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = _split(spark, d).select(F.col("id").cast("string").alias("span_id"), "page_index", "new_id")
    rects = B.rects(spark, d).withColumn("span_id", F.col("span_id").cast("string"))
    return spans.remap_ids(rects, ids, ("span_id", "page_index")).select("page_index", "span_pos", "span_id")


# --- pages, styles, runs -----------------------------------------------------------------------------

_PAGES = "p AS (SELECT o_custkey AS chapter_id, o_orderkey AS page, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS runs FROM orders)"


def _order_pages(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "orders").select(F.col("o_custkey").alias("chapter_id"), F.col("o_orderkey").alias("page"), F.when(F.col("o_totalprice") > 100000, 1).otherwise(0).alias("runs"))


@query(_with(_PAGES) + "SELECT chapter_id, page, (row_number() OVER (ORDER BY chapter_id, page) - 1)::BIGINT AS page_index FROM p")
def global_page_index(spark: SparkSession, d: str) -> DataFrame:
    return pages.number_pages(_order_pages(spark, d), "chapter_id", "page").select("chapter_id", "page", "page_index")


@query(_with(_PAGES, "k AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY page) - 1 AS n FROM p WHERE runs > 0)") + "SELECT chapter_id, page, n::INT AS page_in_chapter, chapter_id || '_p' || lpad(n::VARCHAR, 4, '0') AS page_id FROM k")
def renumber_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.renumber_pages(_order_pages(spark, d), order="page").select("chapter_id", "page", "page_in_chapter", "page_id")


_STYLES = """sr AS (SELECT l_orderkey AS page, l_linenumber AS pos, l_partkey AS tie, l_returnflag AS family, l_linestatus AS slant, l_linenumber AS size FROM lineitem),
f AS (SELECT family, slant, size, min((page, pos, tie)) AS first FROM sr GROUP BY 1, 2, 3), styles AS (SELECT family, slant, size, (row_number() OVER (ORDER BY first) - 1)::BIGINT AS style_id FROM f)"""


def _style_runs(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("tie"), F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("slant"), F.col("l_linenumber").alias("size"))


def _styles(spark: SparkSession, d: str) -> DataFrame:
    # distinct (page, pos, tie, style) have no ties of their own beyond equal styles' rows
    return pages.style_dictionary(_style_runs(spark, d), ["family", "slant", "size"], "page", "pos", "tie", "family", "slant")


@query(_with(_STYLES.replace("min((page, pos, tie))", "min((page, pos, tie, family, slant))")) + "SELECT family, slant, size, style_id FROM styles")
def style_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return _styles(spark, d)


@query("SELECT l_orderkey AS page, l_returnflag AS family, l_linestatus AS slant, l_linenumber AS size, count(*) AS n FROM lineitem GROUP BY ALL")
def style_decode(spark: SparkSession, d: str) -> DataFrame:
    style = ["family", "slant", "size"]
    styles = _styles(spark, d)
    coded = pages.encode_styles(_style_runs(spark, d), styles, style)
    return pages.decode_styles(coded, styles, style).groupBy("page", *style).agg(F.count("*").alias("n"))


_GLYPHS = "g AS (SELECT page_index, span_id AS pos, chr((97 + span_id % 26)::INT) AS ch, x, floor(y / 100) * 10 AS y, 10.0::DOUBLE AS w, 10.0::DOUBLE + h * 0 AS h FROM rect)"


def _glyphs(spark: SparkSession, d: str) -> DataFrame:
    r = B.rects(spark, d)
    return r.select("page_index", F.col("span_id").alias("pos"), F.expr("chr(97 + span_id % 26)").alias("ch"), "x", (F.floor(F.col("y") / 100) * 10).cast("double").alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))


@query(_with(B.RECT, _GLYPHS, """m AS (SELECT *, CASE WHEN abs(y - lag(y) OVER o) > 1 OR abs(y + h - lag(y + h) OVER o) > 1 OR lag(y) OVER o IS NULL THEN 1 ELSE 0 END AS turn FROM g WINDOW o AS (PARTITION BY page_index ORDER BY pos)),
r AS (SELECT *, sum(turn) OVER (PARTITION BY page_index ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM m)""") + """SELECT page_index, run::BIGINT AS run, string_agg(ch, '' ORDER BY pos) AS text, round(min(x), 6) AS x, min(y) AS y, round(max(x + w) - min(x), 6) AS w, max(y + h) - min(y) AS h FROM r GROUP BY 1, 2""")
def run_merge(spark: SparkSession, d: str) -> DataFrame:
    return pages.merge_runs(_glyphs(spark, d)).withColumns({"x": F.round("x", 6), "w": F.round("w", 6)})


@query(_with(B.RECT, _GLYPHS) + "SELECT page_index, ch, y, min(pos) AS pos FROM g GROUP BY 1, 2, 3")
def run_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return pages.dedupe_runs(_glyphs(spark, d), ["page_index", "ch", "y"], "pos")


@query(_with(B.RECT) + "SELECT span_id, page_index, round(greatest(0, x - 300), 6) AS page_x, round(y - 500, 6) AS page_y, greatest(0, w) AS page_w, greatest(0, h) AS page_h, round(y + h - least(greatest(1, w * 0.2), h), 6) AS baseline_y FROM rect")
def page_coordinates(spark: SparkSession, d: str) -> DataFrame:
    x, y, w, h = (F.col(c) for c in "xywh")
    box = pages.page_coordinates(x, y, w, h, F.lit(300.0), F.lit(500.0))
    out = B.rects(spark, d).select("span_id", "page_index", *[F.round(c, 6).alias(n) for n, c in box.items()], F.round(pages.baseline(y, h, None, w), 6).alias("baseline_y"))
    return out


# --- lookups -----------------------------------------------------------------------------------------

_POINTS = "point AS (SELECT user_id AS book_id, event_id AS point_id, floor(epoch_us(ts) / 1000.0::DOUBLE)::DOUBLE - 1704067200000.0::DOUBLE AS t FROM events WHERE event_type = 'click'), live AS (SELECT * FROM timed WHERE chapter_id <> 'click')"


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = B.table(spark, d, "events").where("event_type = 'click'")
    t = F.floor(B._micros(e) / F.lit(1000.0)).cast("double") - F.lit(1704067200000.0)
    return e.select(F.col("user_id").alias("book_id"), F.col("event_id").alias("point_id"), t.alias("t")), B.spans(spark, d).where(timed() & (F.col("chapter_id") != "click"))


def _asof(spark: SparkSession, d: str, **how: bool) -> DataFrame:
    points, live = _points(spark, d)
    return lookups.asof(points, live, "book_id", "t", "clip_begin_ms", "ord", ["id", "clip_begin_ms", "clip_end_ms"], **how)


@query(_with(B.SPAN, _POINTS, "a AS (SELECT p.point_id, p.t, s.id, s.clip_end_ms, row_number() OVER (PARTITION BY p.point_id ORDER BY s.clip_begin_ms DESC, s.ord DESC) AS k FROM point p LEFT JOIN live s ON s.book_id = p.book_id AND s.clip_begin_ms <= p.t)") + "SELECT point_id, CASE WHEN t < clip_end_ms THEN id END AS active_id FROM a WHERE k = 1")
def active_span_asof(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d).select("point_id", F.when(F.col("t") < F.col("found_clip_end_ms"), F.col("found_id")).alias("active_id"))


@query(_with(B.SPAN, _POINTS) + "SELECT p.point_id, arg_min(s.id, s.ord) AS active_id FROM point p LEFT JOIN live s ON s.book_id = p.book_id AND s.clip_begin_ms <= p.t AND p.t < s.clip_end_ms GROUP BY 1")
def active_span_first_match(spark: SparkSession, d: str) -> DataFrame:
    points, live = _points(spark, d)
    found = lookups.interval_first(points, live, "book_id", "t", "clip_begin_ms", "clip_end_ms", "ord", ["id"])
    return found.select("point_id", F.col("found_id").alias("active_id"))


@query(_with(B.SPAN, _POINTS) + "SELECT p.point_id, arg_min(s.id, (s.clip_begin_ms, s.ord)) AS next_id FROM point p LEFT JOIN live s ON s.book_id = p.book_id AND s.clip_begin_ms >= p.t GROUP BY 1")
def next_span_after(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, forward=True).select("point_id", F.col("found_id").alias("next_id"))


@query(_with(B.SPAN, _POINTS) + "SELECT p.point_id, arg_max(s.id, (s.clip_begin_ms, s.ord)) AS last_id FROM point p LEFT JOIN live s ON s.book_id = p.book_id AND s.clip_begin_ms < p.t GROUP BY 1")
def last_span_before(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, strict=True).select("point_id", F.col("found_id").alias("last_id"))


@query(_with(B.SPAN, _POINTS, """a AS (SELECT p.point_id, p.t, s.id, s.clip_end_ms, row_number() OVER (PARTITION BY p.point_id ORDER BY s.clip_begin_ms DESC, s.ord DESC) AS k FROM point p LEFT JOIN live s ON s.book_id = p.book_id AND s.clip_begin_ms <= p.t),
n AS (SELECT p.point_id, arg_min(s.id, (s.clip_begin_ms, s.ord)) AS next_id FROM point p LEFT JOIN live s ON s.book_id = p.book_id AND s.clip_begin_ms >= p.t GROUP BY 1)""") + "SELECT point_id, coalesce(CASE WHEN t < clip_end_ms THEN id END, next_id) AS play_id FROM a JOIN n USING (point_id) WHERE k = 1")
def play_pause_resolution(spark: SparkSession, d: str) -> DataFrame:
    now = _asof(spark, d).select("point_id", F.when(F.col("t") < F.col("found_clip_end_ms"), F.col("found_id")).alias("active_id"))
    after = _asof(spark, d, forward=True).select("point_id", "found_id")
    return now.join(after, "point_id").select("point_id", F.coalesce("active_id", "found_id").alias("play_id"))


_TAPS = "tap AS (SELECT o_orderkey AS tap_id, (o_custkey % 100)::INT AS page_index, (o_orderkey * 37 % 1500)::DOUBLE AS tap_x, (o_orderkey * 91 % 1800)::DOUBLE AS tap_y FROM orders)"


@query(_with(B.RECT, _TAPS) + """SELECT t.tap_id, arg_min(r.span_id, r.span_pos) AS span_id FROM tap t LEFT JOIN rect r ON r.page_index = t.page_index AND tap_x >= x AND tap_x <= x + w AND tap_y >= y AND tap_y <= y + h GROUP BY 1""")
def tap_hit_test(spark: SparkSession, d: str) -> DataFrame:
    o = B.table(spark, d, "orders")
    taps = o.select(F.col("o_orderkey").alias("tap_id"), (F.col("o_custkey") % 100).cast("int").alias("page_index"), (F.col("o_orderkey") * 37 % 1500).cast("double").alias("tap_x"), (F.col("o_orderkey") * 91 % 1800).cast("double").alias("tap_y"))
    return lookups.point_in_rect(taps, B.rects(spark, d)).select("tap_id", "span_id")


@query(_with(B.RECT, B.ORDER_SPAN) + "SELECT page_index, arg_min(id, span_pos) AS span_id, arg_min(clip_begin_ms, span_pos) AS clip_begin_ms FROM rect JOIN ospan ON id = span_id WHERE clip_begin_ms >= 0 AND clip_end_ms > clip_begin_ms GROUP BY 1")
def first_timed_span_on_page(spark: SparkSession, d: str) -> DataFrame:
    return lookups.first_timed_on_page(B.rects(spark, d), B.order_spans(spark, d))


# --- navigation --------------------------------------------------------------------------------------

_NAV = """nav AS (SELECT r_regionkey % 2 AS book_id, 'r' || r_regionkey AS node_id, NULL AS parent_id, r_regionkey::BIGINT AS sibling_ord, r_name AS title, r_regionkey::INT AS page_index FROM region
UNION ALL SELECT n_regionkey % 2, 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey::BIGINT, n_name, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey::INT END FROM nation
UNION ALL SELECT n_regionkey % 2, 'c' || c_custkey, 'n' || c_nationkey, c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 100)::INT END FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def _nav(spark: SparkSession, d: str) -> DataFrame:
    r, n, c = (B.table(spark, d, t) for t in ("region", "nation", "customer"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    a = r.select((F.col("r_regionkey") % 2).alias("book_id"), key("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("long").alias("sibling_ord"), F.col("r_name").alias("title"), F.col("r_regionkey").cast("int").alias("page_index"))
    b = n.select(F.col("n_regionkey") % 2, key("n", "n_nationkey"), key("r", "n_regionkey"), F.col("n_nationkey").cast("long"), "n_name", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey")).cast("int"))
    e = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_regionkey") % 2, key("c", "c_custkey"), key("n", "c_nationkey"), F.col("c_custkey").cast("long"), "c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 100).cast("int"))
    return a.union(b).union(e)


_FLAT = """, walk AS (SELECT *, 0 AS level, [sibling_ord] AS path FROM nav WHERE parent_id IS NULL UNION ALL SELECT n.*, w.level + 1, list_append(w.path, n.sibling_ord) FROM nav n JOIN walk w ON n.parent_id = w.node_id AND n.book_id = w.book_id)
SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY path) - 1)::INT AS position, title, page_index, level FROM walk WHERE page_index IS NOT NULL"""


@query("WITH RECURSIVE " + _NAV + _FLAT)
def toc_flatten(spark: SparkSession, d: str) -> DataFrame:
    return toc.flatten(_nav(spark, d))


@query("""SELECT o_custkey % 3 AS book_id, CASE WHEN o_custkey % 3 = 0 THEN -1 ELSE (row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_custkey) - 1) END::INT AS position, CASE WHEN o_custkey % 3 = 0 THEN 'own' ELSE o_custkey::VARCHAR END AS title, n::INT AS page_index, 0 AS level
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE o_custkey % 3 <> 0 UNION ALL SELECT 0, -1, 'own', 0, 0""")
def toc_fallback(spark: SparkSession, d: str) -> DataFrame:
    n = B.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("int").alias("page_index"))
    chapters = n.select((F.col("o_custkey") % 3).alias("book_id"), F.col("o_custkey").alias("ord"), F.col("o_custkey").alias("chapter_id"), "page_index")
    own = spark.range(1).select(F.lit(0).cast("long").alias("book_id"), F.lit(-1).alias("position"), F.lit("own").alias("title"), F.lit(0).alias("page_index"), F.lit(0).alias("level"))
    return toc.with_fallback(own, chapters)


_TARGETS = "target AS (SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'OPS/' || n_name WHEN 1 THEN 'ops/' || lower(n_name) WHEN 2 THEN 'OPS/' || replace(n_name, ' ', '%20') ELSE 'none' END AS path FROM nation), chapter AS (SELECT n_nationkey AS ord, 'c' || n_nationkey AS chapter_id, 'OPS/' || n_name AS q FROM nation)"


@query(_with(_TARGETS) + "SELECT t.id, t.path, c.chapter_id FROM target t LEFT JOIN chapter c ON lower(replace(t.path, '%20', ' ')) = lower(c.q)")
def toc_path_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = B.table(spark, d, "nation")
    k, name = F.col("n_nationkey"), F.col("n_name")
    path = F.when(k % 4 == 0, F.concat(F.lit("OPS/"), name)).when(k % 4 == 1, F.concat(F.lit("ops/"), F.lower(name))).when(k % 4 == 2, F.concat(F.lit("OPS/"), F.replace(name, F.lit(" "), F.lit("%20")))).otherwise(F.lit("none"))
    chapters = n.select(k.alias("ord"), F.concat(F.lit("c"), k.cast("string")).alias("chapter_id"), F.concat(F.lit("OPS/"), name).alias("xhtml_path"))
    return toc.chapter_of_targets(n.select(k.alias("id"), path.alias("path")), chapters).select("id", "path", "chapter_id")


# --- validation --------------------------------------------------------------------------------------

_TARGET_PARTS = """chapter AS (SELECT DISTINCT chapter_id, 'OPS/' || chapter_id || '.xhtml' AS xhtml_path FROM span WHERE chapter_id <> 'view'),
i AS (SELECT s.*, CASE WHEN c.xhtml_path IS NULL THEN 'smil_textref_unknown_chapter' WHEN ord % 17 = 0 THEN 'smil_textref_missing_fragment' WHEN split_part(text_ref, '#', 1) <> c.xhtml_path THEN 'smil_textref_path_mismatch'
  WHEN ord % 60 >= 50 THEN 'smil_textref_fragment_not_found' END AS a, CASE WHEN clip_begin_ms >= 0 AND clip_end_ms > clip_begin_ms AND ord % 3 <> 0 AND ord % 5 <> 0 THEN 'timed_span_without_geometry_text' END AS b FROM span s LEFT JOIN chapter c USING (chapter_id)),
issue AS (SELECT ord, id, chapter_id, text_ref, unnest([a, b]) AS code FROM i)"""


def _target_issues(spark: SparkSession, d: str) -> DataFrame:
    s = B.spans(spark, d)
    chapters = s.select("chapter_id").distinct().where("chapter_id <> 'view'").withColumn("xhtml_path", F.concat(F.lit("OPS/"), F.col("chapter_id"), F.lit(".xhtml")))
    fragments = chapters.select("chapter_id", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("n")).select("chapter_id", F.concat(F.lit("f"), F.col("n").cast("string")).alias("fragment"))
    return validate.target_issues(s, chapters, fragments, s.where("ord % 3 = 0").select(F.col("id").alias("span_id")), s.where("ord % 5 = 0").select(F.col("id").alias("span_id")))


@query(_with(B.SPAN, _TARGET_PARTS) + "SELECT * FROM issue WHERE code IS NOT NULL")
def smil_target_issues(spark: SparkSession, d: str) -> DataFrame:
    return _target_issues(spark, d)


@query(_with(B.SPAN, _TARGET_PARTS) + f"SELECT code, count(*) AS count, list_position([{', '.join(repr(c) for c in validate.TARGET_CODES)}], code)::INT AS position FROM issue WHERE code IS NOT NULL GROUP BY 1")
def smil_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return validate.issue_counts(_target_issues(spark, d))


_BUNDLE = """b AS (SELECT 'warning' AS severity, c AS code, span_id::VARCHAR AS entity FROM (SELECT span_id, unnest([CASE WHEN w <= 0 THEN 'rect_width' END, CASE WHEN h <= 0 THEN 'rect_height' END, CASE WHEN x < 0 THEN 'rect_negative_x' END,
  CASE WHEN y < 0 THEN 'rect_negative_y' END, CASE WHEN x + w > 1200 THEN 'rect_beyond_width' END, CASE WHEN y + h > 1500 THEN 'rect_beyond_height' END]) AS c FROM rect) WHERE c IS NOT NULL
UNION ALL SELECT 'warning', c, page_index::VARCHAR FROM (SELECT page_index, unnest([CASE WHEN w <= 0 OR h <= 0 THEN 'run_size' END, CASE WHEN x < 0 OR y < 0 THEN 'run_negative_position' END, CASE WHEN y + h > 1500 THEN 'run_beyond_height' END]) AS c FROM run) WHERE c IS NOT NULL
UNION ALL SELECT 'warning', 'page_without_runs', page_index::VARCHAR FROM page WHERE page_index NOT IN (SELECT page_index FROM run)),
twice AS (SELECT id FROM assigned UNION ALL SELECT id FROM assigned WHERE id % 500 = 0)"""


@query(_with(B.RECT, B.RUN, B.PAGE, B.ORDER_SPAN, _ASSIGNED, _BUNDLE) + """SELECT severity, code, entity, count(*) AS count FROM b GROUP BY 1, 2, 3 UNION ALL SELECT 'error', 'duplicate_span_id', id::VARCHAR, count(*) - 1 FROM twice GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'warning', 'spans_without_page', NULL, count(*) FROM assigned WHERE page_index < 0 HAVING count(*) > 0""")
def bundle_validation(spark: SparkSession, d: str) -> DataFrame:
    a = _assigned(spark, d)
    twice = a.select("id", "page_index").union(a.where("id % 500 = 0").select("id", F.greatest("page_index", F.lit(0))))
    return validate.bundle_issues(twice, B.pages(spark, d), B.rects(spark, d), B.runs(spark, d), 1200.0, 1500.0)


# markup before and behind each page's own, by page: what the driver's pages lack
_EXTRA = ("<table><tr><td>x</td></tr></table>", "<ruby>a<rt>b</rt></ruby>", '<p dir="rtl">x</p><svg></svg>', """<p style="float: left; position: absolute">x</p><p style='POSITION: fixed'>y</p>""", "<style>p { writing-mode: vertical-rl } /* float: left */</style><style>q { text-orientation: upright }</style>", "<math></math>", "<style>.a { display: table-cell }</style><table></table><style>.b { table-layout: fixed; float: right }</style>", "")
_HEAD = '<head><link rel="stylesheet" href="css/s.css"><link rel="Alternate StyleSheet" href="./css/s.css?v=1"><link rel="stylesheet" href="http://x.example/a.css"><link rel="icon" href="css/s.css"></head>'
_SHEET = "p { float: left } /* direction: rtl */ q { unicode-bidi: embed } r { position: absolute }"
_HTML = "h AS (SELECT page_id, 'OPS/p' || page_id || '.xhtml' AS file_path, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'c' || page_id % 10 END AS chapter_id, CASE WHEN page_id % 5 = 0 THEN '" + _HEAD + "' ELSE '' END || coalesce(html, '') || CASE page_id % 8 " + " ".join("WHEN %d THEN '%s'" % (i, x.replace("'", "''")) for i, x in enumerate(_EXTRA)) + " END AS html FROM pages)"
# the oracle's own patterns, written from what each feature is
_MARKUP_SQL = """list_filter([CASE WHEN regexp_matches(html, '(?i)<\\s*([a-z0-9_-]+:)?(table|thead|tbody|tfoot|tr|td|th|caption|colgroup|col)\\b') THEN {'code': 'table-layout', 'detail': 'contains table markup (<table>/<tr>/<td>/...)'} END,
  CASE WHEN regexp_matches(html, '(?i)<\\s*([a-z0-9_-]+:)?(ruby|rb|rt|rp)\\b') THEN {'code': 'ruby-text', 'detail': 'contains ruby annotations (<ruby>/<rt>)'} END,
  CASE WHEN regexp_matches(html, '(?i)<\\s*([a-z0-9_-]+:)?math\\b') THEN {'code': 'mathml-content', 'detail': 'contains MathML (<math>)'} END,
  CASE WHEN regexp_matches(html, '(?i)<\\s*([a-z0-9_-]+:)?svg\\b') THEN {'code': 'svg-text-flow', 'detail': 'contains inline SVG content (<svg>)'} END,
  CASE WHEN regexp_matches(html, '(?i)\\bdir\\s*=\\s*["'']rtl["'']') THEN {'code': 'rtl-direction', 'detail': 'contains dir="rtl" markup'} END], lambda x: x IS NOT NULL)"""
_STYLE_SQL = """list_filter([CASE WHEN regexp_matches(css, '\\btable-layout\\s*:') OR regexp_matches(css, '\\bdisplay\\s*:\\s*(inline-)?table(-[a-z-]+)?\\b') THEN {'code': 'table-layout', 'detail': label || 'uses table display/layout CSS declarations'} END,
  CASE WHEN fl AND po THEN {'code': 'positioned-layout', 'detail': label || 'uses float and absolute/fixed positioning CSS declarations'} WHEN fl THEN {'code': 'positioned-layout', 'detail': label || 'uses float CSS declarations'}
       WHEN po THEN {'code': 'positioned-layout', 'detail': label || 'uses absolute/fixed positioning CSS declarations'} END,
  CASE WHEN regexp_matches(css, '\\bdirection\\s*:\\s*rtl\\b') OR regexp_matches(css, '\\bunicode-bidi\\s*:\\s*(embed|bidi-override|isolate|isolate-override|plaintext)\\b') THEN {'code': 'rtl-direction', 'detail': label || 'uses RTL directionality CSS (direction/unicode-bidi)'} END,
  CASE WHEN regexp_matches(css, '\\bwriting-mode\\s*:\\s*(vertical(-rl|-lr)?|tb-rl|tb-lr|sideways-rl|sideways-lr)\\b') OR regexp_matches(css, '\\btext-orientation\\s*:\\s*(upright|sideways(-right)?)\\b') THEN {'code': 'vertical-writing-mode', 'detail': label || 'uses vertical writing-mode/text-orientation CSS'} END], lambda x: x IS NOT NULL)"""
_FEATURES = _with(
    _HTML,
    f"m AS (SELECT file_path, chapter_id, 0 AS seq, unnest({_MARKUP_SQL}) AS f FROM h)",
    r"""lists AS (SELECT file_path, chapter_id, list_concat(list_transform(regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style>', 1), lambda x: {'label': 'inline <style> block ', 'css': x}),
  list_transform(regexp_extract_all(html, '(?is)\bstyle\s*=\s*("[^"]*"|''[^'']*'')', 1), lambda x: {'label': 'inline style attribute ', 'css': x[2:-2]})) AS l FROM h)""",
    "src AS (SELECT file_path, chapter_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS seq FROM lists)",
    "linked AS (SELECT 'OPS/css/s.css' AS file_path, chapter_id, {'label': 'linked stylesheet \"' || href || '\" ', 'css': '" + _SHEET + "'} AS s, 1000000 + i AS seq FROM h, (VALUES (1, 'css/s.css'), (2, './css/s.css?v=1')) AS l(i, href) WHERE page_id % 5 = 0)",
    r"every AS (SELECT file_path, chapter_id, seq, s.label AS label, lower(regexp_replace(s.css, '(?s)/\*.*?\*/', ' ', 'g')) AS css FROM (SELECT file_path, chapter_id, seq, s FROM src UNION ALL SELECT file_path, chapter_id, seq, s FROM linked))",
    r"flags AS (SELECT *, regexp_matches(css, '\bfloat\s*:\s*(left|right|inline-start|inline-end)\b') AS fl, regexp_matches(css, '\bposition\s*:\s*(absolute|fixed)\b') AS po FROM every)",
    f"f AS (SELECT * FROM m UNION ALL SELECT file_path, chapter_id, seq, unnest({_STYLE_SQL}) FROM flags)",
    "one AS (SELECT file_path, chapter_id, f.code AS code, f.detail AS detail, min(seq) AS seq FROM f GROUP BY ALL)",
    "warned AS (SELECT one.code, label, level, file_path, chapter_id, string_agg(detail, '; ' ORDER BY seq) AS detail FROM one JOIN (VALUES ('fixed-layout', 'Fixed-layout indicators', 'unsupported'), ('table-layout', 'Tables / complex table layout', 'degraded'), ('positioned-layout', 'Floats / absolute positioning', 'degraded'), ('ruby-text', 'Ruby text annotations', 'degraded'), ('mathml-content', 'MathML content', 'unsupported'), ('svg-text-flow', 'SVG-heavy text flow', 'degraded'), ('rtl-direction', 'RTL directionality', 'unsupported'), ('vertical-writing-mode', 'Vertical writing mode', 'unsupported')) AS l(code, label, level) ON l.code = one.code GROUP BY ALL)",
)


def _extended_pages(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, file_path, chapter_id, html): the pages as chapters, with the markup above."""
    k = F.col("page_id")
    extra = F.element_at(F.array(*[F.lit(x) for x in _EXTRA]), (k % 8 + 1).cast("int"))
    html = F.concat(F.when(k % 5 == 0, _HEAD).otherwise(""), F.coalesce("html", F.lit("")), extra)
    return B.table(spark, d, "pages").select("page_id", F.concat(F.lit("OPS/p"), k.cast("string"), F.lit(".xhtml")).alias("file_path"), F.when(k % 3 != 0, F.concat(F.lit("c"), (k % 10).cast("string"))).alias("chapter_id"), html.alias("html"))


def _feature_warnings(spark: SparkSession, d: str) -> DataFrame:
    return validate.feature_warnings(_extended_pages(spark, d), spark.createDataFrame([("OPS/css/s.css", _SHEET)], "file_path string, css string"))


@query(_FEATURES + "SELECT code, label, level, file_path, chapter_id, detail FROM warned")
def feature_scan(spark: SparkSession, d: str) -> DataFrame:
    return _feature_warnings(spark, d)


@query(_FEATURES + "SELECT code, label, level, count(*) AS warnings, count(DISTINCT coalesce(chapter_id, file_path)) AS chapters, (row_number() OVER (ORDER BY CASE WHEN level = 'unsupported' THEN 0 ELSE 1 END, label))::INT AS position FROM warned GROUP BY 1, 2, 3")
def feature_summary(spark: SparkSession, d: str) -> DataFrame:
    return validate.feature_summary(_feature_warnings(spark, d))


@query(_FEATURES + "SELECT code, file_path, chapter_id, (row_number() OVER (ORDER BY CASE WHEN level = 'unsupported' THEN 0 ELSE 1 END, label, coalesce(chapter_id, ''), file_path) - 1)::INT AS position FROM warned")
def feature_order(spark: SparkSession, d: str) -> DataFrame:
    """All warnings of the pages, as one book's, in the order in which they are told."""
    return validate.warning_order(_feature_warnings(spark, d)).select("code", "file_path", "chapter_id", "position")


# --- style sheets, paths, colours, times -------------------------------------------------------------


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style>', 1))::INT AS n, array_to_string(regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style>', 1), '|') AS styles FROM pages""")
def style_blocks(spark: SparkSession, d: str) -> DataFrame:
    found = css.style_blocks(F.col("html"))
    return B.table(spark, d, "pages").select("page_id", F.size(found).alias("n"), F.array_join(found, "|").alias("styles"))


@query(_with(_HTML) + r"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'css/s.css|./css/s.css?v=1|http://x.example/a.css' ELSE '' END AS hrefs, CASE WHEN page_id % 5 = 0 THEN 'OPS/css/s.css|OPS/css/s.css' ELSE '' END AS paths FROM h""")
def stylesheet_hrefs(spark: SparkSession, d: str) -> DataFrame:
    """The sheets that each page's head links, and where in the package they are."""
    found = _extended_pages(spark, d).select("page_id", "file_path", css.stylesheet_hrefs(F.col("html")).alias("h"))
    at = F.array_compact(F.transform("h", lambda x: paths.stylesheet_path(F.col("file_path"), x)))
    return found.select("page_id", F.array_join("h", "|").alias("hrefs"), F.array_join(at, "|").alias("paths"))


# a sheet behind each page's own, made of its number
_PAGE_SHEETS = (
    '@import url("http://x.example/{k}.css"); @import "local{k}.css"; p { color: red }',
    "p { background: URL( 'http://x.example/{k}.png' ) } q { background: url(//x/{k}) } r { background: url(img/{k}.png) } s { cursor: url(data:a{k}) }",
    "p { behavior: url(x{k}.htc); width: expression(alert({k})); scroll-behavior: smooth; color: red }",
    "h{k} { break-before: page; color: red } @media print { h2 { page-break-after: LEFT !important; page-break-after: left } }",
)
_SHEET_SQL = "s AS (SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<style\\b[^>]*>(.*?)</style>', 1), chr(10)) || chr(10) || replace(CASE page_id % 4 " + " ".join("WHEN %d THEN '%s'" % (i, x.replace("'", "''")) for i, x in enumerate(_PAGE_SHEETS)) + " END, '{k}', page_id::VARCHAR) AS t FROM pages)"


def _page_sheets(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, css): the style elements of each page, and one more sheet."""
    k = F.col("page_id")
    own = F.replace(F.element_at(F.array(*[F.lit(x) for x in _PAGE_SHEETS]), (k % 4 + 1).cast("int")), F.lit("{k}"), k.cast("string"))
    return B.table(spark, d, "pages").select("page_id", F.concat(F.array_join(css.style_blocks(F.col("html")), "\n"), F.lit("\n"), own).alias("css"))


@query(_with(_SHEET_SQL) + r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)@import\s+[^;]*//[^;]*;', '', 'g'), '(?i)\bbehavior\s*:[^;{}]*;?', '', 'g'), '(?i)[a-z-]+\s*:[^;{}]*expression\s*\([^;{}]*\)[^;{}]*;?', '', 'g'), '(?i)url\(\s*[''"]?(https?:)?//[^)]*\)', 'url("")', 'g') AS css,
CASE page_id % 4 WHEN 0 THEN 1 ELSE 0 END AS removed_imports, CASE page_id % 4 WHEN 1 THEN 2 ELSE 0 END AS rewritten_urls, CASE page_id % 4 WHEN 2 THEN 3 ELSE 0 END AS removed_declarations FROM s""")
def css_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return _page_sheets(spark, d).select("page_id", css.sanitized(F.col("css")).alias("s")).select("page_id", "s.*")


@query(r"""SELECT page_id, CASE page_id % 4 WHEN 3 THEN 'h' || page_id || ' { break-before: column; }' || chr(10) || '@media print {' || chr(10) || '  h2 { page-break-after: left !important; break-after: column !important; page-break-after: left; break-after: column; }' || chr(10) || '}' ELSE '' END AS rules FROM pages""")
def break_rules(spark: SparkSession, d: str) -> DataFrame:
    return _page_sheets(spark, d).select("page_id", F.array_join(css.break_rules_of(F.col("css")), "\n").alias("rules"))


_CLIP = """CASE event_id % 5 WHEN 0 THEN event_id || 'ms' WHEN 1 THEN event_id || 's' WHEN 2 THEN '00:' || lpad((event_id % 60)::VARCHAR, 2, '0') || ':07.5' WHEN 3 THEN (event_id % 60) || ':30' ELSE event_id || '.25' END"""


@query(f"""SELECT event_id, clip, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN event_id * 1000 WHEN 2 THEN (event_id % 60) * 60000 + 7500 WHEN 3 THEN (event_id % 60) * 60000 + 30000 ELSE event_id * 1000 + 250 END::DOUBLE AS ms FROM (SELECT event_id, {_CLIP} AS clip FROM events)""")
def clip_time_parse(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    s = n.cast("string")
    text = F.when(n % 5 == 0, F.concat(s, F.lit("ms"))).when(n % 5 == 1, F.concat(s, F.lit("s"))).when(n % 5 == 2, F.concat(F.lit("00:"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(":07.5"))).when(n % 5 == 3, F.concat((n % 60).cast("string"), F.lit(":30"))).otherwise(F.concat(s, F.lit(".25")))
    return B.table(spark, d, "events").select("event_id", text.alias("clip")).withColumn("ms", clip.clip_ms(F.col("clip")))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS clock,
(s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS minutes FROM (SELECT event_id, event_id * 1234567 % 20000000 // 1000 AS s FROM events)""")
def format_ms(spark: SparkSession, d: str) -> DataFrame:
    ms = (F.col("event_id") * 1234567 % 20000000).cast("double")
    return B.table(spark, d, "events").select("event_id", clip.hours_text(ms).alias("clock"), clip.minutes_text(ms).alias("minutes"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'OPS/text/a' || p_partkey || '.xhtml' WHEN 1 THEN 'OPS/img/b.png#f' WHEN 2 THEN 'c.css' WHEN 3 THEN 'OPS/text/d/e.js' ELSE 'OPS/x' END AS path FROM part""")
def resolve_path(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    relative = F.when(k % 5 == 0, F.concat(F.lit("a"), k.cast("string"), F.lit(".xhtml"))).when(k % 5 == 1, F.lit("../img/b.png#f#g")).when(k % 5 == 2, F.lit("../../../../c.css")).when(k % 5 == 3, F.lit("./d//e.js")).otherwise(F.lit("q/../../x"))
    return B.table(spark, d, "part").select("p_partkey", paths.resolve(F.lit("OPS/text/ch.xhtml"), relative).alias("path"))


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://[^/]*', 'https://EPUB.local:443/OPS/./x%20y') WHEN 2 THEN 'data:text/plain,' || url WHEN 3 THEN 'https://epub.local/a%2F..%2F..%2F' || page_id || '.css' ELSE regexp_replace(url, '^[a-z]+:', '') END AS url FROM pages)
SELECT page_id, 'blocked' AS kind, NULL AS path, 'origin ' || regexp_extract(url, '^(https?://[^/?#]*)', 1) || ' is not allowed' AS reason FROM u WHERE page_id % 5 = 0
UNION ALL SELECT page_id, 'epub-resource', 'OPS/x y' || regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https://EPUB.local:443/OPS/./x%20y', ''), NULL FROM u WHERE page_id % 5 = 1
UNION ALL SELECT page_id, 'inline-resource', NULL, NULL FROM u WHERE page_id % 5 = 2 UNION ALL SELECT page_id, 'blocked', NULL, 'invalid EPUB resource path' FROM u WHERE page_id % 5 = 3 UNION ALL SELECT page_id, 'blocked', NULL, 'invalid URL' FROM u WHERE page_id % 5 = 4""")
def classify_url(spark: SparkSession, d: str) -> DataFrame:
    """The pages' URLs: as they are, moved to the package's origin, as data, leading out of the package, and without a scheme."""
    k, url = F.col("page_id"), F.col("url")
    made = (
        F.when(k % 5 == 0, url).when(k % 5 == 1, F.regexp_replace(url, "^https?://[^/]*", "https://EPUB.local:443/OPS/./x%20y")).when(k % 5 == 2, F.concat(F.lit("data:text/plain,"), url))
        .when(k % 5 == 3, F.concat(F.lit("https://epub.local/a%2F..%2F..%2F"), k.cast("string"), F.lit(".css"))).otherwise(F.regexp_replace(url, "^[a-z]+:", ""))
    )
    return B.table(spark, d, "pages").select("page_id", paths.classify_url(made).alias("c")).select("page_id", "c.*")


# the oracle's own table of contents by ending, and endings that are none
_TYPES_SQL = """(VALUES ('xhtml', 'application/xhtml+xml'), ('xml', 'application/xhtml+xml'), ('opf', 'application/xhtml+xml'), ('html', 'text/html; charset=utf-8'), ('htm', 'text/html; charset=utf-8'), ('css', 'text/css; charset=utf-8'), ('js', 'text/javascript; charset=utf-8'), ('mjs', 'text/javascript; charset=utf-8'),
('json', 'application/json; charset=utf-8'), ('svg', 'image/svg+xml'), ('png', 'image/png'), ('jpg', 'image/jpeg'), ('jpeg', 'image/jpeg'), ('gif', 'image/gif'), ('webp', 'image/webp'), ('ttf', 'font/ttf'), ('otf', 'font/otf'), ('woff', 'font/woff'), ('woff2', 'font/woff2'), ('smil', 'application/smil+xml')) AS t(ending, content_type)"""
_ENDINGS = "xhtml xml opf html htm css js mjs json svg png jpg jpeg gif webp ttf otf woff woff2 smil mp3 CSS Png x.css gz".split()
_PATHS_SQL = "p AS (SELECT p_partkey, lower(string_split('" + " ".join(_ENDINGS) + f"', ' ')[p_partkey % {len(_ENDINGS)} + 1]) AS e FROM part), q AS (SELECT p_partkey, regexp_extract(e, '([^.]*)$', 1) AS ending FROM p)"


def _part_paths(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, path): parts as files of a package."""
    k = F.col("p_partkey")
    return B.table(spark, d, "part").select("p_partkey", F.concat(F.lit("OPS/"), F.replace("p_name", F.lit(" "), F.lit("/")), k.cast("string"), F.lit("."), F.element_at(F.array(*[F.lit(x) for x in _ENDINGS]), (k % len(_ENDINGS) + 1).cast("int"))).alias("path"))


@query(_with(_PATHS_SQL) + f"SELECT p_partkey, coalesce(t.content_type, 'application/octet-stream') AS content_type, q.ending IN ('css', 'ttf', 'otf', 'woff', 'woff2') OR p_partkey % 9 = 0 AS critical, p_partkey % 10 = 0 OR q.ending = 'css' AS stylesheet FROM q LEFT JOIN {_TYPES_SQL} ON t.ending = q.ending")
def content_type(spark: SparkSession, d: str) -> DataFrame:
    k, path = F.col("p_partkey"), F.col("path")
    sheet = player.is_stylesheet(F.when(k % 10 == 0, " StyleSheet").otherwise("other"), paths.content_type(path), path)
    return _part_paths(spark, d).select("p_partkey", paths.content_type(path).alias("content_type"), paths.is_critical(path, F.when(k % 9 == 0, "Font ").otherwise("other")).alias("critical"), sheet.alias("stylesheet"))


@query(_with(_PATHS_SQL) + "SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN 'blocked' WHEN p_partkey % 6 = 4 THEN 'inline' WHEN p_partkey % 2 = 0 THEN 'ok' ELSE 'missing' END AS outcome, CASE WHEN p_partkey % 6 = 5 OR p_partkey % 2 = 1 THEN CASE WHEN ending IN ('css', 'ttf', 'otf', 'woff', 'woff2') THEN 'fatal' ELSE 'warning' END END AS severity FROM q")
def resource_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Every part as a request; half of the parts are in the package."""
    files, k = _part_paths(spark, d), F.col("p_partkey")
    url = F.when(k % 6 == 5, F.concat(F.lit("https://x.example/"), F.col("path"))).when(k % 6 == 4, F.concat(F.lit("data:,"), F.col("path"))).otherwise(F.concat(F.lit(paths.ORIGIN + "/"), paths.encode_path(F.col("path")), F.lit("?v=1")))
    return validate.resource_outcomes(files.select("p_partkey", url.alias("url"), F.lit("other").alias("resource_type")), files.where(k % 2 == 0).select("path")).select("p_partkey", "outcome", "severity")


@query(r"""SELECT page_id, 'https://epub.local/OPS/ch%20' || page_id || '/' AS base, '<html><head>' || chr(10) || '  <base href="https://epub.local/OPS/ch%20' || page_id || '/"></head>' AS html FROM pages""")
def base_links(spark: SparkSession, d: str) -> DataFrame:
    """The URL of each chapter's folder, and a head with it."""
    href = paths.base_href(F.concat(F.lit("OPS\\ch "), F.col("page_id").cast("string"), F.lit("/text.xhtml")))
    return B.table(spark, d, "pages").select("page_id", href.alias("base"), paths.inject_base(F.lit("<html><head></head>"), href).alias("html"))


@query("""SELECT p_partkey, least(255, greatest(0, floor(((0.2126 * r + 0.7152 * g + 0.0722 * b) * a + 255.0 * (1 - a)) / 85 + 0.5) * 85))::INT AS ink FROM (SELECT p_partkey, (p_partkey * 7 % 256)::DOUBLE AS r, (p_partkey * 13 % 256)::DOUBLE AS g, (p_partkey * 29 % 256)::DOUBLE AS b, CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS a FROM part)""")
def ink_gray(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rgb = F.concat_ws(", ", *[(k * m % 256).cast("string") for m in (7, 13, 29)])
    text = F.when(k % 3 == 0, F.concat(F.lit("rgba("), rgb, F.lit(", 0.5)"))).otherwise(F.concat(F.lit("rgb("), rgb, F.lit(")")))
    return B.table(spark, d, "part").select("p_partkey", color.ink_gray(text).alias("ink"))


# --- alignment ---------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[\x2E-\x5F()\[\],/?!@#$%^&*`~;:=''"<>+ˌˈ]', '', 'g')) AS counted FROM documents""")
def sentence_filter(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").select("doc_id", align.counted_length(F.coalesce("text", F.lit(""))).cast("long").alias("counted"))


@query()
def sentence_extract(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").select("doc_id", F.posexplode(align.sentences(F.col("text"))).alias("position", "sentence"))


@query()
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Each passage of benchmark, one letter of every forty changed, in every turn of all conversations that begin with its first word; and in itself, without conv_id and turn."""
    word = lambda c: F.lower(F.regexp_extract(c, r"^\s*(\S*)", 1))
    c = B.table(spark, d, "conversations").select("conv_id", "turn", "text")
    b = B.table(spark, d, "benchmark").where("text is not null").select("item_id", word("text").alias("word"), F.regexp_replace("text", "(?s)(.{20}).(.{0,19})", "$1#$2").alias("needle"), "text")
    first = c.groupBy("conv_id").agg(word(F.min_by("text", "turn")).alias("word"))
    alike = first.join(b, "word").select("conv_id", "item_id", "needle").join(c, "conv_id").select("item_id", "conv_id", "turn", "needle", F.col("text").alias("hay"))
    none = lambda name: F.lit(None).cast(c.schema[name].dataType).alias(name)
    own = b.select("item_id", none("conv_id"), none("turn"), "needle", F.concat(F.lit("Before. "), F.col("text"), F.lit(" After.")).alias("hay"))
    pairs = own.union(alike).repartition(4 * spark.sparkContext.defaultParallelism)  # few rows, much work each
    return pairs.select("item_id", "conv_id", "turn", align.fuzzy_match(F.col("needle"), F.col("hay")).alias("m")).select("item_id", "conv_id", "turn", "m.*")


@query()
def passage_search(spark: SparkSession, d: str) -> DataFrame:
    """Each passage of benchmark, one letter of every forty changed, in the whole texts of all documents: those that hold it with a tenth of its letters wrong at most."""
    b = B.table(spark, d, "benchmark").where("text is not null").select(F.col("item_id").alias("needle_id"), F.regexp_replace("text", "(?s)(.{20}).(.{0,19})", "$1#$2").alias("needle"))
    found = search.search(b, B.table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"), share=0.1, least=1)
    return found.select(F.col("needle_id").alias("item_id"), F.col("text_id").alias("doc_id"), "start", "end", "distance")


def _conversation_words(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = B.table(spark, d, "conversations")
    said = c.groupBy(F.col("conv_id").alias("book_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("transcript"))
    parts = said.select("book_id", F.posexplode(F.split("transcript", " ")).alias("ord", "w"))
    along = Window.partitionBy("book_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("w") + 1).over(along), F.lit(0)).cast("long")
    words = parts.select("book_id", "ord", (F.col("ord") * 0.5).alias("start_s"), (F.col("ord") * 0.5 + 0.4).alias("end_s"), begin.alias("start_off"), (begin + F.length("w")).alias("end_off"), F.lit("a.mp3").alias("audiofile"))
    return said, words


@query()
def align_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation as a book of one chapter, its transcript itself."""
    said, words = _conversation_words(spark, d)
    chapters = said.select("book_id", F.lit(0).alias("ord"), F.lit("c0").alias("chapter_id"), align.sentences(F.col("transcript")).alias("sentences"))
    tracks = said.select("book_id", F.lit("a.mp3").alias("href"), F.lit(10000.0).alias("duration_s"))
    return align.align_books(chapters, words, said, tracks)


@query()
def align_anchored(spark: SparkSession, d: str) -> DataFrame:
    """Twenty books whose chapters are conversations, each heard in the text of all of them, cut at anchors."""
    c = B.table(spark, d, "conversations").where("text is not null").select((F.col("conv_id") % 20).alias("book_id"), F.col("conv_id"), "turn", "text")
    told = c.groupBy("book_id", "conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    told = materialise(told, "told")
    chapters = told.select("book_id", F.col("conv_id").alias("ord"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("chapter_id"), align.sentences(F.col("text")).alias("sentences"))
    # a book's text is its conversations' with a blank between two: where each begins, and how many words are before it
    sized = told.select("book_id", "conv_id", (align.units("text") + 1).alias("size"), F.size(F.split("text", " ")).cast("long").alias("n"))
    begun = Ranged(Ranged(sized, "book_id", "conv_id").sum_before(F.col("size"), "at"), "book_id", "conv_id").sum_before(F.col("n"), "first")
    placed = materialise(told.join(begun.select("book_id", "conv_id", "at", "first"), ["book_id", "conv_id"]), "placed")
    parts = placed.select("book_id", F.greatest(F.col("at") - 1, F.lit(0)).alias("at"), F.when(F.col("at") == 0, F.col("text")).otherwise(F.concat(F.lit(" "), F.col("text"))).alias("transcript"))
    words = align.blank_words(placed).select("book_id", "ord", (F.col("ord") * 0.5).alias("start_s"), (F.col("ord") * 0.5 + 0.4).alias("end_s"), "start_off", "end_off", F.lit("a.mp3").alias("audiofile"))
    tracks = told.select("book_id").distinct().select("book_id", F.lit("a.mp3").alias("href"), F.lit(1000000.0).alias("duration_s"))
    return anchors.align_pieces(chapters, words, parts, tracks)


_FILLED = "b AS (SELECT *, coalesce(lag(id) OVER (PARTITION BY chapter_id ORDER BY id), -1) AS prev FROM rng), filled AS (SELECT chapter_id, id, start_s, end_s, audiofile FROM rng UNION ALL SELECT chapter_id, unnest(range(prev + 1, id)) AS id, -1.0, -1.0, audiofile FROM b)"


@query(_with(B.RANGE.replace("event_id AS id", "event_id % 40 AS id"), "u AS (SELECT chapter_id, id, min(start_s) AS start_s, min(end_s) AS end_s, min(audiofile) AS audiofile FROM rng GROUP BY 1, 2)", _FILLED.replace("FROM rng", "FROM u")) + "SELECT * FROM filled")
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    r = B.ranges(spark, d).withColumn("id", F.col("id") % 40).groupBy("chapter_id", "id").agg(*[F.min(c).alias(c) for c in ("start_s", "end_s", "audiofile")])
    return align.fill_gaps(r)


@query("WITH RECURSIVE " + B.RANGE + """, n AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY id) AS k FROM rng),
w AS (SELECT chapter_id, id, k, start_s, end_s, audiofile FROM n WHERE k = 1 UNION ALL
SELECT chapter_id, id, k, s, CASE WHEN s < 0 OR end_s < 0 OR end_s > s THEN end_s ELSE s + 0.001 END, audiofile FROM (SELECT n.*, CASE WHEN w.end_s > n.start_s AND w.audiofile = n.audiofile THEN w.end_s ELSE n.start_s END AS s FROM n JOIN w ON n.chapter_id = w.chapter_id AND n.k = w.k + 1))
SELECT chapter_id, id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, audiofile FROM w""")
def expand_ranges(spark: SparkSession, d: str) -> DataFrame:
    return align.widen_empty(B.ranges(spark, d)).withColumns({c: F.round(c, 6) for c in ("start_s", "end_s")})


@query(_with(B.RANGE, "t AS (SELECT *, CASE WHEN lag(audiofile) OVER o IS DISTINCT FROM audiofile THEN 1 ELSE 0 END AS turn FROM rng WINDOW o AS (PARTITION BY chapter_id ORDER BY id))", "r AS (SELECT *, sum(turn) OVER (PARTITION BY chapter_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM t)") + "SELECT chapter_id, sum(d) AS duration_s FROM (SELECT chapter_id, arg_max(end_s, id) - arg_min(start_s, id) AS d FROM r GROUP BY chapter_id, run) GROUP BY 1")
def chapter_duration(spark: SparkSession, d: str) -> DataFrame:
    return align.chapter_durations(B.ranges(spark, d))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 2 THEN '' ELSE coalesce(text, '') END AS text FROM conversations), n AS (SELECT *, length(text) AS units, last_value(nullif(text, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spoken FROM t),
g AS (SELECT *, CASE WHEN spoken IS NULL OR right(spoken, 1) = ' ' THEN 0 ELSE 1 END AS gap FROM n)
SELECT conv_id, turn, (coalesce(sum(gap + units) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + gap)::BIGINT AS shift FROM g""")
def transcript_concat(spark: SparkSession, d: str) -> DataFrame:
    """All turns of each conversation as parts of a transcript, every fifth of them silent."""
    parts = B.table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("ord"), F.when(F.col("turn") % 5 == 2, "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    return align.join_transcripts(parts).select(F.col("book_id").alias("conv_id"), F.col("ord").alias("turn"), "shift")


# --- small functions over the tables ------------------------------------------------------------------


@query(r"""SELECT p_partkey, 'OPS/' || n || '/../' || p_partkey || '/./x%20y.css' AS stripped, '/OPS/' || n || '/../' || p_partkey || '/./x%20y.css' AS slashed, 'OPS/' || p_partkey || '/x%20y.css' AS normalised, 'OPS/' || p_partkey || '/x y.css' AS comparable,
'../' || p_partkey || '/z' AS above, CASE p_partkey % 4 WHEN 0 THEN 'OPS/text/s' || p_partkey || '.css' WHEN 1 THEN 'OPS/a b.css' END AS sheet, p_partkey % 4 < 2 OR p_partkey % 4 = 3 AS safe FROM (SELECT p_partkey, replace(p_name, ' ', '+') AS n FROM part)""")
def path_forms(spark: SparkSession, d: str) -> DataFrame:
    """A package path in each of its forms, and a style sheet's link resolved."""
    k = F.col("p_partkey").cast("string")
    raw = F.concat(F.lit("/OPS\\"), F.replace("p_name", F.lit(" "), F.lit("+")), F.lit("/../"), k, F.lit("/./x%20y.css"))
    href = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("./s"), k, F.lit(".css?v=1#x"))).when(F.col("p_partkey") % 4 == 1, F.lit(" ../a%20b.css ")).when(F.col("p_partkey") % 4 == 2, F.lit("HTTPS://x.example/a.css")).otherwise(F.lit("../../../a.css"))
    return B.table(spark, d, "part").select(
        "p_partkey", paths.strip_lead(raw).alias("stripped"), paths.slashes(raw).alias("slashed"), paths.normalise(raw).alias("normalised"), paths.comparable(raw).alias("comparable"),
        paths.normalise(F.concat(F.lit("a/../../"), k, F.lit("/z"))).alias("above"), paths.stylesheet_path(F.lit("OPS/text/ch.xhtml"), href).alias("sheet"), paths.safe_href(href).alias("safe"),
    )


@query(r"""SELECT p_partkey, p_partkey % 4 < 2 OR p_partkey % 4 = 3 AS own, CASE p_partkey % 4 WHEN 0 THEN 'OPS/ch%20' || p_partkey || '.xhtml' WHEN 2 THEN 'OPS/other.xhtml' WHEN 3 THEN 'OPS/ch ' || p_partkey || '.xhtml' END AS path, CASE p_partkey % 4 WHEN 0 THEN 'a b' WHEN 1 THEN 'f' || p_partkey || '#g' WHEN 2 THEN NULL ELSE '%zz' END AS fragment FROM part""")
def text_references(spark: SparkSession, d: str) -> DataFrame:
    """References of overlays in parts, and whether they mean the chapter itself."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    ref = F.when(n == 0, F.concat(F.lit("OPS/ch%20"), k, F.lit(".xhtml#a%20b"))).when(n == 1, F.concat(F.lit("#f"), k, F.lit("#g"))).when(n == 2, F.lit("OPS/x/../other.xhtml#")).otherwise(F.concat(F.lit("OPS\\ch "), k, F.lit(".xhtml#%zz")))
    chapter = F.concat(F.lit("OPS/ch "), k, F.lit(".xhtml"))
    return B.table(spark, d, "part").select("p_partkey", paths.is_for_chapter(ref, chapter).alias("own"), paths.reference_path(ref).alias("path"), paths.reference_fragment(ref).alias("fragment"))


@query(r"""SELECT page_id, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS attribute,
trim(regexp_replace(regexp_replace(lower(t), '\s+', ' ', 'g'), '[—–]', '-', 'g')) AS search FROM (SELECT page_id, '“It''s” —' || chr(10) || ' ' || coalesce(html, '') AS t FROM pages)""")
def escapes(spark: SparkSession, d: str) -> DataFrame:
    """Every page's markup as text, as an attribute, and as it is looked for."""
    text = F.concat(F.lit("“It's” —\n "), F.coalesce("html", F.lit("")))
    return B.table(spark, d, "pages").select("page_id", markup.escape_html(text).alias("html"), markup.escape_attribute(text).alias("attribute"), markup.search_text(text).alias("search"))


@query(r"""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'urn-' || c_custkey || '-x' ELSE substr(sha256(c_name || '|' || 'c1,c' || c_custkey), 1, 16) END AS id, CASE c_custkey % 3 WHEN 0 THEN 'urn-' || c_custkey || '-x' ELSE substr(sha256(c_name), 1, 16) END AS aligned FROM customer""")
def bundle_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    own = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" urn \t"), k, F.lit("\n x "))).when(F.col("c_custkey") % 3 == 1, F.lit("  "))
    return B.table(spark, d, "customer").select("c_custkey", paths.bundle_id(own, F.col("c_name"), F.array(F.lit("c1"), F.concat(F.lit("c"), k))).alias("id"), paths.bundle_id(own, F.col("c_name")).alias("aligned"))


@query(r"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id - 1 WHEN 2 THEN event_id END::INT AS asked, greatest(0, least(99, event_id % 140 - 20))::INT AS page, greatest(0, least(99, coalesce(CASE WHEN event_id % 2 = 0 THEN event_id % 140 - 20 END, event_id % 90)))::INT AS start,
floor(value)::BIGINT + 1 AS seek_ms, event_id % 50 <= 16 AND event_id % 300 <= 220 AND event_id % 3 = 1 AS tap FROM events""")
def player_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Pages that are asked for, clamped and begun with, seeks and taps."""
    e, n = B.table(spark, d, "events"), F.col("event_id")
    zero = F.when(n % 4 == 0, n.cast("string")).when(n % 4 == 1, F.lit("-1")).when(n % 4 == 2, n.cast("string")).otherwise(F.lit("x"))
    one = F.when(n % 4 == 1, n.cast("string")).when(n % 4 == 2, F.lit("7")).otherwise(F.lit("0"))
    some = F.when(n % 2 == 0, n % 140 - 20)
    return e.select(
        "event_id", player.jump_page(zero, one).alias("asked"), pages.clamp_page(n % 140 - 20, F.lit(100)).cast("int").alias("page"), player.start_page(some, n % 90, F.lit(100)).cast("int").alias("start"),
        clip.seek_target(F.col("value")).alias("seek_ms"), player.is_tap((n % 50).cast("double"), F.lit(32.0), n % 300, n % 3).alias("tap"),
    )


@query(r"""SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'opus' ELSE 'm4a' END AS format, 'audio.' || CASE p_partkey % 2 WHEN 0 THEN 'opus' ELSE 'm4a' END AS file_name, CASE p_partkey % 2 WHEN 0 THEN 'OGG Opus' ELSE 'M4A (AAC)' END AS label,
CASE p_partkey % 2 WHEN 0 THEN '-c:a libopus -b:a 48k -vbr on -application voip' ELSE '-c:a aac -b:a 48k' END AS encoder FROM part""")
def audio_formats(spark: SparkSession, d: str) -> DataFrame:
    f = player.audio_format(F.when(F.col("p_partkey") % 2 == 0, " Opus").otherwise("M4A"))
    return B.table(spark, d, "part").select("p_partkey", f.alias("f")).select("p_partkey", "f.format", "f.file_name", "f.label", F.array_join("f.encoder", " ").alias("encoder"))


@query(_with(B.RECT) + "SELECT span_id, page_index, ceil((x + 1000) / 850.0)::BIGINT AS columns, floor((x - 30 + 4) / 850.0)::BIGINT AS column_no, w <> 0 AND h <> 0 AND x >= 96 AND x < 900 AS shown FROM rect")
def column_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Where rectangles lie in a text that was laid out in columns."""
    r, x = B.rects(spark, d), F.col("x")
    seen = pages.visible(r, F.lit(100.0), F.lit(900.0)).select("span_id", "page_index", F.lit(True).alias("shown"))
    placed = r.select("span_id", "page_index", pages.column_count(x + 1000, F.lit(800.0), F.lit(50.0)).alias("columns"), pages.column_of(x, F.lit(30.0), F.lit(800.0), F.lit(50.0)).alias("column_no"))
    return placed.join(seen, ["span_id", "page_index"], "left").withColumn("shown", F.coalesce("shown", F.lit(False)))


_GLYPHS = "g AS (SELECT user_id AS node, n, n // 10 AS line, CASE WHEN n % 7 = 3 THEN ' ' ELSE chr((97 + event_id % 26)::INT) END AS ch FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events))"


@query(_with(_GLYPHS) + r"""SELECT node, string_agg(ch, '' ORDER BY n) AS text, min((n % 10) * 5)::DOUBLE AS x, (line * 20)::DOUBLE AS y, (max((n % 10) * 5) + 5 - min((n % 10) * 5))::DOUBLE AS w, 10::DOUBLE AS h FROM g WHERE n % 10 <> 9 AND n % 21 <> 10 GROUP BY node, line HAVING trim(string_agg(ch, '')) <> ''""")
def glyph_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every user's events as glyphs in lines of ten, of which the last falls out of the column; some blanks are too narrow to count, all are laid out twice."""
    n = F.col("n")
    e = Ranged(B.table(spark, d, "events").select(F.col("user_id").alias("node"), "event_id"), "node", "event_id").number("n")
    ch = F.when(n % 7 == 3, F.when(n % 2 == 0, "\t").otherwise(" ")).otherwise(F.char((F.lit(97) + F.col("event_id") % 26).cast("int")))
    narrow = F.when((n % 21 == 10), 0.4).otherwise(5.0)
    box = lambda left: F.struct(left.alias("x"), (F.floor(n / 10) * 20).cast("double").alias("y"), narrow.alias("w"), F.lit(10.0).alias("h"))
    right = F.when(n % 10 == 9, F.lit(1000.0)).otherwise((n % 10 * 5).cast("double"))
    rects = e.select("node", n.alias("pos"), ch.alias("ch"), F.posexplode(F.array(F.struct(F.lit(2000.0).alias("x"), F.lit(0.0).alias("y"), F.lit(5.0).alias("w"), F.lit(10.0).alias("h")), box(right))).alias("rect_pos", "b")).select("node", "pos", "ch", "rect_pos", "b.*")
    return pages.build_runs(pages.glyph_boxes(rects, F.lit(0.0), F.lit(100.0))).select("node", "text", "x", "y", "w", "h")


_STATES = """p AS (SELECT user_id AS session, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'playing' WHEN 1 THEN 'ended' WHEN 2 THEN 'ready' ELSE 'seek' END AS kind, event_id % 10 = 0 AS play FROM events),
v AS (SELECT *, CASE kind WHEN 'playing' THEN play WHEN 'ended' THEN FALSE END AS a, CASE kind WHEN 'ready' THEN FALSE WHEN 'ended' THEN TRUE END AS b FROM p)"""


@query(_with(_STATES) + "SELECT session, seq, kind, coalesce(last_value(a IGNORE NULLS) OVER w, FALSE) AS is_playing, coalesce(last_value(b IGNORE NULLS) OVER w, FALSE) AS ended FROM v WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def player_states(spark: SparkSession, d: str) -> DataFrame:
    from lectern.streaming import playback

    n = F.col("event_id")
    kind = F.when(n % 5 == 0, "playing").when(n % 5 == 1, "ended").when(n % 5 == 2, "ready").otherwise("seek")
    return playback.player_states(B.table(spark, d, "events").select(F.col("user_id").alias("session"), n.alias("seq"), kind.alias("kind"), (n % 10 == 0).alias("play_when_ready")))


@query(_with(B.SPAN) + "SELECT p.book_id, p.page_index, t.span_id FROM (SELECT user_id AS book_id, max(event_id // 900)::INT AS page_index FROM events GROUP BY 1) p LEFT JOIN (SELECT book_id, arg_max(id, clip_begin_ms * 1000000 + ord) AS span_id FROM timed GROUP BY 1) t ON t.book_id = p.book_id")
def end_of_books(spark: SparkSession, d: str) -> DataFrame:
    from lectern.streaming import playback

    last = B.table(spark, d, "events").select(F.col("user_id").alias("book_id"), F.floor(F.col("event_id") / 900).cast("int").alias("page_index"))
    return playback.cursor_at_end(B.spans(spark, d), last)


@query("SELECT user_id AS session, arg_max(event_id % 77, event_id) AS page_index FROM events GROUP BY 1")
def latest_jumps(spark: SparkSession, d: str) -> DataFrame:
    from lectern.streaming import playback

    n = F.col("event_id")
    return playback.latest_jump(B.table(spark, d, "events").select(F.col("user_id").alias("session"), n.alias("ts"), (n % 77).alias("page_index"), F.lit(False).alias("preferred")))


# --- pages of lines ----------------------------------------------------------------------------------


_FRAGMENTS = """num AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS total, sum(h + sp) OVER w AS bottom, lead(opens) OVER w AS next_opens, lead(block_id) OVER w AS next_block,
  lead(inside) OVER w AS next_inside, coalesce(lag(doc_id) OVER w IS NULL, TRUE) OR opens AS keeps FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
kind AS (SELECT *, bottom - h - CASE WHEN keeps THEN sp ELSE 0 END AS top, CASE WHEN k + 1 = total THEN 9 WHEN next_opens THEN 0 WHEN next_block = block_id AND (i + 1 < 2 OR m - i - 1 < 2) THEN 3
  WHEN clings OR coalesce(inside = next_inside, FALSE) THEN 2 ELSE 1 END AS kind FROM num),
page AS (SELECT s.doc_id, s.k, CASE WHEN min(e.k) FILTER (e.kind = 0) IS NOT NULL THEN min(e.k) FILTER (e.kind = 0) WHEN bool_or(e.kind = 9) THEN any_value(s.total) - 1
  ELSE coalesce(max(e.k) FILTER (e.kind = 1), max(e.k) FILTER (e.kind = 2), max(e.k) FILTER (e.kind = 3), any_value(s.k)) END + 1 AS nxt
  FROM kind s JOIN kind e ON e.doc_id = s.doc_id AND e.k BETWEEN s.k AND s.k + 60 AND e.bottom <= s.top + 800 GROUP BY s.doc_id, s.k),
walk AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS page FROM page WHERE k = 0 UNION ALL SELECT w.doc_id, p.nxt, w.page + 1 FROM walk w JOIN page p ON p.doc_id = w.doc_id AND p.k = w.k WHERE p.nxt IN (SELECT q.k FROM kind q WHERE q.doc_id = w.doc_id)),
first AS (SELECT w.doc_id, w.k, w.page, n.top, lead(w.k) OVER (PARTITION BY w.doc_id ORDER BY w.k) AS until FROM walk w JOIN kind n ON n.doc_id = w.doc_id AND n.k = w.k)"""


@query("WITH RECURSIVE " + ",\n".join([B.LINE_BOX, _FRAGMENTS]) + """
SELECT l.doc_id AS chapter_id, l.ord, f.page AS page_in_chapter, l.k - f.k AS line_on_page, round(l.bottom - l.h - f.top, 4) AS page_y
FROM kind l JOIN first f ON f.doc_id = l.doc_id AND l.k >= f.k AND (f.until IS NULL OR l.k < f.until)""")
def line_fragments(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every document on pages of 800 pixels."""
    return fragments.paginate(B.line_boxes(spark, d), 800.0).select("chapter_id", "ord", "page_in_chapter", "line_on_page", F.round("page_y", 4).alias("page_y"))


def queries() -> dict[str, Query]:
    from lectern import library
    from lectern.streaming import playback_queries

    return _QUERIES | playback_queries.QUERIES | library.QUERIES


def oracle_sql() -> dict[str, str]:
    from lectern import library
    from lectern.streaming import playback_queries

    return _SQL | playback_queries.SQL | library.SQL
