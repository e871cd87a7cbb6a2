"""The driver's star-schema tables seen as books: spans, pages, rectangles, runs, words. One SQL text serves Spark's views and the oracle.

Each view is a pair: a DataFrame, and the same as a common table expression in ANSI SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _micros(events: DataFrame):
    """Microseconds since the epoch, whatever the session's zone."""
    kind = events.schema["ts"].dataType.typeName()
    return F.expr("unix_micros(ts)") if kind == "timestamp" else F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)")


def spans(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    begin = F.floor(_micros(e) / F.lit(1000.0)).cast("double") - F.lit(1704067200000.0)
    gone = F.col("event_id") % 11 == 0
    ref = F.when(F.col("event_id") % 17 == 0, F.lit("")).otherwise(F.concat(F.lit("#f"), (F.col("event_id") % 60).cast("string")))
    path = F.when(F.col("event_id") % 13 == 0, F.lit("OPS/other.xhtml")).otherwise(F.concat(F.lit("OPS/"), F.col("event_type"), F.lit(".xhtml")))
    return e.select(
        F.col("user_id").alias("book_id"), F.col("event_id").alias("ord"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("chapter_id"),
        F.concat(path, ref).alias("text_ref"), F.concat(F.lit("a"), (F.col("event_id") % 7).cast("string")).alias("audio_src"),
        F.when(gone, -1.0).otherwise(begin).alias("clip_begin_ms"), F.when(gone, -1.0).otherwise(begin + F.floor(F.col("value") * 300000).cast("double")).alias("clip_end_ms"),
    )


SPAN = """span AS (SELECT user_id AS book_id, event_id AS ord, 'e' || event_id AS id, event_type AS chapter_id,
  CASE WHEN event_id % 13 = 0 THEN 'OPS/other.xhtml' ELSE 'OPS/' || event_type || '.xhtml' END || CASE WHEN event_id % 17 = 0 THEN '' ELSE '#f' || (event_id % 60) END AS text_ref,
  'a' || (event_id % 7) AS audio_src, CASE WHEN event_id % 11 = 0 THEN -1.0::DOUBLE ELSE b END AS clip_begin_ms,
  CASE WHEN event_id % 11 = 0 THEN -1.0::DOUBLE ELSE b + floor(value * 300000) END AS clip_end_ms
  FROM (SELECT *, floor(epoch_us(ts) / 1000.0::DOUBLE)::DOUBLE - 1704067200000.0::DOUBLE AS b FROM events)),
timed AS (SELECT * FROM span WHERE clip_begin_ms >= 0 AND clip_end_ms > clip_begin_ms)"""


def rects(spark: SparkSession, d: str) -> DataFrame:
    """A rectangle for each span and page of lineitem; positions by span."""
    one = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("span_id"), F.floor(F.col("l_partkey") / 20).cast("int").alias("page_index")).agg(
        F.min("l_discount").alias("dis"), F.min("l_tax").alias("tax"), F.min("l_quantity").alias("qty"), F.min("l_extendedprice").alias("price")
    )
    return one.select("span_id", "page_index", F.col("span_id").alias("span_pos"), (F.col("dis") * 10000).alias("x"), (F.col("tax") * 20000).alias("y"), (F.col("qty") * 10 - 10).alias("w"), F.floor(F.col("price") / 1000).cast("double").alias("h"))


RECT = """rect AS (SELECT span_id, page_index, span_id AS span_pos, dis * 10000 AS x, tax * 20000 AS y, qty * 10 - 10 AS w, floor(price / 1000)::DOUBLE AS h FROM (
  SELECT l_orderkey * 8 + l_linenumber AS span_id, floor(l_partkey / 20)::INT AS page_index, min(l_discount) AS dis, min(l_tax) AS tax, min(l_quantity) AS qty, min(l_extendedprice) AS price
  FROM lineitem GROUP BY 1, 2))"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """A text run for most rectangles; some have no span, some spans no text."""
    r = rects(spark, d).where("span_id % 9 <> 0")
    return r.select("page_index", F.col("span_id").alias("run_pos"), F.when(F.col("span_id") % 10 == 0, F.lit(None)).otherwise(F.col("span_id")).alias("span_id"), ((F.col("w") + 10) / 10).cast("long").alias("chars"), "x", "y", "w", "h")


RUN = """run AS (SELECT page_index, span_id AS run_pos, CASE WHEN span_id % 10 = 0 THEN NULL ELSE span_id END AS span_id, ((w + 10) / 10)::BIGINT AS chars, x, y, w, h FROM rect WHERE span_id % 9 <> 0)"""


def order_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans that the rectangles show, and some that none does; every seventh untimed."""
    shown = rects(spark, d).select("span_id").distinct()
    lost = shown.where("span_id % 50 = 0").select((F.col("span_id") + 1000000000).alias("span_id"))
    begin = (F.col("span_id") % 100000) * 10.0
    gone = F.col("span_id") % 7 == 0
    return shown.union(lost).select(
        F.col("span_id").alias("id"), F.col("span_id").alias("ord"), F.when(gone, -1.0).otherwise(begin).alias("clip_begin_ms"), F.when(gone, -1.0).otherwise(begin + 900).alias("clip_end_ms")
    )


ORDER_SPAN = """ospan AS (SELECT span_id AS id, span_id AS ord, CASE WHEN span_id % 7 = 0 THEN -1.0::DOUBLE ELSE (span_id % 100000) * 10.0::DOUBLE END AS clip_begin_ms,
  CASE WHEN span_id % 7 = 0 THEN -1.0::DOUBLE ELSE (span_id % 100000) * 10.0::DOUBLE + 900 END AS clip_end_ms FROM (
  SELECT DISTINCT span_id FROM rect UNION ALL SELECT DISTINCT span_id + 1000000000 FROM rect WHERE span_id % 50 = 0))"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page up to twenty behind the last that shows something."""
    top = rects(spark, d).agg(F.max("page_index").alias("top"))
    return top.select(F.explode(F.sequence(F.lit(0), F.col("top") + 20)).alias("page_index"))


PAGE = "page AS (SELECT unnest(range(0, (SELECT max(page_index) FROM rect) + 21))::INT AS page_index)"


def tracks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("book_id"), F.col("p_partkey").alias("ord"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("href"), (F.col("p_size") * 1000.0).alias("duration_ms"))


TRACK = "track AS (SELECT p_brand AS book_id, p_partkey AS ord, 't' || p_partkey AS href, p_size * 1000.0::DOUBLE AS duration_ms FROM part)"


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """Sentence ranges per user with missing numbers and some empty or overlapping ranges, in whole seconds."""
    e = table(spark, d, "events").where("event_id % 3 <> 0")
    n = F.col("event_id")
    start = (n % 977 + F.floor(n / 100) * 3).cast("double")
    return e.select(F.col("user_id").alias("chapter_id"), n.cast("long").alias("id"), start.alias("start_s"), (start + n % 4).alias("end_s"), F.concat(F.lit("a"), F.floor(n / 500).cast("string")).alias("audiofile"))


RANGE = """rng AS (SELECT user_id AS chapter_id, event_id AS id, (event_id % 977 + floor(event_id / 100) * 3)::DOUBLE AS start_s,
  (event_id % 977 + floor(event_id / 100) * 3 + event_id % 4)::DOUBLE AS end_s, 'a' || floor(event_id / 500)::BIGINT AS audiofile FROM events WHERE event_id % 3 <> 0)"""


def line_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The texts of documents as line boxes: each of their lines is a block of rows of 60 characters; short ones are headings, some begin a page, some are kept together."""
    blocks = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block_id", "t")).withColumn("n", F.length("t"))
    many = F.greatest(F.lit(1), F.ceil(F.col("n") / 60.0).cast("int"))
    boxes = blocks.select("doc_id", "block_id", "n", many.alias("m"), F.explode(F.sequence(F.lit(0), many - 1)).alias("i"))
    return boxes.select(
        F.col("doc_id").alias("chapter_id"), (F.col("block_id") * F.lit(1000000).cast("long") + F.col("i")).alias("ord"), "block_id", F.when(F.col("n") <= 40, 30.5).otherwise(20.25).alias("height"),
        F.when(F.col("i") == 0, 12.0).otherwise(0.0).alias("space"), F.when((F.col("n") % 41 == 7) & (F.col("i") == 0), "page").alias("break_before"),
        F.when((F.col("n") <= 40) & (F.col("i") == F.col("m") - 1), "avoid").alias("break_after"), F.when(F.col("n") % 5 == 0, F.col("block_id")).alias("inside"),
    )


LINE_BOX = """par AS (SELECT doc_id, unnest(range(0, len(l))) AS block_id, unnest(l) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
box AS (SELECT doc_id, block_id, length(t) AS n, greatest(1, ceil(length(t) / 60.0::DOUBLE)::BIGINT) AS m, unnest(range(0, greatest(1, ceil(length(t) / 60.0::DOUBLE)::BIGINT))) AS i FROM par),
line AS (SELECT doc_id, block_id, block_id * 1000000 + i AS ord, i, m, CASE WHEN n <= 40 THEN 30.5::DOUBLE ELSE 20.25::DOUBLE END AS h, CASE WHEN i = 0 THEN 12.0::DOUBLE ELSE 0.0::DOUBLE END AS sp,
  n % 41 = 7 AND i = 0 AS opens, n <= 40 AND i = m - 1 AS clings, CASE WHEN n % 5 = 0 THEN block_id END AS inside FROM box)"""
