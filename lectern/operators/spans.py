"""Spans and audio: order, offsets, ids, splitting over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.player import audio_format
from lectern.operators.ordering import Ranged
from lectern.predicates import timed


def audio_order(spans: DataFrame, manifest: DataFrame, book: str = "book_id") -> DataFrame:
    """Audio files by first timed use, then those of the manifest that no timed span uses, in manifest order; 0-based per book.

    spans(book, ord, audio_src, ...), manifest(book, ord, href).
    """
    used = spans.where(timed()).join(manifest.select(book, F.col("href").alias("audio_src")).distinct(), [book, "audio_src"], "left_semi")
    first = used.groupBy(book, F.col("audio_src").alias("href")).agg(F.min("ord").alias("ord")).withColumn("part", F.lit(0))
    rest = manifest.groupBy(book, "href").agg(F.min("ord").alias("ord")).join(first.select(book, "href"), [book, "href"], "left_anti").withColumn("part", F.lit(1))
    n = F.row_number().over(Window.partitionBy(book).orderBy("part", "ord")) - 1
    return first.unionByName(rest).select(book, "href", n.alias("position"))


def audio_offsets(tracks: DataFrame, book: str = "book_id") -> DataFrame:
    """tracks(book, ord, href, duration_ms) with start_ms, end_ms and the book's total_ms: an exclusive running sum in order."""
    found = Ranged(tracks, book, "ord").sum_before(F.col("duration_ms"), "start_ms", "total_ms")
    return found.select(*tracks.columns, "start_ms", (F.col("start_ms") + F.col("duration_ms")).alias("end_ms"), "total_ms")


def concat_plan(offsets: DataFrame, format: str, book: str = "book_id") -> DataFrame:
    """(book, list, arguments, output): per book the encoder's list of files in order, and its arguments. The encoder runs elsewhere.

    offsets: audio_offsets(); a quote in a file's name is written as the list format asks for.
    """
    known = audio_format(F.lit(format))
    name = F.replace("href", F.lit("'"), F.lit("'\\''"))
    listed = offsets.groupBy(book).agg(F.sort_array(F.collect_list(F.struct("ord", F.concat(F.lit("file '"), name, F.lit("'")).alias("line"))))["line"].alias("lines"))
    fixed = F.array(*[F.lit(x) for x in ("-y", "-f", "concat", "-safe", "0", "-i", "list.txt")])
    return listed.select(book, F.array_join("lines", "\n").alias("list"), F.concat(fixed, known["encoder"], F.array(known["file_name"])).alias("arguments"), known["file_name"].alias("output"))


def apply_audio_offsets(spans: DataFrame, offsets: DataFrame, keys: tuple[str, ...] = ("audio_src",)) -> DataFrame:
    """Spans moved by their file's start; spans with a negative bound, or of an unknown file, stay as they are."""
    start = offsets.select(*keys, "start_ms")
    move = F.when((F.col("clip_begin_ms") >= 0) & (F.col("clip_end_ms") >= 0), F.coalesce("start_ms", F.lit(0.0))).otherwise(F.lit(0.0))
    moved = spans.join(start, list(keys), "left").withColumn("__by", move)
    return moved.withColumns({"clip_begin_ms": F.col("clip_begin_ms") + F.col("__by"), "clip_end_ms": F.col("clip_end_ms") + F.col("__by")}).drop("__by", "start_ms")


def compact_ids(spans: DataFrame, book: str = "book_id") -> DataFrame:
    """spans with new_id: 's' and the row's 0-based number in the book, base 36. A repeated id in a book raises an error."""
    twice = spans.groupBy(book, "id").count().where("count > 1").head(1)
    if twice:
        raise ValueError(f"duplicate span id: {twice[0]['id']}")
    name = F.concat(F.lit("s"), F.lower(F.conv(F.col("__n").cast("string"), 10, 36)))
    return Ranged(spans, book, "ord").number("__n").select(*spans.columns, name.alias("new_id"))


def remap_ids(rows: DataFrame, ids: DataFrame, keys: tuple[str, ...] = ("span_id",)) -> DataFrame:
    """rows with span_id replaced by new_id of ids(*keys, new_id) where there is one."""
    return rows.join(ids.select(*keys, "new_id"), list(keys), "left").withColumn("span_id", F.coalesce("new_id", "span_id")).drop("new_id")


def page_metrics(rects: DataFrame, runs: DataFrame) -> DataFrame:
    """(span_id, page_index) with the text's length in code units and the rectangles' area, 0 where one is missing."""
    chars = runs.where("span_id is not null").groupBy("span_id", "page_index").agg(F.sum("chars").alias("chars"))
    area = rects.groupBy("span_id", "page_index").agg(F.sum(F.col("w") * F.col("h")).alias("area"))
    both = chars.join(area, ["span_id", "page_index"], "full")
    return both.select("span_id", "page_index", F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("area", F.lit(0.0)).alias("area"))


def split_over_pages(spans: DataFrame, metrics: DataFrame) -> DataFrame:
    """Parts of the timed spans that are on several pages: (id, page_index, new_id, clip_begin_ms, clip_end_ms).

    A part's share of the time is its share of the characters, else of the area (at least 1 for each
    page), else the same for all; bounds run on, and the last ends where the span does. A new id that a span has already gets a number.
    """
    per = Window.partitionBy("id")
    live = spans.where(timed()).select("id", "clip_begin_ms", "clip_end_ms").join(metrics.withColumnRenamed("span_id", "id"), "id")
    many = live.withColumn("n", F.count("*").over(per)).where("n > 1")
    weight = (
        F.when(F.sum("chars").over(per) > 0, F.greatest(F.col("chars").cast("double"), F.lit(1.0)))
        .when(F.sum("area").over(per) > 0, F.greatest("area", F.lit(1.0)))
        .otherwise(F.lit(1.0))
    )
    w = many.withColumn("weight", weight)
    along = per.orderBy("page_index")
    upto, total = F.sum("weight").over(along.rowsBetween(Window.unboundedPreceding, 0)), F.sum("weight").over(per)
    length = F.col("clip_end_ms") - F.col("clip_begin_ms")
    cut = F.when(F.row_number().over(along) == F.col("n"), F.col("clip_end_ms")).otherwise(F.col("clip_begin_ms") + length * upto / total)
    parts = w.withColumn("cut", cut)
    parts = parts.withColumn("begin", F.coalesce(F.lag("cut").over(along), F.col("clip_begin_ms")))
    named = parts.withColumn("name", F.concat(F.col("id").cast("string"), F.lit("__p"), F.col("page_index").cast("string")))
    # names that spans have: name itself, or name_1, name_2 ...; the least free number is taken
    held = spans.select(F.col("id").cast("string").alias("h")).where(F.col("h").rlike("__p-?[0-9]+(_[0-9]+)?$"))
    held = held.select(F.regexp_extract("h", r"^(.*__p-?[0-9]+)(?:_[0-9]+)?$", 1).alias("name"), F.coalesce(F.expr("try_cast(nullif(regexp_extract(h, '__p-?[0-9]+_([0-9]+)$', 1), '') as int)"), F.lit(0)).alias("k"))
    held = held.groupBy("name").agg(F.collect_set("k").alias("ks"))
    free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("ks")), F.col("ks")))
    out = named.join(held, "name", "left").withColumn("k", F.coalesce(free, F.lit(0)))
    return out.select("id", "page_index", F.when(F.col("k") > 0, F.concat("name", F.lit("_"), F.col("k").cast("string"))).otherwise(F.col("name")).alias("new_id"), F.col("begin").alias("clip_begin_ms"), F.col("cut").alias("clip_end_ms"))
