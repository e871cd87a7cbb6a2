"""Whole jobs over libraries of packaged books: compile, align, inspect, look up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import paths
from lectern.operators import align, anchors, inspect, lookups, spans, toc, validate
from lectern.operators.ordering import Ranged
from lectern.shared import materialise
from lectern.sources import archives, books, bundle


#: What is read of an archive as text; audio and images stay where they are.
TEXTS = (".xml", ".opf", ".xhtml", ".html", ".htm", ".ncx", ".smil", ".css")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """The text entries of all archives at path, unpacked once."""
    return materialise(archives.entries(spark, path, TEXTS), "books-entries")


def compile_books(spark: SparkSession, path: str, rects: DataFrame | None = None, runs: DataFrame | None = None, tracks: DataFrame | None = None, strict: bool = False) -> dict[str, DataFrame]:
    """Tables of all books in the archives at path. A layout engine's rects(archive, chapter_id, page_index, span_id, span_pos, x, y, w, h) and runs(archive, span_id), and a probe's tracks(archive, href, duration_ms), are inputs.

    Every table is keyed by archive: ids hold in one book. strict: a book without overlays, and issues of overlay targets, raise an error before
    anything else is made; without rects and runs, issues of the references alone. Otherwise both are tables, `failures` and `issues`, and the other books are compiled.
    """
    entries = _texts(spark, path)
    packs = materialise(books.packages(entries), "books-packages")
    told = materialise(books.chapters(packs), "books-chapters")
    texts = books.chapter_texts(entries, told)
    own = books.overlay_spans(entries, told)
    numbered = Ranged(own, "archive", "chapter_ord", "ord").number("__ord")
    own = materialise(numbered.withColumn("ord", F.col("__ord").cast("int")).drop("__ord"), "books-spans")
    failures = books.without_overlays(packs, told)
    issues = validate.target_issues(own, told, books.fragments(texts), rects, runs, by=("archive",))
    if strict:
        books.require_overlays(packs.select("archive").join(told.select("archive", "smil_path"), "archive", "left"))
        validate.require_none(issues, "overlay targets")
    out = {"packages": packs, "chapters": told, "spans": own, "texts": books.tagged_chapters(texts, own), "issues": validate.format_issue(issues), "failures": failures, "styles": books.publisher_styles(texts)}
    documents = texts.select("archive", F.col("xhtml_path").alias("file_path"), "chapter_id", "html")
    sheets = entries.where(F.lower("path").endswith(".css")).select("archive", F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("css"))
    out["feature_warnings"] = validate.warning_order(validate.feature_warnings(documents, sheets, books.package_signs(entries, packs), by=("archive",)), ("archive",))
    out["break_css"] = books.break_hints(texts, sheets)
    out["audio_order"] = spans.audio_order(own, books.audio_files(packs).select("archive", "ord", "href"), "archive")
    out["bundle_ids"] = packs.select("archive", "title", paths.bundle_id(F.col("identifier"), F.col("title"), F.transform("spine", lambda s: s["idref"])).alias("bundle_id"))
    if tracks is not None:
        placed = out["audio_order"].join(tracks, ["archive", "href"]).withColumnRenamed("position", "ord")
        out["audio_offsets"] = spans.audio_offsets(placed, "archive")
        out["spans"] = spans.apply_audio_offsets(own, out["audio_offsets"].withColumnRenamed("href", "audio_src"), ("archive", "audio_src"))
    if rects is not None:
        first = rects.groupBy("archive", "chapter_id").agg(F.min("page_index").alias("page_index"))
        nav = toc.chapter_of_targets(books.navigation(entries, packs), told, by=("archive",)).join(first, ["archive", "chapter_id"], "left")
        flat = toc.flatten(nav.withColumnRenamed("archive", "book_id"))
        out["toc"] = toc.with_fallback(flat, told.join(first, ["archive", "chapter_id"], "left").withColumnRenamed("archive", "book_id"))
    return out


def align_books(spark: SparkSession, path: str, words: DataFrame, transcripts: DataFrame, tracks: DataFrame) -> dict[str, DataFrame]:
    """The books in the archives at path, heard in their transcripts: spans of all sentences (unheard ones are -1) and texts in which the heard ones are marked."""
    entries = _texts(spark, path)
    told = books.chapters(books.packages(entries))
    heard = materialise(books.chapter_sentences(books.chapter_texts(entries, told)).withColumnRenamed("archive", "book_id"), "align-sentences")
    found = materialise(anchors.align_pieces(heard.select("book_id", "ord", "chapter_id", "sentences"), words, transcripts, tracks), "align-ranges")
    keyed = found.withColumn("chapter_id", F.struct("book_id", "chapter_id"))
    whole = align.widen_empty(align.fill_gaps(keyed))
    flat = materialise(whole.select("chapter_id.book_id", F.col("chapter_id.chapter_id").alias("chapter_id"), "id", "start_s", "end_s", "audiofile"), "align-whole")
    at = flat.join(heard.select("book_id", "chapter_id", "xhtml_path", F.col("ord").alias("chapter_ord")), ["book_id", "chapter_id"])
    out = align.ranges_to_spans(at, F.col("xhtml_path"), "book_id", "chapter_ord")
    return {"spans": out, "texts": books.sentence_tagged(heard, flat)}


def inspect_bundle(spark: SparkSession, path: str) -> DataFrame:
    """inspect.report of a written bundle."""
    b = bundle.read(spark, path)
    s = b["spans"].select(F.lit(0).alias("book_id"), "ord", "id", F.col("clipBeginMs").alias("clip_begin_ms"), F.col("clipEndMs").alias("clip_end_ms"))
    r = b["pages"].select(F.col("pageIndex").alias("page_index"), F.explode("spanRects").alias("s")).select("page_index", F.col("s.spanId").alias("span_id"))
    return inspect.report(s, r, b["pages"].select(F.col("pageIndex").alias("page_index")))


def active_spans(spark: SparkSession, path: str, times: DataFrame) -> DataFrame:
    """times(t) with the span of a written bundle that is active then, the first in the file where several are."""
    b = bundle.read(spark, path)
    s = b["spans"].select(F.lit(0).alias("book_id"), "ord", "id", F.col("clipBeginMs").alias("b"), F.col("clipEndMs").alias("e"), F.col("pageIndex").alias("page_index"))
    return lookups.interval_first(times.withColumn("book_id", F.lit(0)), s, "book_id", "t", "b", "e", "ord", ["id", "page_index"]).drop("book_id")
