"""Packaged books as typed tables, from a table of archive entries (archive, path, content)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import css, paths
from lectern.shared import release_memory
from lectern.sources import markup as M

_ITEM = "struct<ord:int,id:string,href:string,media_type:string,media_overlay:string,properties:array<string>>"
_PACKAGE = f"title string, identifier string, toc string, manifest array<{_ITEM}>, spine array<struct<ord:int,idref:string,linear:boolean>>"


def _text(entries: DataFrame) -> DataFrame:
    """entries with text: UTF-8, without a byte order mark in front."""
    return entries.withColumn("text", F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", ""))


def packages(entries: DataFrame) -> DataFrame:
    """(archive, opf_path, title, identifier, toc, manifest, spine), a row per archive; an archive without a package raises an error."""
    return _packages(entries, 0)


def package_parts(entries: DataFrame, some: int = 20_000) -> DataFrame:
    """packages() with manifests and spines in parts of `some` items at most, so that no row grows with its book; the last row of an archive has its title, identifier and toc, the others nulls.

    All that reads packages() here reads these, too.
    """
    return _packages(entries, some)


def _packages(entries: DataFrame, some: int) -> DataFrame:
    """some: items of a row, 0 for all."""

    @F.pandas_udf("string")
    def root(texts: pd.Series) -> pd.Series:
        return texts.map(M.rootfile)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"manifest": M.MANIFEST, "spine": M.SPINE}

        def told(at: list[pa.Array], said: list, lists: dict[str, list[pa.Array]]) -> pa.RecordBatch:
            made = [pa.ListArray.from_arrays(pa.array([0, sum(map(len, lists[c]))], pa.int32()), pa.concat_arrays(lists[c] or [pa.array([], kinds[c])])) for c in kinds]
            return pa.RecordBatch.from_arrays([*at, *(pa.array([x], pa.string()) for x in said), *made], ["archive", "opf_path", "title", "identifier", "toc", "manifest", "spine"])

        for batch in batches:
            for row in range(batch.num_rows):  # a document can be as large as a batch
                at, said = [batch.column(c).slice(row, 1) for c in ("archive", "opf_path")], []
                lists: dict[str, list[pa.Array]] = {c: [] for c in kinds}
                for name, value in M.package_parts(batch.column("text")[row].as_buffer(), some or 20_000):
                    if name not in kinds:
                        said.append(value)
                    elif some:
                        yield told(at, [None] * 3, {c: [value] if c == name else [] for c in kinds})
                    else:
                        lists[name].append(value)
                yield told(at, said, lists)
                del lists
                release_memory()

    at = _text(entries.where(F.lower("path") == "meta-inf/container.xml")).select("archive", root("text").alias("opf_path"))
    opf = at.join(entries.select("archive", F.col("path").alias("opf_path"), "content"), ["archive", "opf_path"], "left")
    text = F.when(F.col("content").isNull(), F.raise_error(F.lit("package document not found"))).otherwise(F.decode("content", "UTF-8"))
    kind = opf.schema["archive"].dataType.simpleString()
    return opf.select("archive", "opf_path", text.alias("text")).mapInArrow(parsed, f"archive {kind}, opf_path string, {_PACKAGE}")


def manifest(books: DataFrame) -> DataFrame:
    """(archive, ord, id, href, media_type, media_overlay, properties), hrefs as package paths; of a repeated id the last item, at the first's place."""
    rows = books.select("archive", "opf_path", F.explode("manifest").alias("m")).select("archive", "opf_path", "m.*")
    one = rows.groupBy("archive", "opf_path", "id").agg(F.max_by(F.struct("href", "media_type", "media_overlay", "properties"), "ord").alias("i"), F.min("ord").alias("ord"))
    return one.select("archive", "ord", "id", paths.resolve(F.col("opf_path"), F.col("i.href")).alias("href"), "i.media_type", "i.media_overlay", "i.properties")


def spine(books: DataFrame) -> DataFrame:
    return books.select("archive", F.explode("spine").alias("s")).select("archive", "s.*")


def chapters(books: DataFrame) -> DataFrame:
    """(archive, ord, chapter_id, xhtml_path, smil_path): linear spine items that are XHTML or HTML, with their overlays."""
    m = manifest(books)
    item = m.where(F.col("media_type").isin("application/xhtml+xml", "text/html")).select("archive", F.col("id").alias("idref"), F.col("href").alias("xhtml_path"), "media_overlay")
    over = m.select("archive", F.col("id").alias("media_overlay"), F.col("href").alias("smil_path"))
    return spine(books).where("linear").join(item, ["archive", "idref"]).join(over, ["archive", "media_overlay"], "left").select("archive", "ord", F.col("idref").alias("chapter_id"), "xhtml_path", "smil_path")


def audio_files(books: DataFrame) -> DataFrame:
    return manifest(books).where(F.col("media_type").startswith("audio/")).select("archive", "ord", "href", "media_type")


def navigation_paths(books: DataFrame) -> DataFrame:
    """(archive, nav_path, ncx_path): the first item of property nav; the spine's toc if it is an NCX, else the first NCX."""
    m = manifest(books).join(books.groupBy("archive").agg(F.max("toc").alias("toc")), "archive")
    ncx = F.col("media_type") == "application/x-dtbncx+xml"
    return m.groupBy("archive").agg(
        F.min_by("href", F.when(F.array_contains("properties", "nav"), F.col("ord"))).alias("nav_path"),
        F.coalesce(F.min_by("href", F.when(ncx & (F.col("id") == F.col("toc")), F.col("ord"))), F.min_by("href", F.when(ncx, F.col("ord")))).alias("ncx_path"),
    )


def _rows(parse: Callable, *columns: str, of: str):
    @F.pandas_udf(of)
    def each(*series: pd.Series) -> pd.Series:
        return pd.Series([parse(*(s.iloc[i] for s in series)) for i in range(len(series[0]))])

    return each(*columns)


_SPAN = "array<struct<id:string,text_ref:string,audio_src:string,clip_begin_ms:double,clip_end_ms:double>>"


def overlay_spans(entries: DataFrame, told: DataFrame) -> DataFrame:
    """(archive, chapter_ord, ord, id, chapter_id, text_ref, audio_src, clip_begin_ms, clip_end_ms) of all chapters' overlays."""
    keys = ("id", "text_ref", "audio_src", "clip_begin_ms", "clip_end_ms")
    parse = lambda text, chapter, path: [dict(zip(keys, r, strict=True)) for r in M.overlay(text, chapter, path)]
    found = told.where("smil_path is not null").join(_text(entries).select("archive", F.col("path").alias("smil_path"), "text"), ["archive", "smil_path"])
    rows = found.select("archive", F.col("ord").alias("chapter_ord"), "chapter_id", _rows(parse, "text", "chapter_id", "smil_path", of=_SPAN).alias("spans"))
    return rows.select("archive", "chapter_ord", "chapter_id", F.posexplode("spans").alias("ord", "s")).select("archive", "chapter_ord", "ord", "chapter_id", "s.*")


def without_overlays(books: DataFrame, told: DataFrame) -> DataFrame:
    """(archive, reason) of books none of whose chapters has an overlay."""
    some = told.where("smil_path is not null").select("archive").distinct()
    return books.select("archive").distinct().join(some, "archive", "left_anti").select("archive", F.lit("no chapter with an overlay").alias("reason"))


def require_overlays(told: DataFrame) -> DataFrame:
    """chapters() that have overlays; a book of which none has any raises an error."""
    bare = without_overlays(told, told).orderBy("archive").head(1)
    if bare:
        raise ValueError(f"{bare[0]['reason']}: {bare[0]['archive']}")
    return told.where("smil_path is not null")


def chapter_texts(entries: DataFrame, told: DataFrame) -> DataFrame:
    return told.join(_text(entries).select("archive", F.col("path").alias("xhtml_path"), F.col("text").alias("html")), ["archive", "xhtml_path"])


def fragments(texts: DataFrame) -> DataFrame:
    """(archive, chapter_id, fragment): the ids of all elements."""
    return texts.select("archive", "chapter_id", F.explode(_rows(M.element_ids, "html", of="array<string>")).alias("fragment"))


def chapter_sentences(texts: DataFrame) -> DataFrame:
    return texts.withColumn("sentences", _rows(M.sentences_of_html, "html", of="array<string>"))


def publisher_styles(texts: DataFrame) -> DataFrame:
    """(archive, chapter_id, ord, kind, value) of the head's style sheets."""
    parse = lambda text: [{"kind": k, "value": v} for k, v in M.publisher_styles(text)]
    rows = texts.select("archive", "chapter_id", F.posexplode(_rows(parse, "html", of="array<struct<kind:string,value:string>>")).alias("ord", "s"))
    return rows.select("archive", "chapter_id", "ord", "s.*")


def tagged_chapters(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(archive, chapter_id, xhtml_path, html, span_ids): safe markup with data-span-id on the spans' elements; of spans of one element the last."""
    part = paths.reference_fragment(F.col("text_ref"))
    own = spans.join(texts.select("archive", "chapter_id", "xhtml_path"), ["archive", "chapter_id"]).where(paths.is_for_chapter(F.col("text_ref"), F.col("xhtml_path")))
    ids = own.withColumn("fragment", part).where("fragment is not null").groupBy("archive", "chapter_id", "fragment").agg(F.max_by("id", "ord").alias("id"))
    held = ids.groupBy("archive", "chapter_id").agg(F.collect_list(F.struct("fragment", "id")).alias("ids"))
    tag = lambda text, ids: M.tag_elements(text, {x["fragment"]: x["id"] for x in ([] if ids is None else ids)})
    found = texts.join(held, ["archive", "chapter_id"], "left")
    return found.select("archive", "chapter_id", "xhtml_path", _rows(tag, "html", "ids", of="string").alias("html"), F.coalesce(F.transform("ids", lambda x: x["id"]), F.array().cast("array<string>")).alias("span_ids"))


def sentence_tagged(heard: DataFrame, ranges: DataFrame) -> DataFrame:
    """(book_id, chapter_id, xhtml_path, html) with every sentence that was heard wrapped in a span; others are left alone.

    heard(book_id, chapter_id, xhtml_path, html, sentences), ranges(book_id, chapter_id, id, start_s, end_s), -1 unknown.
    """
    known = ranges.where("start_s >= 0 and end_s >= 0").groupBy("book_id", "chapter_id").agg(F.collect_set("id").alias("wanted"))
    listed = lambda v: [] if v is None else list(v)
    tag = lambda text, chapter, sentences, wanted: M.tag_sentences(text, chapter, listed(sentences), set(listed(wanted)))
    found = heard.join(known, ["book_id", "chapter_id"], "left")
    return found.select("book_id", "chapter_id", "xhtml_path", _rows(tag, "html", "chapter_id", "sentences", "wanted", of="string").alias("html"))


def package_signs(entries: DataFrame, books: DataFrame) -> DataFrame:
    """(archive, file_path, opf, properties, hrefs) of every package document: what tells a fixed layout."""
    items = manifest(books).groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("ord", "href", "properties"))).alias("items"))
    text = _text(entries).select("archive", F.col("path").alias("opf_path"), F.col("text").alias("opf"))
    found = books.select("archive", "opf_path").distinct().join(text, ["archive", "opf_path"]).join(items, "archive", "left")
    none = F.array().cast("array<struct<ord:int,href:string,properties:array<string>>>")
    found = found.withColumn("items", F.coalesce("items", none))
    return found.select("archive", F.col("opf_path").alias("file_path"), F.regexp_replace("opf", "^\ufeff", "").alias("opf"), F.transform("items", lambda i: i["properties"]).alias("properties"), F.transform("items", lambda i: i["href"]).alias("hrefs"))


def break_hints(texts: DataFrame, sheets: DataFrame) -> DataFrame:
    """(archive, chapter_id, css, missing): the rules of every chapter that say where to break, of its style elements first, then of the sheets that it links; missing: links to no sheet.

    A chapter without rules has an empty css. sheets(archive, file_path, css).
    """
    inline = texts.select("archive", "chapter_id", F.lit(-1).alias("source"), F.posexplode(css.style_blocks(F.col("html"))).alias("at", "css"))
    links = texts.select("archive", "chapter_id", "xhtml_path", F.posexplode(css.stylesheet_hrefs(F.col("html"))).alias("source", "href"))
    links = links.withColumn("file_path", paths.stylesheet_path(F.col("xhtml_path"), F.col("href"))).join(sheets.select("archive", "file_path", "css"), ["archive", "file_path"], "left")
    linked = links.where("css is not null").select("archive", "chapter_id", "source", F.lit(0).alias("at"), "css")
    rules = inline.union(linked).select("archive", "chapter_id", "source", "at", css.break_rules_of(F.col("css")).alias("rules"))
    flat = F.array_distinct(F.flatten(F.sort_array(F.collect_list(F.struct("source", "at", "rules")))["rules"]))
    joined = rules.groupBy("archive", "chapter_id").agg(F.array_join(flat, "\n").alias("css"))
    lost = links.where("css is null and file_path is not null").groupBy("archive", "chapter_id").agg(F.sort_array(F.collect_list(F.struct("source", "href")))["href"].alias("missing"))
    every = texts.select("archive", "chapter_id").join(joined, ["archive", "chapter_id"], "left").join(lost, ["archive", "chapter_id"], "left")
    return every.select("archive", "chapter_id", F.coalesce("css", F.lit("")).alias("css"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def navigation(entries: DataFrame, books: DataFrame) -> DataFrame:
    """(archive, node_id, parent_id, sibling_ord, title, path): the nav document's tree, else the NCX's."""
    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n = 0
                for parse, name in ((M.navigation_rows, "nav"), (M.ncx_rows, "ncx")):
                    if n or not batch.column(name)[row].is_valid:
                        continue
                    rows = parse(batch.column(name)[row].as_buffer(), batch.column(f"{name}_path")[row].as_py())
                    while found := list(islice(rows, 20_000)):
                        n += len(found)
                        some = M.columns_of(found, M.NAVIGATION)
                        yield pa.RecordBatch.from_arrays([batch.column("archive").take(pa.array([row] * len(found))), *some], ["archive", *(f.name for f in M.NAVIGATION)])
                release_memory()

    at = navigation_paths(books)
    text = _text(entries).select("archive", "path", "text")
    nav = at.join(text.select("archive", F.col("path").alias("nav_path"), F.col("text").alias("nav")), ["archive", "nav_path"], "left")
    both = nav.join(text.select("archive", F.col("path").alias("ncx_path"), F.col("text").alias("ncx")), ["archive", "ncx_path"], "left")
    kind = both.schema["archive"].dataType.simpleString()
    return both.select("archive", "nav", "nav_path", "ncx", "ncx_path").mapInArrow(parsed, f"archive {kind}, node_id int, parent_id int, sibling_ord int, title string, path string")
