"""Pages, text runs and styles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ordering import global_index, in_turn
from lectern.predicates import in_column

#: What JavaScript calls white space.
_SPACE = re.compile("[\\t\\n\\v\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")


def renumber_pages(pages: DataFrame, chapter: str = "chapter_id", order: str = "page_in_chapter") -> DataFrame:
    """Pages with text, numbered from 0 in their chapter, with an id `<chapter>_p0000`."""
    n = F.row_number().over(Window.partitionBy(chapter).orderBy(order)) - 1
    kept = pages.where("runs > 0").withColumn("page_in_chapter", n)
    return kept.withColumn("page_id", F.format_string("%s_p%04d", F.col(chapter).cast("string"), "page_in_chapter"))


def number_pages(pages: DataFrame, *order: str) -> DataFrame:
    """The page's number in the whole book or library, in reading order."""
    return global_index(pages, *order, name="page_index")


def first_page_of_chapters(pages: DataFrame) -> DataFrame:
    return pages.groupBy("chapter_id").agg(F.min("page_index").alias("page_index"))


def style_dictionary(runs: DataFrame, style: list[str], *order: str) -> DataFrame:
    """Distinct styles with style_id in order of first use."""
    first = runs.groupBy(*style).agg(F.min(F.struct(*order)).alias("first"))
    return global_index(first, "first", name="style_id").drop("first")


def encode_styles(runs: DataFrame, styles: DataFrame, style: list[str]) -> DataFrame:
    return runs.join(styles, style).drop(*style)


def decode_styles(runs: DataFrame, styles: DataFrame, style: list[str]) -> DataFrame:
    """runs(style_id) with the style's columns; an unknown style_id raises an error."""
    known = styles.select("style_id", *style, F.lit(True).alias("__known"))
    found = runs.join(known, "style_id", "left")
    checked = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("unknown style id: "), F.col("style_id").cast("string"))).cast(found.schema["style_id"].dataType)).otherwise(F.col("style_id"))
    return found.withColumn("style_id", checked).drop("__known")


def dedupe_runs(runs: DataFrame, key: list[str], position: str = "run_pos") -> DataFrame:
    """Runs that agree in all key columns once, at their first position."""
    return runs.groupBy(*key).agg(F.min(position).alias(position))


def merge_runs(glyphs: DataFrame, page: str = "page_index") -> DataFrame:
    """Glyphs (page, pos, ch, x, y, w, h) on one line merged into runs: a new run starts where top or bottom moves by more than a pixel."""
    along = Window.partitionBy(page).orderBy("pos")
    top, bottom = F.col("y"), F.col("y") + F.col("h")
    moved = (F.abs(top - F.lag(top).over(along)) > 1) | (F.abs(bottom - F.lag(bottom).over(along)) > 1)
    run = F.sum(F.coalesce(moved, F.lit(True)).cast("int")).over(along)
    cells = glyphs.withColumn("run", run)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ch"))), lambda g: g["ch"]), "")
    box = (F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))
    return cells.groupBy(page, "run").agg(text.alias("text"), *box)


def column_count(scroll_width: Column, width: Column, gap: Column) -> Column:
    """In how many columns a text lies that was laid out to so many pixels."""
    return F.ceil(scroll_width / (width + gap))


def column_of(left: Column, margin: Column, width: Column, gap: Column) -> Column:
    """The 0-based column of a box; one that begins up to four pixels before a column belongs to it."""
    return F.floor((left - margin + 4) / (width + gap))


def visible(rects: DataFrame, column_left: Column, column_right: Column) -> DataFrame:
    """rects(x, y, w, h) that have a size and lie in the column."""
    return rects.where((F.col("w") != 0) & (F.col("h") != 0) & in_column(F.col("x"), column_left, column_right))


def glyph_boxes(glyphs: DataFrame, column_left: Column, column_right: Column) -> DataFrame:
    """glyphs(node, pos, ch, rect_pos, x, y, w, h), one row for each rectangle, as one row a glyph: its first rectangle that has a
    height and lies in the column, or nulls."""
    fits = (F.col("h") != 0) & in_column(F.col("x"), column_left, column_right)
    box = F.min_by(F.struct("x", "y", "w", "h"), F.when(fits, F.col("rect_pos")))
    return glyphs.groupBy("node", "pos", "ch").agg(box.alias("b")).select("node", "pos", "ch", "b.*")


def build_runs(glyphs: DataFrame) -> DataFrame:
    """(node, run, text, x, y, w, h): glyph_boxes() of text nodes as runs of one line each.

    A run ends at a glyph without a box, and where top or bottom is more than a pixel off the run's box so far. White space is
    a blank; one no wider than half a pixel is passed over, and so is one that lies, to a pixel, where the blank before it does.
    Runs without a size, and runs of nothing but blanks, are dropped.
    """

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        node, pos, ch, x, y, w, h = row
        run, box, last = state or (0, None, None)
        if x is None:
            return (run + 1, None, None), None
        own, blank = (x, y, x + w, y + h), bool(_SPACE.match(ch))
        near = lambda a, b: all(abs(p - q) <= 1 for p, q in zip(a, b, strict=True))
        if blank and (w <= 0.5 or (last is not None and near(own, last))):
            return (run, box, last), None
        if box is None or not near((own[1], own[3]), (box[1], box[3])):
            run, box = run + 1, own
        else:
            box = (min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3]))
        return (run, box, own if blank else None), (node, pos, " " if blank else ch, run, *own)

    rows = glyphs.select("node", "pos", "ch", *[F.col(c).cast("double") for c in ("x", "y", "w", "h")])
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("node", "pos")]
    kept = in_turn(rows, "node", "pos", step, ", ".join([*kinds, "ch string, run long, l double, t double, r double, b double"]))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ch"))), lambda g: g["ch"]), "")
    made = kept.groupBy("node", "run").agg(text.alias("text"), F.min("l").alias("x"), F.min("t").alias("y"), (F.max("r") - F.min("l")).alias("w"), (F.max("b") - F.min("t")).alias("h"))
    return made.where("w > 0 and h > 0 and trim(text) <> ''")


def page_coordinates(x: Column, y: Column, w: Column, h: Column, left: Column, top: Column) -> dict[str, Column]:
    """Page-local box: x not below 0, y as it falls, sizes not below 0."""
    zero = F.lit(0.0)
    return {"page_x": F.greatest(zero, x - left), "page_y": y - top, "page_w": F.greatest(zero, w), "page_h": F.greatest(zero, h)}


def baseline(y: Column, h: Column, descender: Column | None, size: Column) -> Column:
    d = F.coalesce(descender, F.greatest(F.lit(1.0), size * 0.2)) if descender is not None else F.greatest(F.lit(1.0), size * 0.2)
    return y + h - F.least(d, h)


def clamp_page(i: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(n - 1, i))
