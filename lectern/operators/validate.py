"""Checks of overlays, bundles, features and resources, as issue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import css, markup, paths
from lectern.predicates import timed

# The order in which issue codes are reported.
TARGET_CODES = ("smil_textref_missing_fragment", "smil_textref_path_mismatch", "smil_textref_fragment_not_found", "smil_textref_unknown_chapter", "timed_span_without_geometry_text")


def target_issues(spans: DataFrame, chapters: DataFrame, fragments: DataFrame, rects: DataFrame | None = None, runs: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ord, id, chapter_id, text_ref, code) of the spans whose reference leads nowhere or that are timed but shown nowhere.

    chapters(by, chapter_id, xhtml_path), fragments(by, chapter_id, fragment); rects and runs have by and span_id; without both nothing is
    known of what is shown. by: columns that name a book; chapter and span ids hold in one book. A span has at
    most one issue of its reference: unknown chapter, no fragment, other path, fragment not found, in that order.
    """
    parts = spans.withColumns({"__path": paths.reference_path(F.col("text_ref")), "__fragment": paths.reference_fragment(F.col("text_ref"))})
    known = parts.join(chapters.select(*by, "chapter_id", "xhtml_path").dropDuplicates([*by, "chapter_id"]), [*by, "chapter_id"], "left")
    ids = fragments.select(*by, "chapter_id", F.col("fragment").alias("__fragment")).distinct().withColumn("__there", F.lit(True))
    found = known.join(ids, [*by, "chapter_id", "__fragment"], "left")
    reference = (
        F.when(F.col("xhtml_path").isNull(), F.lit("smil_textref_unknown_chapter"))
        .when(F.col("__fragment").isNull(), F.lit("smil_textref_missing_fragment"))
        .when(~F.col("__path").eqNullSafe(F.col("xhtml_path")), F.lit("smil_textref_path_mismatch"))
        .when(F.col("__there").isNull(), F.lit("smil_textref_fragment_not_found"))
    )
    laid = [df.select(*by, F.col("span_id").alias("id")) for df in (rects, runs) if df is not None]
    geometry = F.lit(None).cast("string")
    if laid:
        shown = (laid[0].union(laid[1]) if len(laid) > 1 else laid[0]).where("id is not null").distinct().withColumn("__shown", F.lit(True))
        found = found.join(shown, [*by, "id"], "left")
        geometry = F.when(timed() & F.col("__shown").isNull(), F.lit("timed_span_without_geometry_text"))
    return found.select(*by, "ord", "id", "chapter_id", "text_ref", F.explode(F.array_compact(F.array(reference, geometry))).alias("code"))


def issue_counts(issues: DataFrame, codes: tuple[str, ...] = TARGET_CODES) -> DataFrame:
    """(position, code, count) of the codes that occur, in the fixed order."""
    order = F.array_position(F.array(*[F.lit(c) for c in codes]), F.col("code")).cast("int")
    return issues.groupBy("code").agg(F.count("*").alias("count")).withColumn("position", order)


def format_issue(issues: DataFrame) -> DataFrame:
    return issues.withColumn("message", F.format_string("[%s] chapter=%s span=%s textRef=%s", "code", "chapter_id", F.col("id").cast("string"), "text_ref"))


def _issue(severity: str, code: str, entity: Column, on: Column) -> Column:
    return F.when(on, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), entity.cast("string").alias("entity")))


def bundle_issues(spans: DataFrame, pages: DataFrame, rects: DataFrame, runs: DataFrame, width: float, height: float) -> DataFrame:
    """(severity, code, entity, count): what is wrong with a bundle of spans(id, page_index), pages(page_index), rects and runs with boxes x, y, w, h.

    Rows of one message are counted. Repeated span ids count once for each repetition.
    """
    def of(df: DataFrame, *checks: Column) -> DataFrame:
        return df.select(F.explode(F.array_compact(F.array(*checks))).alias("i")).select("i.*")

    x, y, w, h, span = F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("span_id")
    boxes = of(
        rects, _issue("warning", "rect_width", span, w <= 0), _issue("warning", "rect_height", span, h <= 0), _issue("warning", "rect_negative_x", span, x < 0), _issue("warning", "rect_negative_y", span, y < 0),
        _issue("warning", "rect_beyond_width", span, x + w > width), _issue("warning", "rect_beyond_height", span, y + h > height),
    )
    page = F.col("page_index")
    texts = of(runs, _issue("warning", "run_size", page, (w <= 0) | (h <= 0)), _issue("warning", "run_negative_position", page, (x < 0) | (y < 0)), _issue("warning", "run_beyond_height", page, y + h > height))
    row = lambda severity, code, entity: (F.lit(severity).alias("severity"), F.lit(code).alias("code"), entity.cast("string").alias("entity"))
    bare = pages.join(runs.select("page_index"), "page_index", "left_anti").select(*row("warning", "page_without_runs", page))
    every = boxes.union(texts).union(bare).groupBy("severity", "code", "entity").agg(F.count("*").alias("count"))
    twice = spans.groupBy("id").agg((F.count("*") - 1).alias("count")).where("count > 0").select(*row("error", "duplicate_span_id", F.col("id")), "count")
    none = F.lit(None)
    lost = spans.agg(F.count_if(F.coalesce(F.col("page_index"), F.lit(-1)) < 0).alias("count")).where("count > 0").select(*row("warning", "spans_without_page", none), "count")
    empty = lambda df, code: df.agg(F.count("*").alias("n")).where("n = 0").select(*row("error", code, none), F.lit(1).cast("long").alias("count"))
    return every.union(twice).union(lost).union(empty(spans, "no_spans")).union(empty(pages, "no_pages")).union(empty(runs, "no_runs"))


def feature_warnings(documents: DataFrame, sheets: DataFrame | None = None, packages: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, code, label, level, file_path, chapter_id, detail): what books hold that pages can't show.

    documents(by, file_path, chapter_id, html) with their markup, style elements and style attributes; sheets(by, file_path, css),
    each for every document whose head links it; packages(by, file_path, opf, properties, hrefs). by: columns that name a book.
    Details of one code, file and chapter are joined by '; ' as they are met, one that is part of what is there already left out.
    """
    found = lambda label, features: F.transform(features, lambda f: F.struct(f["code"].alias("code"), F.concat(label, f["detail"]).alias("detail")))
    inline = lambda label, sources: F.flatten(F.transform(sources, lambda s: found(F.lit(label), markup.css_features(s))))
    html = F.col("html")
    own = F.concat(found(F.lit(""), markup.markup_features(html)), inline("inline <style> block ", css.style_blocks(html)), inline("inline style attribute ", css.style_attributes(html)))
    keys = [*by, "file_path", "chapter_id"]
    every = documents.select(*keys, F.lit(0).alias("source"), F.posexplode(own).alias("at", "f"))
    if sheets is not None:
        links = documents.select(*by, "chapter_id", "file_path", F.posexplode(css.stylesheet_hrefs(html)).alias("source", "href"))
        links = links.select(*by, "chapter_id", (F.col("source") + 1).alias("source"), "href", paths.stylesheet_path(F.col("file_path"), F.col("href")).alias("file_path"))
        label = F.concat(F.lit('linked stylesheet "'), F.col("href"), F.lit('" '))
        linked = links.join(sheets.select(*by, "file_path", "css"), [*by, "file_path"])
        every = every.union(linked.select(*keys, "source", F.posexplode(found(label, markup.css_features(F.col("css")))).alias("at", "f")))
    if packages is not None:
        signs = packages.select(*by, "file_path", F.lit(None).cast("string").alias("chapter_id"), F.lit(0).alias("source"), F.posexplode(markup.package_features(F.col("opf"), F.col("properties"), F.col("hrefs"))).alias("at", "f"))
        every = every.union(signs)
    first = every.select(*keys, "source", "at", "f.*").groupBy(*keys, "code", "detail").agg(F.min(F.struct("source", "at")).alias("place"))
    details = first.groupBy(*keys, "code").agg(F.sort_array(F.collect_list(F.struct("place", "detail")))["detail"].alias("details"))
    joined = F.aggregate("details", F.lit(""), lambda a, d: F.when(F.contains(a, d), a).when(a == "", d).otherwise(F.concat(a, F.lit("; "), d)))
    label = F.create_map(*[F.lit(x) for code, text, _ in markup.FEATURES for x in (code, text)])
    level = F.create_map(*[F.lit(x) for code, _, text in markup.FEATURES for x in (code, text)])
    return details.select(*by, "code", F.element_at(label, F.col("code")).alias("label"), F.element_at(level, F.col("code")).alias("level"), "file_path", "chapter_id", joined.alias("detail"))


def warning_order(warnings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """feature_warnings() with `position`, from 0 in each book: unsupported ones first, then by label, chapter and file. A book's warnings are few."""
    order = Window.partitionBy(*by).orderBy(F.when(F.col("level") == "unsupported", 0).otherwise(1), "label", F.coalesce("chapter_id", F.lit("")), "file_path")
    return warnings.withColumn("position", F.row_number().over(order) - 1)


def feature_summary(warnings: DataFrame) -> DataFrame:
    """Per code the warnings and the chapters (else files) concerned; position: unsupported first, then by label."""
    counted = warnings.groupBy("code", "label", "level").agg(F.count("*").alias("warnings"), F.countDistinct(F.coalesce("chapter_id", "file_path")).alias("chapters"))
    order = Window.orderBy(F.when(F.col("level") == "unsupported", 0).otherwise(1), "label")  # of eight codes at most
    return counted.withColumn("position", F.row_number().over(order))


def resource_outcomes(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """requests(url, resource_type) with kind, path, outcome and severity against the package's entries(path).

    'ok', 'inline'; 'missing' is fatal for style sheets and fonts and else a warning; 'blocked' alike.
    """
    asked = requests.withColumn("__c", paths.classify_url(F.col("url"))).select(*requests.columns, F.col("__c.kind").alias("kind"), F.col("__c.path").alias("path"), F.col("__c.reason").alias("reason"))
    there = entries.select("path").distinct().withColumn("__there", F.lit(True))
    found = asked.join(there, "path", "left")
    outcome = F.when(F.col("kind") == "inline-resource", "inline").when(F.col("kind") == "blocked", "blocked").when(F.col("__there"), "ok").otherwise("missing")
    critical = paths.is_critical(F.coalesce("path", "url"), F.col("resource_type"))
    severity = F.when(F.col("outcome").isin("missing", "blocked"), F.when(critical, "fatal").otherwise("warning"))
    return found.withColumn("outcome", outcome).withColumn("severity", severity).drop("__there")


def unique_issues(issues: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each distinct message once, at its first place."""
    return issues.groupBy(*key).agg(F.min(order).alias(order))


def require_none(issues: DataFrame, what: str) -> None:
    """Strict mode: raises if there is an issue, naming the first few by code and count."""
    counts = {r["code"]: r["count"] for r in issues.groupBy("code").count().collect()}  # as many rows as codes
    if counts:
        raise ValueError(f"{what}: {sum(counts.values())} issues ({', '.join(f'{n} {c}' for c, n in sorted(counts.items()))})")
