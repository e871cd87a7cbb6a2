"""The driver's tables as a library of packaged books, and the queries that read them back.

A nation is an archive, its customers are chapters, and their orders the paragraphs, spans and overlay entries. The archives'
entries are written as text here; what the parsers make of them must be what the tables say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.bindings import table
from lectern.operators import align, toc, validate
from lectern.shared import materialise
from lectern.sources import books

_CONTAINER = '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def _text(template: str, **columns: Column) -> Column:
    """The template with each {name} replaced by a column's text."""
    out, rest = [], template
    while rest:
        at = min((rest.find("{%s}" % c) for c in columns if "{%s}" % c in rest), default=-1)
        if at < 0:
            return F.concat(*out, F.lit(rest))
        name = next(c for c in columns if rest.startswith("{%s}" % c, at))
        out += [F.lit(rest[:at]), columns[name].cast("string")]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*out)


def _joined(order: str, text: Column, on: Column | None = None) -> Column:
    row = F.struct(F.col(order).alias("o"), text.alias("t"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(row if on is None else F.when(on, row))), lambda x: x["t"]), "")


def entries(spark: SparkSession, d: str) -> DataFrame:
    """(archive, path, content) of all books."""
    o, k, c = F.col("o_orderkey"), F.col("c_custkey"), table(spark, d, "customer")
    end = o + 1500
    clock = F.format_string("%d:%02d:%02d.%03d", F.floor(end / 3600000), F.floor(end / 60000) % 60, F.floor(end / 1000) % 60, end % 1000)
    until = F.when(o % 3 == 1, clock).when(o % 3 == 2, F.format_string("%d.%03ds", F.floor(end / 1000), end % 1000)).otherwise(F.concat(end.cast("string"), F.lit("ms")))
    sound = F.when(o % 5 == 0, "").otherwise(_text('<audio src="../audio/b.mp3" clipBegin="{o}ms" clipEnd="{until}"/>', o=o, until=until))
    part = F.when(o % 13 == 0, "").when(o % 11 == 0, F.concat(F.lit("#nowhere"), o.cast("string"))).otherwise(F.concat(F.lit("#f"), o.cast("string")))
    par = _text('<par id="s{o}"><text src="../text/c{k}.xhtml{part}"/>{sound}</par>', o=o, k=F.col("o_custkey"), part=part, sound=sound)
    paragraph = _text('<p id="f{o}" onclick="x()" style="behavior: url(x); color: red">Order {o} is of state {s}. It costs <b>{p}</b> cents!</p>', o=o, s=F.col("o_orderstatus"), p=F.floor("o_totalprice"))
    told = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(_joined("o_orderkey", par, o % 4 != 0).alias("top"), _joined("o_orderkey", par, o % 4 == 0).alias("nested"), _joined("o_orderkey", paragraph).alias("body"))
    told = materialise(c.join(told, "c_custkey", "left").fillna("", ["top", "nested", "body"]), "library-chapters")
    archive = F.concat(F.lit("book-"), F.col("c_nationkey").cast("string"))
    file = lambda path, text: F.struct(path.alias("path"), text.cast("binary").alias("content"))
    html = _text('<html><head><title>t</title><script>no()</script></head><body onload="x()"><h1 id="h">{n}</h1>{body}<!-- end --></body></html>', n=F.col("c_name"), body=F.col("body"))
    smil = _text('<smil xmlns="http://www.w3.org/ns/SMIL"><body><seq>{nested}</seq>{top}</body></smil>', nested=F.col("nested"), top=F.col("top"))
    chapters = told.select(archive.alias("archive"), F.explode(F.array(file(_text("OPS/text/c{k}.xhtml", k=k), html), file(_text("OPS/smil/c{k}.smil", k=k), smil))).alias("f"))
    overlay = F.when(k % 3 == 0, "").otherwise(_text(' media-overlay="m{k}"', k=k))
    item = _text('<item id="c{k}" href="text/c{k}.xhtml" media-type="application/xhtml+xml"{overlay}/><item id="m{k}" href="smil/../smil/c{k}.smil" media-type="application/smil+xml"/>', k=k, overlay=overlay)
    ref = _text('<itemref idref="c{k}"{linear}/>', k=k, linear=F.when(k % 7 == 0, ' linear="no"').otherwise(""))
    packed = c.groupBy("c_nationkey").agg(_joined("c_custkey", item).alias("items"), _joined("c_custkey", ref).alias("refs")).join(table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    opf = _text(
        '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{n}</dc:title><dc:identifier> urn {i} </dc:identifier></metadata>'
        '<manifest><item id="a" href="audio/b.mp3" media-type="audio/mpeg"/><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{refs}</spine></package>',
        n=F.col("n_name"), i=F.col("c_nationkey"), items=F.col("items"), refs=F.col("refs"),
    )
    leaf = _text('<li><a href="text/c{k}.xhtml#h"> {n} </a></li>', k=k, n=F.col("c_name"))
    segments = c.groupBy("c_nationkey", "c_mktsegment").agg(_joined("c_custkey", leaf).alias("leaves"), F.min("c_custkey").alias("first"))
    node = F.when(F.col("c_mktsegment") == "BUILDING", _text("<li><span>none</span><ol>{l}</ol></li>", l=F.col("leaves"))).otherwise(_text('<li><a href="text/c{f}.xhtml">{s}</a><ol>{l}</ol></li>', f=F.col("first"), s=F.col("c_mktsegment"), l=F.col("leaves")))
    nav = segments.groupBy("c_nationkey").agg(_joined("c_mktsegment", node).alias("nodes"))
    nav = nav.select(archive.alias("archive"), file(F.lit("OPS/nav.xhtml"), _text('<html><body><nav epub:type="landmarks"><ol><li><a href="x.xhtml">no</a></li></ol></nav><nav epub:type="toc"><h2>Contents</h2><ol>{n}</ol></nav></body></html>', n=F.col("nodes"))).alias("f"))
    heads = packed.select(archive.alias("archive"), F.explode(F.array(file(F.lit("META-INF/container.xml"), F.lit(_CONTAINER)), file(F.lit("OPS/p.opf"), opf))).alias("f"))
    return materialise(chapters.union(nav).union(heads).select("archive", "f.*"), "library-entries")


_BOOK = "'book-' || c_nationkey AS archive"
_CHAPTERS = f"""ch AS (SELECT {_BOOK}, c_custkey AS k, c_name, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS ord, 'c' || c_custkey AS chapter_id, 'OPS/text/c' || c_custkey || '.xhtml' AS xhtml_path,
  CASE WHEN c_custkey % 3 <> 0 THEN 'OPS/smil/c' || c_custkey || '.smil' END AS smil_path FROM customer)"""
_SPANS = f"""{_CHAPTERS}, sp AS (SELECT archive, ord AS chapter_ord, (row_number() OVER (PARTITION BY k ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END, o_orderkey) - 1)::INT AS ord, 's' || o_orderkey AS id, chapter_id,
  xhtml_path || CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN '#nowhere' || o_orderkey ELSE '#f' || o_orderkey END AS text_ref, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'OPS/audio/b.mp3' END AS audio_src,
  CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_orderkey END::DOUBLE AS clip_begin_ms, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_orderkey + 1500 END::DOUBLE AS clip_end_ms, o_orderkey, xhtml_path
  FROM ch JOIN orders ON o_custkey = k WHERE k % 7 <> 0 AND k % 3 <> 0)"""
_BODY = "string_agg(p, '' ORDER BY o_orderkey)"


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = entries(spark, d)
    packs = materialise(books.package_parts(e), "library-packages")
    return e, packs, books.chapters(packs)


def book_packages(spark: SparkSession, d: str) -> DataFrame:
    """What every package document says of its book."""
    packs = books.packages(entries(spark, d))
    return packs.select("archive", "opf_path", "title", "identifier", F.size("manifest").alias("items"), F.size("spine").alias("refs"))


def book_manifest(spark: SparkSession, d: str) -> DataFrame:
    return books.manifest(books.package_parts(entries(spark, d))).select("archive", "id", "href", "media_type", "media_overlay", F.array_join("properties", " ").alias("properties"))


def book_chapters(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d)[2]


def book_audio(spark: SparkSession, d: str) -> DataFrame:
    return books.audio_files(books.package_parts(entries(spark, d))).select("archive", "href", "media_type")


def book_overlays(spark: SparkSession, d: str) -> DataFrame:
    e, _, told = _parts(spark, d)
    return books.overlay_spans(e, told)


def book_navigation(spark: SparkSession, d: str) -> DataFrame:
    e, packs, _ = _parts(spark, d)
    return books.navigation(e, packs)


def book_toc(spark: SparkSession, d: str) -> DataFrame:
    """The navigation trees flattened, with the place of each target's chapter as its page."""
    e, packs, told = _parts(spark, d)
    pages = told.select("archive", F.col("xhtml_path").alias("path"), "chapter_id", F.col("ord").alias("page_index"))
    nav = books.navigation(e, packs).join(pages, ["archive", "path"], "left").withColumnRenamed("archive", "book_id")
    return toc.flatten(nav).select(F.col("book_id").alias("archive"), "position", "title", "page_index", "level")


def book_fragments(spark: SparkSession, d: str) -> DataFrame:
    e, _, told = _parts(spark, d)
    return books.fragments(books.chapter_texts(e, told))


def book_sentences(spark: SparkSession, d: str) -> DataFrame:
    e, _, told = _parts(spark, d)
    return books.chapter_sentences(books.chapter_texts(e, told)).select("archive", "chapter_id", F.posexplode("sentences").alias("n", "sentence"))


def book_tagged(spark: SparkSession, d: str) -> DataFrame:
    """Safe markup of all chapters, with the spans' ids on their elements."""
    e, _, told = _parts(spark, d)
    made = books.tagged_chapters(books.chapter_texts(e, told), books.overlay_spans(e, told))
    return made.select("archive", "chapter_id", "xhtml_path", "html", F.array_join(F.sort_array("span_ids"), " ").alias("span_ids"))


def book_sentence_tags(spark: SparkSession, d: str) -> DataFrame:
    """Safe markup of all chapters with every second sentence, as if it were heard, in a span."""
    e, _, told = _parts(spark, d)
    heard = materialise(books.chapter_sentences(books.chapter_texts(e, told)).withColumnRenamed("archive", "book_id"), "library-heard")  # read twice
    ranges = heard.select("book_id", "chapter_id", F.posexplode("sentences").alias("id", "s")).select("book_id", "chapter_id", "id", F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0).alias("start_s"), F.lit(2.0).alias("end_s"))
    return books.sentence_tagged(heard, ranges).select(F.col("book_id").alias("archive"), "chapter_id", "html")


def book_target_issues(spark: SparkSession, d: str) -> DataFrame:
    """Overlay references that lead nowhere, over all books."""
    e, _, told = _parts(spark, d)
    return validate.target_issues(books.overlay_spans(e, told), told, books.fragments(books.chapter_texts(e, told)), by=("archive",)).select("archive", "id", "chapter_id", "text_ref", "code")


def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each word of every turn is, looked for one behind the other."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    found = align.locate_tokens(c.withColumn("tokens", F.filter(F.split("text", " "), lambda x: x != "")))
    return found.select("conv_id", "turn", F.posexplode(F.arrays_zip("tokens", "offsets")).alias("n", "t")).select("conv_id", "turn", "n", F.col("t.tokens").alias("token"), F.col("t.offsets").alias("place"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (book_packages, book_manifest, book_chapters, book_audio, book_overlays, book_navigation, book_toc, book_fragments, book_sentences, book_tagged, book_sentence_tags, book_target_issues, token_offsets)
}
_NAV = f"""c AS (SELECT *, {_BOOK} FROM customer), seg AS (SELECT archive, c_mktsegment, min(c_custkey) AS first FROM c GROUP BY 1, 2),
nodes AS (SELECT archive, c_mktsegment, 0 AS part, 0 AS k, c_mktsegment AS title, 'OPS/text/c' || first || '.xhtml' AS path FROM seg WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT archive, c_mktsegment, 1, c_custkey, c_name, 'OPS/text/c' || c_custkey || '.xhtml' FROM c),
n AS (SELECT *, (row_number() OVER (PARTITION BY archive ORDER BY c_mktsegment, part, k) - 1)::INT AS node_id FROM nodes),
m AS (SELECT n.*, p.node_id AS parent_id FROM n LEFT JOIN n p ON n.part = 1 AND p.part = 0 AND n.archive = p.archive AND n.c_mktsegment = p.c_mktsegment)"""
SQL = {
    "book_packages": f"SELECT {_BOOK}, 'OPS/p.opf' AS opf_path, n_name AS title, 'urn ' || c_nationkey AS identifier, (2 * count(*) + 2)::INT AS items, count(*)::INT AS refs FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_nationkey, n_name",
    "book_manifest": f"""SELECT {_BOOK}, 'c' || c_custkey AS id, 'OPS/text/c' || c_custkey || '.xhtml' AS href, 'application/xhtml+xml' AS media_type, CASE WHEN c_custkey % 3 <> 0 THEN 'm' || c_custkey END AS media_overlay, '' AS properties FROM customer
UNION ALL SELECT {_BOOK}, 'm' || c_custkey, 'OPS/smil/c' || c_custkey || '.smil', 'application/smil+xml', NULL, '' FROM customer
UNION ALL SELECT DISTINCT {_BOOK}, i, h, t, NULL, p FROM customer, (VALUES ('a', 'OPS/audio/b.mp3', 'audio/mpeg', ''), ('nav', 'OPS/nav.xhtml', 'application/xhtml+xml', 'nav')) AS v(i, h, t, p)""",
    "book_chapters": f"WITH {_CHAPTERS} SELECT archive, ord, chapter_id, xhtml_path, smil_path FROM ch WHERE k % 7 <> 0",
    "book_audio": f"SELECT DISTINCT {_BOOK}, 'OPS/audio/b.mp3' AS href, 'audio/mpeg' AS media_type FROM customer",
    "book_overlays": f"WITH {_SPANS} SELECT archive, chapter_ord, ord, id, chapter_id, text_ref, audio_src, clip_begin_ms, clip_end_ms FROM sp",
    "book_navigation": f"WITH {_NAV} SELECT archive, node_id, parent_id, (row_number() OVER (PARTITION BY archive, parent_id ORDER BY node_id) - 1)::INT AS sibling_ord, title, path FROM m",
    "book_toc": f"""WITH {_NAV}, {_CHAPTERS}, t AS (SELECT m.archive, node_id, title, ch.ord AS page_index, CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END AS level FROM m LEFT JOIN ch ON ch.archive = m.archive AND ch.xhtml_path = m.path AND ch.k % 7 <> 0)
SELECT archive, (row_number() OVER (PARTITION BY archive ORDER BY node_id) - 1) AS position, title, page_index, level FROM t WHERE page_index IS NOT NULL""",
    "book_fragments": f"WITH {_CHAPTERS} SELECT archive, chapter_id, 'h' AS fragment FROM ch WHERE k % 7 <> 0 UNION ALL SELECT archive, chapter_id, 'f' || o_orderkey FROM ch JOIN orders ON o_custkey = k WHERE k % 7 <> 0",
    "book_sentences": f"""WITH {_CHAPTERS}, r AS (SELECT archive, chapter_id, row_number() OVER (PARTITION BY k ORDER BY o_orderkey) AS r, orders.* FROM ch JOIN orders ON o_custkey = k WHERE k % 7 <> 0)
SELECT archive, chapter_id, 0 AS n, c_name AS sentence FROM ch WHERE k % 7 <> 0 UNION ALL SELECT archive, chapter_id, (2 * r - 1)::INT, 'Order ' || o_orderkey || ' is of state ' || o_orderstatus || '.' FROM r
UNION ALL SELECT archive, chapter_id, (2 * r)::INT, 'It costs ' || floor(o_totalprice)::BIGINT || ' cents!' FROM r""",
    "book_tagged": f"""WITH {_SPANS}, p AS (SELECT ch.*, o_orderkey, sp.id AS span, '<p id="f' || o.o_orderkey || '" style=" color: red"' || CASE WHEN sp.id IS NULL OR o.o_orderkey % 11 = 0 THEN '' ELSE ' data-span-id="' || sp.id || '"' END
  || '>Order ' || o.o_orderkey || ' is of state ' || o_orderstatus || '. It costs <b>' || floor(o_totalprice)::BIGINT || '</b> cents!</p>' AS p
  FROM ch LEFT JOIN orders o ON o_custkey = k LEFT JOIN (SELECT id, o_orderkey AS okey FROM sp WHERE o_orderkey % 13 <> 0) sp ON okey = o.o_orderkey WHERE k % 7 <> 0)
SELECT archive, chapter_id, xhtml_path, '<body><h1 id="h">' || any_value(c_name) || '</h1>' || coalesce({_BODY}, '') || '</body>' AS html, coalesce(string_agg(span, ' ' ORDER BY span), '') AS span_ids FROM p GROUP BY 1, 2, 3""",
    "book_sentence_tags": f"""WITH {_CHAPTERS}, r AS (SELECT ch.*, o.*, row_number() OVER (PARTITION BY k ORDER BY o_orderkey) AS r FROM ch LEFT JOIN orders o ON o_custkey = k WHERE k % 7 <> 0),
p AS (SELECT *, '<p id="f' || o_orderkey || '" style=" color: red">Order ' || o_orderkey || ' is of state ' || o_orderstatus || '. <span data-span-id="' || chapter_id || '-sentence' || 2 * r || '">It costs </span><b>' || floor(o_totalprice)::BIGINT || '</b> cents!</p>' AS p FROM r)
SELECT archive, chapter_id, '<body><h1 id="h"><span data-span-id="' || chapter_id || '-sentence0">' || any_value(c_name) || '</span></h1>' || coalesce({_BODY}, '') || '</body>' AS html FROM p GROUP BY 1, 2""",
    "book_target_issues": f"""WITH {_SPANS} SELECT archive, id, chapter_id, text_ref, CASE WHEN o_orderkey % 13 = 0 THEN 'smil_textref_missing_fragment' ELSE 'smil_textref_fragment_not_found' END AS code FROM sp WHERE o_orderkey % 13 = 0 OR o_orderkey % 11 = 0""",
    "token_offsets": """WITH w AS (SELECT conv_id, turn, unnest(range(1, len(p) + 1)) AS i, p FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS p FROM conversations)),
a AS (SELECT conv_id, turn, i, p[i] AS token, sum(length(p[i]) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) - length(p[i]) - 1 AS place FROM w)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1)::INT AS n, token, place::INT AS place FROM a WHERE token <> ''""",
}
