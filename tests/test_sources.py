import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import validate
from lectern.plans import books as plans
from lectern.sources import archives, books, bundle, markup, transcripts

from .conftest import rows

CONTAINER = '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/><rootfile full-path="x"/></rootfiles></container>'
OPF = """<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>A Book</dc:title><dc:identifier> id 1 </dc:identifier></metadata>
<manifest><item id="c1" href="text/c1.xhtml" media-type="application/xhtml+xml" media-overlay="m1"/><item id="c2" href="text/c2.xhtml" media-type="application/xhtml+xml"/>
<item id="m1" href="text/c1.smil" media-type="application/smil+xml"/><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav x"/><item id="a" href="a.mp3" media-type="audio/mpeg"/>
<item id="b" href="b.mp3" media-type="audio/mpeg"/><item id="css" href="s.css" media-type="text/css"/><item id="bad" href="z"/><item id="c2" href="text/c2b.xhtml" media-type="application/xhtml+xml"/></manifest>
<spine toc="ncx"><itemref idref="c1"/><itemref idref="c2"/><itemref idref="nav" linear="no"/></spine></package>"""
SMIL = """<smil xmlns="http://www.w3.org/ns/SMIL"><body><seq><par id="p3"><text src="c1.xhtml#f3"/><audio src="../a.mp3" clipBegin="2s" clipEnd="3s"/></par></seq>
<par id="p1"><text src="c1.xhtml#f1"/><audio src="../a.mp3" clipBegin="0:00:00.000" clipEnd="1500ms"/></par><par><text src="c1.xhtml#f2"/></par><par><audio src="x"/></par></body></smil>"""
C1 = '<html><head><title>t</title><style>p { float: left }</style></head><body><p id="f1" onclick="x()">One. Two!</p><p id="f2"><b>Three</b> is here.<script>no()</script></p><p id="f3"><a href="java script:x">L</a></p></body></html>'
NAV = '<html><body><nav epub:type="landmarks"><ol><li><a href="x.xhtml">no</a></li></ol></nav><nav epub:type="toc"><div><ol><li><a href="text/c1.xhtml">Part <i>I</i></a><ol><li><a href="text/c2b.xhtml#x">Two</a></li></ol></li><li><span>none</span><ol><li><a href="text/c1.xhtml#f2">Up</a></li></ol></li></ol></div></nav></body></html>'


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    at = tmp_path_factory.mktemp("books") / "one.epub"
    with zipfile.ZipFile(at, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.mkdir("OPS")
        for name, text in {"META-INF/container.xml": CONTAINER, "OPS/p.opf": OPF, "OPS/text/c1.smil": SMIL, "OPS/text/c1.xhtml": C1, "OPS/text/c2b.xhtml": "<html><body><table><tr><td id='q'>x</td></tr></table></body></html>", "OPS/nav.xhtml": NAV, "OPS/s.css": "p { direction: rtl }"}.items():
            z.writestr(name, text)
    return str(at)


def test_entries(spark, book):
    assert archives.entries(spark, book).count() == 8 and archives.entries(spark, book, (".css",)).first().path == "OPS/s.css"
    spark.dataSource.register(archives.ZipArchives)
    assert spark.read.format("ziparchive").option("suffix", ".xhtml").load(book).count() == 3


def test_package(spark, book):
    e = archives.entries(spark, book)
    p = books.packages(e)
    assert p.select("opf_path", "title", "identifier", "toc").first() == ("OPS/p.opf", "A Book", "id 1", "ncx")
    assert [(r.id, r.href) for r in books.manifest(p).orderBy("ord").collect()][:2] == [("c1", "OPS/text/c1.xhtml"), ("c2", "OPS/text/c2b.xhtml")]
    told = books.chapters(p)
    assert [r[1:] for r in rows(told, "ord")] == [(0, "c1", "OPS/text/c1.xhtml", "OPS/text/c1.smil"), (1, "c2", "OPS/text/c2b.xhtml", None)]
    assert books.navigation_paths(p).first()[1:] == ("OPS/nav.xhtml", None)
    s = books.overlay_spans(e, told).orderBy("ord").collect()
    assert [(r.id, r.text_ref, r.audio_src, r.clip_begin_ms, r.clip_end_ms) for r in s] == [
        ("p1", "OPS/text/c1.xhtml#f1", "OPS/a.mp3", 0.0, 1500.0), ("span_c1_1", "OPS/text/c1.xhtml#f2", "", 0.0, 0.0), ("p3", "OPS/text/c1.xhtml#f3", "OPS/a.mp3", 2000.0, 3000.0),
    ]
    assert books.require_overlays(told).count() == 1
    with pytest.raises(ValueError, match="no chapter with an overlay"):
        books.require_overlays(told.where("smil_path is null"))
    texts = books.chapter_texts(e, told)
    html = {r.chapter_id: r.html for r in books.tagged_chapters(texts, books.overlay_spans(e, told)).collect()}["c1"]
    assert '<p id="f1" data-span-id="p1">' in html and "onclick" not in html and "script" not in html
    assert [r.fragment for r in books.fragments(texts).where("chapter_id = 'c1'").collect()] == ["f1", "f2", "f3"]
    assert books.chapter_sentences(texts).where("chapter_id = 'c1'").first().sentences[:3] == ["One.", "Two!", "Three is here."]
    assert [(r.title, r.path, r.parent_id) for r in books.navigation(e, p).orderBy("node_id").collect()] == [("Part I", "OPS/text/c1.xhtml", None), ("Two", "OPS/text/c2b.xhtml", 0), ("Up", "OPS/text/c1.xhtml", None)]


def test_compile(spark, book):
    rects = spark.createDataFrame([(f"file:{book}", "c1", 0, "p1"), (f"file:{book}", "c2", 3, "none")], "archive string, chapter_id string, page_index int, span_id string")
    tracks = spark.createDataFrame([(f"file:{book}", "OPS/b.mp3", 7000.0), (f"file:{book}", "OPS/a.mp3", 5000.0)], "archive string, href string, duration_ms double")
    out = plans.compile_books(spark, book, rects, None, tracks)
    assert [r.href for r in out["audio_order"].orderBy("position").collect()] == ["OPS/a.mp3", "OPS/b.mp3"]
    assert [r.start_ms for r in out["audio_offsets"].orderBy("ord").collect()] == [0.0, 5000.0]
    warned = [(r.code, r.chapter_id, r.file_path, r.detail) for r in out["feature_warnings"].orderBy("position").collect()]
    assert warned == [("positioned-layout", "c1", "OPS/text/c1.xhtml", "inline <style> block uses float CSS declarations"), ("table-layout", "c2", "OPS/text/c2b.xhtml", "contains table markup (<table>/<tr>/<td>/...)")]
    assert [(r.title, r.page_index, r.level) for r in out["toc"].orderBy("position").collect()] == [("Part I", 0, 0), ("Two", 3, 1), ("Up", 0, 0)]
    assert {(r.id, r.code) for r in out["issues"].collect()} == {("p3", "timed_span_without_geometry_text")}
    with pytest.raises(ValueError, match="1 issues .1 timed_span_without_geometry_text"):
        plans.compile_books(spark, book, rects, strict=True)
    assert validate.feature_summary(out["feature_warnings"]).count() == 2


def archive_of(at, files):
    with zipfile.ZipFile(at, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)


def test_a_library_of_books_with_equal_ids(spark, tmp_path):
    """Chapters and spans of one id in two books, whose files lie elsewhere; one of them has a reference to nowhere."""
    other = OPF.replace('full-path="OPS/p.opf"', "").replace("text/c1.xhtml", "body/one.xhtml").replace("text/c1.smil", "body/one.smil")
    smil = SMIL.replace("c1.xhtml", "one.xhtml")
    fixed = other.replace('properties="nav x"', 'properties="nav Rendition:layout-pre-paginated"').replace("<dc:title>", '<meta name="fixed-layout" content="yes"/><dc:title>')
    linked = C1.replace("<style>", '<link rel="stylesheet" href="../s.css"/><link rel="stylesheet" href="./../s.css"/><link rel="stylesheet" href="no.css"/><style>h1 { page-break-before: always }</style><style>')
    sheet = "p { direction: rtl } h1 { page-break-before: always } h2 { break-after: page }"
    base = {"META-INF/container.xml": CONTAINER, "OPS/text/c2b.xhtml": "<html><body>x</body></html>", "OPS/nav.xhtml": NAV, "OPS/s.css": sheet}
    archive_of(tmp_path / "a.epub", base | {"OPS/p.opf": OPF, "OPS/text/c1.smil": SMIL, "OPS/text/c1.xhtml": C1})
    archive_of(tmp_path / "b.epub", base | {"OPS/p.opf": fixed, "OPS/body/one.smil": smil.replace("#f3", "#f9"), "OPS/body/one.xhtml": linked})
    out = plans.compile_books(spark, str(tmp_path))
    issues = [(r.archive[-6:], r.id, r.code) for r in out["issues"].collect()]
    assert issues == [("b.epub", "p3", "smil_textref_fragment_not_found")]
    with pytest.raises(ValueError, match="1 smil_textref_fragment_not_found"):
        plans.compile_books(spark, str(tmp_path), strict=True)
    warned = {(r.archive[-6:], r.code, r.chapter_id, r.file_path): r.detail for r in out["feature_warnings"].collect()}
    assert warned == {
        ("a.epub", "positioned-layout", "c1", "OPS/text/c1.xhtml"): "inline <style> block uses float CSS declarations",
        ("b.epub", "positioned-layout", "c1", "OPS/body/one.xhtml"): "inline <style> block uses float CSS declarations",
        ("b.epub", "rtl-direction", "c1", "OPS/s.css"): 'linked stylesheet "../s.css" uses RTL directionality CSS (direction/unicode-bidi); linked stylesheet "./../s.css" uses RTL directionality CSS (direction/unicode-bidi)',
        ("b.epub", "fixed-layout", None, "OPS/p.opf"): 'manifest marks item(s) as rendition:layout-pre-paginated ("OPS/nav.xhtml"); OPF metadata contains fixed-layout=true indicator; OPF contains rendition:layout-pre-paginated spine/manifest properties',
    }
    hints = {(r.archive[-6:], r.chapter_id): (r.css, r.missing) for r in out["break_css"].collect()}
    assert hints[("b.epub", "c1")] == ("h1 { page-break-before: always; break-before: column; }\nh2 { break-after: column; }", ["no.css"]) and hints[("a.epub", "c1")] == ("", [])
    rects = out["spans"].select("archive", "chapter_id", F.lit(0).alias("page_index"), F.col("id").alias("span_id")).where("archive like '%a.epub'")
    shown = plans.compile_books(spark, str(tmp_path), rects)["issues"].where("code = 'timed_span_without_geometry_text'")
    assert sorted((r.archive[-6:], r.id) for r in shown.collect()) == [("b.epub", "p1"), ("b.epub", "p3")]


def test_books_are_aligned_and_tagged(spark, tmp_path):
    told = [f"This is the {w} sentence to be heard." for w in "first second third fourth fifth sixth".split()] + ["Nobody reads that bit out loud!", "Then comes another one to hear."]
    html = "".join(f"<p>{s}</p>" for s in told).replace("comes another", "<b>comes another</b>")
    archive_of(tmp_path / "a.epub", {"META-INF/container.xml": CONTAINER, "OPS/p.opf": OPF, "OPS/text/c1.xhtml": f"<html><body>{html}</body></html>", "OPS/text/c2b.xhtml": "<html><body></body></html>"})
    text = " ".join(told[:6] + told[7:]) + " And more talk." * 400
    at, words = 0, []
    book = f"file:{tmp_path}/a.epub"
    for i, w in enumerate(text.split(" ")):
        words.append((book, i, i * 0.5, i * 0.5 + 0.4, at, at + len(w), "a.mp3"))
        at += len(w) + 1
    out = plans.align_books(
        spark, str(tmp_path / "a.epub"), spark.createDataFrame(words, "book_id string, ord int, start_s double, end_s double, start_off long, end_off long, audiofile string"),
        spark.createDataFrame([(book, text)], "book_id string, transcript string"), spark.createDataFrame([(book, "a.mp3", 700.0)], "book_id string, href string, duration_s double"),
    )
    spans = [(r.id, r.text_ref, r.clip_begin_ms, r.clip_end_ms) for r in out["spans"].orderBy("ord").collect()]
    assert spans[0] == ("c1-sentence0", "OPS/text/c1.xhtml#c1-sentence0", 0.0, 4000.0) and spans[6][3] == -1.0 and spans[7][2] == 24000.0
    html = out["texts"].where("chapter_id = 'c1'").first().html
    assert '<span data-span-id="c1-sentence0">This is the first sentence to be heard.</span>' in html and "sentence6" not in html and '<span data-span-id="c1-sentence7">Then </span><b>comes' in html


def test_ncx():
    text = '<ncx><navMap><navPoint><navLabel><text>A</text></navLabel><content src="c.xhtml#x"/><navPoint><navLabel><text>B</text></navLabel><content src="d.xhtml"/></navPoint></navPoint></navMap></ncx>'
    assert markup.ncx(text, "OPS/t.ncx") == [(0, None, 0, "A", "OPS/c.xhtml"), (1, 0, 0, "B", "OPS/d.xhtml")]


def test_sentence_tags():
    html = "<body><p>One is here. <b>Two</b> goes on. Three.</p></body>"
    out = markup.tag_sentences(html, "c", ["One is here.", "Two goes on.", "Three."], {0, 1})
    assert '<span data-span-id="c-sentence0">One is here.</span>' in out and '<b><span data-span-id="c-sentence1">Two</span></b> goes on.' in out and "sentence2" not in out


def test_bundle_round_trip(spark, tmp_path):
    page = {"pageId": "c_p0000", "chapterId": "c", "pageIndex": 0, "textRuns": [{"text": "a", "x": 1.0, "styleId": 0, "spanId": "s0"}], "spanRects": [{"spanId": "s0", "rects": [{"x": 0.0, "y": 0.0, "width": 5.0, "height": 5.0}]}]}
    read = lambda rows, schema: spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    tables = {
        "meta": read([{"bundleId": "b", "audioFile": "a.opus"}], bundle.META), "spans": read([{"ord": 0, "id": "s0", "clipBeginMs": 0, "clipEndMs": 10, "pageIndex": 0}, {"ord": 1, "id": "s1", "clipBeginMs": 5, "clipEndMs": 9, "pageIndex": -1}], bundle.SPANS),
        "styles": read([{"styleId": 0, "fontFamily": "serif"}], bundle.STYLES), "pages": read([page], bundle.PAGES),
    }
    at = str(tmp_path / "bundle")
    bundle.write(tables, at)
    back = bundle.read(spark, at)
    assert back["spans"].orderBy("id").collect() == tables["spans"].orderBy("id").collect() and back["toc"].count() == 0
    assert bundle.text_runs(back).first().fontFamily == "serif" and bundle.audio_is_safe(back).first().safe
    with pytest.raises(FileNotFoundError):
        bundle.audio_path(spark, back, at)
    (tmp_path / "bundle/a.opus").write_bytes(b"x")
    assert bundle.audio_path(spark, back, at) == f"{at}/a.opus"
    with pytest.raises(ValueError, match="inside the bundle"):
        bundle.audio_path(spark, {"meta": back["meta"].withColumn("audioFile", F.lit("../a.opus"))}, at)
    got = {r.metric: r.value for r in plans.inspect_bundle(spark, at).collect()}
    assert got["timed"] == 2 and got["spans_without_rects"] == 1
    hit = plans.active_spans(spark, at, spark.createDataFrame([(6.0,), (20.0,)], "t double"))
    assert {r.t: r.found_id for r in hit.collect()} == {6.0: "s0", 20.0: None}
    files = bundle.to_files(back, "b").union(bundle.to_files(back, "other"))
    made = bundle.to_archives(files, str(tmp_path / "zips"))
    assert sorted((r.book, r.files) for r in made.collect()) == [("b", 5), ("other", 5)] and sorted(x.name for x in (tmp_path / "zips").iterdir()) == ["b.zip", "other.zip"]
    content = (tmp_path / "zips/b.zip").read_bytes()
    assert "pages/c_p0000.json" in bundle.archive_names(content)
    with zipfile.ZipFile(tmp_path / "zips/b.zip") as z:
        assert z.testzip() is None and [json.loads(x)["id"] for x in z.read("spans.jsonl").decode().splitlines()] == ["s0", "s1"]
    again = bundle.from_archives(spark, str(tmp_path / "zips"))
    assert {t: df.count() for t, df in again.items()} == {"meta": 2, "spans": 4, "styles": 2, "pages": 2, "toc": 0}
    assert again["spans"].where("archive like '%b.zip'").orderBy("ord").drop("archive").collect() == back["spans"].orderBy("ord").collect()
    assert again["pages"].first().textRuns[0].text == "a"
    assert bundle.probe(spark, [str(tmp_path / "none"), str(tmp_path / "zips"), str(tmp_path / "zips/b"), at]) == str(tmp_path / "zips/b.zip")
    assert bundle.probe(spark, [str(tmp_path / "none"), at]) == at and bundle.probe(spark, []) is None
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as z:
        z.writestr("../x", "y")
    with pytest.raises(ValueError):
        bundle.archive_names((tmp_path / "evil.zip").read_bytes())


def test_positions_keep_the_latest(spark, tmp_path):
    at = str(tmp_path / "positions")
    new = lambda *r: spark.createDataFrame(list(r), "book_id string, position_ms long, ts long")
    bundle.save_positions(spark, new(("a", 5, 1), ("b", 6, 1)), at)
    assert rows(bundle.save_positions(spark, new(("a", 9, 2), ("a", 7, 0)), at).select("book_id", "position_ms"), "book_id") == [("a", 9), ("b", 6)]
    books_ = spark.createDataFrame([("a",), ("c",)], "book_id string")
    assert rows(bundle.load_positions(spark, books_, at), "book_id") == [("a", 9), ("c", 0)]
    assert rows(bundle.load_positions(spark, books_, f"{at}-none"), "book_id") == [("a", 0), ("c", 0)]
    (tmp_path / "positions/version=9").mkdir()  # a write that was broken off
    bundle.clear_positions(spark, books_, at)
    assert rows(bundle.load_positions(spark, new(("a", 1, 1), ("b", 1, 1)).select("book_id"), at), "book_id") == [("a", 0), ("b", 6)]


def test_transcripts(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"transcript": "a b", "wordTimeline": [{"text": "a", "startTime": 0, "endTime": 1, "startOffsetUtf16": 0, "endOffsetUtf16": 1}]}))
    t, w = transcripts.read_transcripts(spark, str(tmp_path / "t.json"), "x.mp3")
    assert t.first().transcript == "a b" and w.first().audiofile == "x.mp3"
    (tmp_path / "r.json").write_text(json.dumps({"text": "Hello big world", "sentences": [{"text": "", "start": 0, "end": 1, "tokens": [{"text": " hello", "start": 0, "end": 1}, {"text": "nope", "start": 1, "end": 2}, {"text": "world", "start": 2, "end": 3}]}]}))
    got = transcripts.read_recognised(spark, str(tmp_path / "r.json"), "x.mp3").orderBy("ord").collect()
    assert [(r.text, r.start_off, r.end_off) for r in got] == [("hello", 0, 5), ("world", 10, 15)]


def test_targets_of_two_books_and_books_without_overlays(spark, tmp_path):
    """Targets that differ in case or encoding find their own book's chapter; a book without overlays is named, and the other is compiled."""
    nav = NAV.replace("text/c1.xhtml", "TEXT/C1.xhtml").replace("text/c2b.xhtml", "text/c2%62.xhtml")
    base = {"META-INF/container.xml": CONTAINER, "OPS/text/c2b.xhtml": "<html><body>x</body></html>", "OPS/nav.xhtml": nav, "OPS/text/c1.smil": SMIL, "OPS/text/c1.xhtml": C1}
    archive_of(tmp_path / "a.epub", base | {"OPS/p.opf": OPF})
    archive_of(tmp_path / "b.epub", base | {"OPS/p.opf": OPF.replace(' media-overlay="', ' x="')})
    a, b = f"file:{tmp_path}/a.epub", f"file:{tmp_path}/b.epub"
    rects = spark.createDataFrame([(a, "c1", 5, "p1"), (b, "c1", 7, "p1"), (b, "c2", 9, "p9")], "archive string, chapter_id string, page_index int, span_id string")
    out = plans.compile_books(spark, str(tmp_path), rects)
    entries = {(r.book_id[-6:], r.title): r.page_index for r in out["toc"].collect()}
    assert entries["a.epub", "Part I"] == 5 and entries["b.epub", "Part I"] == 7 and {p for (x, _), p in entries.items() if x == "b.epub"} <= {7, 9}
    assert [(r.archive, r.reason) for r in out["failures"].collect()] == [(b, "no chapter with an overlay")]
    assert {r.archive for r in out["spans"].select("archive").distinct().collect()} == {a}
    assert all(m.startswith("[") and "chapter=" in m for m in (r.message for r in out["issues"].collect()))
    assert out["styles"].count() > 0
    with pytest.raises(ValueError, match="no chapter with an overlay: .*b.epub"):
        plans.compile_books(spark, str(tmp_path), rects, strict=True)


def test_sentences_agree_with_texts_as_before():
    def plain(text, at, sentence):
        i, j = at, 0
        while i < len(text) and j < len(sentence):
            if text[i].isspace() and sentence[j].isspace():
                while i < len(text) and text[i].isspace():
                    i += 1
                j += 1
            elif text[i].isspace():
                i += 1
            elif text[i] == sentence[j]:
                i, j = i + 1, j + 1
            elif sentence[j].isspace():
                j += 1
            else:
                break
        return i, j

    for text in ("a b. c", "a  b.", "a b", "a  b", "a \n", " a b", "a b c"):
        for sentence in ("a", "a b", "a  b", "a ", " a", "a b. c", "b"):
            for at in range(3):
                assert markup._common(text, at, sentence) == plain(text, at, sentence), (text, at, sentence)
    assert markup.serialize(markup.parse_html('<p style="behavior: url(x); color: red">a</p>' * 3)).count('style=" color: red"') == 3
    assert markup._safe_style.cache_info().hits >= 2  # a style is looked through once
