import math

import pytest
from pyspark.sql import functions as F

from lectern import profiles
from lectern.functions import clip, color, css, markup, paths, player


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_clip_times(spark):
    cases = {"1500ms": 1500, "1.5s": 1500, "0:00:01.5": 1500, "01:30.500": 90500, "12": 12000, "": 0, "2min": 2000, "1:2:3:4": 0, " 7 s ": 7000}
    df = spark.createDataFrame([(t, float(v)) for t, v in cases.items()], "t string, v double")
    for r in df.select("t", "v", clip.clip_ms(F.col("t")).alias("ms")).collect():
        assert r.ms == r.v, r.t
    assert math.isnan(one(spark, clip.clip_ms(F.lit("soon"))))
    assert one(spark, clip.clip_ms(F.lit(None).cast("string"))) == 0


def test_clip_times_agree_with_the_tree_parser(spark):
    from lectern.sources.markup import clip_ms

    for t in ("1500ms", "1.5s", "0:00:01.5", "01:30.500", "12", "", "2min", "1:2:3:4"):
        assert clip_ms(t) == one(spark, clip.clip_ms(F.lit(t)))


def test_clocks(spark):
    assert one(spark, clip.hours_text(F.lit(3723000.0))) == "1:02:03"
    assert one(spark, clip.hours_text(F.lit(63999.0))) == "1:03"
    assert one(spark, clip.hours_text(F.lit(float("nan")))) == "n/a"
    assert one(spark, clip.minutes_text(F.lit(3723000.0))) == "62:03"
    assert one(spark, clip.seconds_to_ms(F.lit(-1.0))) == -1
    assert one(spark, clip.seek_target(F.lit(12.9))) == 13


def test_paths(spark):
    r = lambda base, rel: one(spark, paths.resolve(F.lit(base), F.lit(rel)))
    assert r("OPS/text/ch.xhtml", "../img/a.png#x#y") == "OPS/img/a.png#x"
    assert r("ch.xhtml", "../../a") == "a"
    assert one(spark, paths.normalise(F.lit("a/../../b"))) == "../b"
    assert one(spark, paths.strip_lead(F.lit("\\a\\b"))) == "/a/b"
    assert one(spark, paths.is_for_chapter(F.lit("OPS/chapter%201.xhtml#frag1"), F.lit("OPS/chapter 1.xhtml")))
    assert one(spark, paths.is_for_chapter(F.lit("#frag1"), F.lit("OPS/chapter 1.xhtml")))
    assert one(spark, paths.reference_fragment(F.lit("a#b%20c"))) == "b c"
    assert one(spark, paths.reference_fragment(F.lit("a#"))) is None
    assert one(spark, paths.percent_decode(F.lit("%E0%A4%A+"))) == "%E0%A4%A+"
    assert one(spark, paths.encode_path(F.lit("a b/c"))) == "a%20b/c"
    assert one(spark, paths.stylesheet_path(F.lit("OPS/a.xhtml"), F.lit("../s.css?x"))) == "s.css"
    assert one(spark, paths.stylesheet_path(F.lit("a.xhtml"), F.lit("../s.css"))) is None
    assert one(spark, paths.code_units(F.lit("a😀"))) == 3
    assert one(spark, paths.safe_audio_path(F.lit("audio/a.mp3"))) and not one(spark, paths.safe_audio_path(F.lit("../a.mp3"))) and not one(spark, paths.safe_audio_path(F.lit("C:\\a.mp3")))


def test_bundle_ids(spark):
    assert one(spark, paths.bundle_id(F.lit(" urn: x "), F.lit("T"))) == "urn:-x"
    assert len(one(spark, paths.bundle_id(F.lit(" "), F.lit("T"), F.array(F.lit("a"))))) == 16


def test_href_safety(spark):
    for href, safe in (("a.css", True), ("../b.css", True), ("c.css?d", True), ("http://x/a.css", False), ("https://x", False), ("//x/a.css", False), ("data:text/css,a", False), (" ", False)):
        assert one(spark, paths.safe_href(F.lit(href))) is safe, href


def test_url_classes(spark):
    c = lambda url: tuple(one(spark, paths.classify_url(F.lit(url))))
    assert c("https://epub.local/OEBPS/styles/base.css") == ("epub-resource", "OEBPS/styles/base.css", None)
    for url in ("data:image/png;base64,AA", "blob:https://epub.local/1", " DATA:x"):
        assert c(url) == ("inline-resource", None, None), url
    for url, origin in (("https://example.com/theme.css", "https://example.com"), ("http://epub.local/a.css", "http://epub.local"), ("https://epub.local:8443/a", "https://epub.local:8443"), ("about:blank", "null"), ("file:///a.css", "null"), ("HTTPS://u:p@EXAMPLE.com:443/x", "https://example.com"), ("http://x:080/", "http://x")):
        assert c(url) == ("blocked", None, f"origin {origin} is not allowed"), url
    for url in ("", "a.css", "//epub.local/a.css", "https://", "https://epub.local:99999/", "https://epub.local:x/a", "https://a b/"):
        assert c(url) == ("blocked", None, "invalid URL"), url
    for url in ("https://epub.local/%E0%A4%A.css", "https://epub.local/%zz", "https://epub.local/a%2f..%2f..%2fb.css", "https://epub.local/%FF"):
        assert c(url) == ("blocked", None, "invalid EPUB resource path"), url
    for url, path in (("https://epub.local", ""), ("https://EPUB.local:443/", ""), ("https://epub.local/a/../../b.css?x#y", "b.css"), ("https://epub.local/a/%2e%2E/b%20c+d.css", "b c+d.css"), ("https:\\\\epub.local\\a\\b.css", "a/b.css"), ("https://epub.local/a//b/./c/", "a/b/c/"), ("https://epub.local/a%2f..%2fb.css", "b.css"), ("https://epub.local/x/..", ""), ("https://epub.local/%EF%BF%BD", "\ufffd")):
        assert c(url) == ("epub-resource", path, None), url


def test_bases(spark):
    for path, href in (("c.xhtml", "https://epub.local/"), ("/OPS/a b/c.xhtml", "https://epub.local/OPS/a%20b/"), ("O\\ü!'()*~/x", "https://epub.local/O/%C3%BC!'()*~/")):
        assert one(spark, paths.base_href(F.lit(path))) == href, path
    inject = lambda html: one(spark, paths.inject_base(F.lit(html), F.lit("https://epub.local/O/")))
    assert inject('<html><HEAD lang="x"><title/></HEAD><head>') == '<html><HEAD lang="x">\n  <base href="https://epub.local/O/"><title/></HEAD><head>'
    for html in ("<p>x</p>", '<head><BASE href="y"></head>'):
        assert inject(html) == html


def test_contents(spark):
    for path, kind in (("a/b.XHTML", "application/xhtml+xml"), ("c.opf", "application/xhtml+xml"), ("d.smil", "application/smil+xml"), ("e.mjs", "text/javascript; charset=utf-8"), ("f.json", "application/json; charset=utf-8"), ("g.mp3", "application/octet-stream"), (".css", "application/octet-stream"), ("x.y/.css", "application/octet-stream"), ("h.tar.css", "text/css; charset=utf-8")):
        assert one(spark, paths.content_type(F.lit(path))) == kind, path
    assert one(spark, paths.is_critical(F.lit("a.png"), F.lit(" Font "))) and one(spark, paths.is_critical(F.lit("a.WOFF"), F.lit("image"))) and not one(spark, paths.is_critical(F.lit("a.png"), F.lit("image")))


def test_profile():
    p = profiles.get()
    assert p is profiles.get("supernote-manta-a5x2") and (p.width, p.height, p.content) == (1920, 2560, (1760, 2260)) and (p.top, p.right, p.bottom, p.left) == (100, 80, 200, 80)
    assert "padding: 100px 80px 200px 80px !important; font-family: 'Noto Serif', serif !important; font-size: 48px !important; line-height: 1.5 !important" in p.css()
    with pytest.raises(ValueError, match="Unknown profile: x. Available: supernote-manta-a5x2"):
        profiles.get("x")


def test_ink(spark):
    for text, gray in (("rgb(0, 0, 0)", 0), ("rgb(255,255,255)", 255), ("rgba(0,0,0,0.5)", 170), ("rgb(100%, 0%, 0%)", 85), ("red", 0), ("rgb(300, 300, 300)", 255)):
        assert one(spark, color.ink_gray(F.lit(text))) == gray, text


def test_sanitizing():
    text = '@import url("http://x/a.css"); @import "//y"; p { behavior: url(x.htc); background: url(http://x/a.png); b: url(img.png) } q { background: url(data:a) }'
    out, imports, urls, declarations = css.sanitize(text)
    assert (imports, declarations) == (2, 1) and urls == 1
    assert "behavior" not in out and "http:" not in out and "url(img.png)" in out and "url(data:a)" in out
    assert css.sanitize('@import "a.css"; p { width: expression(alert(1)); color: red }') == ('@import "a.css"; p {  color: red }', 0, 0, 1)
    assert css.sanitize("a { b: url() }")[2] == 1


def test_sanitizing_of_odd_sheets():
    for given, want in (
        ("a { scroll-behavior: smooth; color: red }", ("a { scroll- color: red }", 0, 0, 1)),
        ('@import "http://x/a.css" p { }', ('@import "http://x/a.css" p { }', 0, 0, 0)),
        ("@IMPORT URL( 'HTTPS://x/a.css' ) screen;b{}", ("b{}", 1, 0, 0)),
        ("@import url() \"a.css\"; @import url(); @import;", ('@import url("") "a.css";  @import;', 1, 1, 0)),
        ("a { -moz-binding: url(x) } b{x-moz-binding: url(y)}", ("a { -moz-binding: url(x) } b{x}", 0, 0, 1)),
        ("a { b: url( \"#f\" ) url(//h/i) url('DATA:x') url(c", ("a { b: url( \"#f\" ) url(\"\") url('DATA:x') url(c", 0, 1, 0)),
        ("color:#111; width:expression(alert(1));", ("color:#111; ", 0, 0, 1)),
        ("behavior:x", ("", 0, 0, 1)),
        ("", ("", 0, 0, 0)),
    ):
        assert css.sanitize(given, given.startswith(("color", "behavior"))) == want, given
    sheet = """
      @import url("https://evil.example.com/theme.css");
      @import url("../styles/local.css");
      .chapter { background-image: url("https://evil.example.com/bg.png"); color: #222; }
      .legacy { behavior: url("behavior.htc"); }
    """
    out, imports, urls, declarations = css.sanitize(sheet)
    assert '@import url("../styles/local.css");' in out and "evil" not in out and "behavior:" not in out and (imports, urls, declarations) == (1, 1, 1)


def test_break_rules():
    assert css.break_rules(".chapter { break-before: page; break-after: always; color: red }") == [".chapter { break-before: column; break-after: column; }"]
    assert css.break_rules(".chapter { page-break-before: always; page-break-after: left }") == [".chapter { page-break-before: always; break-before: column; page-break-after: left; break-after: column; }"]
    assert css.break_rules(".chapter { break-after: avoid-page !important; page-break-after: always }") == [".chapter { break-after: avoid !important; page-break-after: always; break-after: column; }"]
    assert css.break_rules('@media print { h1 { break-before: page } } p::after { content: "}{"; }') == ["@media print {\n  h1 { break-before: column; }\n}"]
    assert css.break_rules("h1 { color: red } /* h2 { break-before: page } */") == []


def test_links_and_styles(spark):
    head = '<head><style>a{}</style><link rel="Stylesheet" href="a.css"><link href=\'b.css\' rel="x stylesheet"><link rel="icon" href="i"><link rel=stylesheet href=a.css></head><p style="x: y">'
    assert one(spark, css.stylesheet_hrefs(F.lit(head))) == ["a.css", "b.css"]
    assert one(spark, css.style_blocks(F.lit(head))) == ["a{}"] and one(spark, css.style_attributes(F.lit(head))) == ["x: y"]


def test_features(spark):
    got = one(spark, markup.css_features(F.lit("p { float: left; position: fixed } /* direction: rtl */ q { display: inline-table }")))
    assert [g["code"] for g in got] == ["table-layout", "positioned-layout"]
    got = one(spark, markup.package_features(F.lit('<meta property="rendition:layout">pre-paginated</meta>'), F.array(F.array(F.lit("rendition:layout-pre-paginated"))), F.array(F.lit("a.xhtml"))))
    assert [g["detail"] for g in got] == ['manifest marks item(s) as rendition:layout-pre-paginated ("a.xhtml")', 'OPF metadata contains <meta property="rendition:layout">pre-paginated</meta>']
    assert one(spark, markup.escape_attribute(F.lit("<a & \"b'>"))) == "&lt;a &amp; &quot;b&#39;&gt;"
    assert one(spark, markup.search_text(F.lit(" A —\n“B” "))) == "a - “b”"


def test_player_decisions(spark):
    page = lambda a, b: one(spark, player.jump_page(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert (page("4", "9"), page(None, "9"), page("x", "1"), page("-1", None), page(None, "0")) == (4, 8, 0, None, None)
    tap = lambda *v: one(spark, player.is_tap(*map(F.lit, v)))
    assert tap(4.0, 8.0, 220, 1) and not tap(4.1, 8.0, 100, 1) and not tap(0.0, 8.0, 221, 1) and not tap(0.0, 8.0, 10, 2)
    assert one(spark, player.start_page(F.lit(None).cast("int"), F.lit(99), F.lit(10))) == 9
    assert tuple(one(spark, player.audio_format(F.lit(" M4A "))))[:3] == ("m4a", "audio.m4a", "M4A (AAC)")
    assert one(spark, player.audio_format(F.lit("opus"))).encoder == ["-c:a", "libopus", "-b:a", "48k", "-vbr", "on", "-application", "voip"]
    with pytest.raises(Exception, match="Unsupported audio format: aac. Expected one of: opus, m4a"):
        one(spark, player.audio_format(F.lit("aac")))
    source = lambda referer: one(spark, player.request_source(F.lit(referer).cast("string"), F.lit("O/ch.xhtml")))
    assert [source(x) for x in (None, "", "https://epub.local/O/a%20b.xhtml", "https://x.example/y", "https://epub.local/%zz")] == ["O/ch.xhtml", "O/ch.xhtml", "O/a b.xhtml", "https://x.example/y", "https://epub.local/%zz"]
    sheet = lambda *v: one(spark, player.is_stylesheet(*map(F.lit, v)))
    assert sheet("x", "", "a.CSS") and sheet(" StyleSheet", "", "") and sheet("x", "Text/CSS; charset=x", "a") and not sheet("x", "text/html", "css")
