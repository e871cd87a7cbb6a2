"""Package and navigation documents of books with many chapters are read without holding their trees and rows."""

import tracemalloc

import pyarrow as pa

from lectern.sources import books
from lectern.sources import markup as M

N = 30_000


def peak(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_large_package_is_read_as_a_stream():
    items = "".join(f'<item id="c{i}" href="text/c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(N))
    refs = "".join(f'<itemref idref="c{i}"/>' for i in range(N))
    text = f"<package><metadata><title>a <b>b</b></title></metadata><manifest>{items}</manifest><spine toc='n'>{refs}</spine></package>"
    found, most = peak(lambda: M.package(text, 1000))
    assert most < 3 * len(text)
    assert found["title"] == "a b" and found["toc"] == "n"
    assert [len(p) for p in found["manifest"]] == [1000] * 30 and sum(map(len, found["spine"])) == N
    assert found["manifest"][-1][-1].as_py() == {"ord": N - 1, "id": f"c{N - 1}", "href": f"text/c{N - 1}.xhtml", "media_type": "application/xhtml+xml", "media_overlay": None, "properties": []}


def test_a_large_navigation_leaves_in_batches(spark):
    points = "".join(f'<li><a href="c{i}.xhtml">t {i}</a></li>' for i in range(N))
    opf = '<package><manifest><item id="nav" href="nav.xhtml" media-type="x" properties="nav"/></manifest></package>'
    files = {"META-INF/container.xml": '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>', "p.opf": opf, "nav.xhtml": f'<nav epub:type="toc"><ol>{points}</ol></nav>'}
    entries = spark.createDataFrame([("b", p, t.encode()) for p, t in files.items()], "archive string, path string, content binary")
    rows = books.navigation(entries, books.packages(entries))
    assert "ArrowEvalPython" not in rows.select("node_id")._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    got = rows.orderBy("node_id").collect()
    assert len(got) == N and tuple(got[-1]) == ("b", N - 1, None, N - 1, f"t {N - 1}", f"c{N - 1}.xhtml")


def test_a_large_navigation_is_read_as_a_stream():
    points = "".join(f'<li><a href="c{i}.xhtml">t <b>{i}</b> &amp; é</a><ol><li>x<a href="c{i}.xhtml#f"> u </a></ol></li>' for i in range(N // 2))
    text = f'﻿<html><body><nav><ol><li><a href="x">no</a></li></ol></nav><nav role="doc-toc"><h2>C</h2><ol>{points}</ol><ol><li><a href="y">no</a></li></ol></nav><p>{"<i>z</i>" * N}</p></body></html>'
    rows, most = peak(lambda: [sum(1 for _ in M.navigation_rows(text, "OPS/nav.xhtml"))])
    assert rows == [N] and most < 5_000_000  # a tree takes ten times as much
    listed = M.navigation(text, "OPS/nav.xhtml")
    assert listed[2:4] == [(2, None, 1, "t 1 & é", "OPS/c1.xhtml"), (3, 2, 0, "u", "OPS/c1.xhtml")] and listed == M.navigation(pa.py_buffer(text.encode()), "OPS/nav.xhtml")


def test_a_large_ncx_is_read_as_a_stream():
    points = "".join(f'<navPoint><navLabel><text>t {i}</text></navLabel><content src="c{i}.xhtml"/><navPoint><navLabel/><navPoint><navLabel>u</navLabel><content src="d"/></navPoint></navPoint></navPoint>' for i in range(N // 2))
    text = f"<ncx><head><meta/></head><navMap><navInfo/>{points}</navMap><navMap><navPoint><navLabel>no</navLabel><content src='e'/></navPoint></navMap></ncx>"
    rows, most = peak(lambda: [sum(1 for _ in M.ncx_rows(text, "n.ncx"))])
    assert rows == [N] and most < 10_000_000
    assert M.ncx(text, "n.ncx")[2:4] == [(2, None, 1, "t 1", "c1.xhtml"), (3, 2, 0, "u", "d")]


def test_packages_in_parts_say_what_packages_do(spark):
    items = '<item id="nav" href="nav.xhtml" media-type="x" properties="nav"/>' + "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(50))
    opf = f'<package><title>a</title><manifest>{items}</manifest><spine toc="n">{"".join(f"""<itemref idref="c{i}"/>""" for i in range(50))}</spine></package>'
    files = {"META-INF/container.xml": '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>', "p.opf": opf}
    entries = spark.createDataFrame([(b, p, t.encode()) for b in "ab" for p, t in files.items()], "archive string, path string, content binary")
    whole, parts = books.packages(entries), books.package_parts(entries, 7)
    assert whole.count() == 2 and max(len(r.manifest) + len(r.spine) for r in parts.collect()) == 7
    assert [(r.title, r.toc) for r in parts.where("title is not null").collect()] == [("a", "n")] * 2
    for read in (books.manifest, books.chapters, books.navigation_paths, books.audio_files):
        assert sorted(map(str, read(whole).collect())) == sorted(map(str, read(parts).collect())), read
