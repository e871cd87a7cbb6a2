import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import warc_index as W


def pages():
    rng = random.Random(6)
    base = ["<p>" + "".join(rng.choice("abcé\r\n ") for _ in range(rng.choice([10, 99, 100, 3000]))) for _ in range(15)] + ["WARC/1.1\r\n\r\n" * 30, "x" * 300_000]
    return [(i, f"http://x/{i}\r\nInjected: y" if i % 9 == 0 else None if i % 7 == 0 else f"http://x/{i}", rng.choice(base + [None, ""])) for i in range(80)]


def brute(rows):
    first = {}
    for i, _, h in sorted(rows):
        if len((h or "").encode()) >= 100:
            first.setdefault(h, i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = first.get(h, i) != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out)


def test_pages_come_back(spark):
    rows = pages()
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(1), "digest": F.lit("d"), "first": F.lit("f")}).repartition(5)
    got = W.archive_report(spark, docs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_archives_are_archives(spark, tmp_path, monkeypatch):
    rows = pages()
    index = W.write_archives(spark, spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w")).collect()
    files = {r.file for r in index}
    assert len(files) == 1
    text = gzip.open(next(iter(files)).removeprefix("file:")).read().decode()
    assert text.count("WARC/1.1\r\nWARC-Type: response\r\n") == sum(r.record_type == "response" for r in index) and text.count("WARC-Refers-To:") == sum(r.record_type == "revisit" for r in index)
    assert "\r\nInjected:" not in text
    ordered = sorted(index, key=lambda r: r.offset)
    assert ordered[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(ordered, ordered[1:], strict=False))


@pytest.mark.parametrize(("gap", "read"), [(0, 1), (1 << 16, 1 << 23), (10, 5000)])
def test_selected_records_in_any_ranges(spark, tmp_path, monkeypatch, gap, read):
    monkeypatch.setattr(W, "GAP", gap)
    monkeypatch.setattr(W, "READ", read)
    rows = pages()
    index = W.write_archives(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"))
    got = {r.id: r for r in W.read_records(index.where("id % 3 = 1")).collect()}
    assert set(got) == {i for i, _, _ in rows if i % 3 == 1}
    for i, _, h in rows:
        if i in got and got[i].record_type == "response":
            assert bytes(got[i].payload) == (h or "").encode()


def test_repeats_nulls_and_no_rows(spark):
    rows = [(4, "u", "x" * 100), (2, "u", "x" * 100), (2, "v", "x" * 100), (None, "u", "x" * 100), (9, None, "x" * 99), (8, None, "x" * 99)]
    got = W.archive_report(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got) == [
        (0, "revisit", 2, 100), (2, "response", None, 100), (2, "response", None, 100), (4, "revisit", 2, 100), (8, "response", None, 99), (9, "response", None, 99),
    ]
    assert W.archive_report(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
