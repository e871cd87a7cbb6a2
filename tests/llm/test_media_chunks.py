import collections
import hashlib
import io
import math
import random
import wave
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import media_chunks as M
from lectern.shared import drop_shared, new_path


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij é") for _ in range(9))
    shared = " ".join(word() for _ in range(900))
    return [None, "", "a", "x" * 64, "x" * 63, "a\0", "é" * 40, shared, shared, "new beginning " + shared, shared + " new end", shared[:4000] + " middle " + shared[4000:], " ".join(word() for _ in range(20000)), "z" * 200000]


def plain(text):
    """What a row must give, by the standard library alone: (n_bytes, payload, file, feature)."""
    raw = (text or "").encode()
    payload = raw
    while not payload or len(payload) % 64:
        payload += b"\0"
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(payload)
    x = [b - 128 for b in payload]
    n = len(x)
    count = collections.Counter(x)
    cross = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    bits = -sum(k / n * math.log2(k / n) for k in count.values()) + 0.0
    feature = f"n={n};mean={sum(x) / n:.4f};rms={math.sqrt(sum(v * v for v in x) / n):.4f};cross={cross};bits={bits:.4f}"
    return len(raw), payload, out.getvalue(), feature


def check(rows, got):
    assert len(got) == len(rows)
    for r in got:
        n, p, media, feature = plain(dict(rows)[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), feature)


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_round_trip(spark, broadcast_rows):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "object": F.lit("o"), "seq": F.lit(0)})
    check(rows, M.media_features(spark, docs, broadcast_rows=broadcast_rows).collect())


def test_a_shared_chunk_is_stored_once(spark, tmp_path):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = M.store(spark, docs, str(tmp_path / "store"))
    digests = [bytes(r.digest) for r in s.shared().collect()]
    assert len(digests) == len(set(digests)) > 2
    kept = sum(len(r.body) for r in s.containers().collect()) + sum(len(r["bytes"]) for r in s.shared().collect())
    whole = sum(len(M.to_wave(M.payload_of(t)[1])) for t in {t or "" for _, t in rows})
    assert kept < whole - 3 * 7000  # the passage that four files share


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    s = M.store(spark, docs, str(tmp_path / "store"))
    bad = s.containers().withColumn("body", F.concat("body", F.lit(b"x")))
    broken = type("Broken", (), {"containers": lambda self: bad, "shared": lambda self: s.shared(), "id_type": s.id_type})()
    with pytest.raises(Exception, match="can't be rebuilt"):
        M.read_back(broken).collect()


def test_a_store_is_opened_by_its_path(spark, tmp_path):
    rows = list(enumerate(texts()))
    M.store(spark, spark.createDataFrame(rows, "doc_id int, text string"), str(tmp_path / "store"))
    drop_shared(spark)
    s = M.MediaStore(spark, str(tmp_path / "store"))
    files = {plain(t)[2] for _, t in rows}
    assert {bytes(r.media_sha256) for r in M.read_back(s).collect()} == {hashlib.sha256(f).digest() for f in files}
    # by hand: each file is the ordered list's chunks, the shared ones by digest, the others from the container
    chunk = {bytes(r.digest): bytes(r["bytes"]) for r in s.shared().collect()}
    assert all(hashlib.sha256(c).digest()[:16] == d for d, c in chunk.items())
    built = set()
    for r in s.containers().collect():
        at, whole = 0, b""
        for c in r.chunks:
            part = chunk[bytes(c.digest)] if c.shared else bytes(r.body[at : at + c["bytes"]])
            at += 0 if c.shared else c["bytes"]
            assert hashlib.sha256(part).digest()[:16] == bytes(c.digest) and len(part) == c["bytes"]
            whole += part
        built.add(whole)
    assert built == files and s.copies().count() == len(rows) - len({t or "" for _, t in rows}) and s.id_type == "int"


def test_cuts_follow_the_content():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    ends = M.cuts(data)
    assert ends[-1] == len(data) and all(M.LEAST <= b - a <= M.MOST for a, b in zip([0, *ends[:-2]], ends[:-1], strict=True))
    moved = M.cuts(b"inserted" + data)
    assert len({e + 8 for e in ends} & set(moved)) > 0.9 * len(ends)
    h, gear = 0, [int(x) for x in M._GEAR]
    rolled = []
    for b in data[:5000]:
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        rolled.append(h & int(M._CUT) == 0)
    first = next(i + 1 for i, ok in enumerate(rolled) if ok and i + 1 >= M.LEAST)
    assert ends[0] == first
    assert M.cuts(b"") == [0] and M.cuts(bytes(100_000))[:2] == [M.MOST, 2 * M.MOST]


def test_the_file_is_a_wave_file():
    n, p = M.payload_of("hello")
    with wave.open(io.BytesIO(M.to_wave(p))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())) == (1, 1, M.RATE, p)
    assert M.from_wave(M.to_wave(p)) == p and n == 5


def test_repeats_nulls_and_no_rows(spark):
    rows = [(1, "same"), (1, "same"), (None, "same"), (None, None), (2, "b"), (2, "c")]
    got = M.media_features(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in got) == [(0, 0), (0, 4), (1, 4), (1, 4), (2, 1), (2, 1)]
    assert M.media_features(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_missing_chunks_raise(spark):
    long = "".join(f"{i} " for i in range(40_000))
    docs = spark.createDataFrame([(0, long), (1, long + "a"), (2, long + "b"), (3, "own"), (4, "b" + long)], "doc_id long, text string")
    media = M.store(spark, docs, new_path(spark, "media-store"))
    assert media.shared().count() > 0 and M.read_back(media).count() == 5
    some = media.shared().orderBy("digest").limit(1)
    for left in (media.shared().limit(0), media.shared().join(some, "digest", "left_anti")):
        lost = type("Lost", (), {"containers": lambda self: media.containers(), "shared": lambda self, left=left: left, "id_type": media.id_type})()
        with pytest.raises(Exception, match="is missing"):
            M.read_back(lost).collect()
