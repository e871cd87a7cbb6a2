import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import line_index as L


def brute(rows, least, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(-(1 << 63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        k = -(1 << 63) if i is None else i
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and max(held[key(x)]) != k)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def corpus(n=60):
    rng = random.Random(4)
    common = ["Some long line that is SHARED by many documents %d" % i for i in range(12)] + ["é" * 39, "É" * 40, "short", "", "  Padded line that is shared and long enough here\t"]
    rows = [(i, "\n".join(rng.choice(common + [f"own {i} {rng.random()}"]) for _ in range(rng.randint(0, 9)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, common[0]), (3, rows[3][1]), (n + 2, "\n".join(common * 300)), (n + 3, common[1].upper() + "\n" + common[1])]


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "per_shard": 2, "hits_per_task": 4}, {"broadcast_bytes": 700, "per_shard": 2}, {"per_shard": 2}])
def test_matches_a_plain_count(spark, how):
    rows = corpus()
    docs = spark.createDataFrame([(t, i, 7, "x") for i, t in rows], "text string, doc_id long, id int, row string")
    got = L.dedup_lines(spark, docs, **how)
    assert got.columns == [*docs.columns, "__n_lines", "__n_dropped"]
    found = sorted(((r.doc_id, r.text, r["__n_lines"], r["__n_dropped"]) for r in got.collect()), key=str)
    assert found == brute(rows, 40, 5) and any(r[3] for r in found)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.dedup_lines(spark, docs).count() == 0 and L.dedup_lines(spark, docs, broadcast_bytes=-1).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 100, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        h = L.PerfectHash.build(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys))) and len(h.words) * 64 <= max(64 * 8, 5 * n)


def test_shards_pack_and_reject_strangers():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 900, np.uint64) for _ in range(2))
    s = L.Shard.unpack(L.Shard.build(a, b, np.arange(900) + 5, np.arange(900)).pack())
    member, last = s.probe(a, b)
    assert member.all() and last.tolist() == list(range(900))
    assert not s.probe(a, b + np.uint64(1))[0].any() and not s.probe(*(rng.integers(0, 1 << 63, 900, np.uint64) for _ in range(2)))[0].any()
    empty = L.Shard.build(*(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64)))
    assert not empty.probe(a, b)[0].any()


def test_lines_that_agree_in_half_their_hash():
    a, b = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 3, 1], np.uint64)
    s = L.Shard.unpack(L.Shard.build(a, b, np.arange(4), np.array([10, 20, 30, 40])).pack())
    assert s.seed > 0
    member, last = s.probe(a, b)
    assert member.all() and last.tolist() == [10, 20, 30, 40]
    assert not s.probe(np.array([5], np.uint64), np.array([4], np.uint64))[0].any()


def test_filter_passes_all_members_and_few_others():
    rng = np.random.default_rng(2)
    b, other = np.unique(rng.integers(0, 1 << 63, 20_000, np.uint64)), rng.integers(0, 1 << 63, 20_000, np.uint64)
    f = L.Filter.build(b)
    assert f.passes(b).all() and f.passes(other).mean() < 0.02 and not L.Filter.build(b[:0]).passes(other).any()


def test_taken_names(spark):
    docs = spark.createDataFrame([(1, "a\nb", 8, 9)], "doc_id long, text string, __N_lines long, `c0.x` long")
    got = L.dedup_lines(spark, docs)
    assert got.columns == [*docs.columns, "__n_lines_", "__n_dropped"] and tuple(got.first()) == (1, "a\nb", 8, 9, 2, 0)
    only = L.dedup_lines(spark, docs.select("text", F.col("doc_id").alias("Text_id")), id="Text_id")
    assert only.columns == ["text", "Text_id", "__n_lines", "__n_dropped"]


def test_other_columns_pass(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string").withColumn("__odd.name", F.lit(3))
    assert L.dedup_lines(spark, docs).first()["__odd.name"] == 3
