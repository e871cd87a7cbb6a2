import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from lectern.llm import language_id, merge_dropout

from .test_line_index import brute as brute_lines
from .test_merge_dropout import brute_force as brute_pieces
from .test_mixture import brute_draws, brute_targets, place_of
from .test_simhash import brute_print, cosine


def brute_near(docs):
    """The least id of each group of texts that are within two bits, or whose cosine is 0.8 or more: every pair is looked at."""
    prints, root = [brute_print(t, 5) for _, t in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [{w.lower() for w in t.split()} for _, t in docs]
    for i, (_, a) in enumerate(docs):
        for j, (_, b) in enumerate(docs[:i]):
            if bin(prints[i] ^ prints[j]).count("1") <= 2 or (len(bags[i] & bags[j]) >= 0.4 * max(len(bags[i]), len(bags[j])) and cosine(a, b) >= 0.8):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {min(docs[j][0] for j in range(len(docs)) if find(j) == k) for k in {find(i) for i in range(len(docs))}}


@pytest.mark.skipif(not Path(merge_dropout.MODEL).exists(), reason="no tokenizer model")
def test_the_run_is_the_plainest_run(spark, sf_dir):
    """Stage after stage without Spark, but for the trained model's weights and the hash that places documents."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, model = raw.collect(), language_id.train(raw)
    found = [model.predict(r.text) for r in rows]
    kept = [(r.doc_id, r.source, r.text) for r, (lang, _, ambiguous) in zip(rows, found, strict=True) if lang != "und" and not ambiguous]
    text = {i: t for i, t, *_ in brute_lines([(i, t) for i, _, t in kept], 40, 5)}
    kept = [(i, s, text[i]) for i, s, _ in kept]
    ones = brute_near([(i, t) for i, _, t in kept])
    kept = [r for r in kept if r[0] in ones]
    size = {i: len(t.encode().split()) for i, _, t in kept}
    sizes = {}
    for i, s, _ in kept:
        sizes[s] = sizes.get(s, 0) + size[i]
    passes, _ = brute_draws(kept, place_of(spark, size), brute_targets(sizes), size)
    pieces = merge_dropout.Pieces(merge_dropout.MODEL)
    want = sorted((i, s, tuple(brute_pieces(pieces, t, 0.1, 11))) for i, s, t in kept for _ in passes[i])
    assert len(want) > 100 and sorted((r.doc_id, r.source, tuple(r.ids)) for r in P.run(spark, sf_dir).collect()) == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    now = docs
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, "/root/testdata/sf0.001")
        assert now.schema.names == docs.schema.names and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema], name
        now = spark.createDataFrame(now.toPandas(), docs.schema)
        assert now.count() > 0.5 * docs.count()
    last = P.STAGES[-1][1](spark, now, "")
    assert last.count() == now.count() and last.where("not lossless").isEmpty()


def test_stages_with_nulls_odd_columns_and_nothing(spark):
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    un, one = "un deux trois quatre", "one two three four"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, one, "en", "a", 13), (2, one, "en", "a", 13), (3, un, "fr", None, 13), (None, "!!", "en", "b", 2), (7, one + " " + "very long " * 20000, "en", "a", 1)]
    odd = ["odd.name", "__n_lines", "__ids", "__lossless", "id", "row", "place", "block", "draws", "size", "tid", "found", "copy", "o"]
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(f"x{i}") for i, c in enumerate(odd)})
    found = {}
    for name, stage in P.STAGES:
        got = stage(spark, docs, "")
        if name != "sentencepiece":
            assert got.columns == docs.columns
            assert got.select(*[f"`{c}`" for c in odd]).distinct().collect() in ([], [tuple(f"x{i}" for i in range(len(odd)))])
        found[name] = sorted(((r.doc_id, r.source) for r in got.collect()), key=str)
        assert stage(spark, docs.limit(0), "").count() == 0
    key = lambda *which: sorted([(rows[i][0], rows[i][3]) for i in which], key=str)
    assert found["language_id"] == key(2, 3, 4, 6)
    assert found["line_dedup"] == key(0, 1, 2, 3, 4, 5, 6)
    assert found["simhash_near_dedup"] == key(1, 2, 4, 5, 6)
    assert {x for x in found["source_mixing"] if x[0] not in (None, 1)} <= set(key(2, 4, 6))
    assert found["sentencepiece"] == key(0, 1, 2, 3, 4, 5, 6)
    text = {r.doc_id: (r.text, r.n_chars) for r in P.drop_shared_lines(spark, docs.where("text is null or doc_id = 3"), "").collect()}
    assert text == {None: ("", 0), 3: (un, 20)}
    bare = P.drop_shared_lines(spark, docs.drop("n_chars"), "")
    assert bare.columns == [c for c in docs.columns if c != "n_chars"]
    pieces = {r.doc_id: r for r in P.encode_pieces(spark, docs.where("doc_id is null and text is null or doc_id = 1"), "").collect()}
    assert (pieces[None].n_pieces, pieces[None].lossless, pieces[None].ids) == (None, None, None) and (pieces[1].n_pieces, pieces[1].lossless) == (0, True)


def test_decisions_take_effect(spark):
    line = "This very long line of boilerplate is in all of the documents here."
    words = lambda i: " ".join(f"word{(i * 37 + k * 11) % 97}" for k in range(60))
    rows = [(i, f"{words(i)}\n{line}", "en", f"s{i % 3}", 1) for i in range(12)] + [(50, words(3) + "\n" + line, "en", "s0", 1), (51, "!!! 123", "en", "s0", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema)
    kept = P.identify_language(spark, docs, "")
    assert 51 not in [r.doc_id for r in kept.collect()] and kept.count() == 13
    cut = P.drop_shared_lines(spark, kept, "").collect()
    assert [r.doc_id for r in cut if line in r.text] == [50] and all(r.n_chars == len(r.text) for r in cut)
    one = P.drop_near_duplicates(spark, docs, "")
    assert {3, 50} - {r.doc_id for r in one.collect()} == {50}
    mixed = P.mix_sources(spark, docs.withColumn("n_chars", F.col("n_chars")), "")
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
