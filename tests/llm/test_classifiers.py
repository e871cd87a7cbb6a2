import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import language_id as L
from lectern.llm import toxicity as T
from lectern.llm.queries import op6_toxicity, op9_language_id

SF = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    got = {r.doc_id: r for r in op9_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values()) and sum(r.ambiguous for r in got.values()) < 0.01 * len(docs)


def test_languages_of_odd_texts(spark):
    fit = lambda texts, langs: L.fit([L.sparse(t) for t in texts], langs)
    m = fit(["the cat and the dog " * 3, "der hund und die katze " * 3, "le chat et le chien " * 3], ["en", "de", "fr"])
    assert m.predict(None) == ("und", 0.0, True) and m.predict("") == ("und", 0.0, True) and m.predict("12 !?\n") == ("und", 0.0, True)
    assert m.predict("the dog")[0] == "en" and m.predict("und die")[0] == "de" and m.predict("le chien " * 50000)[0] == "fr"
    assert fit([], []).predict("abc")[0] == "und" and fit(["abc"], ["xx"]).predict("q")[:2] == ("xx", 1.0)
    docs = spark.createDataFrame([(1, "the cat", "en", 0), (2, "42", None, 0), (3, None, "en", 0), (3, "le chat", "fr", 0)], "doc_id long, text string, lang string, found int")
    kept = L.reject_unclear(spark, docs, m)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["le chat", "the cat"]
    assert L.train(docs.limit(0)).languages == () and L.train(docs.where("lang is null")).languages == ()


@pytest.mark.parametrize("n", [2, 3, 5, 9, 40])
def test_codewords_are_apart(n):
    c = L.codewords(n)
    assert c.shape[0] == n and set(np.unique(c)) <= {-1, 1}
    apart = min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i))
    assert apart >= max(1, c.shape[1] // 4) and (np.abs(c.sum(axis=0)) < n).all()


def test_grams_cover_whole_texts():
    a, b = "abc " * 400_000, "abc " * 400_000 + "zzzz" * 200_000
    assert not np.allclose(L.grams(a), L.grams(b)) and np.linalg.norm(L.grams(b)) == pytest.approx(1, abs=1e-4)


def test_grams_are_counts(spark):
    """Against a count of n-grams, one after the other."""
    for text in ("Ab ab", "é", "日本 x", "word " * 40):
        points, counts = [ord(c) for c in " " + text.lower() + " "], np.zeros(L.WIDTH)
        for k in (1, 2, 3):
            for i in range(len(points) - k + 1):
                h = points[i] * 0x9E3779B1 % 2**32
                for c in points[i + 1 : i + k]:
                    h = ((h ^ h >> 15) * 0x85EBCA6B + c * 0xC2B2AE35) % 2**32
                counts[h >> 18] += 1
        x = np.sqrt(counts) / np.sqrt(counts.sum())
        assert np.allclose(L.grams(text), x, atol=1e-6) and np.allclose(L.dense([L.sparse(text)])[0], x, atol=1e-6)


def test_decoding_is_the_nearest_codeword_by_loss():
    texts = [w * 5 for w in ("the cat ", "der hund ", "le chat ", "el gato ")]
    m = L.fit([L.sparse(t) for t in texts], ["en", "de", "fr", "es"])
    for text in ("the hund", "le gato", "cat", "der der chat"):
        x = [float(v) for v in L.grams(text)]
        out = [sum(x[i] * float(m.weights[i, b]) for i in range(L.WIDTH) if x[i]) + float(m.bias[b]) for b in range(m.codes.shape[1])]
        loss = {name: sum(float(m.trust[b]) * math.log1p(math.exp(-int(code[b]) * out[b])) for b in range(len(out))) for name, code in zip(m.languages, m.codes, strict=True)}
        lang, score, ambiguous = m.predict(text)
        first, second = sorted(loss, key=loss.get)[:2]
        assert lang == first and ambiguous == (loss[second] - loss[first] < m.margin)
        assert score == pytest.approx(1 / sum(math.exp(loss[first] - v) for v in loss.values()), rel=1e-3)


def test_copies_of_a_text_take_no_other_languages_place(spark):
    rows = [("copy of one text", "aa")] * 3000 + [(f"text number {i} of this", "bb") for i in range(50)] + [(f"noch ein text {i} hier", "cc") for i in range(50)]
    m = L.train(spark.createDataFrame(rows, "text string, lang string").withColumns({"each": F.lit(0), "draw": F.lit("d"), "rows": F.lit(1)}), per_language=40)
    assert m.languages == ("aa", "bb", "cc") and m.predict("noch ein text 77 hier")[0] == "cc" and m.predict("text number 99 of this")[0] == "bb"


def plain_nnpu(positive, unlabelled, ids, prior, steps, rate=0.05, decay=1e-4):
    """Text after text, feature after feature: (weights, bias, whether a step went against the estimate)."""
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    w, b = dict.fromkeys(ids, 0.0), math.log(prior / (1 - prior))
    m, v, mb, vb, against = dict.fromkeys(ids, 0.0), dict.fromkeys(ids, 0.0), 0.0, 0.0, False
    for t in range(1, steps + 1):
        score = lambda x: sigmoid(b + sum(w.get(int(i), 0.0) for i in x))  # noqa: B023, E731
        sp, su = [score(x) for x in positive], [score(x) for x in unlabelled]
        negative = sum(su) / len(su) - prior * sum(sp) / len(sp)
        below = negative < 0
        against |= below
        gw, gb = {i: decay * w[i] for i in ids}, 0.0
        for texts, scores, slope in (
            (positive, sp, lambda s: prior * s * (1 - s) / len(positive) * (1 if below else -2)),  # noqa: B023
            (unlabelled, su, lambda s: s * (1 - s) / len(unlabelled) * (-1 if below else 1)),  # noqa: B023
        ):
            for x, s in zip(texts, scores, strict=True):
                gb += slope(s)
                for i in x:
                    if int(i) in gw:
                        gw[int(i)] += slope(s)
        scale = rate * math.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        for i in ids:
            m[i], v[i] = 0.9 * m[i] + 0.1 * gw[i], 0.99 * v[i] + 0.01 * gw[i] ** 2
            w[i] -= scale * m[i] / (math.sqrt(v[i]) + 1e-7)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        b -= scale * mb / (math.sqrt(vb) + 1e-7)
    return w, b, against


@pytest.mark.parametrize(("prior", "steps", "expect"), [(0.2, 3, False), (0.2, 40, True), (0.9, 40, True)])
def test_it_is_the_plainest_nnpu(prior, steps, expect):
    rng = np.random.default_rng(5)
    positive = [np.array([k, 7, 7]) for k in rng.integers(0, 3, 40)]
    unlabelled = [np.array([k]) for k in rng.integers(1, 6, 200)] + [np.array([7])] * 8
    ids = T.select(positive, unlabelled).tolist()
    assert 7 in ids
    got = T.fit(positive, unlabelled, prior, steps=steps)
    w, b, against = plain_nnpu(positive, unlabelled, ids, prior, steps)
    assert against == expect and got.ids.tolist() == ids
    assert got.bias == pytest.approx(b, abs=1e-6) and got.weights.tolist() == pytest.approx([w[i] for i in ids], abs=1e-4)


def test_queries_over_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert op6_toxicity(spark, str(tmp_path)).count() == 0 and op9_language_id(spark, str(tmp_path)).count() == 0


def test_toxicity_with_odd_columns_and_repeats(spark):
    docs = spark.createDataFrame([(i % 90, "you stupid idiot" if i % 3 == 0 else f"nice day {i % 30}", 1, "x") for i in range(300)], "doc_id long, text string, toxic int, d string").withColumn("w", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "t") for i in range(60)], "doc_id long, toxic int, text string")
    model = T.train(docs, labels)
    scores = [r.s for r in docs.select(T.scores(spark, model, F.col("text")).alias("s"), "text").collect() if r.text.startswith("you")]
    assert len(set(scores)) == 1 and scores[0] > model.score("nice day 3")


def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in op6_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [x for x in labels if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    hit = sum(got[x.doc_id].predicted for x in held if x.toxic)
    assert hit / sum(x.toxic for x in held) > 0.8 and hit / max(1, sum(got[x.doc_id].predicted for x in held)) > 0.9
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_learning_from_positives_alone():
    rng = np.random.default_rng(0)
    clean = lambda: " ".join(f"w{rng.integers(0, 400)}" for _ in range(60))
    toxic = lambda: clean() + " " + " ".join(rng.choice(["idiotic", "idiots", "stupid", "trash"], 3))
    positive = [T.features(toxic()) for _ in range(150)]
    unlabelled = [T.features(toxic() if i % 10 == 0 else clean()) for i in range(1500)]
    m = T.fit(positive, unlabelled, 0.1)
    assert np.mean([m.score(toxic()) > 0.5 for _ in range(200)]) > 0.95 and np.mean([m.score(clean()) > 0.5 for _ in range(200)]) < 0.02
    assert m.score("idiotish stupid trash") > 0.5  # unseen forms of known stems
    assert m.score(None) == m.score("") == m.score(" ... ") < 0.5


def test_toxicity_without_examples(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert T.train(docs, labels).score("a") < 0.5 and T.train(docs.limit(0), labels.limit(0)).score("") < 0.5
    bad = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, toxic int")
    assert 0 <= T.train(docs, bad).score("a") <= 1


def test_copies_take_one_place_of_the_sample(spark, monkeypatch):
    """Half of all rows are copies of one text: the unlabelled sample still holds about as many different texts as it is asked for."""
    seen = []
    monkeypatch.setattr(T, "fit", lambda bad, rest, prior, *a: seen.append((bad, rest)))
    rows = [(i, "the copy" if i % 2 else f"text {i} is one of its own") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(4000)], "doc_id long, toxic int")
    T.train(docs, labels, positives=50, unlabelled=600)
    bad, rest = seen[0]
    assert 450 < len(rest) <= 800 and len({x.tobytes() for x in rest}) == len(rest) and 20 <= len(bad) <= 100
