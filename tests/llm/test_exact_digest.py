import hashlib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from lectern.llm import exact_digest as E


def canon(t):
    n = lambda s: unicodedata.normalize("NFKC", s)
    return re.sub(r"\s+", " ", n(n(t).casefold())).strip(" ")


def test_canonical_form(spark):
    texts = ["", "  A\t\nb ", "ﬁne Straße", "É é", "ＡＢＣ １", "a b c　d", "İ", "ΑΣ ας"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", E.canonical(F.col("t")).alias("c"))
    assert {r.t: r.c for r in df.collect()} == {t: canon(t) for t in texts}


def rows_of(n=60):
    rng = random.Random(8)
    base = [" ".join(rng.choice(["Alpha", "beta", "é", "ﬁ", "x\ty", "\U0001f600"]) for _ in range(rng.randint(0, 30))) for _ in range(20)]
    rows = [(rng.randint(0, 10**6), rng.choice(base)) for _ in range(n)]
    return list(dict(rows).items()) + [(-5, None), (-6, ""), (-7, "ab"), (-8, "A " * 30000), (-9, " a" * 30000)]


def test_edits_and_likeness(spark):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h1": F.lit(1), "next": F.lit("n"), "k": F.lit(2)}).repartition(5)
    got = {r.doc_id: r for r in E.edited_likeness(spark, docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    least = {}
    for i, t in reversed(order):
        least.setdefault(canon(t or ""), i)
    prints = {}
    for at, (i, t) in enumerate(order):
        t, after = t or "", order[(at + 1) % len(order)][1] or ""
        k = len(t) // 3
        edit, r = t[: len(t) - k] + after[:k], got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert r.near_next == float(canon(t) == canon(after)) and r.near_edited == float(canon(t) == canon(edit)) and r.exact_class == least[canon(t)]
        for c, f in ((canon(t), r.fingerprint), (canon(edit), r.edited_fingerprint)):
            assert prints.setdefault(c, f) == f and len(f) == 32
    assert len(set(prints.values())) == len(prints)


def test_byte_comparison_tells_colliding_texts_apart(spark, monkeypatch):
    monkeypatch.setattr(E, "halves", lambda canon: (F.length(canon).cast("long"), F.lit(0).cast("long")))  # a poor hash
    docs = spark.createDataFrame([(1, "aa"), (2, "BB"), (3, "bb"), (4, "AA"), (5, "c")], "doc_id long, text string")
    got = {r.k: r.cls for r in E.classes(spark, docs).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 1, 5: 5}


def test_repeats_nulls_and_no_rows(spark):
    rows = [(1, "ab c"), (1, "ab c"), (1, "other"), (None, "x"), (2, None)]
    got = E.edited_likeness(spark, spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 1), (False, 1), (False, 2), (True, 0)]
    assert E.edited_likeness(spark, spark.createDataFrame([], "doc_id int, text string")).count() == 0
    alone = E.edited_likeness(spark, spark.createDataFrame([(1, "abcdef")], "doc_id int, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and alone.near_next == 1.0
