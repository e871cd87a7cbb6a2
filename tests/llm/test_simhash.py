import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import simhash as S


def brute_print(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    for t in (None, "", " \t\n", "one", "One two", "a b c", "A b c d a b c", "É é ÀA\x0bb c", "x y z " * 3000, "word " * 70000):
        assert S.fingerprint_of(t) == brute_print(t), t


def test_masks_cover_every_pair_of_bits():
    for radius in (2, 4):
        masks = [m & (2**64 - 1) for m in S.covering_masks(radius)]
        assert len(masks) == 2 ** (radius + 1) - 1
        rng = random.Random(1)
        pairs = [(i, j) for i in range(64) for j in range(i)] if radius == 2 else [tuple(rng.sample(range(64), 4)) for _ in range(3000)]
        assert all(any(not any(m >> b & 1 for b in bits) for m in masks) for bits in pairs)


@pytest.mark.parametrize(("radius", "up_to"), [(2, 32), (2, 1), (2, 4), (4, 32), (4, 2)])
def test_links_have_the_components_of_all_pairs(spark, radius, up_to):
    rng = np.random.default_rng(7)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    for x in list(prints)[:12]:
        for _ in range(12):
            y = x
            for b in rng.integers(0, 63, rng.integers(1, 6)):
                y ^= 1 << int(b)
            prints.add(y)
    prints = sorted(prints)
    from lectern.operators.components import connected_components

    got = dict(connected_components(S.links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius, up_to)).collect())
    want = brute_components(prints, radius)
    assert [got.get(p, p) for p in prints] == [prints[r] for r in want]


def test_whole_operator(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(12)]
    texts = [None, "", "  ", "one", "ONE"] + base + [b + " tail" for b in base] + [b.upper() for b in base[:4]] + ["long " * 30000]
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"fp": F.lit(1), "root": F.lit("r"), "id": F.lit(0)})
    got = {r.doc_id: r for r in S.near_duplicates(spark, docs).collect()}
    prints = [brute_print(t) for t in texts]
    roots = brute_components(prints, 2)
    for i in range(len(texts)):
        assert got[100 - i].fp & (2**64 - 1) == prints[i]
        assert got[100 - i].component_id == min(100 - j for j in range(len(texts)) if roots[j] == roots[i])


def test_keep_one(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g"), (9, None), (8, ""), (7, "something else altogether here now")]
    docs = spark.createDataFrame([(*r, i, "q") for i, r in enumerate(rows)], "doc_id long, text string, row long, tie string")
    kept = S.keep_one(spark, docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, rows[1][1]), (7, rows[6][1]), (8, "")]
    assert S.keep_one(spark, docs.limit(0)).count() == 0 and S.near_duplicates(spark, docs.limit(0)).count() == 0


def cosine(a, b, k=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    return len(sets[0] & sets[1]) / (len(sets[0]) * len(sets[1])) ** 0.5


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_similar_texts_are_found_and_others_are_not(spark):
    rng = random.Random(11)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in [60] * 10 + [250] * 25 + [1500] * 5]
    texts = base + [edited(rng, t, max(1, len(t.split()) // 55)) for t in base] + [edited(rng, t, len(t.split()) // 8) for t in base]
    shared = " ".join(f"passage{i}" for i in range(40))
    texts += [f"{shared} " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(120)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in S.keep_one(spark, docs).collect()}
    n = len(base)
    close = [i for i in range(n) if cosine(texts[i], texts[n + i]) >= 0.8]
    assert len(close) >= 30 and not any(n + i in kept for i in close)
    assert set(range(n)) <= kept and set(range(2 * n, len(texts))) <= kept
    assert all(n + i in kept for i in range(n) if i not in close)


def test_recall_of_pairs_near_the_threshold():
    """Of pairs whose cosine is 0.8 to 0.86, of all sizes, 99 in a hundred and more share a class fingerprint."""
    rng = random.Random(21)
    found = n = 0
    while n < 600:
        size = rng.choice((12, 25, 60, 150, 400, 1200))
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(size))
        other = edited(rng, text, rng.randint(1, max(1, size // 25)))
        if not 0.8 <= cosine(text, other) <= 0.86:
            continue
        n += 1
        a, b = (set(S.class_fingerprints(S.shingle_hashes(t, 5))) for t in (text, other))
        found += bool(a & b)
    assert found / n >= 0.99


def test_a_large_group_of_near_copies_goes_to_one(spark):
    rng = random.Random(12)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    docs = spark.createDataFrame([(i, edited(rng, text, 1)) for i in range(400)] + [(1000, text)], "doc_id long, text string")
    assert S.keep_one(spark, docs).count() == 1


def test_copies_hang_together_by_a_text_that_is_no_representative(spark):
    rng = random.Random(13)
    hub = [f"w{rng.randrange(5000)}" for _ in range(200)]
    copies = []
    for _ in range(520):  # seven words replaced, far from each other
        w = list(hub)
        for at in range(0, 196, 28):
            w[at + 5 + rng.randrange(18)] = f"new{rng.randrange(10**9)}"
        copies.append(" ".join(w))
    texts = [" ".join(hub), *copies]
    assert all(cosine(texts[0], c) >= 0.8 for c in copies)
    assert sum(cosine(a, b) < 0.8 for a, b in zip(copies, copies[1:])) > 500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in S.keep_one(spark, docs).collect()] == [0]


def test_all_links_of_a_family_on_one_template_are_found(spark):
    """Texts of a long template, alike in pairs: groups are large, and no text is central."""
    rng = random.Random(17)
    template = [f"t{i}" for i in range(150)]
    texts = []
    for _ in range(150):
        own = template + [f"v{rng.randrange(10**9)}" for _ in range(60)]
        other = list(own)
        for at in rng.sample(range(160, 205), 3):
            other[at] = f"new{rng.randrange(10**9)}"
        texts += [" ".join(own), " ".join(other)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if cosine(texts[i], texts[j]) >= 0.8]
    assert pairs == [(i, i - 1) for i in range(1, 300, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (S.BLOCK_SHINGLES, 5000):
        kept = {r.doc_id for r in S.keep_one(spark, docs, block=block).collect()}
        assert sum(i not in kept for i, _ in pairs) >= 149 and set(range(0, 300, 2)) <= kept
