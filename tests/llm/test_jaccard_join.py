"""The Jaccard join against all pairs of word sequences, written out."""

import random

import numpy as np

from lectern.llm import jaccard_join as J
from lectern.llm import tiles as T


def brute(rows, k=5, percent=80):
    sets = []
    for _, text in rows:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[of(i)] = of(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[of(i)] = min(least.get(of(i), key), key)
    return sorted((key, len(sets[i]), least[of(i)]) for i, (key, _) in enumerate(rows))


def found(spark, rows, **more):
    docs = spark.createDataFrame([(t, i, "c") for i, t in rows], "text string, doc_id long, tid string").repartition(3)
    return sorted(tuple(r) for r in J.jaccard_components(spark, docs, **more).collect())


def corpus(seed, n=260):
    """Unrelated texts, families of near copies around the threshold, chains, a template shared by many, lines shared by more."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(3000)}"
    line = " ".join(word() for _ in range(14))
    template = [word() for _ in range(60)]
    texts = []
    while len(texts) < n:
        kind = draw.randrange(5)
        base = [word() for _ in range(draw.choice([3, 8, 40, 90, 200]))]
        if kind == 0:
            texts.append(" ".join(base))
        elif kind == 1:
            texts += [" ".join(base), line + "\n" + " ".join(base)]
        elif kind == 2:  # near copies: a few words changed each
            for _ in range(draw.choice([2, 3, 12])):
                own = list(base)
                for _ in range(draw.randrange(1, 4)):
                    own[draw.randrange(len(own))] = word()
                texts.append(" ".join(own).upper() if draw.random() < 0.2 else " ".join(own))
        elif kind == 3:  # a chain: each is like the next
            for at in range(0, 5):
                texts.append(" ".join(base[at * len(base) // 60 :] + [word() for _ in range(at)]))
        else:  # a template, filled in: around the threshold
            texts += [" ".join(template + [word() for _ in range(draw.choice([2, 5, 6, 7, 8, 12]))]) for _ in range(9)]
    return [(1000 + i, t) for i, t in enumerate(texts)]


def test_against_all_pairs(spark):
    rows = corpus(1)
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(rows) - 40
    assert found(spark, rows) == want
    # small blocks, nothing or much in the order's end: the same links
    assert found(spark, rows, block=400, common=0) == want
    assert found(spark, rows, block=50, seen=2, common=5000) == want


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO\n"), (6, "one two three"), (7, "É é"), (8, "é É"), (9, long), (10, long + " end"), (10, "ten"), (11, "ten"), (12, "ten"), (12, "ten"), (13, "a a a a a a a a"), (14, "a a a a a"), (15, "a a a a")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_null_ids_keep_their_links(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h i j k"), (5, "a b c d e f g h i j k l")], "doc_id long, text string")
    assert sorted(tuple(r)[1:] for r in J.jaccard_components(spark, docs).collect()) == [(7, 5), (8, 5)]


def test_prefixes_of_linked_sets_meet():
    draw = np.random.default_rng(3)
    common = np.unique(draw.integers(0, 1 << 63, 50, dtype=np.uint64))
    rank = draw.permutation(len(common))
    for _ in range(300):
        n = int(draw.integers(1, 60))
        a = np.unique(np.concatenate([draw.integers(0, 1 << 63, n, dtype=np.uint64), draw.choice(common, int(draw.integers(0, 40)))]))
        b = np.unique(np.concatenate([a[draw.random(len(a)) < 0.93], draw.integers(0, 1 << 63, int(draw.integers(0, 3)), dtype=np.uint64)]))
        overlap = len(np.intersect1d(a, b))
        if 100 * overlap >= 80 * (len(a) + len(b) - overlap):
            assert len(np.intersect1d(J.prefix(a, T.Jaccard(80), common, rank), J.prefix(b, T.Jaccard(80), common, rank)))
        words = min(len(T.bitmap(a)), len(T.bitmap(b)))
        apart = int(np.bitwise_count(T._folded(T.bitmap(a), words) ^ T._folded(T.bitmap(b), words)).sum()) if len(b) else 0
        assert 2 * overlap <= len(a) + len(b) - apart


def test_bits_lose_nothing(spark):
    from lectern.llm import bit_filter as B

    values = np.unique(np.random.default_rng(5).integers(0, 1 << 40, 3000))
    bits = B.Bits(dict(B.chunks(values)))
    assert bits.holds(values).all() and not bits.holds(values[np.diff(values, append=1 << 41) > 1] + 1).any()
    assert not B.Bits({}).holds(values).any() and not list(B.chunks(values[:0]))
    rows = spark.createDataFrame([(None,), *((i,) for i in range(500))], "id long")
    keys = spark.createDataFrame([(None,), (7,), (400,)], "k long")
    kept = {r[0] for r in B.passing(rows, "id", keys, "k").collect()}
    assert {None, 7, 400} <= kept and len(kept) < 20


def test_shingles_of_one_class_are_not_shuffled_with_rows(spark, monkeypatch):
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in map(seen.apply, range(seen.size()))}
    for module in (J, T):  # as with tables beyond the bounds
        monkeypatch.setattr(module, "broadcast_if_small", lambda df, *_: df, raising=False)
    draw = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join(f"w{draw.randrange(10**6)}" for _ in range(300))) for i in range(120)] + [(200 + i, " ".join([*base, *"abcd"[:i]])) for i in range(4)]
    seen = store.stageList(None, False, False, none, None)
    before = stages()
    assert found(spark, rows) == brute(rows)
    seen = store.stageList(None, False, False, none, None)
    written = sum(n for k, n in stages().items() if k not in before)
    assert written < 124 * 60  # their firsts, once; it was twice and more
