"""Seeded search against the whole distance table of every pair."""

import random
from itertools import combinations

import pytest

from lectern.operators import search as S


def plain(needle, text):
    """(distance, end): the least edit distance of needle to a part of text, and the first end it has."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(needle, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min((d, j) for j, d in enumerate(row))


def whole(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(draw, text, edits):
    s = list(text)
    for _ in range(edits):
        i = draw.randrange(len(s))
        kind = draw.randrange(3)
        if kind == 0:
            s[i] = "#"
        elif kind == 1:
            del s[i]
        else:
            s.insert(i, "+")
    return "".join(s)


def test_all_pairs_within_the_distance(spark):
    draw = random.Random(6)
    letters = lambda n: "".join(draw.choice("abc ") for _ in range(n))
    needles = [letters(draw.choice([8, 13, 40, 41, 90])) for _ in range(12)] + ["the the the the ", "é🙂é🙂é🙂é🙂 éé"]
    texts = [letters(draw.choice([0, 5, 60, 400])) for _ in range(20)] + ["the " * 40, "", None]
    for n in needles:
        texts += [letters(30) + edited(draw, n, draw.randrange(0, 2 + len(n) // 8)) + letters(25), edited(draw, n, 1), n[2:], n * 3]
    asked, held = spark.createDataFrame([*enumerate(needles), (99, None)], "needle_id int, needle string"), spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    found = S.search(asked, held, share=0.12, least=1)
    assert sorted(found.collect()) == sorted(S.search(asked, held, share=0.12, least=1, wanted_rows=5).collect())
    got = {(r.needle_id, r.text_id): r for r in found.collect()}
    n_found = 0
    for i, n in enumerate(needles):
        most = max(int(0.12 * len(n)), 1)
        for j, t in enumerate(texts):
            d, end = plain(n, t or "")
            if t is None or d > most:
                assert (i, j) not in got
            else:
                r = got[i, j]
                assert (r.distance, r.end) == (d, end) and whole(n, t[r.start : r.end]) == d
                n_found += 1
    assert n_found == len(got) > 40


def test_the_rarest_pieces():
    draw = random.Random(2)
    for _ in range(60):
        size, n = draw.randrange(1, 4), draw.randrange(6, 11)
        costs, k = [draw.randrange(9) for _ in range(n)], draw.randrange(1, 3)
        ways = [c for c in combinations(range(n), k) if all(b - a >= size for a, b in zip(c, c[1:]))]
        got = S.rarest_pieces(costs, size, k)
        assert tuple(got) in ways and sum(costs[i] for i in got) == min(sum(costs[i] for i in c) for c in ways)


def test_needles_shorter_than_their_errors_are_refused(spark):
    one = spark.createDataFrame([(1, "a")], "needle_id int, needle string")
    with pytest.raises(Exception, match="longer than the errors"):
        S.search(one, spark.createDataFrame([(1, "abc")], "text_id int, text string")).collect()
    assert S.search(one.limit(0), spark.createDataFrame([(1, "abc")], "text_id int, text string")).collect() == []


def test_wanted_grams_are_looked_for_by_rolling_hashes(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choice("abé🙂") for _ in range(draw.choice([0, 1, 2, 7, 50, 900]))) for _ in range(60)]
    grams = sorted({t[i : i + k] for t in texts[::7] for k in (1, 3, 6) for i in range(0, max(0, len(t) - k), 40)} | {"zzz", "\U0010ffff"})
    wanted = S._Wanted(grams, [1, 3, 6, 9])
    expected = sorted((w, i, t[i : i + k]) for w, t in enumerate(texts) for k in (1, 3, 6) for i in range(len(t) - k + 1) if t[i : i + k] in grams)
    assert sorted(wanted.places(texts)) == expected and len(expected) > 100
    held = spark.createDataFrame([*enumerate(texts), (99, None)], "text_id int, text string")
    asked = spark.createDataFrame([(g,) for g in grams], "gram string")
    for most in (10_000, 1):  # in parts of ten places, and by the join
        assert sorted(map(tuple, S._met(held, asked, [1, 3, 6], most, 10).collect())) == expected
