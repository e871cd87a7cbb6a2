import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import mixture as M


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Shared by weight, stopped at the caps, the excess shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = float(sum(sizes.values())), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        for s in free:
            target[s] += left * w[s] / total
        left = sum(max(0.0, target[s] - most * sizes[s]) for s in free)
        over = {s for s in free if target[s] >= most * sizes[s]}
        for s in over:
            target[s] = float(most * sizes[s])
        free -= over
    return target


def corpus(seed=1, n=900):
    rng = random.Random(seed)
    sources = ["hot"] * 12 + ["a", "b", "É", "z", None, "tiny", "Z"]
    rows = [(i, rng.choice(sources), " ".join("w" * rng.randint(1, 3) for _ in range(int(rng.paretovariate(1.1) * 4) % 3000))) for i in range(n)]
    return rows + [(n, "tiny", None), (n + 1, "empty", ""), (n + 2, "empty", None), (n + 3, "one", "x " * 9000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def place_of(spark, ids, seed=17):
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return {r[0]: r[1] for r in df.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1)).collect()}


def brute_draws(rows, place, target, size):
    """(taken in which passes, by document; blocks in which order, by source): one source after the other, one document after the other."""
    passes, blocks = {}, {}
    for s in {r[1] for r in rows}:
        docs = sorted((place[i], i) for i, own, _ in rows if own == s)
        total = sum(size[i] for _, i in docs)
        whole = int(target[s] // total) if total else 0
        rest = target[s] - whole * total
        bits = max(0, math.ceil(math.log2(len(docs) / 16)))
        assert bits <= 8
        for _, i in docs:
            passes[i] = list(range(whole))
        blocks[s] = (sorted({p >> (63 - bits) for p, _ in docs}), whole, bits)
        if rest <= 0:
            continue
        at, left = 0, rest
        while size[docs[at][1]] <= left:
            left -= size[docs[at][1]]
            passes[docs[at][1]].append(whole)
            at += 1
        # of each part of an octave the smallest and the largest, from large to small
        parts = {}
        for p, i in docs[at:]:
            if size[i]:
                parts.setdefault(math.floor(8 * math.log2(size[i])), []).append((size[i], p, i))
        seen = sorted({x for v in parts.values() for x in (min(v), max(v, key=lambda x: (x[0], -x[1])))}, reverse=True)
        over, took = None, set()
        if left >= 0.5:
            for n, p, i in seen:
                if n <= left:
                    left -= n
                    took.add(i)
                else:
                    over = (n, p, i)
            unseen = [min(v)[0] for v in parts.values() if len(v) > 2]
            if unseen and min(unseen) <= left:  # in rounds
                low, limit = 0, left
                while left >= 1:
                    again = [(p, i) for p, i in docs[at:] if p >= low and i not in took and size[i] <= limit]
                    for p, i in again:
                        if size[i] > left:
                            low = p
                            break
                        left -= size[i]
                        took.add(i)
                    else:
                        break
                    limit = left
            elif over and over[0] - left < left:
                took.add(over[2])
        for i in took:
            passes[i].append(whole)
        blocks[s] = (*blocks[s], docs[at][0] >> (63 - bits))
    return passes, blocks


@pytest.mark.parametrize("seed", [1, 2])
def test_it_takes_what_the_plainest_mix_takes(spark, seed):
    rows = corpus(seed) + [(2000 + i, "ones", "w") for i in range(700)] + [(5000, "ones", "w " * 5000)]
    got = M.mix_report(spark, frame(spark, rows).withColumns({"block": F.lit(1), "place": F.lit("p"), "size": F.lit(0), "draws": F.lit(2)})).collect()
    assert len(got) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in rows}
    of = {i: s for i, s, _ in rows}
    sizes = {}
    for i, s in of.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    target = brute_targets(sizes)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    place = place_of(spark, of)
    passes, blocks = brute_draws(rows, place, {of[r.doc_id]: r.target for r in got}, size)
    shards = {}
    for r in got:
        s, draws = of[r.doc_id], [tuple(map(int, d.split(":"))) for d in r.draws.split(",") if d]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s]) and r.target == pytest.approx(target[s])
        assert [p for p, _ in draws] == passes[r.doc_id] and r.taken == r.size * len(draws) <= 3 * r.size
        block = place[r.doc_id] >> (63 - blocks[s][2])
        last = blocks[s][1]
        for p, k in draws:  # a block is in one shard in each pass; what fills the last pass comes with its last block
            key = (s, p, blocks[s][3] if p == last and block >= blocks[s][3] else block)
            assert shards.setdefault(key, k) == k
    # each source's blocks, pass after pass, lie in the shards in rising runs, and all shards hold as many, but for one
    unit = {}
    for (s, p, b), k in shards.items():
        unit.setdefault(s, []).append((p, blocks[s][0].index(b), k))
    for s, listed in unit.items():
        assert [k for *_, k in sorted(listed)] == sorted(k for *_, k in listed)
    taken = {s: sum(size[i] * len(passes[i]) for i in of if of[i] == s) for s in sizes}
    for s in sizes:
        untaken = [size[i] for i in of if of[i] == s and size[i] and len(passes[i]) <= blocks[s][1]]
        if taken[s] > target[s] + 1:  # one document more, as it misses by less than half of itself
            assert taken[s] - target[s] <= max(size[i] for i in of if of[i] == s) / 2
        else:
            assert target[s] - taken[s] < max(1, min(untaken, default=1))
    again = M.mix_report(spark, frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(again) == sorted(got)


def test_leaves_are_draws_without_replacement(spark):
    """The number of a source's blocks in a shard is hypergeometric: its mean, and its variance over many seeds."""
    q = {"a": 60, "b": 30, "c": 10}
    df = spark.createDataFrame(list(q.items()), "source string, blocks long")
    counts = {s: [] for s in q}
    for seed in range(12):
        leaves = M.split_quotas(df, F.lit(2), seed).collect()
        for s, n in q.items():
            of = [sum(r.blocks for r in leaves if r.source == s and r.shard == k) for k in range(4)]
            assert sum(of) == n
            counts[s] += of
        assert all(sum(r.blocks for r in leaves if r.shard == k) == 25 for k in range(4))
    for s, n in q.items():
        p = n / 100
        variance = 25 * p * (1 - p) * 75 / 99
        mean = sum(counts[s]) / 48
        assert mean == pytest.approx(25 * p)
        assert 0.5 * variance < sum((x - mean) ** 2 for x in counts[s]) / 48 < 1.7 * variance


def test_the_mix_has_what_the_report_says(spark):
    rows = corpus(3, 300)
    docs = frame(spark, rows).withColumn("extra", F.col("doc_id") * 2)
    copies = {r.doc_id: r.draws.count(":") for r in M.mix_report(spark, docs).collect() if r.draws}
    mixed = M.mix_documents(spark, docs)
    assert mixed.columns == docs.columns
    found = [r.doc_id for r in mixed.collect()]
    assert {i: found.count(i) for i in set(found)} == copies and found != sorted(found)


def test_the_tree_keeps_its_sums(spark):
    q = {"a": 300, "b": 51, "c": 1, None: 20}
    df = spark.createDataFrame([(s, n) for s, n in q.items()], "source string, blocks long")
    leaves = M.split_quotas(df, F.lit(3), 5).collect()
    for s, n in q.items():
        assert sum(r.blocks for r in leaves if r.source == s) == n
    sums = [sum(r.blocks for r in leaves if r.shard == k) for k in range(8)]
    assert sum(sums) == 372 and max(sums) - min(sums) <= 1
    share = [sum(r.blocks for r in leaves if r.shard == k and r.source == "a") for k in range(8)]
    assert all(25 <= x <= 46 for x in share) and len(set(share)) > 1  # as drawn without replacement, not dealt in turn


def test_small_and_odd_tables(spark):
    assert M.mix_report(spark, frame(spark, [])).count() == 0 and M.mix_documents(spark, frame(spark, [])).count() == 0
    only = M.mix_report(spark, frame(spark, [(1, None, "a b c")])).first()
    assert (only.target, only.taken) == (3.0, 3)
    none = M.mix_report(spark, frame(spark, [(1, "a", None), (2, "b", "")])).collect()
    assert all(r.taken == 0 and r.target == 0 for r in none)
    twice = M.mix_report(spark, frame(spark, [(1, "a", "x y"), (1, "a", "x y"), (None, "b", "z " * 10), (None, None, "z " * 10)])).collect()
    assert len(twice) == 4 and len({r.taken for r in twice if r.doc_id == 1}) == 1
