"""The conversation trie against prefixes that are written out."""

import hashlib
import random
import zlib
from collections import defaultdict

from lectern.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, every=100, heads=6):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(l)] for c, l in own.items()}
    made = {}
    for c, l in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % every) * (1 if c > 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + l[h:])
    members = defaultdict(list)
    for c, l in made.items():
        for d in range(len(l) + 1):
            members[l[:d]].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    saved, leaves = {}, {}
    for k in sorted(members, key=len, reverse=True):
        saved[k] = (len(members[k]) - 1) * len(k[-1][1] if k else "") + sum(saved[x] for x in children[k])
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in members[k] if made[c] == k))).encode()).hexdigest()
    return sorted((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], digest(k)) for k in members)


def found(spark, rows):
    turns = P.in_order(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(r) for r in P.trie(spark, *P.branched(turns)).collect())


def test_against_prefixes_written_out(spark):
    draw = random.Random(5)
    rows = []
    for c in [*range(0, 40), *range(95, 130), 250, 1000, -7]:
        for t in range(draw.choice([0, 1, 2, 3, 5, 9, 17, 33])):
            rows.append((c, t if draw.random() > 0.1 else None, draw.choice(["user", "user", None]), draw.choice(["a", "a", "a", "bé", "", None])))
    rows += [(None, 0, "user", "of none"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "bot", "tie")]
    assert found(spark, rows) == brute(rows)


def test_one_long_conversation_and_hot_beginnings(spark):
    rows = [(200, t, "user", f"t{t % 3}") for t in range(300)] + [(c, t, "user", "same") for c in range(300, 380) for t in range(4)]
    assert found(spark, rows) == brute(rows)


def test_nothing_and_turnless(spark):
    assert found(spark, []) == []
    # base 100 is absent and the own turns are all among the first h: members of the root alone
    short = [(c, 0, "user", "x") for c in range(101, 130)]
    assert found(spark, short) == brute(short)


def test_names_are_dense(spark):
    rows = spark.createDataFrame([(i % 7, str(i % 5)) for i in range(300)], "a long, b string")
    got = sorted(r.n for r in P.dense_names(rows, ["a", "b"], "n").collect())
    assert got == list(range(35))
