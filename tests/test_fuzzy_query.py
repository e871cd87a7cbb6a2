"""The registered query of the approximate search against brute force on a small fixture."""

import random

from lectern import catalog


def brute(needle, hay):
    """The least edit distance of the needle to any part of hay."""
    row = [0] * (len(hay) + 1)
    for i, a in enumerate(needle, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(hay, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_whole_passages_are_looked_for_in_all_turns_that_begin_alike(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passages = [(1, f"Alpha {words(30)}"), (2, f"beta {words(25)}"), (3, f"Gamma {words(8)}")]
    end = passages[0][1][90:]
    said = {7: ["alpha " + words(5), f"{words(9)} {passages[0][1]} {words(9)}", end], 8: ["Beta " + words(4), passages[1][1], None], 9: ["other", passages[2][1]]}
    turns = [(c, i, "user", t) for c, texts in said.items() for i, t in enumerate(texts)]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {(r.item_id, r.conv_id, r.turn): r for r in catalog.queries()["fuzzy_match"](spark, str(tmp_path)).collect()}
    asked = {(i, None, None): f"Before. {t} After." for i, t in passages} | {(i, c, k): said[c][k] for i, c in ((1, 7), (2, 8)) for k in range(3)}
    assert found.keys() == asked.keys()
    for key, hay in asked.items():
        text = dict(passages)[key[0]]
        needle = "".join("#" if i % 40 == 20 else x for i, x in enumerate(text))
        r, least = found[key], None if hay is None else brute(needle, hay)
        if least is None or least > len(needle) // 4:
            assert r.distance is None
        else:
            assert r.distance == least and brute(needle, hay[r.start : r.end]) == least
    assert found[1, None, None].distance >= 3 and found[1, 7, 1].distance == found[1, None, None].distance and found[1, 7, 0].distance is None
