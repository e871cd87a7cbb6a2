import math
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import merge_dropout as M

pytestmark = pytest.mark.skipif(not os.path.exists(M.MODEL), reason="no tokenizer model")


@pytest.fixture(scope="module")
def pieces():
    return M.Pieces(M.MODEL)


def texts():
    rng = random.Random(9)
    words = ["the", "tionally", "Straße", "été", "日本", "😀", "x" * 40, "a\nb", "\t", "▁", "1234567", "  ", "don't"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    return ["", " ", "▁", "\x00\x7f", "y" * 5000, " lead", "trail ", "é é", "word " * 20000] + made


def test_without_dropout_it_is_the_library(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=M.MODEL)
    e = M.Encoder(pieces, 0.0, 1)
    for t, got in zip(texts(), e.encode_all(texts()), strict=True):
        if "▁" not in t:
            assert got.tolist() == sp.encode(t), t


def test_dropout_is_lossless_varied_and_repeatable(pieces):
    all_ = texts()
    got = M.Encoder(pieces, 0.2, 5).encode_all(all_)
    assert [pieces.decode(g) for g in got] == all_
    again = M.Encoder(pieces, 0.2, 5, remember=50)  # a small memory changes nothing
    assert [again.encode(t) for t in all_] == [g.tolist() for g in got]
    other = M.Encoder(pieces, 0.2, 6).encode_all(all_)
    assert sum(a.tolist() != b.tolist() for a, b in zip(got, other, strict=True)) > 50
    plain = M.Encoder(pieces, 0.0, 5).encode_all(all_)
    assert sum(map(len, got)) > sum(map(len, plain))


M64 = 2**64 - 1


def mixed(h):
    h = ((h ^ h >> 33) * 0xFF51AFD7ED558CCD) & M64
    h = ((h ^ h >> 33) * 0xC4CEB9FE1A85EC53) & M64
    return h ^ h >> 33


def brute_force(pieces, text, rate, seed):
    """The ids of a text by the plainest agenda: one list of symbols, every candidate looked at again in each step."""
    out = []
    for place, word in enumerate(re.findall("▁*[^▁]+|▁+", "▁" + text.replace(" ", "▁")) if text else []):
        key = mixed(xxhash.xxh64_intdigest(text, seed) ^ mixed(place + 1))
        symbols, dead, step, n_skips = [(c, i) for i, c in enumerate(word)], set(), 0, 0

        def next_skip(after):
            u = ((mixed((key + (n_skips + 1) * 0x9E3779B97F4A7C15) & M64) >> 11) + 0.5) / 2**53
            return after + 1 + int(math.log(u) / math.log1p(-rate)) if rate else None

        skip = next_skip(-1)
        while True:  # a skipped pair is a new one when a neighbour merged: its symbols are others
            live = [(pieces.rank[a[0] + b[0]], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a[0] + b[0] in pieces.rank and (a, b) not in dead]
            if not live:
                break
            _, i = min(live)
            if step == skip:
                dead.add((symbols[i], symbols[i + 1]))
                n_skips += 1
                skip = next_skip(skip)
            else:
                symbols[i : i + 2] = [(symbols[i][0] + symbols[i + 1][0], symbols[i][1])]
            step += 1
        for s, _ in symbols:
            out += [pieces.ids[s]] if s in pieces.ids else [pieces.bytes[x] for x in s.encode()]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5])
def test_it_is_the_plainest_agenda(pieces, rate):
    rng = random.Random(4)
    letters = lambda k: "".join(rng.choice("etaoinshrdluéß0日") for _ in range(k))
    texts = [" ".join(letters(rng.choice((1, 3, 7, 12, 31, 32, 33, 60))) for _ in range(12)) for _ in range(25)]
    texts += ["international information of the nations " * 3, "a\nb\t\x00", "  two   blanks  ", "x" * 100 + " the", ""]
    for seed in (3, 4):
        got = M.Encoder(pieces, rate, seed).encode_all(texts)
        assert [g.tolist() for g in got] == [brute_force(pieces, t, rate, seed) for t in texts]


def test_a_word_is_cut_in_dozens_of_ways(pieces):
    for word in ("internationalization", "internationalization" * 3):
        texts = [f"{i} {word}" for i in range(400)]
        encoder = M.Encoder(pieces, 0.1, 3)
        ways = {tuple(encoder.pieces.pieces[i] for i in g.tolist())[len(str(n)) :] for n, g in enumerate(encoder.encode_all(texts))}
        assert len(ways) > 36


def test_full_dropout_leaves_characters(pieces):
    [got] = M.Encoder(pieces, 0.9999999, 1).encode_all(["hello"])
    assert [pieces.pieces[i] for i in got.tolist()] == [b" ", b"h", b"e", b"l", b"l", b"o"]


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "long " * 30000), (None, "ü")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "e": F.lit("x"), "ids": F.lit(0)})
    made = M.encode_rows(spark, docs)
    assert made.columns == [*docs.columns, "__ids", "__lossless"]
    back = made.select("text", "__lossless", M.decode(spark, F.col("__ids")).alias("back")).collect()
    assert len(back) == 6 and all(r.text == r.back and r["__lossless"] is (None if r.text is None else True) for r in back)
    assert M.encode_rows(spark, docs.limit(0)).count() == 0
    one = made.where("doc_id = 3").select("__ids").collect()
    assert one[0] == one[1]


def test_added_names_that_are_taken(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, __ids int, __IDS_ int, `odd.name` int")
    made = M.encode_rows(spark, docs)
    assert made.columns == [*docs.columns, "__ids__", "__lossless"]
    [row] = made.collect()
    assert row[2:5] == (5, 6, 7) and row[6] is True


def test_every_occurrence_is_cut_on_its_own(pieces):
    rate, n = 0.1, 20_000
    [got] = M.Encoder(pieces, rate, 3).encode_all([" ".join(["a"] * n)])
    [[whole]] = [g.tolist() for g in M.Encoder(pieces, 0.0, 3).encode_all(["a"])]
    assert abs((got == whole).sum() / n - (1 - rate)) < 0.01  # a word of one merge
    # each first candidate is skipped at the rate, whatever the word
    first = [M.gaps(M._mix(np.arange(200_000, dtype=np.uint64)), k, rate) for k in (0, 1)]
    assert all(abs((f == 0).mean() - rate) < 0.005 and abs((f == 1).mean() - rate * (1 - rate)) < 0.005 for f in first)
