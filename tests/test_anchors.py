"""A book aligned in pieces between anchors, against the book aligned in turn."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from lectern.operators import align, anchors


def a_book(spark, seed, chapters, n):
    """A book and what was heard of it: sentences left out, words misheard, things said in between, two audio files, characters beyond 16 bits."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(2, 9))) for _ in range(900)] + ["smile🙂"]
    sentence = lambda: " ".join(draw.choice(vocabulary) for _ in range(draw.choice([2, 7, 9, 12, 16]))).capitalize() + draw.choice(".!?")
    told = [[sentence() for _ in range(n)] for _ in range(chapters)]
    heard = ["This is a recording of the book."]
    for chapter in told:
        for s in chapter:
            kind = draw.random()
            if kind < 0.06:
                continue
            w = s.split(" ")
            if kind < 0.25:
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
            heard.append(" ".join(w))
            if kind > 0.97:
                heard.append("Well then.")
    text = " ".join(heard)
    words, at = [], 0
    for i, w in enumerate(text.split(" ")):
        size = len(w.encode("utf-16-le")) // 2
        half = i > text.count(" ") // 2
        t = i * 0.5 - (text.count(" ") // 2 * 0.5 if half else 0.0)
        words.append((1, i, t, t + 0.4, at, at + size, "b.mp3" if half else "a.mp3"))
        at += size + 1
    c = spark.createDataFrame([(1, i, f"c{i}", s) for i, s in enumerate(told)], "book_id int, ord int, chapter_id string, sentences array<string>")
    w = spark.createDataFrame(words, "book_id int, ord int, start_s double, end_s double, start_off long, end_off long, audiofile string")
    t = spark.createDataFrame([(1, text)], "book_id int, transcript string")
    tracks = spark.createDataFrame([(1, "a.mp3", 5000.0), (1, "b.mp3", 6000.0)], "book_id int, href string, duration_s double")
    return c, w, t, tracks


def test_pieces_give_what_the_whole_book_gives(spark):
    book = a_book(spark, 3, 4, 90)
    want = sorted(map(tuple, align.align_books(*book).collect()))
    got = sorted(map(tuple, anchors.align_pieces(*book, every=40).collect()))
    assert len(want) > 250 and got == want
    flat = book[0].selectExpr("book_id", "ord", "chapter_id", "posexplode(sentences) AS (id, text)")
    chain = anchors.anchors(flat.selectExpr("book_id", "cast(ord * 90 + id AS long) AS n", "text"), book[2]).orderBy("n").collect()
    assert len(chain) > 100 and all(a.offset < b.offset for a, b in zip(chain, chain[1:]))


def test_books_without_anchors_are_one_piece(spark):
    c, w, t, tracks = a_book(spark, 5, 2, 8)
    assert sorted(map(tuple, anchors.align_pieces(c, w, t, tracks, every=4, anchor_words=60).collect())) == sorted(map(tuple, align.align_books(c, w, t, tracks).collect()))
    assert anchors.align_pieces(c.limit(0), w, t, tracks).count() == 0


def test_rising():
    draw = random.Random(1)
    for _ in range(50):
        p = [draw.randrange(20) for _ in range(draw.randrange(0, 12))]
        got = anchors.rising(p)
        best = 0
        for m in range(1 << len(p)):
            s = [x for i, x in enumerate(p) if m >> i & 1]
            if all(a < b for a, b in zip(s, s[1:])):
                best = max(best, len(s))
        assert len(got) == best and all(p[a] < p[b] for a, b in zip(got, got[1:]))


def cut_between_words(draw, text):
    """(at, part) of the text, at places before or behind white space, in code units."""
    places = sorted(draw.sample([i for i in range(1, len(text)) if text[i].isspace() or text[i - 1].isspace()], 60))
    parts, at = [], 0
    for begin, end in zip([0, *places], [*places, len(text)]):
        parts.append((at, text[begin:end]))
        at += len(text[begin:end].encode("utf-16-le")) // 2
    return parts


@pytest.mark.parametrize("words", [1, 2, 5, 40])
def test_sequences_of_words_pass_over_the_ends_of_parts(spark, words):
    draw = random.Random(words)
    texts = ["".join(draw.choice(["one", "Two’s", "é", "🙂", "x_y", ".", "   "]) + " " for _ in range(400)) for _ in range(2)] + ["a b", "  "]
    want = []
    for book, text in enumerate(texts):
        found = list(anchors._words(align.code_units(text)))
        want += [(book, found[i][0], anchors._gram([w for _, w in found[i : i + words]])) for i in range(len(found) - words + 1)]
    parts = [(book, at, part) for book, text in enumerate(texts[:2]) for at, part in cut_between_words(draw, text)] + [(2, 0, "a"), (2, 1, " "), (2, 2, "b"), (3, 0, "  ")]
    table = anchors.transcript_parts(spark.createDataFrame(parts, "book_id int, at long, transcript string"))
    assert sorted((r.book_id, r.offset, bytes(r.gram)) for r in anchors._heard(table, words).collect()) == sorted(want)
    table = anchors.transcript_parts(spark.createDataFrame(list(enumerate(texts)), "book_id int, transcript string"), 50)
    assert table.count() > 40 and sorted((r.book_id, r.offset, bytes(r.gram)) for r in anchors._heard(table, words).collect()) == sorted(want)


def test_transcripts_in_parts_and_odd_books(spark):
    c, w, t, tracks = a_book(spark, 9, 3, 60)
    parts = cut_between_words(random.Random(2), t.first().transcript)
    odd = spark.createDataFrame([(2, 0, "d0", ["Nothing is heard of this one.", None, ""]), (3, 0, "e0", ["There is no transcript here."]), (4, 0, "f0", []), (5, 0, "g0", ["There are no words for this."])], c.schema)
    told = c.union(odd)
    files = tracks.union(spark.createDataFrame([(5, "a.mp3", 10.0)], tracks.schema))
    timeless = w.union(spark.createDataFrame([(2, 0, None, None, None, None, None), (4, 0, 0.0, 1.0, 0, 5, "a.mp3")], w.schema))
    whole = t.union(spark.createDataFrame([(2, ""), (4, "Hello there."), (5, "There are no words for this.")], t.schema))
    cut = spark.createDataFrame([(1, *p) for p in parts] + [(2, 0, None), (4, 0, "Hello"), (4, 5, " there."), (5, 0, "There are no words for this.")], "book_id int, at int, transcript string")
    want = sorted(map(tuple, align.align_books(c, w, t, tracks).collect()))
    assert len(want) > 100
    for heard in (whole, cut):
        assert sorted(map(tuple, anchors.align_pieces(told, timeless, heard, files, every=20).collect())) == want


def test_times_that_are_not_known_stay_null(spark):
    c = spark.createDataFrame([(1, 0, "c0", ["The first one is heard here.", "And the second one follows it."])], "book_id int, ord int, chapter_id string, sentences array<string>")
    text = "The first one is heard here. And the second one follows it." + " And so on it goes." * 300
    w = spark.createDataFrame([(1, 0, None, None, 0, 28, "a.mp3"), (1, 1, 3.0, 4.0, 29, 60, "b.mp3")], "book_id int, ord int, start_s double, end_s double, start_off long, end_off long, audiofile string")
    t = spark.createDataFrame([(1, text)], "book_id int, transcript string")
    tracks = spark.createDataFrame([(1, "b.mp3", 9.0)], "book_id int, href string, duration_s double")
    got = sorted(map(tuple, anchors.align_pieces(c, w, t, tracks).collect()))
    assert got == [(1, "c0", 0, None, None, "a.mp3"), (1, "c0", 1, 3.0, 4.0, "b.mp3")]


def test_a_passage_is_cut_as_it_is_come_to():
    text = "This is a sentence. " * 100_000
    window = align.Passage(text, 0)
    assert window.find("this is a sentence.") == (0, 19)
    window.move(19)
    assert len(window.pieces) < 30


def test_words_of_a_piece_are_held_as_numbers():
    n, batch = 200_000, 10_000
    columns = [pa.array([0.5] * batch), pa.array([0.9] * batch), pa.array(range(batch)), pa.array(range(batch)), pa.array(["a.mp3"] * batch)]
    words = pa.StructArray.from_arrays(columns, ["start_s", "end_s", "start_off", "end_off", "audiofile"])
    tracemalloc.start()
    piece = anchors._Piece(1, 0)
    for _ in range(n // batch):
        piece.time(words)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(piece.words.audiofile) == len(piece.words.start_off) == n and held < 60 * n
