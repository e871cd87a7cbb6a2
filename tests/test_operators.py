import random
import sys

import pytest
from pyspark.sql import functions as F

from lectern.operators import align, inspect, lookups, pages, spans, toc, validate
from lectern.operators.components import connected_components
from lectern.operators.ordering import Ranged, global_index, in_turn

from lectern.streaming import playback

from .conftest import rows

SPAN = "book_id int, ord int, id string, audio_src string, clip_begin_ms double, clip_end_ms double"


def test_audio_order(spark):
    s = spark.createDataFrame([(1, 0, "a", "c1", 0.0, 5.0), (1, 1, "b", "c2", 9.0, 9.0), (1, 2, "c", "c3", 1.0, 2.0), (1, 3, "d", "c2", 1.0, 2.0), (1, 4, "e", "gone", 0.0, 1.0)], SPAN)
    m = spark.createDataFrame([(1, i, h) for i, h in enumerate(["stinger", "c3", "c2", "c1"])], "book_id int, ord int, href string")
    assert [r[1] for r in rows(spans.audio_order(s, m), "position")] == ["c1", "c3", "c2", "stinger"]
    untimed = s.withColumn("clip_end_ms", F.col("clip_begin_ms"))
    assert [r[1] for r in rows(spans.audio_order(untimed, m), "position")] == ["stinger", "c3", "c2", "c1"]


def test_split_by_characters_and_area(spark):
    s = spark.createDataFrame([("s1", 0.0, 900.0), ("s2", 100.0, 200.0), ("s3", -1.0, -1.0), ("s1__p0", 0.0, 1.0)], "id string, clip_begin_ms double, clip_end_ms double")
    metrics = [("s1", 0, 3, 0.0), ("s1", 1, 6, 0.0), ("s2", 0, 0, 750.0), ("s2", 3, 0, 250.0), ("s3", 0, 3, 1.0), ("s3", 1, 3, 1.0)]
    m = spark.createDataFrame(metrics, "span_id string, page_index int, chars long, area double")
    got = rows(spans.split_over_pages(s, m), "id", "page_index")
    assert got == [("s1", 0, "s1__p0_1", 0.0, 300.0), ("s1", 1, "s1__p1", 300.0, 900.0), ("s2", 0, "s2__p0", 100.0, 175.0), ("s2", 3, "s2__p3", 175.0, 200.0)]


def test_offsets(spark):
    t = spark.createDataFrame([(1, 0, "a", 10.0), (1, 1, "b", 5.0)], "book_id int, ord int, href string, duration_ms double")
    o = spans.audio_offsets(t)
    assert [r[4:] for r in rows(o, "ord")] == [(0.0, 10.0, 15.0), (10.0, 15.0, 15.0)]
    s = spark.createDataFrame([(1, 0, "x", "b", 1.0, 2.0), (1, 1, "y", "b", -1.0, -1.0), (1, 2, "z", "?", 1.0, 2.0)], SPAN)
    moved = spans.apply_audio_offsets(s, o.withColumnRenamed("href", "audio_src"), ("book_id", "audio_src"))
    assert [(r.clip_begin_ms, r.clip_end_ms) for r in moved.orderBy("ord").collect()] == [(11.0, 12.0), (-1.0, -1.0), (1.0, 2.0)]


def test_encoder_plans(spark):
    t = spark.createDataFrame([(1, 1, "b's.mp3", 5.0), (1, 0, "a.mp3", 10.0)], "book_id int, ord int, href string, duration_ms double")
    [plan] = spans.concat_plan(spans.audio_offsets(t), "m4a").collect()
    assert plan.list == "file 'a.mp3'\nfile 'b'\\''s.mp3'" and plan.arguments[-6:] == ["list.txt", "-c:a", "aac", "-b:a", "48k", "audio.m4a"] and plan.output == "audio.m4a"


def test_spans_by_id_and_pages_by_place(spark):
    s = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (2, 0, "a")], "book_id int, ord int, id string")
    asked = spark.createDataFrame([(1, "a"), (1, "x"), (2, "a")], "book_id int, span_id string")
    assert [(r.book_id, r.span_id, r.found and r.found.ord) for r in lookups.span_by_id(asked, s, "book_id").orderBy("book_id", "span_id").collect()] == [(1, "a", 1), (1, "x", None), (2, "a", 0)]
    p = spark.createDataFrame([(1, 7), (1, 3), (2, 5)], "book_id int, page_index int")
    at = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "book_id int, place long")
    assert [(r.book_id, r.place, r.found and r.found.page_index) for r in lookups.page_at(at, p, "book_id").orderBy("book_id", "place").collect()] == [(1, 0, 3), (1, 1, 7), (1, 2, None), (2, 0, 5)]


def test_compact_ids(spark):
    s = spark.range(40).select(F.lit(1).alias("book_id"), F.col("id").alias("ord"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("id"))
    assert [r.new_id for r in spans.compact_ids(s).orderBy("ord").collect()][-5:] == ["sz", "s10", "s11", "s12", "s13"]
    with pytest.raises(Exception, match="duplicate span id"):
        spans.compact_ids(s.union(s.limit(1))).collect()


def test_gaps_look_at_the_one_before(spark):
    s = spark.createDataFrame([(1, 0, "a", "x", 0.0, 100.0), (1, 1, "b", "x", 10.0, 20.0), (1, 2, "c", "x", 30.0, 40.0), (1, 3, "d", "x", 50.0, 60.0), (1, 4, "u", "x", -1.0, -1.0)], SPAN)
    assert [(r.from_id, r.to_id, r.gap_ms) for r in inspect.gaps(s).orderBy("ord").collect()] == [("b", "c", 10.0), ("c", "d", 10.0)]
    assert inspect.gap_summary(s).first()[1:] == (2, 20.0, 10.0, "b", "c")
    assert inspect.duration_stats(s.limit(0)).first() == (0, 0, 0.0, 0.0, 0.0, 0.0)


def test_asof_buckets_do_not_matter(spark):
    rng = random.Random(3)
    s = spark.createDataFrame([(rng.randint(0, 2), i, float(rng.randint(0, 50)), f"s{i}") for i in range(80)], "k int, ord int, b double, id string")
    p = spark.createDataFrame([(rng.randint(0, 3), i, float(rng.randint(0, 60))) for i in range(60)], "k int, n int, t double")
    live = s.collect()
    for forward in (False, True):
        for strict in (False, True):
            want = {}
            for q in p.collect():
                near = [x for x in live if x.k == q.k and ((x.b > q.t if strict else x.b >= q.t) if forward else (x.b < q.t if strict else x.b <= q.t))]
                best = (min if forward else max)(near, key=lambda x: (x.b, x.ord), default=None)
                want[q.n] = best.id if best else None
            got = lookups.asof(p, s, "k", "t", "b", "ord", ["id"], forward, strict)
            assert {r.n: r.found_id for r in got.collect()} == want, (forward, strict)


def test_one_hot_book_is_many_ranges(spark):
    """Hours of one book, a span without an end, and points of a book without spans."""
    spans_ = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("ord"), (F.col("id") * 3000.0).alias("b"), (F.col("id") * 3000.0 + 2500).alias("e"), F.concat(F.lit("s"), F.col("id")).alias("id"))
    odd = spark.createDataFrame([(1, 9000, 5e6, 1e14, "endless"), (1, 9001, 6e6, float("inf"), "infinite"), (1, 9002, 7e6, 7e6, "empty")], "k int, ord int, b double, e double, id string")
    every = spans_.union(odd)
    points = spark.range(3000).select(F.when(F.col("id") % 100 == 0, 2).otherwise(1).alias("k"), (F.col("id") * 4321.0 + 100).alias("t"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    try:
        last = {(r.k, r.t): r.found_id for r in lookups.asof(points, every, "k", "t", "b", "ord", ["id"]).collect()}
        first = {(r.k, r.t): r.found_id for r in lookups.interval_first(points, every, "k", "t", "b", "e", "ord", ["id"]).collect()}
        assert Ranged(every, "k", "b").rows.select("__part").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    for k, t in last:
        n = int(t // 3000)
        if k == 2:
            assert last[k, t] is None and first[k, t] is None
            continue
        begins = [(n * 3000.0, n, f"s{n}") if n < 4000 else (3999 * 3000.0, 3999, "s3999")] + [x for x in ((5e6, 9000, "endless"), (6e6, 9001, "infinite"), (7e6, 9002, "empty")) if x[0] <= t]
        assert last[k, t] == max(begins)[2]
        want = f"s{n}" if n < 4000 and t - n * 3000.0 < 2500 else "endless" if t >= 5e6 else None
        assert first[k, t] == want, t


def test_windows_over_ranges(spark):
    rng = random.Random(5)
    data = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, float(i)])) for i in range(300)]
    df = spark.createDataFrame(data, "k int, ord int, v double").repartition(5)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = Ranged(df, "k", "ord")
        got = {name: {x.ord: x for x in made.collect()} for name, made in (("p", r.previous(F.col("v"), "x")), ("s", r.sum_before(F.col("v"), "x", "y")), ("n", r.number("x", "y")), ("l", r.last_known(F.col("v"), "x")))}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    for key in (1, 2, None):
        own = [(o, v) for k, o, v in data if k == key]
        known = None
        for n, (o, v) in enumerate(own):
            known = v if v is not None else known
            assert got["p"][o].x == (own[n - 1][1] if n else None) and got["l"][o].x == known
            assert (got["n"][o].x, got["n"][o].y) == (n, len(own))
            assert got["s"][o].x == sum(w for _, w in own[:n] if w is not None) and got["s"][o].y == sum(w for _, w in own if w is not None)
    turns = in_turn(df, "k", "ord", lambda state, row: ((state or 0) + 1, (row[0], row[1], (state or 0) + 1)), "k int, ord int, n long")
    assert all(x.n == got["n"][x.ord].x + 1 for x in turns.collect()) and in_turn(df.limit(0), "k", "ord", lambda s, r: (s, r), "k int, ord int, v double").count() == 0


def test_taps_against_all_rectangles(spark):
    rng = random.Random(6)
    rects = [(rng.randint(0, 1), f"s{i}", i, rng.uniform(-50, 900), rng.uniform(-50, 900), rng.choice([-1.0, 0.0, 5.0, 64.0, 300.0, 5000.0]), rng.choice([0.0, 10.0, 64.0, 2000.0])) for i in range(60)]
    taps = [(rng.randint(0, 2), i, rng.uniform(-100, 1000), rng.uniform(-100, 1000)) for i in range(200)]
    taps += [(r[0], 1000 + i, r[3] + max(r[5], 0), r[4] + r[6]) for i, r in enumerate(rects)]  # corners
    got = lookups.point_in_rect(spark.createDataFrame(taps, "page_index int, tap_id int, tap_x double, tap_y double"), spark.createDataFrame(rects, "page_index int, span_id string, span_pos int, x double, y double, w double, h double"))
    found = {r.tap_id: r.span_id for r in got.collect()}
    for page, tap, x, y in taps:
        hits = [r[2] for r in rects if r[0] == page and r[3] <= x <= r[3] + r[5] and r[4] <= y <= r[4] + r[6]]
        assert found[tap] == (f"s{min(hits)}" if hits else None)


def test_interval_first_in_file_order(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 100.0, "long"), (1, 1, 10.0, 20.0, "short"), (1, 2, 10.0, 10.0, "none")], "k int, ord int, b double, e double, id string")
    p = spark.createDataFrame([(1, 15.0), (1, 100.0), (1, 0.0), (2, 15.0)], "k int, t double")
    got = lookups.interval_first(p, s, "k", "t", "b", "e", "ord", ["id"], least=7.0)
    assert {(r.k, r.t): r.found_id for r in got.collect()} == {(1, 15.0): "long", (1, 100.0): None, (1, 0.0): "long", (2, 15.0): None}


def test_navigation_keeps_levels(spark):
    nav = spark.createDataFrame([(1, 0, None, 0, "Part I", 2), (1, 1, 0, 0, "lost", None), (1, 2, 1, 0, "deep", 3), (1, 3, 0, 1, "Chapter 2", 6), (1, 4, None, 1, "End", 9)], "book_id int, node_id int, parent_id int, sibling_ord int, title string, page_index int")
    flat = toc.flatten(nav)
    assert [r[2:] for r in rows(flat, "position")] == [("Part I", 2, 0), ("deep", 3, 2), ("Chapter 2", 6, 1), ("End", 9, 0)]


NAV = "book_id int, node_id int, parent_id int, sibling_ord int, title string, page_index int"


def test_navigation_in_circles_is_refused(spark):
    good = [(1, 0, None, 0, "a", 1), (1, 1, 0, 0, "b", 2)]
    for bad, said in (
        ([(2, 7, None, 0, "x", 1), (2, 8, 9, 0, "y", 1), (2, 9, 8, 0, "z", 1), (2, 10, 9, 0, "below", 1)], "circle, or below one: 8 of 2, 9 of 2, 10 of 2"),
        ([(2, 5, 5, 0, "own", 1)], "circle, or below one: 5 of 2"),
        ([(2, 5, 4, 0, "lost", 1)], "without their parent: 5 of 2"),
        ([(2, 5, None, 0, "x", 1), (2, 5, None, 1, "y", 1)], "one number: 5 of 2"),
    ):
        with pytest.raises(ValueError, match=said):
            toc.flatten(spark.createDataFrame(good + bad, NAV)).collect()
    assert toc.flatten(spark.createDataFrame([], NAV)).collect() == []


def test_deep_navigation_by_jumps(spark):
    draw = random.Random(9)
    nodes, want = [], []
    for book, size, wide in ((1, 300, 300), (2, 400, 2)):
        for v in range(size):
            parent = None if v == 0 or draw.random() < 0.01 else draw.randrange(max(0, v - wide), v)
            nodes.append((book, v, parent, draw.randrange(3), f"n{v}", None if v % 7 == 3 else v))

    def walk(book, parent, level):
        for r in sorted((r for r in nodes if r[0] == book and r[2] == parent), key=lambda r: (r[3], r[1])):
            if r[5] is not None:
                want.append((book, r[4], level))
            walk(book, r[1], level + 1)

    sys.setrecursionlimit(5000)
    walk(1, None, 0), walk(2, None, 0)
    df = spark.createDataFrame(draw.sample(nodes, len(nodes)), NAV)
    for shallow in (64, 4):  # by paths if all are short enough, by tours
        got = [(r.book_id, r.title, r.level) for r in toc.flatten(df, shallow=shallow).orderBy("book_id", "position").collect()]
        assert got == want
    assert max(x[2] for x in want) > 64


def test_a_chain_of_many_levels(spark):
    chain = spark.range(10_000).selectExpr("1 AS book_id", "cast(id AS int) AS node_id", "cast(if(id = 0, null, id - 1) AS int) AS parent_id", "0 AS sibling_ord", "cast(id AS string) AS title", "1 AS page_index")
    got = toc.flatten(chain)
    assert got.where("position <> level or title <> cast(level AS string)").count() == 0 and got.count() == 10_000


def test_target_issues(spark):
    schema = "ord int, id string, chapter_id string, text_ref string, clip_begin_ms double, clip_end_ms double"
    s = spark.createDataFrame([(0, "a", "ch1", "O/1.xhtml", -1.0, -1.0), (1, "b", "ch1", "O/2.xhtml#p", 0.0, 1.0), (2, "c", "ch1", "O/1.xhtml#zz", 0.0, 1.0), (3, "d", "ch9", "O/1.xhtml#p", 0.0, 1.0), (4, "e", "ch1", "O/1.xhtml#p", 0.0, 1.0)], schema)
    chapters = spark.createDataFrame([("ch1", "O/1.xhtml")], "chapter_id string, xhtml_path string")
    fragments = spark.createDataFrame([("ch1", "p")], "chapter_id string, fragment string")
    shown = spark.createDataFrame([("e",)], "span_id string")
    found = validate.target_issues(s, chapters, fragments, shown, shown.limit(0))
    counts = {r.code: r["count"] for r in validate.issue_counts(found).collect()}
    assert counts == {"smil_textref_missing_fragment": 1, "smil_textref_path_mismatch": 1, "smil_textref_fragment_not_found": 1, "smil_textref_unknown_chapter": 1, "timed_span_without_geometry_text": 3}
    with pytest.raises(ValueError, match="7 issues"):
        validate.require_none(found, "targets")


def test_nearest():
    assert align.nearest("abc", "abc", 0) is None  # a last seed that ends at the end is not looked at
    assert align.nearest("abc", "abcd", 0) == (0, 3, 0)
    assert align.nearest("abcde", "xbcde..", 1) is None  # its only seed is hit by the error
    assert align.nearest("hello world", "say hallo world now", 2) == (4, 15, 1)
    with pytest.raises(ValueError):
        align.nearest("a", "abc", 2)


def test_extension_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(2000):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(0, n))) for n in (10, 14))
        most = rng.randint(0, 5)
        row, best = list(range(len(p) + 1)), None
        if len(p) <= most:
            best = (len(p), 0)
        for j, ch in enumerate(t, 1):
            new = [j]
            for i in range(1, len(p) + 1):
                new.append(min(row[i - 1] + (ch != p[i - 1]), row[i] + 1, new[i - 1] + 1))
            row = new
            if row[-1] <= most and (best is None or row[-1] <= best[0]):
                best = (row[-1], j)
        assert align._extend(len(p), align._masks(p), t, most) == ((0, 0) if not p else best)


RANGE = "chapter_id int, id int, start_s double, end_s double, audiofile string"


def test_ranges(spark):
    r = lambda *x: spark.createDataFrame([(1, *y) for y in x], RANGE)
    assert rows(align.fill_gaps(r((2, 1.0, 2.0, "a"), (3, 2.0, 3.0, "a"))), "id")[:2] == [(1, 0, -1.0, -1.0, "a"), (1, 1, -1.0, -1.0, "a")]
    assert [x[1] for x in rows(align.fill_gaps(r((0, 1.0, 2.0, "a"), (3, 2.0, 3.0, "a"))), "id")] == [0, 1, 2, 3]
    assert rows(align.widen_empty(r((0, 0.0, 5.0, "a"), (1, 4.0, 8.0, "a"))), "id")[1][2] == 5.0
    assert rows(align.widen_empty(r((0, 0.0, 5.0, "a"), (1, 5.0, 5.0, "a"))), "id")[1][3] == pytest.approx(5.001)
    assert rows(align.widen_empty(r((0, 0.0, 5.0, "a"), (1, -1.0, -1.0, "a"), (2, 4.0, 6.0, "a"))), "id")[1:] == [(1, 1, 5.0, -1.0, "a"), (1, 2, 4.0, 6.0, "a")]
    assert align.chapter_durations(r((0, 0.0, 5.0, "a"), (1, 5.0, 10.0, "a"), (2, 10.0, 15.0, "a"), (3, 15.0, 20.0, "a"))).first()[1] == 20
    assert align.chapter_durations(r((0, 10.0, 15.0, "a"), (1, 15.0, 20.0, "a"), (2, 0.0, 5.0, "b"), (3, 5.0, 10.0, "b"))).first()[1] == 20


def test_alignment_finds_its_own_words(spark):
    told = ["This is the first sentence here.", "Then comes another one to hear.", "Finally the last of them ends."]
    text = " ".join(told) + " And more talk." * 400
    words, at = [], 0
    for i, w in enumerate(text.split(" ")):
        words.append((1, i, i * 0.5, i * 0.5 + 0.4, at, at + len(w), "a.mp3"))
        at += len(w) + 1
    w = spark.createDataFrame(words, "book_id int, ord int, start_s double, end_s double, start_off long, end_off long, audiofile string")
    c = spark.createDataFrame([(1, 0, "c", told)], "book_id int, ord int, chapter_id string, sentences array<string>")
    t = spark.createDataFrame([(1, text)], "book_id int, transcript string")
    tracks = spark.createDataFrame([(1, "a.mp3", 60.0)], "book_id int, href string, duration_s double")
    got = rows(align.align_books(c, w, t, tracks), "id")
    assert [(r[2], r[3]) for r in got] == [(0, 0.0), (1, 3.0), (2, 6.0)] and got[0][4] == 3.0
    s = align.ranges_to_spans(align.align_books(c, w, t, tracks), F.lit("O/c.xhtml")).orderBy("ord").first()
    assert (s.id, s.text_ref, s.clip_begin_ms, s.clip_end_ms) == ("c-sentence0", "O/c.xhtml#c-sentence0", 0.0, 3000.0)


def test_ranges_are_closed_by_what_follows():
    r = lambda *x: align.Range(*x)
    ranges = [r(0, 1.0, 1.5, "a"), r(1, 2.0, 2.5, "a"), r(3, 4.0, 4.5, "a"), r(4, 0.5, 0.9, "b"), r(6, 2.0, 3.0, "c")]
    before = r(9, 0.1, 0.2, "a")
    align.close_ranges(ranges, {"a": 60.0, "b": 70.0}, before)
    assert [x.end for x in ranges] == [2.0, 2.5, 60.0, 0.9, 3.0] and before.end == 1.0
    for first, end in ((r(2, 5.0, 6.0, "a"), 0.2), (r(2, 5.0, 6.0, "b"), 60.0), (r(0, 5.0, 6.0, "b"), 60.0)):
        before = r(9, 0.1, 0.2, "a")
        align.close_ranges([first], {"a": 60.0}, before)
        assert before.end == end


def test_the_window_slides_and_gives_up():
    rng = random.Random(3)
    talk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)) + "." for _ in range(16)]
    text = " ".join(talk)
    starts = [m.start() for m in __import__("re").finditer(r"\S+", text)]
    ends = [m.end() for m in __import__("re").finditer(r"\S+", text)]
    words = align.Words([float(i) for i in range(len(starts))], [i + 0.5 for i in range(len(starts))], starts, ends, ["a"] * len(starts))
    absent = ["Zq xkcd vvw jjqpz wqqk.", "Bnm lkj hgf dsa poiu.", "Qaz wsx edc rfv tgby."]
    wanted = [talk[0], *absent, talk[12], "A-B. 1", talk[13]]
    found, offset = align.sentence_ranges(0, text, words, wanted, 0, {"a": 99.0})
    at = lambda k: float(text[: text.index(talk[k])].count(" "))
    assert [(x.id, x.start) for x in found] == [(0, at(0)), (4, at(12)), (6, at(13))] and offset == text.index(talk[13]) + len(talk[13])
    assert found[1].end == at(13) - 0.5  # the next is not its neighbour: it ends with its own last word
    assert align.sentence_ranges(0, text, words, absent, 5, {})[0] == [] and align.sentence_ranges(0, text, words, absent, 5, {})[1] == 5


def test_a_chapter_closes_the_one_before(spark):
    told = [["This is the first sentence here.", "Then comes another one to hear."], ["Finally the last of them ends."]]
    text = " ".join(sum(told, [])) + " And more talk." * 400
    words, at = [], 0
    for i, w in enumerate(text.split(" ")):
        words.append((1, i, i * 0.5, i * 0.5 + 0.4, at, at + len(w), "a.mp3"))
        at += len(w) + 1
    w = spark.createDataFrame(words, "book_id int, ord int, start_s double, end_s double, start_off long, end_off long, audiofile string")
    c = spark.createDataFrame([(1, i, f"c{i}", t) for i, t in enumerate(told)], "book_id int, ord int, chapter_id string, sentences array<string>")
    tracks = spark.createDataFrame([(1, "a.mp3", 60.0)], "book_id int, href string, duration_s double")
    got = rows(align.align_books(c, w, spark.createDataFrame([(1, text)], "book_id int, transcript string"), tracks), "chapter_id", "id")
    assert [(r[1], r[2], r[3], r[4]) for r in got] == [("c0", 0, 0.0, 3.0), ("c0", 1, 3.0, 6.0), ("c1", 0, 6.0, 8.9)]


def test_sentence_filter(spark):
    df = spark.createDataFrame([("CHAPTER 12.",), ("The END",), ("Call me.",), ("Oh! A-b",)], "s string")
    assert [r[0] for r in df.where(align.is_long_enough(F.col("s"))).collect()] == ["Call me.", "Oh! A-b"]
    assert align.sentences_of('A b. "C!" d?  e') == ["A b.", '"C!"', "d?", "e"] and "".join(align._with_gaps("A b.  C! ")) == "A b.  C! "


def test_tokens_are_looked_for_ahead():
    assert align.token_offsets("The cat. the dog", ["the", "cat", "THE", "fish", "dog"]) == [9, None, None, None, 13]
    assert align.token_offsets("One two", ["One", "Two", "x"]) == [0, 4, None]


def test_transcripts_join(spark):
    p = spark.createDataFrame([(1, 0, "ab "), (1, 1, "c😀"), (1, 2, ""), (1, 3, "d")], "book_id int, ord int, text string")
    assert [r.shift for r in align.join_transcripts(p).orderBy("ord").collect()][:2] == [0, 3]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_global_index(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("x")).repartition(7)
    assert all(r.x == r["index"] for r in global_index(df, "x").collect())


def test_styles(spark):
    r = spark.createDataFrame([(0, 0, "b"), (0, 1, "a"), (1, 0, "b"), (1, 1, "c")], "page int, pos int, font string")
    d = pages.style_dictionary(r, ["font"], "page", "pos")
    assert rows(d.select("font", "style_id"), "style_id") == [("b", 0), ("a", 1), ("c", 2)]
    bad = spark.createDataFrame([(9,)], "style_id long")
    with pytest.raises(Exception, match="unknown style id"):
        pages.decode_styles(bad, d, ["font"]).collect()


def test_resources(spark):
    q = spark.createDataFrame([("https://epub.local/a.css", "other"), ("https://epub.local/b.png", "image"), ("https://x.example/c.css", "stylesheet"), ("https://epub.local/ok.css", "stylesheet"), ("data:x", "image")], "url string, resource_type string")
    got = validate.resource_outcomes(q, spark.createDataFrame([("ok.css",)], "path string"))
    assert {r.url[-5:]: (r.outcome, r.severity) for r in got.collect()} == {"a.css": ("missing", "fatal"), "b.png": ("missing", "warning"), "c.css": ("blocked", "fatal"), "k.css": ("ok", None), "ata:x": ("inline", None)}


def test_offsets_count_code_units(spark):
    told = ["The \U0001f600\U0001f600\U0001f600 smile is heard first.", "Then the second one follows it."]
    text = " ".join(told) + " And more talk." * 400
    words, at = [], 0
    for i, w in enumerate(text.split(" ")):
        n = len(w.encode("utf-16-le")) // 2
        words.append((1, i, i * 0.5, i * 0.5 + 0.4, at, at + n, "a.mp3"))
        at += n + 1
    w = spark.createDataFrame(words, "book_id int, ord int, start_s double, end_s double, start_off long, end_off long, audiofile string")
    c = spark.createDataFrame([(1, 0, "c", told)], "book_id int, ord int, chapter_id string, sentences array<string>")
    got = rows(align.align_books(c, w, spark.createDataFrame([(1, text)], "book_id int, transcript string"), spark.createDataFrame([(1, "a.mp3", 60.0)], "book_id int, href string, duration_s double")), "id")
    assert [(r[2], r[3]) for r in got] == [(0, 0.0), (1, 3.0)]


def test_runs_of_glyphs(spark):
    glyph = lambda node, pos, ch, *box: [(node, pos, ch, i, *b) for i, b in enumerate(box)]
    g = []
    g += glyph(1, 0, "a", (0.0, 0.0, 5.0, 0.0), (10.0, 0.0, 5.0, 10.0)) + glyph(1, 1, "b", (15.0, 0.5, 5.0, 10.0)) + glyph(1, 2, "\n", (20.0, 0.0, 4.0, 10.0)) + glyph(1, 3, " ", (20.5, 0.0, 4.0, 10.0))
    g += glyph(1, 4, " ", (24.0, 0.0, 0.4, 10.0)) + glyph(1, 5, "c", (90.0, 1.0, 5.0, 10.0)) + glyph(1, 6, "d", (10.0, 12.0, 5.0, 10.0)) + glyph(1, 7, "e", (900.0, 12.0, 5.0, 10.0)) + glyph(1, 8, "f", (15.0, 12.0, 5.0, 10.0))
    g += glyph(2, 0, "\u00a0", (0.0, 0.0, 9.0, 9.0)) + glyph(2, 1, "g", (-4.0, 50.0, 0.0, 9.0)) + glyph(2, 2, "h", (6.0, 80.0, 3.0, 9.0))
    df = spark.createDataFrame(g, "node int, pos int, ch string, rect_pos int, x double, y double, w double, h double")
    runs = rows(pages.build_runs(pages.glyph_boxes(df, F.lit(0.0), F.lit(100.0))).select("node", "text", "x", "y", "w", "h"), "node", "y", "x")
    assert runs == [(1, "ab c", 10.0, 0.0, 85.0, 11.0), (1, "d", 10.0, 12.0, 5.0, 10.0), (1, "f", 15.0, 12.0, 5.0, 10.0), (2, "h", 6.0, 80.0, 3.0, 9.0)]
    r = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 0.0, 1.0), (-4.0, 0.0, 1.0, 1.0), (-4.1, 0.0, 1.0, 1.0), (100.0, 0.0, 1.0, 1.0)], "x double, y double, w double, h double")
    assert pages.visible(r, F.lit(0.0), F.lit(100.0)).count() == 2
    assert spark.range(1).select(pages.column_count(F.lit(2501.0), F.lit(800.0), F.lit(50.0)), pages.column_of(F.lit(876.0), F.lit(30.0), F.lit(800.0), F.lit(50.0))).first()[:] == (3, 1)


def test_player_states(spark):
    e = [(1, 0, "other", None), (1, 1, "playing", True), (1, 2, "seek", None), (1, 3, "ended", None), (1, 4, "ready", None), (1, 5, "playing", False), (2, 0, "ended", None)]
    got = playback.player_states(spark.createDataFrame(e, "session int, seq int, kind string, play_when_ready boolean"))
    assert [(r.session, r.seq, r.is_playing, r.ended) for r in got.orderBy("session", "seq").collect()] == [(1, 0, False, False), (1, 1, True, False), (1, 2, True, False), (1, 3, False, True), (1, 4, False, False), (1, 5, False, False), (2, 0, False, True)]
    s = spark.createDataFrame([(1, 0, "a", 5.0, 9.0), (1, 1, "b", 0.0, 2.0), (1, 2, "c", -1.0, -1.0), (2, 0, "d", -1.0, -1.0)], "book_id int, ord int, id string, clip_begin_ms double, clip_end_ms double")
    p = spark.createDataFrame([(1, 0), (1, 4), (2, 0)], "book_id int, page_index int")
    assert rows(playback.cursor_at_end(s, p), "book_id") == [(1, 4, "a"), (2, 0, None)]
