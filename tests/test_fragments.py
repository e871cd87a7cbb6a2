"""Pages of line boxes against a plain breaker that goes line by line, and chains against plain following."""

import random

from lectern.operators import fragments
from lectern.operators.ordering import chain
from lectern.streaming import playback

LINE = "chapter_id int, ord long, block_id int, height double, space double, break_before string, break_after string, inside int"


def plain(lines, height, orphans=2, widows=2):
    """Pages of one chapter's lines in order: [(page, line, y)]."""

    def kind(i):
        a, b = lines[i], lines[i + 1]
        block = [x for x in lines if x[2] == a[2]]
        if (a[6] in ("page", "always")) or (b[5] in ("page", "always")):
            return 0
        at = block.index(a) + 1
        if a[2] == b[2] and (at < orphans or len(block) - at < widows):
            return 3
        if a[6] == "avoid" or b[5] == "avoid" or (a[7] is not None and a[7] == b[7]):
            return 2
        return 1

    out, page, i = [], 0, 0
    while i < len(lines):
        y, best, keeps, j, tops = 0.0, {}, i == 0 or kind(i - 1) == 0, i, []
        end = None
        while j < len(lines):
            y += (lines[j][4] or 0.0) if (j > i or keeps) else 0.0
            tops.append(y)
            y += lines[j][3] or 0.0
            if y > height:
                break
            if j + 1 == len(lines) or kind(j) == 0:
                end = j + 1
                break
            best[kind(j)] = j + 1
            j += 1
        end = end or best.get(1) or best.get(2) or best.get(3) or i + 1
        out += [(page, n - i, tops[n - i]) for n in range(i, end)]
        page, i = page + 1, end
    return out


def some_lines(draw, chapter, n):
    lines, block = [], 0
    while len(lines) < n:
        m, inside = draw.choice([1, 1, 2, 3, 4, 7, 15, 40]), draw.choice([None, None, block])
        for i in range(m):
            before = draw.choice([None] * 30 + ["page", "avoid"]) if i == 0 else None
            after = draw.choice([None] * 20 + ["always", "avoid", "avoid", "auto"]) if i == m - 1 else None
            lines.append((chapter, len(lines) * 3, block, draw.choice([20.0, 20.5, 31.25, None, 90.0]), draw.choice([0.0, 12.0, None]) if i == 0 else 0.0, before, after, inside))
        block += 1
    return lines


def test_pages_of_lines(spark):
    draw = random.Random(4)
    chapters = {c: some_lines(draw, c, n) for c, n in ((1, 900), (2, 1), (3, 60), (4, 250))}
    chapters[5] = [(5, 0, 0, 500.0, 3.0, None, None, None), (5, 1, 0, 500.0, 0.0, None, None, None)]  # higher than a page
    rows = [r for c in chapters.values() for r in c]
    df = spark.createDataFrame(draw.sample(rows, len(rows)), LINE)
    for height in (200.0, 400.0):
        got = {}
        for r in fragments.paginate(df, height).orderBy("chapter_id", "ord").collect():
            got.setdefault(r.chapter_id, []).append((r.page_in_chapter, r.line_on_page, r.page_y))
        for c, lines in chapters.items():
            assert got[c] == plain(lines, height), c


def test_short_chapters_are_whole_in_a_task_and_long_ones_in_ranges(spark, monkeypatch):
    draw = random.Random(11)
    chapters = {c: some_lines(draw, c, draw.choice([1, 2, 9, 70, 300])) for c in range(24)}
    rows = [r for c in chapters.values() for r in c]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # chapters go on over batches
    try:
        df = spark.createDataFrame(draw.sample(rows, len(rows)), LINE)
        mixed = sorted(map(tuple, fragments.paginate(df, 300.0, long=60).select("chapter_id", "ord", "page_in_chapter", "line_on_page", "page_y").collect()))
        monkeypatch.setattr(fragments, "Ranged", None)
        whole = fragments.paginate(df, 300.0)
        assert whole.columns[:8] == df.columns
        assert sorted(map(tuple, whole.select("chapter_id", "ord", "page_in_chapter", "line_on_page", "page_y").collect())) == mixed
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(c, line[1], *p) for c, lines in chapters.items() for line, p in zip(lines, plain(lines, 300.0), strict=True)]
    assert mixed == sorted(want)


def test_no_lines(spark):
    assert fragments.paginate(spark.createDataFrame([], LINE), 100.0).count() == 0


def test_chain_over_blocks(spark):
    draw = random.Random(8)
    rows = [(k, p, p + draw.choice([1, 1, 2, 9, 40]) if p < n - 41 else None) for k, n in (("a", 700), ("b", 3), ("c", 120)) for p in range(n)]
    want = set()
    nxt = {(k, p): n for k, p, n in rows}
    for k in "abc":
        p = 0
        while p is not None:
            want.add((k, p))
            p = nxt[k, p]
    df = spark.createDataFrame(draw.sample(rows, len(rows)), "k string, p long, n long")
    for size in (16, 8192):
        assert {(r.k, r.p) for r in chain(df, "k", "p", "n", size).collect()} == want


def test_throttle_in_blocks_is_the_fold(spark):
    draw = random.Random(5)
    rows = [(k, 3 * i, float(draw.choice([0, 100, 300, 40]) * i % 7000)) for k, n in ((1, 900), (None, 60), (2, 1)) for i in range(n)]
    want, last = set(), {}
    for k, seq, t in rows:
        n, at = last.get(k, (0, None))
        if at is None or n + 1 >= 20 or abs(t - at) >= 1000.0:
            want.add((k, seq, t))
            last[k] = (0, t)
        else:
            last[k] = (n + 1, at)
    df = spark.createDataFrame(draw.sample(rows, len(rows)), "session long, seq long, t double")
    for size in (64, 8192):
        assert {tuple(r) for r in playback.throttle(df, size=size).collect()} == want
