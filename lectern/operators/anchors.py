"""Aligning one book on many tasks: anchors cut it, and what is between two of them is aligned on its own.

An anchor is a sentence whose first words are, as a sequence, in its book's sentences once and in its transcript once. Anchors meet in an
equi-join, and the longest chain of them that rises in both orders holds. At about every `every`-th sentence the book is cut
at an anchor: the sentences up to the next cut, and the transcript's stretch between both, are a piece of work, so a book's length is no task's
length. What passes over a cut, the end of a range that the next sentence closes, is carried by a window over ranges.

Transcripts are dealt in parts that are cut between words; no row holds a whole one, nor all words of a piece. What a piece needs comes to its task as a
sorted stream, so a book without anchors costs a task its text, its words' numbers and one chapter.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from hashlib import blake2b
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lectern.operators.align import SEARCH_WINDOW, Passage, Words, chapter_offset, code_units, heard_sentences, is_counted, timed_range
from lectern.operators.ordering import Ranged, in_turn
from lectern.shared import broadcast_if_small, materialise, release_memory

#: Words of an anchor; sentences between two cuts, about.
WORDS, EVERY = 5, 300
#: Code units of a part of a transcript, about, and of a cell, by which parts and words find their pieces; rows that leave Python at once.
PART, CELL, ROWS = 100_000, 16_384, 20_000
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_SPACE = re.compile(r"\s")


def rising(places: Sequence[int]) -> list[int]:
    """The positions of a longest strictly rising subsequence."""
    ends, tails = array("q"), array("q")
    before = array("q", [-1]) * len(places)
    for i, p in enumerate(places):
        k = bisect_left(ends, p)
        if k == len(ends):
            ends.append(p)
            tails.append(i)
        else:
            ends[k], tails[k] = p, i
        before[i] = tails[k - 1] if k else -1
    out, i = [], tails[-1] if tails else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _words(units: str, at: int = 0, begin: int = 0) -> Iterator[tuple[int, str]]:
    """(offset, word in lower case) of a text of code units that begins at `at`, from `begin` in it on."""
    return ((at + m.start(), m[0].lower()) for m in _WORD.finditer(units, begin))


def _last_words(units: str, at: int, most: int) -> list[tuple[int, str]]:
    size = 256
    while True:
        gap = _SPACE.search(units, len(units) - size) if size < len(units) else None
        found = list(_words(units, at, gap.end() if gap else 0))
        if gap is None or len(found) >= most:
            return found[max(0, len(found) - most) :]
        size *= 2


def _gram(words: Sequence[str]) -> bytes:
    """What a sequence of words is known by: 128 bits, whatever its length is."""
    return blake2b(" ".join(words).encode(), digest_size=16).digest()


def transcript_parts(transcripts: DataFrame, size: int = PART) -> DataFrame:
    """A table (book_id, at, raw) of transcripts(book_id, transcript): parts that begin at `at`, in UTF-16, cut behind white space. Nothing of empty ones.

    transcripts(book_id, at, transcript) are parts already: the next begins, in code units, where one ends, with white space between their words.
    """
    kind = transcripts.schema["book_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ats, raws, held = [], [], [], 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(ats, pa.int64()), pa.array(raws, pa.binary())], ["book_id", "at", "raw"])  # noqa: B023

            for row in range(batch.num_rows):
                text, at, begin = batch.column(2)[row].as_py() or "", batch.column(1)[row].as_py(), 0
                while begin < len(text):
                    gap = _SPACE.search(text, begin + size)
                    end = gap.end() if gap else len(text)
                    rows.append(row)
                    ats.append(at)
                    raws.append(text[begin:end].encode("utf-16-le"))
                    at, begin, held = at + len(raws[-1]) // 2, end, held + len(raws[-1])
                    if held >= 8 * size:
                        yield made()
                        rows, ats, raws, held = [], [], [], 0
            yield made()
        release_memory()

    at = F.col("at").cast("long") if "at" in transcripts.columns else F.lit(0).cast("long").alias("at")
    return materialise(transcripts.select("book_id", at, "transcript").mapInArrow(cut, f"book_id {kind}, at long, raw binary"), "transcript-parts")


def _heard(parts: DataFrame, words: int) -> DataFrame:
    """(book_id, offset, gram) of all sequences of so many words in transcript_parts(): those within a part, and by a fold over the parts' first and last words those that pass over its end."""
    kind = parts.schema["book_id"].dataType.simpleString()
    beyond = words - 1

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, offsets, grams = [], [], []
            for row in range(batch.num_rows):
                found = list(_words(code_units(batch.column(2)[row].as_py().decode("utf-16-le")), batch.column(1)[row].as_py()))
                told = [w for _, w in found]
                for i in range(len(found) - beyond):
                    rows.append(row)
                    offsets.append(found[i][0])
                    grams.append(_gram(told[i : i + words]))
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(offsets, pa.int64()), pa.array(grams, pa.binary())], ["book_id", "offset", "gram"])
                        rows, offsets, grams = [], [], []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(offsets, pa.int64()), pa.array(grams, pa.binary())], ["book_id", "offset", "gram"])
        release_memory()

    ends = "array<struct<offset:long,word:string>>"
    listed = lambda found: [{"offset": o, "word": w} for o, w in found]
    target = to_arrow_schema(_parse_datatype_string(f"book_id {kind}, at long, first {ends}, last {ends}, goes_on boolean"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last, goes_on = [], [], []
            for at, raw in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                units = code_units(raw.as_py().decode("utf-16-le"))
                some = list(islice(_words(units, at), words))
                first.append(listed(some[:beyond]))
                last.append(listed(_last_words(units, at, beyond)))
                goes_on.append(len(some) == words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, target.field(i).type) for i, c in enumerate((first, last, goes_on), 2))], schema=target)

    def over(carried: list | None, row: tuple) -> tuple[list, tuple | None]:
        book, _, first, last, goes_on = row
        carried = carried or []
        both = carried + first
        found = [{"offset": both[i]["offset"], "gram": _gram([x["word"] for x in both[i : i + words]])} for i in range(min(len(carried), len(both) - beyond))]
        return last if goes_on else both[max(0, len(both) - beyond) :], (book, found) if found else None

    passing = in_turn(parts.mapInArrow(edges, f"book_id {kind}, at long, first {ends}, last {ends}, goes_on boolean"), "book_id", "at", over, f"book_id {kind}, grams array<struct<offset:long,gram:binary>>")
    return parts.mapInArrow(within, f"book_id {kind}, offset long, gram binary").union(passing.select("book_id", F.explode("grams").alias("g")).select("book_id", "g.offset", "g.gram"))


def anchors(sentences: DataFrame, transcripts: DataFrame, words: int = WORDS) -> DataFrame:
    """A table (book_id, n, offset) of a book's chain of anchors: sentences(book_id, n, text) in order, and where in the transcript each begins, in code units. Transcripts may be transcript_parts()."""

    def heads(texts: pd.Series) -> pd.Series:
        firsts = ([w for _, w in islice(_words(code_units(t or "")), words)] for t in texts)
        return pd.Series([_gram(ws) if len(ws) == words else None for ws in firsts], dtype=object)

    kind = sentences.schema["book_id"].dataType.simpleString()
    parts = transcripts if "raw" in transcripts.columns else transcript_parts(transcripts)
    told = sentences.select("book_id", "n", F.pandas_udf(heads, "binary")("text").alias("gram")).where("gram is not null").groupBy("book_id", "gram").agg(F.min("n").alias("n"), F.count("*").alias("c")).where("c = 1")
    heard = _heard(parts, words).groupBy("book_id", "gram").agg(F.min("offset").alias("offset"), F.count("*").alias("c")).where("c = 1")
    pairs = materialise(told.drop("c").join(heard.drop("c"), ["book_id", "gram"]).select("book_id", "n", "offset"), "anchors-pairs")

    def chain(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:  # two numbers a sentence
        rows = rows.sort_values("n")
        return rows.iloc[rising(array("q", rows["offset"].to_numpy("int64").tobytes()))]

    return materialise(pairs.groupBy("book_id").applyInPandas(chain, f"book_id {kind}, n long, offset long"), "anchors-chain")


class _Piece:
    """A piece of work as it comes in: its stretch of the transcript, then its words, then its sentences, of which the chapter at hand is held."""

    def __init__(self, book: object, cut: int):
        self.book, self.cut = book, cut
        self.cells: list[str] = []
        self.text, self.begin, self.whole, self.n_tracks = "", 0, 0, None
        self.words = Words(array("d"), array("d"), array("q"), array("q"), [])
        self.told: list[dict] = []
        self.at = self.chapters = 0

    def hear(self, cells: pa.StructArray) -> None:
        for c in cells.to_pylist():
            self.begin, self.whole, self.n_tracks = c["begin"], c["whole"], c["n_tracks"]
            self.cells.append(code_units(c["raw"].decode("utf-16-le", "surrogatepass")))

    def time(self, words: pa.StructArray) -> None:
        for name in ("start", "end", "start_off", "end_off"):
            column, held = words.field(name if name.endswith("off") else f"{name}_s"), getattr(self.words, name)
            if column.null_count and isinstance(held, array):  # times that aren't known
                held = list(held)
                setattr(self.words, name, held)
            if isinstance(held, array):
                held.frombytes(np.ascontiguousarray(column.to_numpy()).tobytes())
            else:
                held.extend(column.to_pylist())
        names = words.field("audiofile").dictionary_encode()
        files = [*map(self._files.setdefault, *(2 * [names.dictionary.to_pylist()])), None]
        self.words.audiofile.extend(files[i] for i in names.indices.fill_null(len(files) - 1).to_pylist())

    _files: dict[str, str] = {}  # one string for each name

    def tell(self, sentences: pa.StructArray) -> Iterator[list[tuple]]:
        for s in sentences.to_pylist():
            if self.told and s["ord"] != self.told[0]["ord"]:
                yield self.chapter()
            self.told.append(s)

    def chapter(self) -> list[tuple]:
        """The ranges of the chapter at hand: (book_id, ord, chapter_id, id, start_s, end_s, audiofile)."""
        part, self.told = self.told, []
        if self.cells:
            self.text, self.cells = "".join(self.cells), []
        if not part or not self.text:
            return []
        k, self.chapters = self.chapters, self.chapters + 1
        told, start, text = [code_units(s["text"] or "") for s in part], part[0]["id"], self.text
        if k == 0 and self.cut:
            first, offset = 0, 0
        elif self.n_tracks == 1 and (self.begin + self.at) / self.whole > 0.8:
            first, offset = 0, self.at if self.at < len(text) else None
        else:
            first, offset = chapter_offset(told, text, self.at)
        if offset is None:
            return []
        wanted = [(i, s) for i, s in enumerate(told) if i >= first and is_counted(s)]
        heard = list(heard_sentences(wanted, Passage(text, offset), self.words))
        self.at = heard[-1][2] if heard else offset
        ranges = [timed_range(*h, self.words) for h in heard]
        if not ranges and start == 0:
            return [(self.book, part[0]["ord"], part[0]["chapter_id"], -1, None, None, None)]  # a chapter in which nothing was heard closes no range
        return [(self.book, part[0]["ord"], part[0]["chapter_id"], start + r.id, r.start, r.end, r.audiofile) for r in ranges]


def _runs(batch: pa.RecordBatch, keys: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that are alike in the first columns."""
    n = batch.num_rows
    changes = np.zeros(max(0, n - 1), bool)
    for column in batch.columns[:keys]:
        changes |= pc.not_equal(column.slice(1), column.slice(0, max(0, n - 1))).to_numpy(zero_copy_only=False).astype(bool)
    ends = [*(np.flatnonzero(changes) + 1).tolist(), n] if n else []
    for begin, end in zip([0, *ends], ends):
        yield batch.slice(begin, end - begin)


def align_pieces(chapters: DataFrame, words: DataFrame, transcripts: DataFrame, tracks: DataFrame, every: int = EVERY, anchor_words: int = WORDS) -> DataFrame:
    """align.align_books()'s columns, of books cut at anchors: (book_id, chapter_id, id, start_s, end_s, audiofile).

    A piece begins with a sentence that is known to be heard where it begins; chapters that begin within it are looked for as ever, in the piece's own stretch.
    Books without anchors are one piece. Null sentences and transcripts are empty. Transcripts are whole, or in parts as transcript_parts() takes them.
    """
    kinds = {f.name: f.dataType.simpleString() for f in chapters.schema}
    flat = chapters.select("book_id", "ord", "chapter_id", F.posexplode("sentences").alias("id", "text"))
    flat = materialise(Ranged(flat, "book_id", "ord", "id").number("n"), "pieces-sentences")
    parts = transcript_parts(transcripts)
    found = anchors(flat, parts, anchor_words)
    # the first anchor of each run of `every` sentences; a book's beginning is a cut besides
    cuts = found.groupBy("book_id", F.floor(F.col("n") / every).alias("run")).agg(F.min(F.struct("n", "offset")).alias("c")).where("run > 0").select("book_id", "c.n", "c.offset")
    zero = F.lit(0).cast("long")
    cuts = cuts.union(chapters.select("book_id").distinct().select("book_id", zero, zero))
    # a piece also hears what follows its end, up to a search window: a chapter may begin there
    along = Window.partitionBy("book_id").orderBy("n")  # a row for each `every` sentences
    next_n, next_at, far = F.lead("n").over(along), F.lead("offset").over(along), F.lead("offset", 2).over(along)
    units = (F.octet_length("raw") / 2).cast("long")
    whole = parts.groupBy("book_id").agg(F.max(F.col("at") + units).alias("whole"))
    sizes = flat.groupBy("book_id").agg((F.max("n") + 1).alias("told"))
    long = tracks.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("href", "duration_s"))).alias("tracks")).select("book_id", F.size("tracks").alias("n_tracks"))
    placed = cuts.select("book_id", F.col("n").alias("cut"), F.col("offset").alias("begin"), next_n.alias("next"), next_at.alias("end"), far.alias("far")).join(whole, "book_id").join(sizes, "book_id").join(long, "book_id", "left")
    end = F.least(F.coalesce("end", "whole") + SEARCH_WINDOW, F.coalesce("far", "whole"))
    pieces = materialise(placed.select("book_id", "cut", "begin", end.alias("end"), F.col("end").isNull().alias("last"), F.coalesce("next", "told").alias("next"), "whole", "n_tracks"), "pieces-cuts")
    held = broadcast_if_small(pieces.select("*", F.explode(F.sequence(F.floor(F.col("begin") / CELL), F.floor((F.col("end") - 1) / CELL))).alias("cell")).drop("next"))
    numbered = broadcast_if_small(pieces.select("book_id", "cut", "next", F.explode(F.sequence(F.floor(F.col("cut") / every), F.floor((F.col("next") - 1) / every))).alias("cell")))

    texts = parts.select("*", F.explode(F.sequence(F.floor(F.col("at") / CELL), F.floor((F.col("at") + units - 1) / CELL))).alias("cell")).join(held, ["book_id", "cell"])
    since = F.greatest("at", "begin", F.col("cell") * CELL)
    until = F.least(F.col("at") + units, F.col("end"), (F.col("cell") + 1) * CELL)
    raw = F.substring("raw", (2 * (since - F.col("at")) + 1).cast("int"), (2 * (until - since)).cast("int"))
    texts = texts.where(until > since).select("book_id", "cut", F.struct(since.alias("at"), "begin", "whole", "n_tracks", raw.alias("raw")).alias("t"))

    offset = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    known = words.select("book_id", "ord", F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"), offset("start_off"), offset("end_off"), "audiofile")
    known = known.join(broadcast_if_small(pieces.where("last").select("book_id", F.col("whole").alias("ends"))), "book_id").withColumn("cell", F.floor(F.least(F.col("start_off"), F.col("ends") - 1) / CELL)).drop("ends")
    known = known.join(held, ["book_id", "cell"]).where((F.col("start_off") >= F.col("begin")) & (F.col("last") | (F.col("start_off") < F.col("end"))))
    from_begin = lambda c: (F.col(c) - F.col("begin")).alias(c)
    known = known.select("book_id", "cut", F.struct("ord", "start_s", "end_s", from_begin("start_off"), from_begin("end_off"), "audiofile").alias("w"))

    told = flat.withColumn("cell", F.floor(F.col("n") / every)).join(numbered, ["book_id", "cell"]).where((F.col("n") >= F.col("cut")) & (F.col("n") < F.col("next")))
    told = told.select("book_id", "cut", F.struct("n", "ord", "chapter_id", "id", "text").alias("s"))

    rows = texts.withColumn("kind", F.lit(0)).unionByName(known.withColumn("kind", F.lit(1)), True).unionByName(told.withColumn("kind", F.lit(2)), True)
    size = pieces.where("last").agg(F.sum("whole")).first()[0] or 0
    tasks = max(4 * chapters.sparkSession.sparkContext.defaultParallelism, min(10_000, size >> 22))
    work = rows.select("book_id", "cut", "kind", "t", "w", "s").repartition(tasks, "book_id", "cut").sortWithinPartitions("book_id", "cut", "kind", "t.at", "w", "s")
    schema = f"book_id {kinds['book_id']}, ord {kinds['ord']}, chapter_id {kinds['chapter_id']}, id long, start_s double, end_s double, audiofile string"
    target = to_arrow_schema(_parse_datatype_string(schema))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece: _Piece | None = None
        found: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [[]] * len(target)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        for batch in batches:
            for run in _runs(batch, 3):
                book, cut, kind = (run.column(i)[0].as_py() for i in range(3))
                if piece is None or (piece.book, piece.cut) != (book, cut):
                    if piece is not None:
                        found += piece.chapter()
                    piece = _Piece(book, cut)
                if kind == 0:
                    piece.hear(run.column(3))
                elif kind == 1:
                    piece.time(run.column(4))
                else:
                    for ranges in piece.tell(run.column(5)):
                        found += ranges
                        if len(found) >= ROWS:
                            yield made()
                            found = []
        if piece is not None:
            found += piece.chapter()
        yield made()
        piece = None
        release_memory()

    closed = close_over_cuts(materialise(work.mapInArrow(of, schema), "pieces-ranges"), tracks)
    return closed.select("book_id", "chapter_id", F.col("id").cast("int").alias("id"), "start_s", "end_s", "audiofile")


def close_over_cuts(ranges: DataFrame, tracks: DataFrame) -> DataFrame:
    """ranges(book_id, ord, chapter_id, id, ..) as align.close_ranges() leaves them: the end of a range that the next sentence follows is that one's start, or its file's if that one is in another. Rows of id -1 go."""
    back = ranges.withColumns({"__ord": -F.col("ord"), "__id": -F.col("id")})
    now = F.struct("ord", "id", "start_s", "audiofile")
    seen = Ranged(back, "book_id", "__ord", "__id").previous(now, "__next").drop("__ord", "__id").where("id >= 0")
    after = F.col("__next")
    within = (after["ord"] == F.col("ord")) & (after["id"] == F.col("id") + 1)
    across = (after["ord"] != F.col("ord")) & (after["id"] >= 0) & ((after["id"] == 0) | (after["audiofile"] != F.col("audiofile")))
    files = tracks.groupBy("book_id", F.col("href").alias("audiofile")).agg(F.max("duration_s").alias("__long"))
    end = F.when(F.coalesce(within | across, F.lit(False)), F.when(after["audiofile"] == F.col("audiofile"), after["start_s"]).otherwise(F.coalesce("__long", "end_s"))).otherwise(F.col("end_s"))
    return seen.join(files, ["book_id", "audiofile"], "left").withColumn("end_s", end)
