"""SentencePiece BPE with seeded merge-dropout, and lossless decoding.

Works from a public model's pieces and scores. A text is cut where no piece can span; in each segment an
agenda holds the merges that are possible, best score first, leftmost first among equals. Without dropout
that gives the library's own segmentation. With dropout, each merge that comes up is skipped at the rate,
and may come up again when a neighbour has merged. Keyed hashes decide: an occurrence's key is the hash of its
text, under the seed, mixed with the segment's place in it, so every occurrence of a word is cut on its own,
and the same corpus always in the same ways.

The candidates of a segment come up one by one, so which are skipped is a set of steps, and the number of steps
between two skips is drawn at once, from the hash of the occurrence's key and the skip's number (`gaps`; it is
geometric, which is what one draw for each step would give). Segments of any length are cut by these draws: short ones
together, as rows of a matrix, others by a heap each. What a word gives for a set of steps is remembered, so a word
is cut once for each set that comes up, however often it occurs.

What the vocabulary lacks is spelled in byte pieces, and so is the blank symbol U+2581 where a text itself
holds it; decoding restores every text exactly. Null text has null ids; empty text has none. Rows that repeat
have the same ids, an empty table gives an empty one, and very long texts are cut whole: nothing is truncated.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.predicates import fresh
from lectern.shared import release_memory

BLANK = "▁"
#: A text's own U+2581 while it is being cut: a code point that UTF-8 can't carry, so no text has it.
_OWN = "\ud800"
_SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Segments up to so many code points are cut together as rows of matrices of so many rows, others by a heap each.
_SHORT, _MATRIX = 32, 4096
#: A node and a step are one number. A segment of n symbols has at most 3 (n - 1) candidates: n - 1 at first, and two for each merge.
_STEPS = 128
_NONE = np.iinfo(np.int32).max
_CHARS = 1 << 20
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Pieces:
    """The vocabulary of a BPE model with byte fallback, an identity normaliser and a blank put in front."""

    def __init__(self, model: str | bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model) if isinstance(model, bytes) else sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces: list[bytes | None] = []
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes: list[int] = [0] * 256
        for i in range(sp.get_piece_size()):
            piece, out = sp.id_to_piece(i), None
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                out = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                out = piece.replace(BLANK, " ").encode()
                self.rank[piece] = -sp.get_score(i)
            self.pieces.append(out)
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece spans segments")
        self.of_point = np.full(0x110000, -1, np.int32)  # the pieces of one character
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_point[ord(p)] = i
        self._pairs()

    def _pairs(self) -> None:
        """A hash table of all pairs of pieces that are a piece when joined: key, place among the scores, joined piece."""
        order = {r: i for i, r in enumerate(sorted(set(self.rank.values())))}
        found = [(l << 32 | r, order[self.rank[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if (l := self.ids.get(p[:k])) is not None and (r := self.ids.get(p[k:])) is not None]
        keys, ranks, joined = (np.array(c, np.int64) for c in zip(*found, strict=True))
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks, self.joined = np.full(1 << self.bits, _NONE, np.int32), np.zeros(1 << self.bits, np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # linear probing: in each round the first of those that want a free slot has it
            here = at[todo]
            free = self.keys[here] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(np.where(free, here, -1), return_index=True)[1]] = True
            won = first & free
            self.keys[here[won]], self.ranks[here[won]], self.joined[here[won]] = keys[todo[won]], ranks[todo[won]], joined[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, joined piece) of each pair of int64 symbols; rank _NONE where it is no piece."""
        keys = left << 32 | right
        at = self._slot(keys)
        there = self.keys[at]
        todo = np.flatnonzero((there != keys) & (there != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            there[todo] = now = self.keys[at[todo]]
            todo = todo[(now != keys[todo]) & (now != -1)]
        return np.where(there == keys, self.ranks[at], _NONE), self.joined[at]

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the symbols of all segments, one behind the other; how many each has). What is no piece is a number that none has."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = self.of_point[points]
        return np.where(ids < 0, points.astype(np.int32) + len(self.pieces), ids), size

    def cut(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all segments, one behind the other; how many each has; how many steps each took).

        flat: symbols, of which a segment has `size` from `begin` on (1 to _SHORT). low and high: the bits of the steps 0-63
        and 64-127 that a segment is cut without. Segments are cut by length, so that matrices are narrow.
        """
        order = np.argsort(size, kind="stable")
        flats, lens, steps = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(order), _MATRIX):
            part = order[at : at + _MATRIX]
            ids, n, took = self._matrix(flat, begin[part], size[part], low[part], high[part])
            flats.append(ids)
            lens.append(n)
            steps.append(took)
        flat, lens, back = np.concatenate(flats), np.concatenate(lens), np.argsort(order, kind="stable")
        return gather(flat, np.cumsum(lens) - lens, lens, back), lens[back], np.concatenate(steps)[back]

    def _matrix(self, flat: np.ndarray, begin: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Agenda processing of all rows in step: each takes its best pair, the leftmost of equals, and merges or skips it.

        A symbol is the place (row * width + column) where it begins, and a pair that of its first symbol. `after` and `before`
        link a row's symbols, -1 at its ends; a symbol that another swallowed is -1.
        """
        rows, width = len(n), int(n.max())
        inside = np.arange(width) < n[:, None]
        places = np.arange(rows * width)
        symbols = np.where(inside, flat[np.where(inside, begin[:, None] + np.arange(width), 0)], -1).astype(np.int64).ravel()
        after, before = places + 1, places - 1
        after[np.arange(rows) * width + n - 1] = -1
        before[::width] = -1
        ranks, joined = np.full(rows * width, _NONE, np.int32), np.zeros(rows * width, np.int64)
        pairs = places[inside.ravel() & (after >= 0)]
        ranks[pairs], joined[pairs] = self._find(symbols[pairs], symbols[pairs + 1])
        of_row, live, steps, step = ranks.reshape(rows, width), np.arange(rows), np.zeros(rows, np.int64), 0
        last = int(high.max()).bit_length() + 64 if high.any() else int(low.max()).bit_length()
        while len(live):
            at = live * width + of_row[live].argmin(axis=1)
            open_ = ranks[at] != _NONE
            if not open_.all():
                steps[live[~open_]] = step
                live, at = live[open_], at[open_]
            if step < last:
                skip = ((low if step < 64 else high)[live] >> np.uint64(step & 63)) & np.uint64(1) == 1
                ranks[at[skip]] = _NONE
                at = at[~skip]
            step += 1
            second = after[at]
            third = after[second]
            symbols[at], after[at] = joined[at], third
            symbols[second], ranks[second] = -1, _NONE
            more = third >= 0
            ranks[at[~more]] = _NONE
            left, right = at[more], third[more]
            before[right] = left
            ahead = before[at]
            some = ahead >= 0
            left, right = np.concatenate([left, ahead[some]]), np.concatenate([right, at[some]])
            ranks[left], joined[left] = self._find(symbols[left], symbols[right])
        alive = symbols >= 0
        flat, most = symbols[alive].astype(np.int32), len(self.pieces)
        count = alive.reshape(rows, width).sum(axis=1)
        strange = flat >= most
        if strange.any():  # spelled in bytes; most are one byte, such as a line's end
            short = strange & (flat < most + 128)
            flat[short] = np.array(self.bytes, np.int32)[flat[short] - most]
            at = np.flatnonzero(flat >= most)
            if len(at):
                spelled = [self._spell(chr(s - most)) for s in flat[at].tolist()]
                more = np.array([len(x) for x in spelled])
                row = np.repeat(np.arange(rows), count)[at]
                width = np.ones(len(flat), np.int64)
                width[at] = more
                flat = np.repeat(flat, width)
                flat[flat >= most] = np.concatenate([np.array(x, np.int32) for x in spelled])
                np.add.at(count, row, more - 1)
        return flat, count, steps

    def _spell(self, character: str) -> list[int]:
        """The byte pieces of a character."""
        return [self.bytes[x] for x in (BLANK if character == _OWN else character).encode()]

    def segment(self, text: str, skips: Iterator[int] = iter(())) -> list[int]:
        """The ids of one segment of any length, whose agenda is a heap. skips: rising numbers of the steps that it is cut without."""
        symbols: list[str | None] = list(text)
        n, rank, step, skip = len(symbols), self.rank.get, 0, next(skips, -1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, a, a + 1, p) for a in range(n - 1) if (r := rank(p := text[a : a + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, piece = heapq.heappop(agenda)
            left, right = symbols[a], symbols[b]
            if left is None or right is None or after[a] != b or left + right != piece:
                continue
            step += 1
            if skip == step - 1:
                skip = next(skips, -1)
                continue
            symbols[a], symbols[b] = piece, None
            after[a] = c = after[b]
            if c < n:
                before[c] = a
            for x, y in ((before[a], a), (a, c)):
                if x >= 0 and y < n and (r := rank(joined := symbols[x] + symbols[y])) is not None:
                    heapq.heappush(agenda, (r, x, y, joined))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                i = self.ids.get(s)
                out += [i] if i is not None else self._spell(s)
        return out

    def decode(self, ids: Iterator[int] | list[int] | np.ndarray) -> str:
        """The text that was encoded: pieces joined, without the blank in front."""
        listed = ids.tolist() if isinstance(ids, np.ndarray) else ids
        return b"".join(map(self.pieces.__getitem__, listed))[1:].decode()


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of flat that `which` names, one behind the other."""
    n = lens[which]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gaps(keys: np.ndarray, k: int, rate: float) -> np.ndarray:
    """How many steps are taken between the skips number k - 1 and k of each occurrence, each step being skipped at the rate."""
    u = ((_mix(keys + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return np.minimum(np.log(u) / np.log1p(-rate), 2.0**40).astype(np.int64)


def skipped_steps(key: int, rate: float) -> Iterator[int]:
    """The steps that an occurrence is cut without, rising."""
    at, own = -1, np.array([key], np.uint64)
    for k in count() if rate else ():
        at += 1 + int(gaps(own, k, rate)[0])
        yield at


class _Rows:
    """Arrays of one length that grow together."""

    def __init__(self, **kinds: type):
        self.n, self.room = 0, 1 << 12
        self.kinds = kinds
        for name, kind in kinds.items():
            setattr(self, name, np.zeros(self.room, kind))

    def add(self, m: int, **values: np.ndarray | int) -> np.ndarray:
        """The numbers of m new rows."""
        while self.n + m > self.room:
            self.room *= 2
            for name in self.kinds:
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        for name, v in values.items():
            getattr(self, name)[self.n : self.n + m] = v
        self.n += m
        return np.arange(self.n - m, self.n)


class _Memory:
    """Segments that were cut, each without some steps: nodes, numbered. A node's child at a step is cut without that one, too."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}  # of a segment, cut without dropout
        self.symbols, self.ids = _Rows(symbol=np.int32), _Rows(id=np.int32)
        self.nodes = _Rows(begin=np.int64, size=np.int16, low=np.uint64, high=np.uint64, start=np.int64, lens=np.int64, steps=np.int16)
        self.asked, self.child = np.zeros(0, np.int64), np.zeros(0, np.int64)  # by parent and step, sorted


class Encoder:
    """Encodes texts, remembering what it has cut, about `remember` nodes."""

    def __init__(self, pieces: Pieces, rate: float, seed: int, remember: int = 500_000):
        self.pieces, self.rate, self.seed, self.most = pieces, rate, seed, remember
        self.memory = _Memory()

    def cut(self, segments: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments, one behind the other; how many each has). keys: uint64 of each occurrence."""
        if self.memory.nodes.n > self.most:
            self.memory = _Memory()
        m = self.memory
        new = list(set(segments).difference(m.index))
        if new:
            self._add_segments(new)
        node = np.fromiter(map(m.index.__getitem__, segments), np.int64, len(segments))
        if self.rate:
            todo = np.flatnonzero(m.nodes.steps[node] > 0)
            k, at = 0, np.full(len(todo), -1)
            while len(todo):
                at = at + 1 + gaps(keys[todo], k, self.rate)
                more = at < m.nodes.steps[node[todo]]
                todo, at = todo[more], at[more]
                node[todo] = self._children(node[todo] * _STEPS + at)
                k += 1
        flat, lens = gather(m.ids.id, m.nodes.start, m.nodes.lens, node), m.nodes.lens[node]
        long = np.flatnonzero(m.nodes.steps[node] < 0).tolist()
        if not long:
            return flat, lens
        parts, ends, begin = [], np.cumsum(lens), 0
        for i in long:  # each occurrence by a heap of its own
            found = self.pieces.segment(segments[i], skipped_steps(int(keys[i]), self.rate))
            parts += [flat[begin : ends[i]], np.array(found, np.int32)]
            begin, lens[i] = ends[i], len(found)
        return np.concatenate([*parts, flat[begin:]]), lens

    def _add_segments(self, new: list[str]) -> None:
        m = self.memory
        flat, size = self.pieces.symbols(new)
        begin = m.symbols.n + np.cumsum(size) - size
        m.symbols.add(len(flat), symbol=flat)
        none, short = np.zeros(len(new), np.uint64), size <= _SHORT
        nodes = np.full(len(new), -1)
        nodes[short] = self._add(begin[short], size[short], none[short], none[short])
        nodes[~short] = m.nodes.add(int((~short).sum()), steps=-1)  # no ids: the heap cuts these
        m.index.update(zip(new, nodes.tolist(), strict=True))

    def _add(self, begin: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        m = self.memory
        ids, lens, steps = self.pieces.cut(m.symbols.symbol, begin, size, low, high)
        start = m.ids.n + np.cumsum(lens) - lens
        m.ids.add(len(ids), id=ids)
        return m.nodes.add(len(size), begin=begin, size=size, low=low, high=high, start=start, lens=lens, steps=steps)

    def _children(self, asked: np.ndarray) -> np.ndarray:
        """The nodes of parent * _STEPS + step, each."""
        m = self.memory
        keys, back = np.unique(asked, return_inverse=True)
        at = np.searchsorted(m.asked, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(m.asked)
        new[inside] = m.asked[at[inside]] != keys[inside]
        if new.any():
            parent, step = keys[new] // _STEPS, (keys[new] % _STEPS).astype(np.uint64)
            bit = np.uint64(1) << (step & np.uint64(63))
            low = m.nodes.low[parent] | np.where(step < 64, bit, np.uint64(0))
            high = m.nodes.high[parent] | np.where(step < 64, np.uint64(0), bit)
            made = self._add(m.nodes.begin[parent], m.nodes.size[parent].astype(np.int64), low, high)
            m.asked, m.child = np.insert(m.asked, at[new], keys[new]), np.insert(m.child, at[new], made)
            at = np.searchsorted(m.asked, keys)
        return m.child[at][back]

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one behind the other; where each begins, and the end). A text's hash and a segment's place in it key what is skipped."""
        asked: list[str] = []
        bounds, hashes = [0], []
        for t in texts:
            if t:
                if BLANK in t:
                    t = t.replace(BLANK, _OWN)
                asked += _SEGMENT.findall(BLANK + t.replace(" ", BLANK))
                hashes.append(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), self.seed))
            else:
                hashes.append(0)
            bounds.append(len(asked))
        n = np.diff(bounds)
        place = np.arange(len(asked), dtype=np.uint64) - np.repeat(np.array(bounds[:-1], np.uint64), n)
        keys = _mix(np.repeat(np.array(hashes, np.uint64), n) ^ _mix(place + np.uint64(1)))
        ids, lens = self.cut(asked, keys)
        return ids, np.concatenate([[0], np.cumsum(lens)])[bounds]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The ids of each text."""
        ids, ends = self.encode_flat(texts)
        return [None if t is None else ids[a:b] for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, text: str | None) -> list[int] | None:
        found = self.encode_all([text])[0]
        return None if found is None else found.tolist()


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of about _CHARS code points together, one at least."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= _CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


@lru_cache(maxsize=1)
def _pieces(model: bytes) -> Pieces:
    """One vocabulary for each Python worker. What an Encoder remembers goes with its task: idle workers shouldn't hold it."""
    return Pieces(model)


def encode(spark: SparkSession, text: Column, rate: float = 0.1, seed: int = 11, model: str = MODEL) -> Column:
    """struct<ids, lossless> of each text; lossless: decoding gave the text back. model: a path that the driver can read."""
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # one vocabulary

    @F.arrow_udf("struct<ids:array<int>,lossless:boolean>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(_pieces(shared.value), rate, seed)
        spelled = encoder.pieces.pieces.__getitem__
        for texts in batches:
            for part in _slices(texts.to_pylist()):  # small results: few texts' pieces are in memory at once
                ids, ends = encoder.encode_flat(part)
                none = [t is None for t in part]
                listed = list(map(spelled, ids.tolist()))
                ok = [b"".join(listed[a:b]) == (b" " + t.encode() if t else b"") for t, a, b in ((t or "", a, b) for t, a, b in zip(part, ends[:-1].tolist(), ends[1:].tolist(), strict=True))]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(none))
                yield pa.StructArray.from_arrays([lists, pa.array(ok, pa.bool_(), mask=np.array(none, bool))], names=["ids", "lossless"])
        encoder.memory = _Memory()
        release_memory()

    return of(text)


def encode_rows(spark: SparkSession, docs: DataFrame, text: str = "text", rate: float = 0.1, seed: int = 11, model: str = MODEL) -> DataFrame:
    """docs with columns __ids (array<int>) and __lossless (boolean) added. All columns stay; where docs has a column of an added
    name, in any case, the added one gets underscores behind it until its name is new."""
    names = docs.columns
    added = fresh(names, "__ids", "__lossless")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))
    made = rows.select("row", encode(spark, F.col("text"), rate, seed, model).alias("e"))
    return made.select("row.*", F.col("e.ids").alias(added[0]), F.col("e.lossless").alias(added[1]))


def decode(spark: SparkSession, ids: Column, model: str = MODEL) -> Column:
    """The text of each array of ids; null for null."""
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _pieces(shared.value)
        for rows in batches:
            yield pa.array([None if x is None else pieces.decode(x) for x in rows.to_pylist()], pa.string())

    return of(ids)
