"""Alignment of two tokenizers' tokens over the same bytes.

A byte-level BPE (A) and a byte-fallback BPE with word marks (B) both cut a text's bytes; where tokens of both end, the text falls into
groups, and all A-B pairs of a group are linked. Neither model's tokens, nor A's pre-tokens, reach from a visible ASCII character over
a space, so a text is cut there into units, which both encode alike alone and in place (the constructor checks B's pieces). A task
encodes and aligns each different unit once while it remembers it.

The alignment is DuckDB's work inside each Arrow partition: token interval tables on one axis of bytes, common ends by an
equi-join, each token's group by an ASOF join to the next common end, a group's unit by a range lookup, link numbers by
window sums. Each task sends partial numbers of documents by id pair, and Spark merges them. Documents keep their different pairs
in a table, which meets the merged counts in a second pass: broadcast behind a check of their size, a shuffle join beyond.

Texts that are null or empty, or whose tokens don't give back their bytes, have no tokens: zeros, and '' in place of a digest. Special tokens' strings
are plain text. Rows that repeat are documents of their own in the counts. Very long texts are taken whole, a few at a time. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.shared import broadcast_if_small, discard, materialise, release_memory

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Where units begin: at a space behind a visible ASCII character.
_UNITS = re.compile(r"(?<=[!-~])(?= )")
#: Fixed value: the pre-tokens of byte-level models.
_PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A task remembers so many units, aligns texts of so many characters at once, and sends partial counts of so many pairs.
REMEMBERED, CHARS, PARTIAL = 300_000, 1_000_000, 500_000
_SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>"
_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), *[(c, pa.list_(pa.int32())) for c in "abn"]])


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for themselves, the others from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def bytes_of_a(model: Tokenizer) -> list[bytes]:
    table = byte_of_char()
    out = [b""] * model.get_vocab_size()
    for token, i in model.get_vocab().items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def bytes_of_b(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    byte = re.compile(r"<0x([0-9A-Fa-f]{2})>")
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces]


def encoder_of_a(model: Tokenizer, table: list[bytes]) -> Callable[[list[str]], list[np.ndarray]]:
    """A's encoder: tiktoken's with the model's own vocabulary as ranks, where its merges are in the order of their ids and its pre-tokens are the byte-level ones; else the model itself."""
    told = json.loads(model.to_str())
    before, merges = told["pre_tokenizer"], told["model"]["merges"]
    ids = told["model"]["vocab"]
    joined = [ids.get("".join(m if isinstance(m, list) else m.split(" "))) for m in merges]
    plain = before and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not told["normalizer"] and joined == sorted(joined) and not told["model"].get("ignore_merges")
    if not plain:
        return lambda texts: [np.array(e.ids, np.int32) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    ranks = {table[i]: i for i in ids.values() if i not in {t["id"] for t in told["added_tokens"]}}
    fast = tiktoken.Encoding("a", pat_str=_PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [np.array(fast.encode_ordinary(t), np.int32) for t in texts]


class Aligner:
    """What a task remembers: units, their group strings and sizes here, their linked pairs in DuckDB."""

    def __init__(self, a: str = MODEL_A, b: str = MODEL_B, remembered: int = REMEMBERED):
        model, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        model.encode_special_tokens = True
        self.a_bytes, self.b_bytes = bytes_of_a(model), bytes_of_b(self.b)
        self.encode_a = encoder_of_a(model, self.a_bytes)
        self.lengths = [np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes)]
        # a token with what stands behind it: within its group, and at its group's end
        self.shown = [np.array([f"{i}{sign}" for sign in signs for i in range(len(table))], object) for table, signs in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))]
        if any(re.search(rf"[^{MARK}]{MARK}", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())):
            raise ValueError("a piece of B reaches over a space, so texts can't be cut there")
        self.space = self.b.piece_to_id(MARK)
        self.remembered = remembered
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB"})
        self.con.execute("CREATE TABLE counts (a INT, b INT, n BIGINT)")
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.text: list[str] = []
        self.sizes = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, whether the bytes are lost
        self.con.execute("CREATE OR REPLACE TABLE unit_pairs (unit INT, a INT, b INT, n BIGINT)")

    def encoded(self, runs: list[list[int]], units: list[str]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        """(run, A's ids, B's ids) of runs of units, each encoded at once, whose bytes come back; a run whose don't is taken unit by unit."""
        texts = ["".join(map(units.__getitem__, run)) for run in runs]
        a, b = self.encode_a(texts), self.b.encode([t[1:] for t in texts], num_threads=1)
        out, again = [], []
        for run, t, x, y in zip(runs, texts, a, b, strict=True):
            y = [self.space] if t == " " else y
            if b"".join(map(self.a_bytes.__getitem__, x.tolist())) == t.encode() == b"".join(map(self.b_bytes.__getitem__, y)):
                out.append((run, x, np.array(y, np.int32)))
            elif len(run) > 1:
                again += [[k] for k in run]
        return out + (self.encoded(again, units) if again else [])

    def learn(self, units: list[str]) -> None:
        """Encode units and align them."""
        first = len(self.ids)
        # units that end with a visible character stand one behind the other as in a text
        inner = [k for k, u in enumerate(units) if "!" <= u[-1] <= "~"]
        alone = [k for k, u in enumerate(units) if not "!" <= u[-1] <= "~"]
        done = self.encoded([*(inner[at : at + 400] for at in range(0, len(inner), 400)), *([k] for k in alone)], units)
        sizes = np.zeros((len(units), 5), np.int64)
        sizes[:, 4] = 1
        text = [""] * len(units)
        if done:
            kept = np.concatenate([np.array(run, np.int32) for run, _, _ in done])
            sizes[kept, 4] = 0
            ids = [np.concatenate([x[side] for x in done]) for side in (1, 2)]
            ends = np.cumsum([len(units[k].encode()) for k in kept.tolist()])
            for name, x, length in zip(("a_tokens", "b_tokens"), ids, self.lengths, strict=True):
                self.con.register(name, pa.table({"id": x, "pos": np.cumsum(length[x])}))
            self.con.register("unit_ends", pa.table({"unit": kept + np.int32(first), "pos": ends}))
            self.con.execute(
                """
                CREATE OR REPLACE TEMP TABLE cuts AS SELECT a.pos, row_number() OVER (ORDER BY a.pos) AS g FROM a_tokens a JOIN b_tokens b ON a.pos = b.pos;
                CREATE OR REPLACE TEMP TABLE ga AS SELECT a.id, a.pos, c.g FROM a_tokens a ASOF JOIN cuts c ON a.pos <= c.pos;
                CREATE OR REPLACE TEMP TABLE gb AS SELECT b.id, b.pos, c.g FROM b_tokens b ASOF JOIN cuts c ON b.pos <= c.pos;
                CREATE OR REPLACE TEMP TABLE of_unit AS SELECT c.g, c.pos, u.unit FROM cuts c ASOF JOIN unit_ends u ON c.pos <= u.pos;
                INSERT INTO unit_pairs SELECT u.unit, ga.id, gb.id, count(*) FROM ga JOIN gb ON ga.g = gb.g JOIN of_unit u ON u.g = ga.g GROUP BY ALL
                """
            )
            # running sums over the groups; a unit's are the differences at its end
            running = self.con.sql(
                """
                WITH x AS (SELECT g, count(*) AS n FROM ga GROUP BY g), y AS (SELECT g, count(*) AS n FROM gb GROUP BY g),
                z AS (SELECT c.g, c.pos, sum(x.n) OVER w AS n_a, sum(y.n) OVER w AS n_b, sum(x.n * y.n) OVER w AS n_links FROM cuts c JOIN x ON x.g = c.g JOIN y ON y.g = c.g WINDOW w AS (ORDER BY c.g))
                SELECT CAST(n_a AS BIGINT), CAST(n_b AS BIGINT), g, CAST(n_links AS BIGINT) FROM z JOIN unit_ends u ON u.pos = z.pos ORDER BY z.pos
                """
            ).to_arrow_table()
            sums = np.column_stack([running.column(k).to_numpy() for k in range(4)])
            sizes[kept, :4] = np.diff(sums, axis=0, prepend=0)
            groups = [self.con.sql(f"SELECT g FROM {t} ORDER BY pos").to_arrow_table().column(0).to_numpy() for t in ("ga", "gb")]
            parts = []
            for x, g, shown in zip(ids, groups, self.shown, strict=True):
                parts.append(shown[x + np.append(g[1:] != g[:-1], True) * (len(shown) // 2)])
            order = np.argsort(np.concatenate([2 * groups[0], 2 * groups[1] + 1]), kind="stable")
            shown = np.concatenate(parts)[order].tolist()
            at = 0
            for k, end in zip(kept.tolist(), np.cumsum(sizes[kept, 0] + sizes[kept, 1]).tolist(), strict=True):
                text[k] = "".join(shown[at:end])
                at = end
        self.ids.update(zip(units, range(first, first + len(units)), strict=True))
        self.text += text
        self.sizes = np.concatenate([self.sizes, sizes])

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[np.ndarray]]:
        """Of each text n_a, n_b, n_groups, n_links and the digest; and (text, a, b, links) of all its different pairs, by text. Adds to the partial counts."""
        cut = [_UNITS.split(" " + t) if t else [] for t in texts]
        new = list(dict.fromkeys(u for units in cut for u in units if u not in self.ids))
        if len(self.ids) + len(new) > self.remembered and self.ids:
            self.forget()
            new = list(dict.fromkeys(chain.from_iterable(cut)))
        if new:
            self.learn(new)
        sizes, digests, of_doc, of_unit = np.zeros((len(texts), 4), np.int64), [""] * len(texts), [], []
        for d, units in enumerate(cut):
            ids = [self.ids[u] for u in units]
            own = self.sizes[ids]
            if not ids or own[:, 4].any():
                continue
            sizes[d] = own[:, :4].sum(axis=0)
            digests[d] = hashlib.sha256("".join(map(self.text.__getitem__, ids))[:-1].encode()).hexdigest()
            of_unit.append(np.array(ids, np.int32))
            of_doc.append(np.full(len(ids), d, np.int32))
        if not of_doc:
            return sizes, digests, [np.zeros(0, np.int32)] * 4
        self.con.register("doc_units", pa.table({"doc": np.concatenate(of_doc), "unit": np.concatenate(of_unit)}))
        self.con.execute(
            """
            CREATE OR REPLACE TEMP TABLE doc_pairs AS
            SELECT d.doc, p.a, p.b, CAST(sum(d.k * p.n) AS INT) AS n FROM (SELECT doc, unit, count(*) AS k FROM doc_units GROUP BY ALL) d JOIN unit_pairs p ON p.unit = d.unit GROUP BY ALL;
            INSERT INTO counts SELECT a, b, count(*) FROM doc_pairs GROUP BY ALL
            """
        )
        pairs = self.con.sql("SELECT doc, a, b, n FROM doc_pairs ORDER BY doc, a, b").to_arrow_table()
        return sizes, digests, [pairs.column(i).to_numpy() for i in range(4)]

    def partial(self, least: int = 0) -> pa.Table | None:
        """The partial counts (a, b, n) so far, which are then forgotten; none if there are at most `least` of them."""
        if self.con.execute("SELECT count(*) FROM counts").fetchall()[0][0] <= least:
            return None
        self.con.execute("CREATE OR REPLACE TABLE counts AS SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL")
        if self.con.execute("SELECT count(*) FROM counts").fetchall()[0][0] <= least:
            return None
        out = self.con.sql("SELECT a, b, CAST(n AS INT) AS n FROM counts ORDER BY a, b").to_arrow_table()
        self.con.execute("DELETE FROM counts")
        return out


def _rows(first: int, ids: pa.Array, sizes: np.ndarray, digests: list[str], pairs: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.searchsorted(pairs[0], np.arange(len(digests) + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(p, pa.int32())) for p in pairs[1:]]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(digests))), ids, *[pa.array(sizes[:, k]) for k in range(4)], pa.array(digests), *lists], schema=_ARROW)


def _partial_rows(counts: pa.Table | None) -> Iterator[pa.RecordBatch]:
    """Rows without a number, each with some 20,000 of the partial counts."""
    for at in range(0, counts.num_rows if counts else 0, 20_000):
        part = counts.slice(at, 20_000)
        null = lambda kind: pa.nulls(1, kind)
        lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(k).combine_chunks().cast(pa.int32())) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*[null(f.type) for f in list(_ARROW)[:7]], *lists], schema=_ARROW)


def aligned(docs: DataFrame, id: str = "doc_id", text: str = "text", a: str = MODEL_A, b: str = MODEL_B, remembered: int = REMEMBERED, partial: int = PARTIAL, chars: int = CHARS) -> DataFrame:
    """Two kinds of rows: of a document (row not null) its sizes, digest and different pairs with their links, and of a task (row null) partial counts of documents by pair."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Aligner(a, b, remembered)
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 33
        for batch in batches:
            at = 0
            lengths = np.cumsum(pa.compute.utf8_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + chars, "right")))
                part = batch.slice(at, end - at)
                yield _rows(row, part.column(0), *task.align(part.column(1).to_pylist()))
                row, at = row + part.num_rows, end
                yield from _partial_rows(task.partial(least=partial))
        yield from _partial_rows(task.partial())
        task.con.close()
        release_memory()

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(of, _SCHEMA)


def pair_counts(made: DataFrame) -> DataFrame:
    """(a, b, n_docs, best) of aligned() rows: how many documents hold the pair, and whether none of its A id is in more."""
    zipped = made.where("row is null").select(F.explode(F.arrays_zip("a", "b", "n")).alias("p"))
    counts = materialise(zipped.groupBy("p.a", "p.b").agg(F.sum(F.col("p.n").cast("long")).alias("n_docs")), "pairs-counts")
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))  # a row for each id of A's vocabulary at most
    out = materialise(counts.join(F.broadcast(most), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best")), "pairs-best")
    discard(counts)
    return out


def alignment_report(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", a: str = MODEL_A, b: str = MODEL_B) -> DataFrame:
    """Of each row its id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    made = materialise(aligned(docs, id, text, a, b), "pairs-aligned")
    told = pair_counts(made)
    pairs = made.where("row is not null").select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("row", "p.a", "p.b", "p.n")
    zero = F.lit(0).cast("long")
    sums = pairs.join(broadcast_if_small(told, rows=2_000_000, size=160 << 20), ["a", "b"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0).cast("long")).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"))
    rows = made.where("row is not null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out: list[Column] = [F.col("doc_id").alias(id), *[F.col(c) for c in ("n_a", "n_b", "n_groups", "n_links")], *[F.coalesce(c, zero).alias(c) for c in ("n_best", "count_sum")], F.col("groups_sha256")]
    return rows.join(sums, "row", "left").select(*out)
