"""Playback as streams of positions: the active span, throttled positions, timings by count.

A session's state is one small row, so sessions spread over tasks and a lost executor resumes from the
checkpoint. Batch twins give the same rows from a finished log.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.cloudpickle.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.ordering import Ranged, blocks_with_ahead, chain
from lectern.predicates import timed
from lectern.shared import materialise

# the worker that readies a stateful stream has no files of the context: processors travel whole
register_pickle_by_value(sys.modules[__name__])

CURSOR = "session long, seq long, t double, span_id string, page_index int"
TIMINGS = "label string, window_no long, n long, mean_ns long, min_ns long, max_ns long"


class CursorProcessor(StatefulProcessor):
    """Rows (session, seq, t, span_id, page_index): positions with the span looked up for them. Emits when span or page changes; a position in no span keeps the last.

    A session's rows of one micro-batch, which its trigger bounds, are put in order; of all before only the last span is kept.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "span_id string, page_index int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        last = self.now.get() if self.now.exists() else None
        met = pd.concat([r[r["span_id"].notna()] for r in rows]).sort_values("seq")
        if not len(met):
            return
        page = met["page_index"].astype("Int64")
        # a page may be unknown: -1 stands for that in comparisons, as no page has that number
        now = pd.DataFrame({"span": met["span_id"].to_numpy(), "page": page.fillna(-1).to_numpy(int)})
        before = now.shift(1)
        if last is not None:
            before.iloc[0] = [last[0], -1 if last[1] is None else last[1]]
        changed = ((now["span"] != before["span"]) | (now["page"] != before["page"])).to_numpy()
        self.now.update((now["span"].iloc[-1], None if pd.isna(page.iloc[-1]) else int(page.iloc[-1])))
        yield met.assign(page_index=page)[["session", "seq", "t", "span_id", "page_index"]][changed]

    def close(self) -> None:
        pass


class TimingProcessor(StatefulProcessor):
    """Rows (label, seq, ns): tumbling windows of `size` samples per label; the last one, unless full, is not reported.

    A label's samples of one micro-batch, which its trigger bounds, are put in order; of an open window its sums are kept.
    """

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "done long, n long, total long, least long, most long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        done, n, total, least, most = self.open.get() if self.open.exists() else (0, 0, 0, 0, 0)
        ns = pd.concat([r[["seq", "ns"]] for r in rows]).sort_values("seq")["ns"].to_numpy(np.int64)
        of = (n + np.arange(len(ns))) // self.size  # the window of each, from the open one on
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        sums, lows, highs = (f.reduceat(ns, starts) for f in (np.add, np.minimum, np.maximum))
        counts = np.diff(np.append(starts, len(ns)))
        if n:  # what the open window had
            counts[0], sums[0], lows[0], highs[0] = counts[0] + n, sums[0] + total, min(lows[0], least), max(highs[0], most)
        full = counts == self.size
        numbers = done + np.arange(len(counts))
        made = pd.DataFrame({"label": key[0], "window_no": numbers, "n": counts, "mean_ns": sums // np.maximum(counts, 1), "min_ns": lows, "max_ns": highs})
        rest = (int(counts[-1]), int(sums[-1]), int(lows[-1]), int(highs[-1])) if not full[-1] else (0, 0, 0, 0)
        self.open.update((int(done + full.sum()), *rest))
        yield made[full]

    def close(self) -> None:
        pass


def cursor_stream(positions: DataFrame) -> DataFrame:
    return positions.groupBy("session").transformWithStateInPandas(CursorProcessor(), CURSOR, "append", "none")


def timing_stream(samples: DataFrame, size: int) -> DataFrame:
    return samples.groupBy("label").transformWithStateInPandas(TimingProcessor(size), TIMINGS, "append", "none")


def cursor_batch(positions: DataFrame) -> DataFrame:
    """The cursor's changes from a finished log of positions."""
    now = F.struct("span_id", "page_index")
    found = Ranged(positions.where("span_id is not null"), "session", "seq").previous(now, "__b")
    return found.where(~F.col("__b").eqNullSafe(now)).select("session", "seq", "t", "span_id", "page_index")


def throttle(positions: DataFrame, every: int = 20, jump_ms: float = 1000.0, size: int = 8192) -> DataFrame:
    """Positions shown: each `every`-th since the last shown, or one at least jump_ms from the last shown. (session, seq, t)

    Which position is shown after one that is shown depends on that one alone, so every position is asked, in blocks that see `every` rows ahead, and the
    answers are followed (ordering.chain): a session with a large part of all rows is many tasks' work.
    """
    rows = positions.select(F.struct("session").alias("k"), "session", "seq", F.col("t").cast("double").alias("t"))
    numbered = materialise(Ranged(rows, "k", "seq").number("p"), "throttle-rows")
    seen = blocks_with_ahead(numbered, "k", "p", every, size)
    ahead = F.collect_list(F.struct("p", "t")).over(Window.partitionBy("k", "__block").orderBy("p").rowsBetween(1, every))
    far = F.filter(ahead, lambda x: (x["p"] - F.col("p") >= every) | (F.abs(x["t"] - F.col("t")) >= jump_ms))
    asked = seen.withColumn("n", F.try_element_at(far, F.lit(1))["p"]).where("__own").select("k", "p", "n")
    shown = chain(asked, "k", "p", "n", size).select("k", "p").hint("merge")  # its size is not known before it runs
    return numbered.join(shown, ["k", "p"], "left_semi").select("session", F.col("seq").cast("long").alias("seq"), "t")


def saved_positions(positions: DataFrame, every: int = 100) -> DataFrame:
    """What is kept of each session: every `every`-th position, and the last. (session, seq, t)"""
    found = Ranged(positions.select("session", "seq", "t"), "session", "seq").number("__n", "__of")
    return found.where(((F.col("__n") + 1) % every == 0) | (F.col("__n") + 1 == F.col("__of"))).select("session", "seq", "t")


def timing_windows(samples: DataFrame, size: int) -> DataFrame:
    """timing_stream()'s rows from a finished log."""
    numbered = Ranged(samples, "label", "seq").number("__n")
    w = numbered.withColumn("window_no", F.floor(F.col("__n") / size)).groupBy("label", "window_no")
    full = w.agg(F.count("*").alias("n"), F.sum("ns").alias("total"), F.min("ns").alias("min_ns"), F.max("ns").alias("max_ns")).where(F.col("n") == size)
    return full.select("label", "window_no", "n", F.expr("total div n").alias("mean_ns"), "min_ns", "max_ns")


def slow_samples(samples: DataFrame, threshold_ns: int) -> DataFrame:
    return samples.where(F.col("ns") >= threshold_ns)


def latest_jump(requests: DataFrame) -> DataFrame:
    """Of jump requests (session, ts, page_index, preferred) the latest of each session."""
    return requests.groupBy("session").agg(F.max_by("page_index", "ts").alias("page_index"))


def player_states(events: DataFrame) -> DataFrame:
    """events(session, seq, kind, play_when_ready) with is_playing and ended, as they are after each.

    kind: 'playing' (whether the player is meant to play, which a seek doesn't change, decides), 'ready' (not ended any more), 'ended'
    (neither plays), or another, which changes nothing. Before the first of each both are false.
    """
    kind = F.col("kind")
    playing = F.when(kind == "playing", F.col("play_when_ready")).when(kind == "ended", F.lit(False))
    over = F.when(kind == "ready", F.lit(False)).when(kind == "ended", F.lit(True))
    now = Ranged(events.select("session", "seq", "kind", "play_when_ready"), "session", "seq")
    both = now.last_known(playing, "is_playing").select("session", "seq", "kind", F.coalesce("is_playing", F.lit(False)).alias("is_playing"))
    ended = now.last_known(over, "ended").select(F.col("session").alias("__s"), F.col("seq").alias("__q"), F.coalesce("ended", F.lit(False)).alias("ended"))
    return both.join(ended, both["session"].eqNullSafe(ended["__s"]) & (both["seq"] == ended["__q"])).drop("__s", "__q")


def cursor_at_end(spans: DataFrame, pages: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, page_index, span_id): where the cursor goes when a book has ended: its last page and its last timed span, null without one."""
    last = spans.where(timed()).groupBy(book).agg(F.max_by("id", F.struct("clip_begin_ms", "ord")).alias("span_id"))
    return pages.groupBy(book).agg(F.max("page_index").alias("page_index")).join(last, book, "left")
