"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and beginnings of words, each distinct word of the whole text counting once,
is fitted to confirmed toxic texts and to texts of unknown kind. With the share p of toxic texts, the risk on negatives is
estimated as the unlabelled texts' minus p times the positives'; where that estimate falls below zero, which only
overfitting can do, the step goes against it instead (the non-negative estimator). Scores are logistic in the
classifier's value, so 0.5 is its line.

Fitting uses at most about `positives` and `unlabelled` texts, chosen by a keyed hash of the text before anything is
computed of them, and only features that are more frequent in one of the two kinds than chance can make any feature (by the
likelihood ratio against the number of features); it runs in numpy in the driver.

Null and empty texts have the score of a text without words. Rows that repeat have equal scores, whatever batch they are in
(sums are exactly rounded); very long texts are read whole; empty tables give a model that calls nothing toxic, and an
empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 20
#: A word's features: itself, and its beginnings of these lengths, so that unseen forms of a stem count.
BEGINNINGS = (3, 4, 5, 6)
_WORD = re.compile(r"\w+")
_CACHED = 200_000


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def word_features(word: str) -> list[int]:
    names = [word, *("^" + word[:k] for k in BEGINNINGS if len(word) >= k)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in names]


def features(text: str | None) -> np.ndarray:
    """Feature numbers of all distinct words, with repeats."""
    return np.array([i for w in distinct_words(text) for i in word_features(w)], np.int32)


class Model:
    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float):
        self.ids, self.weights, self.bias = ids, weights, bias
        self._words: dict[str, float] = {}
        self._table = dict(zip(ids.tolist(), weights.tolist(), strict=True))

    def score(self, text: str | None) -> float:
        known, found = self._words, []
        for w in distinct_words(text):
            s = known.get(w)
            if s is None:
                if len(known) >= _CACHED:
                    known.clear()
                s = known[w] = math.fsum(self._table.get(i, 0.0) for i in word_features(w))
            if s:
                found.append(s)
        out = self.bias + math.fsum(found)  # whatever their order
        return float(1 / (1 + np.exp(-min(max(out, -30.0), 30.0))))


def select(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Features whose share of texts differs between the kinds by more than chance."""
    (pi, pn), (ui, un) = (np.unique(np.concatenate([np.unique(x) for x in rows]), return_counts=True) for rows in (positive, unlabelled))
    ids = np.union1d(pi, ui)
    a, b = np.zeros(len(ids)), np.zeros(len(ids))
    a[np.searchsorted(ids, pi)], b[np.searchsorted(ids, ui)] = pn, un
    n, m = len(positive), len(unlabelled)
    both = (a + b) / (n + m)

    def part(k: np.ndarray, of: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / (of * both)), 0) + np.where(k < of, (of - k) * np.log((of - k) / (of * (1 - both))), 0)

    ratio = 2 * (part(a, n) + part(b, m))
    return ids[ratio > 2 * np.log(max(len(ids), 2)) + 2]


def _rows(lists: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column numbers of all rows, and where each row ends."""
    cols, ends = [], []
    for x in lists:
        at = np.searchsorted(ids, x)
        ok = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == x) if len(ids) else np.zeros(len(x), bool)
        cols.append(at[ok])
        ends.append(int(ok.sum()))
    return np.concatenate(cols) if cols else np.zeros(0, np.int64), np.cumsum(ends, dtype=np.int64)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """nnPU with sigmoid loss, full-batch Adam; deterministic. prior: the share of toxic among the unlabelled."""
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), -10.0)
    ids = select(positive, unlabelled)
    (pc, pe), (uc, ue) = _rows(positive, ids), _rows(unlabelled, ids)
    pr = np.repeat(np.arange(len(positive)), np.diff(pe, prepend=0))
    ur = np.repeat(np.arange(len(unlabelled)), np.diff(ue, prepend=0))
    w, b = np.zeros(len(ids)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    np_, nu = len(positive), len(unlabelled)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        sp = sigmoid(b + np.bincount(pr, w[pc], np_))  # the sigmoid loss is bounded: no positive can weigh without end
        su = sigmoid(b + np.bincount(ur, w[uc], nu))
        slope_p, slope_u = prior * sp * (1 - sp) / np_, su * (1 - su) / nu
        if su.mean() - prior * sp.mean() >= 0:
            up, down = -2 * slope_p, slope_u  # the positives' own risk, and the estimate of the negatives'
        else:
            up, down = slope_p, -slope_u  # against the estimate alone
        gw = np.bincount(pc, up[pr], len(ids)) + np.bincount(uc, down[ur], len(ids)) + decay * w
        gb = up.sum() + down.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= scale * m / (np.sqrt(v) + 1e-7)
        b -= scale * mb / (np.sqrt(vb) + 1e-7)
    return Model(ids, w.astype(np.float32), b)


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", toxic: str = "toxic", positives: int = 2000, unlabelled: int = 6000) -> Model:
    """Fit on confirmed toxic rows (label 1) and on texts of docs whose label isn't looked at: about so many different texts each (at most twice as many), drawn by a hash of the text. Copies take one place.

    labels may be wider or narrower than docs; rows of null labels or ids are no labels. The prior is the
    share of label 1 among all labels.
    """
    own = labels.where(F.col(toxic).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(F.col(toxic)).alias("toxic"))
    n, ones = own.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or not ones:
        return fit([], [], 0.5)
    range_ = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit("toxicity sample"), "text"), F.lit(range_))

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array([features(t).tobytes() for t in texts.to_pylist()], pa.binary())

    def sample(rows: DataFrame, most: int, of: int) -> list[np.ndarray]:
        """About `most` different texts of about `of`; features are computed of those alone, and only they move."""
        part = rows.where(draw < int(range_ * min(1.0, most / max(of, 1)))).select(draw.alias("d"), "text").distinct()
        few = part.select("d", ids("text").alias("w")).orderBy("d", "w").limit(2 * most)
        return [np.frombuffer(r["w"], np.int32) for r in few.toLocalIterator()]

    rows = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    bad = own.where("toxic = 1").select("id").where(F.pmod(F.xxhash64(F.lit("toxicity bound"), "id"), F.lit(range_)) < int(range_ * min(1.0, 2 * positives / ones)))
    found = rows.join(F.broadcast(bad), "id", "left_semi")  # about 2 * positives ids
    different = lambda of: of.agg(F.approx_count_distinct(F.xxhash64("text"), 0.02)).first()[0]
    return fit(sample(found, positives, different(found)), sample(rows.select("text"), unlabelled, different(rows)), min(max(ones / n, 1e-4), 0.9))


def scores(spark: SparkSession, model: Model, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)  # as large as the vocabulary of the bounded sample

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return of(text)
