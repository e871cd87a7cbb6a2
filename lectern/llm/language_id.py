"""Language identification by error-correcting output codes.

Every language has a codeword of bits; one linear classifier per bit, over hashed character n-grams of the
whole text, says on which side of its bit a text lies. Decoding is weighted by loss: each bit's logistic
loss counts as much as the bit was right on the fitted rows, and the codeword of the least loss wins (of equal losses the
first language by name). A text whose two nearest codewords are almost as near is flagged as ambiguous.

Fitting uses at most `per_language` distinct texts of each language, and `most` in all (a language's share is then less),
chosen by a keyed hash of the text, and their whole texts. Executors turn them into n-gram counts, of which a text has
WIDTH at most, and only those reach the driver, where numpy fits matrices of a fixed size. With one learned language
every text with a letter is of that language; with none every prediction is `und`.

Null text, and text without a letter, is `und` with score 0. Rows that repeat are predicted alike and count once in
fitting; very long texts are counted whole, a slice at a time; an empty table gives an empty result. Other columns are ignored by train()
and identify() and kept by reject_unclear(), whatever their names.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.shared import broadcast_if_small, materialise, release_memory

WIDTH = 1 << 14
UNKNOWN = "und"
_SLICE = 1 << 20


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str, width: int = WIDTH) -> np.ndarray:
    """Hashed counts of the 1-, 2- and 3-grams of the lower-cased text's code points, as unit-length square roots."""
    counts = np.zeros(width, np.int64)
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le"), np.uint32)
    shift = np.uint32(32 - (width.bit_length() - 1))
    for at in range(0, len(points), _SLICE):
        c = points[at : at + _SLICE + 2]
        h = c * np.uint32(0x9E3779B1)
        own = min(_SLICE, len(c))
        counts += np.bincount((h[:own] >> shift).astype(np.intp), minlength=width)
        for k in (1, 2):
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[k:] * np.uint32(0xC2B2AE35)
            if len(h):
                counts += np.bincount((h[:own] >> shift).astype(np.intp), minlength=width)
    x = np.sqrt(counts.astype(np.float32))
    return x / np.float32(np.sqrt(counts.sum()))


def sparse(text: str, width: int = WIDTH) -> bytes:
    """grams() as the numbers and values of what isn't zero."""
    x = grams(text, width)
    at = np.flatnonzero(x)
    return at.astype(np.uint16).tobytes() + x[at].tobytes()


def dense(packed: list[bytes], width: int = WIDTH) -> np.ndarray:
    out = np.zeros((len(packed), width), np.float32)
    for row, blob in zip(out, packed, strict=True):
        n = len(blob) // 6
        row[np.frombuffer(blob, np.uint16, n)] = np.frombuffer(blob, np.float32, n, 2 * n)
    return out


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1/-1. Up to 5 languages: every way to halve them; beyond, seeded random bits, far apart."""
    if n <= 1:
        return np.zeros((n, 0), np.int8)
    if n <= 5:
        bits = range(1, 2 ** (n - 1))
        return np.array([[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for b in bits] for i in range(n)], np.int8)
    rng, best, far = random.Random(seed), None, -1
    size = 15 * (n - 1).bit_length()
    for _ in range(64):
        m = np.array([[rng.choice((-1, 1)) for _ in range(size)] for _ in range(n)], np.int8)
        if any(abs(int(m[:, b].sum())) == n for b in range(size)):
            continue
        d = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if d > far:
            best, far = m, d
    return best if best is not None else m


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray  # WIDTH x bits
    bias: np.ndarray
    trust: np.ndarray
    margin: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        out = grams(text) @ self.weights + self.bias
        loss = (np.logaddexp(0, -self.codes * out) * self.trust).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        odds = np.exp(loss[order[0]] - loss)
        return self.languages[order[0]], float(1 / odds.sum()), bool(loss[order[1]] - loss[order[0]] < self.margin)


def fit(packed: list[bytes], langs: list[str], steps: int = 150, rate: float = 0.5, decay: float = 1e-5, margin: float = 0.05) -> Model:
    """Logistic regression per bit by full-batch Adam; deterministic. packed: sparse() of each text."""
    names = tuple(sorted(set(langs)))
    codes = codewords(len(names))
    if len(names) < 2:
        return Model(names, codes, np.zeros((WIDTH, 0), np.float32), np.zeros(0, np.float32), np.zeros(0), margin)
    x = dense(packed)
    lang = np.array([names.index(v) for v in langs])
    y = codes[lang].astype(np.float32)
    share = (1 / np.bincount(lang, minlength=len(names)))[lang].astype(np.float32)[:, None] / len(names)
    w, b = np.zeros((WIDTH, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    mb, vb = np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) * share
        gw, gb = x.T @ g + decay * w, g.sum(axis=0)
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= scale * m / (np.sqrt(v) + 1e-6)
        b -= scale * mb / (np.sqrt(vb) + 1e-6)
    trust = (np.sign(x @ w + b) == y).mean(axis=0)
    return Model(names, codes, w, b, np.maximum(trust - 0.5, 0.01) * 2, margin)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 400, most: int = 4000) -> Model:
    """Fit on a sample of labelled: of each language at most per_language distinct texts, of all at most `most`, by a hash of the text.

    A first draw by the hash leaves about twice as many distinct texts of each language, so that only those are counted and compared.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("text").alias("texts"))
    each = F.greatest(F.lit(1), F.least(F.lit(per_language), F.floor(F.lit(most) / F.count("*").over(Window.partitionBy()))))  # a row per language
    sizes = materialise(sizes.withColumn("each", each), "language-sizes")
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "text"), F.lit(1 << 30))

    @F.arrow_udf("binary")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([sparse(t) if has_letter(t) else b"" for t in texts.to_pylist()], pa.binary())

    drawn = rows.join(broadcast_if_small(sizes), "lang").withColumn("draw", draw).where(F.col("draw") < F.lit(float(1 << 30)) * 2 * F.col("each") / F.col("texts"))
    # a filter on what is counted would be pushed below the join, and so to all rows: it is put behind the aggregate
    told = drawn.select("lang", "each", "draw", counted("text").alias("x")).groupBy("lang", "each", "draw").agg(F.min("x").alias("x")).where(F.length("x") > 0)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    sample = told.withColumn("place", place).where("place <= each").select("lang", "draw", "x")
    listed = sorted((r["lang"], r["draw"], bytes(r["x"])) for r in sample.toLocalIterator())
    return fit([x for _, _, x in listed], [v for v, _, _ in listed])


def identify(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct<lang, score, ambiguous> of each text."""
    shared = spark.sparkContext.broadcast(model)  # of a fixed size for a number of languages

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield pd.DataFrame([own.predict(t) for t in texts], columns=["lang", "score", "ambiguous"])
        release_memory()

    return of(text)


def reject_unclear(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without those of no language: no letters, or ambiguous between two. All columns stay."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), identify(spark, model, F.col(text)).alias("found"))
    return rows.where((F.col("found.lang") != UNKNOWN) & ~F.col("found.ambiguous")).select("row.*")
