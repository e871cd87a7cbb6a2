"""Canonical exact digests of texts [native].

A text's canonical form is NFKC, then full case folding, NFKC again, runs of white space as one blank,
none at the ends. Its fingerprint is two XXH64 of that form under different seeds (128 bits, 32 hex
digits). Documents of one fingerprint are a bucket; the canonical bytes inside buckets of several are
compared by grouping on them, with combining before the shuffle, so a bucket of a third of all rows costs
a row per task. `exact_class` is the smallest id whose canonical bytes are the same: it tells equal texts
from texts that merely share a fingerprint.

Normalisation and folding are ICU's, which Spark ships, called by java_method(): a SQL function.

Only texts of buckets of several are made canonical a second time, to be compared.

Null text counts as empty. Rows of one id and one text are one document, repeated in the result; null ids
sort below all others. Very long texts are digested whole; an empty table gives an empty result. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.shared import broadcast_if_small, materialise

_NONE = -(1 << 63)
#: Java's \s, and what NFKC leaves of Unicode's other white space.
_BLANKS = r"[\s\u001C-\u001F\u0085   ᠎]+"


def _nfkc(text: Column) -> Column:
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def canonical(text: Column) -> Column:
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(_nfkc(folded), _BLANKS, " "))


def halves(canon: Column) -> tuple[Column, Column]:
    """The two XXH64 of a canonical form."""
    return F.xxhash64(canon), F.xxhash64(F.lit("second"), canon)


def hex_digest(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    """k: the id, never null; tie: tells texts of one id apart."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(id).cast("long"), F.lit(_NONE)).alias("k"), F.col(id).alias("id"), F.xxhash64(t).alias("tie"), t.alias("text"))


def classes(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, tie, n_chars, h1, h2, cls) for each document, as a table; cls: the least k of equal canonical bytes."""
    rows = _rows(docs, id, text).withColumn("canon", canonical(F.col("text")))
    h1, h2 = halves(F.col("canon"))
    rows = rows.withColumns({"h1": h1, "h2": h2})
    keys = materialise(rows.select("k", "tie", F.length("text").cast("long").alias("n_chars"), "h1", "h2").distinct(), "digest-keys")
    buckets = materialise(keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("k").alias("first")).where("n > 1").drop("n"), "digest-buckets")
    members = materialise(keys.join(broadcast_if_small(buckets.select("h1", "h2")), ["h1", "h2"], "left_semi").select("k", "tie"), "digest-members")
    shared = _rows(docs, id, text).join(broadcast_if_small(members), ["k", "tie"], "left_semi").withColumn("canon", canonical(F.col("text")))
    h1, h2 = halves(F.col("canon"))
    shared = shared.withColumns({"h1": h1, "h2": h2})
    alike = shared.groupBy("h1", "h2", "canon").agg(F.min("k").alias("cls"))
    split = Window.partitionBy("h1", "h2")  # of distinct canonical forms that share 128 bits: one, but for a collision
    mixed = materialise(alike.withColumn("forms", F.count("*").over(split)).where("forms > 1").drop("forms"), "digest-mixed")
    apart = keys.limit(0).select("k", "tie", "h1", F.lit(0).cast("long").alias("cls")).drop("h1")
    if not mixed.isEmpty():
        apart = materialise(shared.join(mixed, ["h1", "h2", "canon"]).select("k", "tie", "cls").distinct(), "digest-apart")
    found = keys.join(buckets, ["h1", "h2"], "left").join(apart, ["k", "tie"], "left")
    return materialise(found.select("k", "tie", "n_chars", "h1", "h2", F.coalesce("cls", "first", "k").alias("cls")), "digest-classes")


_KEY = ("k", "tie", "n_chars", "h1", "h2", "cls")


def neighbours(keys: DataFrame) -> DataFrame:
    """keys with next_* and prev_*: the documents after and before each in descending (k, tie), as a ring.

    Sorted by range partitions; only a row per partition meets in one task, to close the seams.
    """
    order = [F.col("k").desc(), F.col("tie").desc()]
    placed = materialise(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "digest-placed")
    own = F.struct(*_KEY)
    ends = placed.groupBy("part").agg(F.max(own).alias("head"), F.min(own).alias("tail"))
    along, back = Window.orderBy("part"), Window.orderBy(F.col("part").desc())
    ring = ends.select(
        "part",
        F.coalesce(F.lead("head").over(along), F.first("head").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"),
        F.coalesce(F.lag("tail").over(along), F.first("tail").over(back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    seen = placed.join(F.broadcast(ring), "part").select(*_KEY, F.coalesce(F.lead(own).over(inside), "after").alias("next"), F.coalesce(F.lag(own).over(inside), "before").alias("prev"))
    return materialise(seen, "digest-ring")


def edited_likeness(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's digest against that of its edit and that of the next document, descending id.

    The edit replaces the last third (rounded down) by the beginning of the next document. Likeness of
    exact digests is 1 for equal canonical bytes and 0 otherwise.
    """
    ring = neighbours(classes(spark, docs, id, text))
    rows = _rows(docs, id, text).select("k", "tie", "text")  # the same columns on both ways: texts are shuffled once
    third = F.floor(F.col("prev.n_chars") / 3).cast("int")
    heads = rows.join(ring, ["k", "tie"]).select(F.col("prev.k").alias("k"), F.col("prev.tie").alias("tie"), F.substring(F.col("text"), F.lit(1), third).alias("head"))
    if not rows.select("k", "tie").groupBy("k", "tie").count().where("count > 1").isEmpty():
        heads = heads.distinct()
    keep = (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")
    whole = (
        rows.join(heads, ["k", "tie"]).join(ring, ["k", "tie"])
        .withColumn("edit", F.concat(F.substring(F.col("text"), F.lit(1), keep), F.col("head")))
        .select("k", "n_chars", "h1", "h2", "cls", "next", "text", "edit", canonical(F.col("edit")).alias("canon_edit"))
    )
    e1, e2 = halves(F.col("canon_edit"))
    same = (F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2"))
    after = (F.col("h1") == F.col("next.h1")) & (F.col("h2") == F.col("next.h2")) & (F.col("cls") == F.col("next.cls"))
    return whole.withColumns({"e1": e1, "e2": e2}).select(
        F.when(F.col("k") != _NONE, F.col("k")).cast(docs.schema[id].dataType).alias(id),
        "n_chars",
        F.sha2("edit", 256).alias("edited_sha256"),
        hex_digest(F.col("h1"), F.col("h2")).alias("fingerprint"),
        hex_digest(F.col("e1"), F.col("e2")).alias("edited_fingerprint"),
        F.when(same, canonical(F.col("text")) == F.col("canon_edit")).otherwise(F.lit(False)).cast("double").alias("near_edited"),
        after.cast("double").alias("near_next"),
        F.when(F.col("cls") == _NONE, F.lit(None)).otherwise(F.col("cls")).alias("exact_class"),
    )
