"""A training corpus from raw documents: each stage is one operator, works on all that the stage before kept, and returns a table.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents, in their order, and
further columns that docs has, whatever their names (with dots, or like names that an operator uses). Every
stage takes nulls in any column, empty and very long texts (whole), rows that repeat and empty tables; what
comes out of them is said below.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language_id, line_index, merge_dropout, mixture, simhash
from lectern.shared import materialise, ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no language go: null, without letters, or ambiguous between two. Learned from the rows that have a language.

    Equal texts stay or go together. With no row that has a language every text is of none, so all go; an empty table stays empty.
    """
    return language_id.reject_unclear(spark, docs, language_id.train(docs))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five documents or more share stay in the one of the largest id only; n_chars, if there, follows the text.

    Null text becomes an empty one. Rows of one id are one document; null ids are one document, below all others. A text of which nothing is left stays, empty.
    """
    kept = line_index.dedup_lines(spark, docs)
    size = lambda c: F.length("text").cast(docs.schema[c].dataType).alias(c)
    return kept.select(*[size(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id (null ids last, ties by text): groups are linked by fingerprints
    within two bits, and by a cosine of 0.8 or more of shingles of five words.

    Null, empty and wordless texts are one group. Of rows of one id and text one stays.
    """
    return simhash.keep_one(spark, docs, radius=2, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, sources by their weights, shuffled. A null source is one, the last.

    Empty texts have no words, so whether the mix takes them follows from their place alone. Rows of one id are taken alike.
    """
    return mixture.mix_documents(spark, docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, lossless and the piece ids of every document of the mix; null text: all but doc_id and source null. Rows that repeat have equal ids."""
    made = merge_dropout.encode_rows(spark, docs.select("doc_id", "source", "text"))
    size = F.when(F.col("__ids").isNotNull(), F.size("__ids")).cast("long")
    return made.select("doc_id", "source", size.alias("n_pieces"), F.col("__lossless").alias("lossless"), F.col("__ids").alias("ids"))


def _shipped(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage, with the package sent to the Python workers first."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", _shipped(identify_language)),
    ("line_dedup", _shipped(drop_shared_lines)),
    ("simhash_near_dedup", _shipped(drop_near_duplicates)),
    ("source_mixing", _shipped(mix_sources)),
    ("sentencepiece", _shipped(encode_pieces)),
]

#: No SQL for a trained classifier; tests/llm hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
