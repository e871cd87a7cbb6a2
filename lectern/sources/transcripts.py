"""Transcripts as words with times and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.align import locate_tokens

TRANSCRIPT = "transcript string, wordTimeline array<struct<text:string,startTime:double,endTime:double,startOffsetUtf16:bigint,endOffsetUtf16:bigint,audiofile:string>>"
RECOGNISED = "text string, sentences array<struct<text:string,start:double,end:double,tokens:array<struct<text:string,start:double,end:double>>>>"


def read_transcripts(spark: SparkSession, path: str, default_audio: str) -> tuple[DataFrame, DataFrame]:
    """(transcripts(file, transcript), words(file, ord, text, start_s, end_s, start_off, end_off, audiofile)); words without a file are of the default."""
    raw = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    w = raw.select("file", F.posexplode("wordTimeline").alias("ord", "w")).select("file", "ord", "w.text", F.col("w.startTime").alias("start_s"), F.col("w.endTime").alias("end_s"), F.col("w.startOffsetUtf16").alias("start_off"), F.col("w.endOffsetUtf16").alias("end_off"), F.coalesce("w.audiofile", F.lit(default_audio)).alias("audiofile"))
    return raw.select("file", "transcript"), w


def read_recognised(spark: SparkSession, path: str, audiofile: str) -> DataFrame:
    """words of a recogniser's result: tokens are looked for in its text, ahead only; those that aren't there are dropped."""
    raw = spark.read.schema(RECOGNISED).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    flat = raw.select("file", "text", F.flatten(F.transform("sentences", lambda s: s["tokens"])).alias("t"))
    at = locate_tokens(flat.withColumn("tokens", F.transform("t", lambda x: F.trim(x["text"]))))
    rows = at.select("file", F.posexplode(F.arrays_zip("t", "tokens", "offsets")).alias("ord", "z")).where("z.offsets is not null and z.tokens <> ''")
    return rows.select("file", "ord", F.col("z.tokens").alias("text"), F.col("z.t.start").alias("start_s"), F.col("z.t.end").alias("end_s"), F.col("z.offsets").cast("long").alias("start_off"), (F.col("z.offsets") + F.length("z.tokens")).cast("long").alias("end_off"), F.lit(audiofile).alias("audiofile"))
