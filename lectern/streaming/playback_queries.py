"""Playback over the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import bindings as B
from lectern.shared import materialise, new_path
from lectern.streaming import playback as P


def _samples(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events")
    return e.select(F.col("event_type").alias("label"), F.col("event_id").alias("seq"), F.floor(F.col("value") * 1000).cast("long").alias("ns"))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events")
    n = F.col("event_id")
    return e.select(F.col("user_id").alias("session"), n.alias("seq"), (n * 50 + F.when(n % 37 == 0, 5000).otherwise(0)).cast("double").alias("t"), F.when(n % 4 != 0, F.concat(F.lit("s"), F.floor(n / 300).cast("string"))).alias("span_id"), F.floor(n / 900).cast("int").alias("page_index"))


_POS = "pos AS (SELECT user_id AS session, event_id AS seq, (event_id * 50 + CASE WHEN event_id % 37 = 0 THEN 5000 ELSE 0 END)::DOUBLE AS t, CASE WHEN event_id % 4 <> 0 THEN 's' || (event_id // 300) END AS span_id, (event_id // 900)::INT AS page_index FROM events)"
_TIMINGS = """WITH w AS (SELECT event_type AS label, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 200 AS window_no, floor(value * 1000)::BIGINT AS ns FROM events)
SELECT label, window_no, count(*) AS n, (sum(ns) // count(*))::BIGINT AS mean_ns, min(ns) AS min_ns, max(ns) AS max_ns FROM w GROUP BY 1, 2 HAVING count(*) = 200"""
_CURSOR = f"""WITH {_POS}, m AS (SELECT *, lag(span_id) OVER o AS a, lag(page_index) OVER o AS b FROM pos WHERE span_id IS NOT NULL WINDOW o AS (PARTITION BY session ORDER BY seq))
SELECT session, seq, t, span_id, page_index FROM m WHERE a IS DISTINCT FROM span_id OR b IS DISTINCT FROM page_index"""


def rolling_timing_stats(spark: SparkSession, d: str) -> DataFrame:
    return P.timing_windows(_samples(spark, d), 200)


def slow_samples(spark: SparkSession, d: str) -> DataFrame:
    return P.slow_samples(_samples(spark, d), 60000)


def playback_cursor(spark: SparkSession, d: str) -> DataFrame:
    return P.cursor_batch(_positions(spark, d))


def position_throttle(spark: SparkSession, d: str) -> DataFrame:
    return P.throttle(_positions(spark, d))


def position_saves(spark: SparkSession, d: str) -> DataFrame:
    return P.saved_positions(_positions(spark, d))


def _run(spark: SparkSession, rows: DataFrame, name: str, make) -> DataFrame:
    """Write rows as two lots of as many files in the order of seq, stream a lot at a time, and read the sink."""
    source, sink, state = (new_path(spark, f"{name}-{x}") for x in ("source", "sink", "state"))
    n, middle = rows.agg(F.count("*"), F.coalesce(F.expr("percentile_approx(seq, 0.5)"), F.lit(0))).first()
    files = max(1, min(spark.sparkContext.defaultParallelism, n // 10_000))
    for part in (F.col("seq") <= middle, F.col("seq") > middle):
        rows.where(part).repartition(files).write.mode("append").parquet(source)
    own = spark.newSession()  # with settings of its own
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    made = make(own.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source))
    made.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(sink)


def playback_cursor_stream(spark: SparkSession, d: str) -> DataFrame:
    """playback_cursor as a stream."""
    return _run(spark, materialise(_positions(spark, d), "positions"), "cursor", P.cursor_stream)


def rolling_timing_stream(spark: SparkSession, d: str) -> DataFrame:
    """rolling_timing_stats as a stream."""
    return _run(spark, materialise(_samples(spark, d), "samples"), "timing", lambda s: P.timing_stream(s, 200))


QUERIES = {f.__name__: f for f in (rolling_timing_stats, slow_samples, playback_cursor, position_throttle, position_saves, playback_cursor_stream, rolling_timing_stream)}
SQL = {
    "rolling_timing_stats": _TIMINGS, "rolling_timing_stream": _TIMINGS, "playback_cursor": _CURSOR, "playback_cursor_stream": _CURSOR,
    "slow_samples": "SELECT event_type AS label, event_id AS seq, floor(value * 1000)::BIGINT AS ns FROM events WHERE floor(value * 1000) >= 60000",
    "position_throttle": f"""WITH RECURSIVE {_POS}, k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS k FROM pos),
w AS (SELECT session, seq, t, k, 0 AS n, t AS last, TRUE AS shown FROM k WHERE k = 1 UNION ALL SELECT session, seq, t, k, CASE WHEN s THEN 0 ELSE n + 1 END, CASE WHEN s THEN t ELSE last END, s
FROM (SELECT k.session, k.seq, k.t, k.k, w.n, w.last, w.n + 1 >= 20 OR abs(k.t - w.last) >= 1000 AS s FROM k JOIN w ON k.session = w.session AND k.k = w.k + 1)) SELECT session, seq, t FROM w WHERE shown""",
    "position_saves": f"WITH {_POS}, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS n, count(*) OVER (PARTITION BY session) AS c FROM pos) SELECT session, seq, t FROM n WHERE n % 100 = 0 OR n = c",
}
