"""What bounds a task's memory and what is shuffled, whatever the tables' size."""

from pyspark.sql import functions as F

from lectern.operators import lookups
from lectern.shared import bound_tasks, unbound_tasks
from lectern.streaming import playback


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rectangles_on_pages_without_taps_are_left_out(spark):
    rects = spark.range(4000).select((F.col("id") % 2000).cast("int").alias("page_index"), F.col("id").alias("span_id"), F.col("id").alias("span_pos"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(50.0).alias("w"), F.lit(50.0).alias("h"))
    taps = spark.createDataFrame([(7, 1, 10.0, 10.0), (7, 2, 60.0, 10.0), (None, 3, 1.0, 1.0)], "page_index int, tap_id long, tap_x double, tap_y double")
    found = lookups.point_in_rect(taps, rects).select("tap_id", "span_id")
    assert "LeftSemi" in _plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, 7), (2, None), (3, None)]


def test_shown_positions_are_not_broadcast(spark):
    rows = spark.range(500).select(F.lit(1).alias("session"), F.col("id").alias("seq"), (F.col("id") * 10.0).alias("t"))
    shown = playback.throttle(rows, size=64)
    assert "SortMergeJoin" in _plan(shown) and "Broadcast" not in _plan(shown).split("SortMergeJoin")[0]
    assert [r.seq for r in shown.orderBy("seq").collect()] == list(range(0, 500, 20))


def test_shuffles_are_dealt_by_the_tables_size(spark, tmp_path):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    (tmp_path / "t.parquet").write_bytes(b"x" * 1_000_000)
    try:
        bound_tasks(spark, str(tmp_path), 10_000)
        assert spark.conf.get(key) == "100"
        bound_tasks(spark, str(tmp_path))
        assert spark.conf.get(key) == spark.conf.get("spark.sql.shuffle.partitions")
    finally:
        unbound_tasks(spark)
