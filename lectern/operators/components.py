"""Connected components by alternating large-star and small-star rounds.

Each round is a few equi-joins and combinable minima over the edges. Minima are written before they are
joined, so that both sides of a join are plain exchanges and adaptive execution can split a node that
has a large part of all edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.shared import discard, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(u, v) -> (node, root): root is the least node reachable; only nodes with an edge to another.

    Self-loops and repeated edges are ignored; no edges give no rows. u and v: one orderable type.
    """
    now = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges"
    )
    before, state = None, _state(now)
    while state != before:
        before = state
        both = now.union(now.select("v", "u"))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"{name}-least")
        large = materialise(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-edges")
        discard(old, least, large, low)
        state = _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
