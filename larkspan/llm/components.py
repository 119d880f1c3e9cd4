"""Connected components by alternating large-star and small-star steps, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.scratch import materialize, release


def _large(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that both sides of the join are plain shuffles: adaptive execution can then split a hub's many edges
    low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
    return low, both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``(node, component)``, component the smallest node reachable.

    Nodes without an edge to another node do not appear. Nulls and loops are ignored. Each step is
    written to the shared folder; rounds stop when the edge set no longer changes.
    """
    e = edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, seen = materialize(e, "cc"), None
    while True:
        got = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == seen or not got[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen, old = tuple(got), e
        low, stars = _large(e)
        e = materialize(_small(stars), "cc")
        release(old)
        release(low)
