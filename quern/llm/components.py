"""Connected components by alternating large-star and small-star steps, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.store import drop_folder, written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over ``edges(u, v)``, u > v.

    Large: every node links its larger neighbours to the least node of its neighbourhood.
    Small: every node links its smaller neighbours and itself to the least of them.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    moved = moved.where(F.col("u") != F.col("v"))
    return moved if large else moved.distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) with v the least node of u's component, for every node of ``edges(u, v)`` that is not the least itself."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        after = written(star(star(now, True), False), "edges")
        drop_folder(now)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return after
        now, mark = after, seen
