"""Connected components by alternating large and small stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import released, written


def _least(edges: DataFrame) -> DataFrame:
    """Per node the least of its neighbours and itself, as a table, so that a join with it can split a hot node."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of any kind of integers: one row (u, v) per node that is not the least of its component, v that least.

    Self-edges and repeated edges change nothing; edges with a null end are ignored.
    """
    tidy = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, before = written(tidy.distinct()), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _least(both)
        large = written(
            both.join(near, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        last, now = now, written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        released(near, large, least, last)
