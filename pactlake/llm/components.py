"""Connected components by alternating large-star and small-star rounds.

Each round replaces edges by edges to the smallest neighbour, using only
aggregations and joins; hubs are pre-aggregated, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import cut, release


def _to_least(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges: two long columns. Returns id, component (its smallest id) for every id on an edge between different ids."""
    a, b = edges.columns[:2]
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        j = e.join(_to_least(e), "u")
        e = cut(
            j.select(F.col("u"), F.col("m").alias("v")).unionByName(
                j.select(F.col("v").alias("u"), F.col("m").alias("v"))
            ).where("u > v").distinct()
        )
        release(edges.sparkSession)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
