"""Rolling samples: statistics of the last windows of time from a small state alone.

Of every window the state keeps the k rows whose keys hash least (a bottom-k sample): every key is as likely as any other,
whatever its place, and the sample is the same whatever the number of tasks or runs that it was made in. Samples merge:
the least k of two samples are those of their union. Windows that have passed are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import versions


def bottom_k(rows: DataFrame, key: str, k: int, by: list[str] | None = None) -> DataFrame:
    """A row for each of the k keys of a group that hash least; null keys don't count.

    Keys are found first, without what else the rows hold: distinct ones, combined before their shuffle, ranked with a
    limit within each task. Then the rows of these few are fetched; of rows that share a key the one that is least by
    its whole content stays, so the sample doesn't hang on their order.
    """
    on, names = [*(by or []), key], rows.columns
    there = rows.where(F.col(key).isNotNull())
    order = Window.partitionBy(*(by or [])).orderBy(F.xxhash64(key), key)
    least = there.select(on).distinct().withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).drop("__k")
    found = there.join(least, on, "left_semi").withColumn("__all", F.to_json(F.struct(*names)))
    return found.groupBy(*on).agg(F.min_by(F.struct(*names), "__all").alias("r")).select("r.*")


class Sample:
    """A rolling sample in a folder of versions: (window, every column of the rows)."""

    def __init__(self, spark: SparkSession, path: str, key: str, k: int = 1000, hours: int = 24, keep: int = 14):
        self.spark, self.path, self.key, self.k, self.seconds, self.keep = spark, path, key, k, hours * 3600, keep

    def window(self, ts: str) -> Column:
        """The number of the window that a time lies in."""
        return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / self.seconds).alias("window")

    def take(self, rows: DataFrame, ts: str) -> None:
        """Add rows, which may come late or again; windows older than the last ``keep`` go."""
        new = bottom_k(rows.withColumn("window", self.window(ts)).where("window is not null"), self.key, self.k, ["window"])
        held = versions.newest(self.spark, self.path)
        both = new if held is None else bottom_k(held.unionByName(new), self.key, self.k, ["window"])
        last = both.agg(F.max("window").alias("__last"))  # one row
        versions.write(both.crossJoin(F.broadcast(last)).where(F.col("window") > F.col("__last") - self.keep).drop("__last"), self.path)

    def rows(self, windows: int | None = None) -> DataFrame:
        """The sample of the last windows, or of all that are kept. The state alone is read."""
        held = versions.newest(self.spark, self.path)
        if held is None:
            raise ValueError(f"no sample in {self.path}")
        if windows is None:
            return held
        return held.crossJoin(F.broadcast(held.agg(F.max("window").alias("__last")))).where(F.col("window") > F.col("__last") - windows).drop("__last")
