"""Contracts on streams: an extension, with batch semantics where they carry over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import moments
from .sequences import sequence_gaps

__all__ = ["baseline_updates", "failure_windows", "first_of", "quarantine_split", "sequence_gaps"]


def failure_windows(
    stream: DataFrame, key: str = "check_id", ts: str = "ts", hours: int = 1, slide: str = "10 minutes", limit: int = 3
) -> DataFrame:
    """Sliding windows with at least ``limit`` failures of a check; later data than ``hours`` is dropped."""
    span = f"{hours} hours"
    return stream.withWatermark(ts, span).groupBy(F.window(ts, span, slide), key).agg(
        F.count(F.lit(1)).alias("failures")
    ).where(F.col("failures") >= limit)


def first_of(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Drops rows whose keys came before within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def quarantine_split(stream: DataFrame, bad: Column, good_path: str, bad_path: str, checkpoint: str):
    """A query that writes good and bad rows apart; a batch that is repeated after a failure replaces its files."""

    def write(batch: DataFrame, n: int) -> None:
        marked = batch.withColumn("__bad", F.coalesce(bad, F.lit(False))).persist()
        marked.where("not __bad").drop("__bad").write.mode("overwrite").parquet(f"{good_path}/batch={n}")
        marked.where("__bad").drop("__bad").write.mode("overwrite").parquet(f"{bad_path}/batch={n}")
        marked.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def baseline_updates(stream: DataFrame, metrics: dict[str, Column], path: str, checkpoint: str, apart: int = moments.APART):
    """A query that adds each batch's moments to the store at ``path``; ``moments.Store`` reads baselines of all batches there.

    A batch that is repeated after a failure replaces itself.
    """

    def learn(batch: DataFrame, n: int) -> None:
        store = moments.Store(batch.sparkSession, path)
        store.put(n, moments.moments(batch, metrics))
        store.compact(apart)

    return stream.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint)
