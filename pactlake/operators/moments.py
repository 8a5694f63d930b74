"""Mergeable moments: baselines that learn from every batch.

A batch leaves one row a column: n, mean, m2 (the sum of squared deviations from its
own mean), least and greatest. Rows of several batches join to those of all their values:
m2 grows by n times the squared distance of each batch's mean from the common one, so no digits are lost as in
sums of squares.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import _files, remove

KIND = "column string, n long, mean double, m2 double, min double, max double"
#: Batches that stay apart before they are folded into one.
APART = 16


def moments(df: DataFrame, metrics: dict[str, Column | str], by: list[str] | None = None) -> DataFrame:
    """(*by, column, n, mean, m2, min, max) of every metric in one pass; what isn't a finite number doesn't count."""
    keys, rows = by or [], []
    for name, m in metrics.items():
        v = (F.expr(m) if isinstance(m, str) else m).try_cast("double")
        v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        n = F.count(v)
        rows.append(
            F.struct(
                F.lit(name).alias("column"), n.alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * n).alias("m2"),
                F.min(v).alias("min"), F.max(v).alias("max")
            )
        )
    one = df.groupBy(*keys).agg(F.array(*rows).alias("r"))
    return one.select(*keys, F.explode("r").alias("r")).select(*keys, "r.*").where("n > 0")


def merged(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The moments of all values whose parts' moments are given, by column."""
    keys = [*(by or []), "column"]
    whole = F.sum(F.col("n") * F.col("mean")).over(Window.partitionBy(*keys)) / F.sum("n").over(Window.partitionBy(*keys))
    apart = F.col("m2") + F.col("n") * (F.col("mean") - F.col("__mean")) * (F.col("mean") - F.col("__mean"))
    out = parts.withColumn("__mean", whole).groupBy(*keys)
    return out.agg(
        F.sum("n").alias("n"), F.first("__mean").alias("mean"), F.sum(apart).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max")
    )


def baselines(parts: DataFrame, least: int = 10, by: list[str] | None = None) -> DataFrame:
    """(column, mean, std, n, min, max) from ``least`` values on; ``drift.drift`` takes them as a baseline."""
    found = merged(parts, by).where(F.col("n") >= least)
    return found.select(*(by or []), "column", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"), "n", "min", "max")


class Store:
    """Moments of numbered batches in a folder.

    A batch has a folder of its own, so a batch that is repeated replaces itself and counts once. ``compact`` folds
    all but the newest ``apart`` batches into one folder that names the last of them: readers take the
    newest such folder and the batches after it, so it doesn't matter when the folded ones go.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, batch: int, rows: DataFrame) -> None:
        rows.select(*[x.split()[0] for x in KIND.split(", ")]).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def _held(self) -> tuple[int, list[int]]:
        """The last batch that is folded in, -1 without one, and the batches after it."""
        files, place = _files(self.spark, self.path), self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
        # a folder counts once its writer has ended
        done = lambda n: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        found = [(m[1], int(m[2])) for n in names if (m := re.fullmatch(r"(upto|batch)=(\d+)", n)) and done(n)]
        upto = max((k for kind, k in found if kind == "upto"), default=-1)
        return upto, sorted(k for kind, k in found if kind == "batch" and k > upto)

    def parts(self, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those before one that are still apart."""
        upto, apart = self._held()
        paths = [f"{self.path}/upto={upto}"] * (upto >= 0) + [f"{self.path}/batch={k}" for k in apart if before is None or k < before]
        return self.spark.read.schema(KIND).parquet(*paths) if paths else self.spark.createDataFrame([], KIND)

    def baselines(self, least: int = 10, before: int | None = None) -> DataFrame:
        return baselines(self.parts(before), least)

    def compact(self, apart: int = APART) -> None:
        upto, held = self._held()
        old = held[: max(0, len(held) - apart)]
        if not old:
            return
        paths = [f"{self.path}/upto={upto}"] * (upto >= 0) + [f"{self.path}/batch={k}" for k in old]
        merged(self.spark.read.schema(KIND).parquet(*paths)).select(*[x.split()[0] for x in KIND.split(", ")]).coalesce(
            1
        ).write.mode("overwrite").parquet(f"{self.path}/upto={old[-1]}")
        remove(self.spark, *paths)
