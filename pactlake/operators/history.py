"""What runs leave for later runs: schema snapshots, baselines, rates, modes."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SNAPSHOT = "contract_id string, taken_at timestamp, schema_json string"


def append_snapshot(spark: SparkSession, path: str, contract_id: str, schema: dict[str, Any], taken_at) -> None:
    """A version of a contract's schema, in a table partitioned by contract: two within a second both stay."""
    row = spark.createDataFrame([(contract_id, taken_at, json.dumps(schema, sort_keys=True))], SNAPSHOT)
    row.write.mode("append").partitionBy("contract_id").parquet(path)


def stem_time(name: Column) -> Column:
    """The time in a snapshot's file name, ``20260405T032800Z.yaml``; null for other names."""
    t = F.regexp_extract(name, r"(\d{8}T\d{6})Z?(\.\w+)?$", 1)
    return F.when(t != "", F.try_to_timestamp(t, F.lit("yyyyMMdd'T'HHmmss")))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, taken_at) of snapshot files, oldest first."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.select("name", stem_time(F.col("name")).alias("taken_at")).orderBy("name")


def latest_pair(snapshots: DataFrame, by: str, order: list[str], ts: str, cutoff: Column | None = None) -> DataFrame:
    """The two newest versions of each contract, ``nth`` 1 the newest, and a status.

    They are taken since ``cutoff`` if there are two, else of all time; an unknown
    time counts as recent. A contract with one version has INSUFFICIENT_SNAPSHOTS.
    """
    recent = F.coalesce(F.col(ts) >= cutoff, F.lit(True)) if cutoff is not None else F.lit(True)
    newest = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    every = Window.partitionBy(by)
    s = snapshots.withColumn("__recent", recent).withColumn(
        "__n", F.count_if("__recent").over(every)
    ).withColumn("__all", F.count(F.lit(1)).over(every))
    s = s.where(F.col("__recent") | (F.col("__n") < 2)).withColumn("nth", F.row_number().over(newest)).where("nth <= 2")
    return s.withColumn("status", F.when(F.col("__all") < 2, "INSUFFICIENT_SNAPSHOTS").otherwise("OK")).drop("__recent", "__n", "__all")


def next_baselines(current: DataFrame, baseline: DataFrame, now: Column, least: int = 10, reset: bool = False) -> DataFrame:
    """The state after a run: known columns keep their baseline unless reset, new ones get one from ``least`` values on."""
    old = baseline.select("column", F.struct("mean", "std", "n", "established_at").alias("old"))
    new = current.where(F.col("n") >= least).select(
        "column",
        F.struct(
            "mean", F.greatest("std", F.lit(1e-9)).alias("std"), F.col("n").cast("long").alias("n"),
            now.alias("established_at")
        ).alias("new")
    )
    kept = F.coalesce("new", "old") if reset else F.coalesce("old", "new")
    return old.join(new, "column", "full_outer").select("column", kept.alias("b")).select("column", "b.*")


def rate_history(runs: DataFrame, by: str, ts: str, keep: int = 24) -> DataFrame:
    """The last ``keep`` runs of each metric."""
    return runs.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(ts)))).where(F.col("nth") <= keep)


def effective_mode(tripped: DataFrame, by: str, mode: str = "ENFORCE") -> DataFrame:
    """A check whose circuit breaker is open runs in WARN mode, whatever was asked (AUDIT stays)."""
    hit = F.bool_or("tripped")
    return tripped.groupBy(by).agg(
        F.when(hit & F.lit(mode != "AUDIT"), "WARN").otherwise(mode).alias("mode"), F.max("recent").alias("most_recent")
    )
