"""Order within groups of any size: the row before, and numbering, without a group in one task.

Rows are ranged over partitions by group and order together, so a group that holds most rows spreads over
most partitions. Windows run inside a partition. What a partition's first group needs of the partitions
before (the last row, the number of rows) is a row for each partition, which is joined back.

Where no group has more than HOT rows, which one count of groups tells (combined before its shuffle), a plain
window by group does: it costs a shuffle, while ranging costs two and a stored table. Rows are the same.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

PART = "__part"
#: Rows of a group that one task sorts; larger groups are ranged.
HOT = 1_000_000


def has_hot(df: DataFrame, by: list[str], hot: int | None = None) -> bool:
    most = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) > (HOT if hot is None else hot)


def ranged(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with the number of their range. Ranges are sampled, so they are stored once; another run may cut elsewhere.

    Rows that are alike in group and order stay together: give ``order`` a tie-breaker where many are.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = cut(df.repartitionByRange(n, *[F.col(c) for c in (*by, *order)]).withColumn(PART, F.spark_partition_id()))
    return stored.repartitionById(n, F.col(PART))  # a range is one task's again


def _same(a: Column, b: Column, keys: list[str]) -> Column:
    """Equal keys, nulls too; nothing equals what isn't there."""
    return functools.reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys]) & b.isNotNull()


def _key(by: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(c) for c in by]).alias("__key")


def with_previous(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "prev", hot: int | None = None) -> DataFrame:
    """Rows with ``value`` of the row before theirs in their group, null at a group's first row."""
    if not has_hot(df, by, hot):
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))
    rows = ranged(df, by, order)
    w = Window.partitionBy(PART, *by).orderBy(*order)
    # a row for each range: its last row, and so the last row before the next range
    every = F.struct(*[F.col(c).alias(c) for c in dict.fromkeys([*by, *order, value])])
    last = rows.groupBy(PART).agg(F.max_by(every, F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate([*by, *order])])).alias("__last"))
    before = last.select((F.lead(PART).over(Window.orderBy(PART))).alias(PART), "__last").where(f"{PART} is not null")
    out = rows.withColumn("__nth", F.row_number().over(w)).withColumn(name, F.lag(value).over(w))
    out = out.join(F.broadcast(before), PART, "left")
    first = (F.col("__nth") == 1) & _same(F.struct(*[F.col(c).alias(c) for c in by]), F.col("__last"), by)
    return out.withColumn(name, F.when(F.coalesce(first, F.lit(False)), F.col("__last")[value]).otherwise(F.col(name))).drop(PART, "__nth", "__last")


def with_number(df: DataFrame, by: list[str], order: list[str], name: str = "sequence_number", hot: int | None = None) -> DataFrame:
    """Rows with their place in their group, from 1."""
    if not has_hot(df, by, hot):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    rows = ranged(df, by, order)
    w = Window.partitionBy(PART, *by).orderBy(*order)
    sizes = rows.groupBy(PART, *by).agg(F.count(F.lit(1)).alias("__n"))
    ends = sizes.select(PART, "__n", _key(by)).groupBy(PART).agg(F.max_by("__n", "__key").alias("__n"), F.max("__key").alias("__key"))
    # a group's rows up to the end of each range whose last group it is; one row a range
    upto = ends.withColumn("__upto", F.sum("__n").over(Window.partitionBy("__key").orderBy(PART)))
    before = upto.select(F.lead(PART).over(Window.orderBy(PART)).alias(PART), "__key", "__upto").where(f"{PART} is not null")
    out = rows.withColumn(name, F.row_number().over(w).cast("long")).join(F.broadcast(before), PART, "left")
    goes_on = F.coalesce(_same(F.struct(*[F.col(c).alias(c) for c in by]), F.col("__key"), by), F.lit(False))
    return out.withColumn(name, F.col(name) + F.when(goes_on, F.col("__upto")).otherwise(0)).drop(PART, "__key", "__upto")
