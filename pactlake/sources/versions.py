"""Tables of state that readers can read while a run writes them.

A version is a folder of its own, which counts once its writer has ended; readers take the newest such. So a reader sees
the old or the new state, never none, and a run that fails leaves the old one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import _files, remove

#: Versions that stay: a reader of the one before may not be done.
KEPT = 2


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions, oldest first."""
    files, at = _files(spark, path), spark._jvm.org.apache.hadoop.fs.Path
    if not files.exists(at(path)):
        return []
    found = [m[1] for f in files.listStatus(at(path)) if (m := re.fullmatch(r"version=(\d+)", f.getPath().getName()))]
    return sorted(int(n) for n in found if files.exists(at(f"{path}/version={n}/_SUCCESS")))


def newest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The newest version, None without one."""
    held = versions(spark, path)
    if not held:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/version={held[-1]}")


def write(table: DataFrame, path: str) -> int:
    """Write a new version, which may be made from the newest one; versions before the last KEPT go."""
    spark = table.sparkSession
    held = versions(spark, path)
    n = held[-1] + 1 if held else 0
    table.write.mode("overwrite").parquet(f"{path}/version={n}")
    remove(spark, *[f"{path}/version={k}" for k in [*held, n][:-KEPT]])
    return n
