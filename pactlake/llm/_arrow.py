"""Helpers shared by the operators: Arrow batches, grouping of sorted
partitions, and cutting lineage in the folder every executor can see."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import bounded_batches, cut, shared_dir

__all__ = [
    "bounded_batches", "cut", "key_groups", "map_arrow", "parts_for", "raw", "release", "shared_dir", "ship", "slices", "stored", "stored_by",
    "texts",
]

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as d:
        shutil.copytree(top, f"{d}/src/{top.name}", ignore=shutil.ignore_patterns("__pycache__"))
        kept = tempfile.mkdtemp(prefix="pactlake-ship-")
        sc.addPyFile(shutil.make_archive(f"{kept}/{top.name}", "zip", f"{d}/src"))
    _SHIPPED.add(sc.applicationId)


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow with bounded batches."""
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as a table in the shared folder, and read back.

    What a task numbers (rows, blocks) is numbered once, here: a second scan of
    the source may be dealt out otherwise, as executors come and go.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """As ``stored``, in buckets of ``key``: groups of it are read where they are, without another shuffle.

    Buckets are a table's; its name leaves the catalog at once, its files stay in the shared folder. Spark allows only so
    many of them: beyond that a bucket holds several parts' groups, which readers take one after another.
    """
    spark = df.sparkSession
    parts = min(parts, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, key).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    out = spark.table(table)
    out.schema  # noqa: B018  resolved before the name goes
    spark.sql(f"DROP TABLE {table}")
    return out


def parts_for(spark: SparkSession, bytes_in: int, each: int = 64 << 20) -> int:
    """Partitions of a shuffle of so many bytes: at least the session's number, and about ``each`` bytes to one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_in // each))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files that nothing refers to any more.

    Iterative jobs would else keep those of all rounds until the driver's heap
    happens to be collected.
    """
    gc.collect()
    spark._jvm.System.gc()


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A string column with nulls as empty strings."""
    col = batch.column(batch.schema.get_field_index(name))
    return (col.fill_null("") if col.null_count else col).cast(pa.large_string())


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a large_string or large_binary array."""
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each; a longer row is alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def key_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key`` (a long without nulls) from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True):
            if held and k[s] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = k[s]
    if held:
        yield pa.Table.from_batches(held)
