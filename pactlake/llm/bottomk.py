"""Bottom-k sketches of word shingles.

A fingerprint holds the K smallest of the distinct shingle hashes of a text (all
of them if fewer), of 64 bits each. Sketches of parts merge into that of the whole
(``merged`` does so by an aggregation); two sketches estimate resemblance and
containment, one the number of distinct shingles.
Texts without words have an empty sketch: its likeness to another empty one is
1, to any other 0.

``edited_neighbours`` pairs each document with the next one in descending
doc_id order. Documents are dealt out by doc_id ranges, and the first document
of each range is also sent to the range before it, so a text is shuffled once
and no window over all rows is needed. Null texts count as empty. Rows with a
null doc_id come last in that order; rows with equal doc_ids are ordered by a
hash of their texts, then by them. Rows without an id, or with an id that many
rows share, are dealt out by ranges of that hash: only rows that are equal in id
and text stay together. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import cut, map_arrow, parts_for
from ._bytes import shingle_sets

K = 128
SLICE = 1 << 20
#: Ranges that are told apart by comparing; more parts divide them by width.
COARSE = 512


def sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """Of sorted distinct 64-bit hashes: the k smallest."""
    return shingles[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    low = merge(a, b, k)
    return float(np.isin(low, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that are in b."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, both / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def sketches(texts: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= SLICE):
            n += len(texts[j])
            j += 1
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts[i:j]])])
        out += [sketch(s) for s in shingle_sets(np.frombuffer(b"".join(texts[i:j]), np.uint8), offs)]
        i = j
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, n_distinct (estimated) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sketches([(t or "").encode() for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([to_text(x) for x in s]), pa.array([distinct(x) for x in s])],
                ["doc_id", "fingerprint", "n_distinct"]
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fingerprint string, n_distinct double")


def merged(prints: DataFrame, key: str, k: int = K) -> DataFrame:
    """prints (key, fingerprint) -> for each key the fingerprint of all its texts together, and n_distinct.

    Hashes are made distinct and cut to the k least of a key before they are
    shuffled by it, so a key of any share sends k hashes a task.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [from_text(t or "") for t in batch.column(1).to_pylist()]
            # the sign bit is turned, so that signed order is that of the hashes
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([(x ^ np.uint64(1 << 63)).view(np.int64) for x in s], pa.list_(pa.int64()))],
                ["key", "h"]
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [np.sort(np.array(x, np.int64).view(np.uint64) ^ np.uint64(1 << 63)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([to_text(x) for x in s], pa.string()), pa.array([distinct(x, k) for x in s], pa.float64())],
                [key, "fingerprint", "n_distinct"]
            )

    kind = prints.schema[key].dataType.simpleString()
    found = map_arrow(prints.select(F.col(key).alias("key"), "fingerprint"), hashes, f"key {kind}, h array<long>")
    keys = found.select("key").distinct()
    each = found.select("key", F.explode("h").alias("h")).distinct()
    least = each.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("h"))).where(F.col("n") <= k)
    lists = least.groupBy("key").agg(F.collect_list("h").alias("h")).withColumnRenamed("key", "k")
    # keys whose texts have no shingles stay
    every = keys.join(lists, F.col("key").eqNullSafe(F.col("k")), "left").select(
        "key", F.coalesce("h", F.array().cast("array<long>")).alias("h")
    )
    return map_arrow(every, join, f"`{key}` {kind}, fingerprint string, n_distinct double")


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, then doc_id descending; a range's last row is a copy of the next one's first."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def pairs():
        held = None
        for part, doc, text, copy in rows():
            if held is not None and held[0] == part:
                yield held, text
                held = None if copy else (part, doc, text)
            elif not copy:
                held = (part, doc, text)

    out, size = [], 0
    for (_, doc, text), after in pairs():
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((doc, len(text), text.encode(), edited.encode(), after.encode()))
        size += len(text) + len(after)
        if size > SLICE:
            yield _compared(out)
            out, size = [], 0
    yield _compared(out)


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    every = sketches([t for r in rows for t in r[2:5]])
    own, edited, after = every[0::3], every[1::3], every[2::3]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(
                [hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string()
            ),
            pa.array([to_text(s) for s in own], pa.string()), pa.array([to_text(s) for s in edited], pa.string()),
            pa.array(
                [resemblance(a, b) for a, b in zip(own, edited, strict=True)], pa.float64()
            ), pa.array([resemblance(a, b) for a, b in zip(own, after, strict=True)], pa.float64()),
            pa.array([distinct(s) for s in own], pa.float64()), pa.array(
                [containment(a, b) for a, b in zip(own, edited, strict=True)], pa.float64()
            ),
        ],
        [
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
            "n_distinct", "contained_in_edited"
        ],
    )


def _by_hash(ways: int):
    """One of ``ways`` ranges of h, ascending."""
    return F.shiftright((F.shiftright("h", 48) + 32768) * ways, 16).cast("int")


def _part(bounds: list[int], heavy: list[int], lo: int, hi: int, fine: int):
    """The part of a doc_id among descending bounds[lo..hi], by halving; ``fine`` equal widths within neighbours.

    A bound that is the id of many rows has ``heavy`` parts of its own, by ranges of h, before those of its range.
    """
    if hi - lo > 1:
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") > bounds[mid], _part(bounds, heavy, lo, mid, fine)).otherwise(_part(bounds, heavy, mid, hi, fine))
    first = lo * fine + sum(heavy[:lo])
    top, low = bounds[lo], bounds[lo + 1]
    share = (F.lit(top).cast("double") - F.col("doc_id")) / max(1.0, float(top) - float(low)) * fine
    rest = F.lit(first + heavy[lo])
    if fine > 1:
        rest = rest + F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.floor(share).cast("int")))
    return F.when(F.col("doc_id") == top, F.lit(first) + _by_hash(heavy[lo])).otherwise(rest) if heavy[lo] else rest


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, contained_in_edited double"
    got = docs.agg(
        F.sum(F.octet_length("text")), F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()),
        F.percentile_approx("doc_id", [i / COARSE for i in range(1, COARSE)] or [0.5], 10000)
    ).first()
    if not got[3]:
        return spark.createDataFrame([], schema)
    parts = parts_for(spark, got[0] or 0)
    # coarse ranges of about equal rows, and equal widths within them: one part for each shuffle partition or more
    coarse = min(parts, COARSE)
    fine = -(-parts // coarse)
    middle = (got[5] or [])[COARSE // coarse - 1 :: COARSE // coarse]
    part, n = F.lit(0), 0
    if got[1] is not None:
        bounds = sorted({got[1], *middle, got[2]}, reverse=True)
        often = [middle.count(b) for b in bounds]  # an id at several of the quantiles fills as many ranges
        heavy = [m * fine if m > 1 else 0 for m in often]
        part = _part([*bounds, bounds[-1] - 1], heavy, 0, len(bounds), fine)
        n = len(bounds) * fine + sum(heavy)
    # rows without an id come last, by ranges of h
    ways = min(1 << 16, -(-parts * got[4] // got[3]))
    if ways:
        part = F.when(F.col("doc_id").isNull(), F.lit(n) + _by_hash(ways)).otherwise(part)
    n += ways
    docs = docs.withColumn("part", part.cast("int"))
    # the first row of a part is the next one of the last row of the part before; that of the first part, of the last row of all.
    # A row of three numbers for each part: no more than the tasks that the driver schedules
    firsts = docs.groupBy("part").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("order"), "h", "doc_id")).alias("f"))
    every_part = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.lag("part").over(every_part.orderBy("part")), F.max("part").over(every_part)).alias("before")
    firsts = cut(firsts.select("part", "f.doc_id", "f.h", before))
    on = ["part", "h"]
    same = [F.col(f"d.{c}") == F.col(f"f.{c}") for c in on] + [F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))]
    copied = docs.alias("d").join(F.broadcast(firsts).alias("f"), [*same], "inner").select(
        F.col("before").alias("part"), "d.doc_id", "d.h", "d.text"
    ).groupBy("part", "doc_id", "h").agg(F.min("text").alias("text"))  # of repeated rows one
    every = docs.select("part", "doc_id", "h", "text", F.lit(False).alias("copy")).unionByName(copied.withColumn("copy", F.lit(True)))
    order = [F.col("part"), F.col("copy"), F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("text")]
    dealt = every.repartitionById(n, "part").sortWithinPartitions(*order)
    return map_arrow(dealt.select("part", "doc_id", "text", "copy"), _pair, schema)
