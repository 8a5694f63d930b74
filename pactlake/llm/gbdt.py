"""Quality scores from histogram gradient-boosted trees over document statistics.

Statistics are taken of whole texts, vectorised over the bytes of many documents.
Trees are grown level by level on quantile bins and flattened into arrays (split
feature, threshold, leaf value of a complete tree), so scoring steps all
documents of a batch down each tree at once.

Trained on at most TRAIN_ROWS labelled rows (those with the smallest hashes of
their doc_id) whose crc32(doc_id as text) mod 5 is not 0; the features of these
rows alone come to the driver. Without both classes among them every score is
the share of label 1, or 0.5 without labels. Null text counts as empty and is
scored, too; null labels are left out, of several labels of a doc_id the
smallest counts; rows with a null doc_id are scored and not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_arrow, raw, slices, texts
from ._bytes import IS_SPACE, SHINGLE, SpanHash, words

TRAIN_ROWS = 20_000
HELD_OUT = 5
THRESHOLD = 0.3
TREES, DEPTH, RATE, BINS, L2 = 120, 5, 0.1, 64, 1.0
#: A leaf's rows have at least this sum of p (1 - p): five rows that are undecided.
LEAST_WEIGHT = 1.25
SLICE = 1 << 20

_B = np.arange(256)
#: Classes of bytes whose shares are statistics.
CLASSES = {
    "lower": (_B >= 97) & (_B <= 122), "upper": (_B >= 65) & (_B <= 90), "digit": (_B >= 48) & (_B <= 57), "high": _B >= 128, "space": IS_SPACE, "line": _B == 10,
    "stop": np.isin(_B, [33, 46, 63]), "comma": np.isin(_B, [44, 58, 59]), "symbol": np.isin(
        _B, [35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 124, 126]
    ), "bracket": np.isin(_B, [40, 41, 91, 93, 123, 125]),
}
NAMES = [
    *CLASSES, "bytes", "words", "word_bytes", "word_spread", "longest", "shouted", "capital", "bare", "closed",
    "distinct", "commonest", "novel", "lines", "line_bytes", "repeated_lines", "entropy"
]


def _lines(data: np.ndarray, offs: np.ndarray, hashed: SpanHash) -> tuple[np.ndarray, np.ndarray]:
    """For each document the number of lines with anything on them, and the share of them that repeat another."""
    d, breaks = len(offs) - 1, np.flatnonzero(data == 10)
    of, own = np.searchsorted(offs, breaks, "right") - 1, np.arange(d)
    begin, end = np.concatenate([offs[:-1], breaks + 1]), np.concatenate([breaks, offs[1:]])
    begin = begin[np.lexsort((begin, np.concatenate([own, of])))]
    by_end = np.lexsort((end, np.concatenate([of, own])))
    doc, end = np.concatenate([of, own])[by_end], end[by_end]
    some = end > begin
    doc, h = doc[some], hashed(begin[some], end[some])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    lines = np.bincount(doc, minlength=d)
    return lines, np.where(lines > 0, 1 - np.bincount(doc[first], minlength=d) / np.maximum(lines, 1), 0)


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of len(NAMES) for each document."""
    n = np.diff(offs)
    d = len(n)
    size = np.maximum(n, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return c[offs[1:]] - c[offs[:-1]]

    out = {k: share(v[data]) / size for k, v in CLASSES.items()}
    s, e, at = words(data, offs)
    count = np.diff(at)
    many = np.maximum(count, 1)

    def over_words(x: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
        return (c[at[1:]] - c[at[:-1]]) / many

    width = e - s
    upper = np.concatenate([[0], np.cumsum(CLASSES["upper"][data], dtype=np.int64)])
    alpha = CLASSES["lower"] | CLASSES["upper"] | CLASSES["high"]
    letters = np.concatenate([[0], np.cumsum(alpha[data], dtype=np.int64)])
    first, last = (data[s], data[e - 1]) if len(s) else (np.zeros(0, np.uint8),) * 2
    mean = over_words(width)
    out |= {
        "bytes": np.log1p(n), "words": np.log1p(count), "word_bytes": mean, "word_spread": np.sqrt(
            np.maximum(0, over_words(width.astype(float) ** 2) - mean**2)
        ),
        "shouted": over_words(
            (upper[e] - upper[s] >= 2) & (upper[e] - upper[s] >= 0.6 * width)
        ), "capital": over_words(CLASSES["upper"][first]), "bare": over_words(letters[e] == letters[s]), "closed": over_words(~alpha[last]),
    }
    hashed = SpanHash(data)
    wh = hashed(s, e)
    lines, repeated = _lines(data, offs, hashed)
    rows = np.zeros((d, 5))
    for i in range(d):
        a, b = at[i], at[i + 1]
        if b > a:
            w = wh[a:b]
            _, c = np.unique(w, return_counts=True)
            rows[i, 0], rows[i, 1], rows[i, 2] = width[a:b].max(), len(c) / (b - a), c.max() / (b - a)
            if b - a >= SHINGLE:
                m = b - a - 2
                tri = w[:m] * np.uint64(3) + w[1 : m + 1] * np.uint64(5) + w[2 : m + 2] * np.uint64(7)
                rows[i, 3] = len(np.unique(tri)) / m
            else:
                rows[i, 3] = 1
            p = np.bincount(data[offs[i] : offs[i + 1]], minlength=256) / n[i]
            p = p[p > 0]
            rows[i, 4] = -(p * np.log2(p)).sum()
    out |= {
        "longest": np.log1p(rows[:, 0]), "distinct": rows[:, 1], "commonest": rows[:, 2], "novel": rows[:, 3],
        "lines": np.log1p(lines), "line_bytes": np.log1p(n / np.maximum(lines, 1)),
        "repeated_lines": repeated, "entropy": rows[:, 4]
    }
    return np.stack([out[k] for k in NAMES], axis=1).astype(np.float32)


@dataclass
class Forest:
    """Complete trees as arrays: node i has children 2i+1 (at most the threshold) and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            z += v[at - inner]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosting of the logistic loss; deterministic."""
    inner = (1 << depth) - 1
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        z = np.zeros((0, inner))
        return Forest(z.astype(np.int64), z, np.zeros((0, inner + 1)), 0.0 if not len(y) else 8.0 if share else -8.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log(share / (1 - share)))
    z = np.full(len(y), base)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            lo, k = (1 << level) - 1, 1 << level
            best, best_gain = np.full((k, 2), -1), np.full(k, 1e-6)
            tot = [np.bincount(at - lo, w, k) for w in (g, h)]
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (at - lo) * (len(e) + 1) + binned[:, j]
                gl, hl = (np.cumsum(np.bincount(cell, w, k * (len(e) + 1)).reshape(k, -1), axis=1)[:, :-1] for w in (g, h))
                gr, hr = tot[0][:, None] - gl, tot[1][:, None] - hl
                gain = gl**2 / (hl + L2) + gr**2 / (hr + L2) - (tot[0] ** 2 / (tot[1] + L2))[:, None]
                gain[(hl < LEAST_WEIGHT) | (hr < LEAST_WEIGHT)] = 0
                i = gain.argmax(axis=1)
                v = gain[np.arange(k), i]
                m = v > best_gain
                best_gain[m], best[m, 0], best[m, 1] = v[m], j, i[m]
            right = np.zeros(len(y), bool)
            for i in range(k):
                if best[i, 0] >= 0:
                    j, b = best[i]
                    feature[t, lo + i], threshold[t, lo + i] = j, edges[j][b]
                    here = at == lo + i
                    right[here] = binned[here, j] > b
            at = 2 * at + 1 + right
        own = at - inner
        leaf[t] = RATE * np.bincount(own, g, inner + 1) / (np.bincount(own, h, inner + 1) + L2)
        z += leaf[t][own]
    return Forest(feature, threshold, leaf, base)


def _of_batch(batch: pa.RecordBatch) -> np.ndarray:
    data, offs = raw(texts(batch))
    x = [statistics(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in slices(offs, SLICE)]
    return np.concatenate(x) if x else np.zeros((0, len(NAMES)), np.float32)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _of_batch(batch)
        stats = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), stats], ["doc_id", "stats"])


def in_test_fold(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(HELD_OUT)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")
    ).where("doc_id is not null and y is not null").where(~in_test_fold())
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` pairs of numbers
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.select("doc_id")), "doc_id")
    x = map_arrow(
        picked.select("doc_id", "text"), _stats, "doc_id long, stats array<float>"
    ).groupBy("doc_id").agg(F.min("stats").alias("stats"))
    got = x.join(known, "doc_id").orderBy("doc_id").toPandas()
    return fit(np.array(got["stats"].tolist(), np.float32).reshape(-1, len(NAMES)), got["y"].to_numpy().astype(float))


def score(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = forest.scores(_of_batch(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"]
            )

    return map_arrow(
        docs.select(F.col("doc_id").cast("long"), "text", in_test_fold().alias("held_out")), run,
        "doc_id long, held_out boolean, score double, predicted int"
    )


def keep(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, that score at least ``threshold``."""
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(forest.scores(_of_batch(batch)) >= threshold))

    return map_arrow(docs.select(cols), run, docs.schema)
