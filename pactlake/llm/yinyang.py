"""Vector codes by product quantisation, with Yinyang's version of Lloyd's iterations.

Vectors become integers, floor(SCALE * x), and are cut into equal parts. Each part position
has a codebook, at first that part of the rows with the smallest ids. A round assigns each
part to its nearest entry (ties to the lower index) and moves entries to the floored means of their parts.

Assignments are exact, but most distances are never computed. A codebook's entries form groups
of about ``GROUP`` that are near one another at the start. A part remembers its entry and, for each
group, a lower bound of its distance to the group's other entries. When entries
move, a group's bound falls by the largest drift in the group. A group is scanned only if its bound doesn't
exceed the distance to the part's own entry, which is computed anew; bounds are rounded down
to whole numbers and drifts up, so rounding never hides an entry, nor one at equal distance. Scans compare
squared distances as integers, by (distance, index), so ties are decided exactly.

State (vector, entries, bounds) is a table in the shared folder, written by one scan a round; the one before
is then deleted. Entries' sums are added up in each task, then by part and entry: PARTS x ENTRIES small rows
come to the driver, whatever the number of vectors, and as many go out with the next round.

Rows whose vector is null, empty or holds a null or non-finite component are dropped, as are those whose length
isn't that of the kept row with the smallest id (nulls last, equal ids by their vectors). Lengths have to be
multiples of PARTS, and components small enough for squared distances in 64 bits; else ValueError. Null ids are coded
but never entries (but the first row's, where all are null); repeated rows are rows of their own. Fewer rows than ENTRIES make smaller codebooks. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove
from ._arrow import map_arrow, shared_dir

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries of a group, about.
GROUP = 10
#: Rows whose distances are computed at once.
ROWS = 2048


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries. Products of floats are used while every sum is below 2^53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * x.shape[1] < 1 << 53 else np.int64
    x, entries = x.astype(kind), entries.astype(kind)
    got = (x * x).sum(1)[:, None] + (entries * entries).sum(1)[None, :] - 2 * (x @ entries.T)
    return got.astype(np.int64)


def floor_root(d: np.ndarray) -> np.ndarray:
    """The largest whole number whose square is at most d."""
    r = np.sqrt(d.astype(np.float64)).astype(np.int64)
    r -= r * r > d
    return r + ((r + 1) * (r + 1) <= d)


def ceil_root(d: np.ndarray) -> np.ndarray:
    r = floor_root(d)
    return r + (r * r < d)


def grouped(entries: np.ndarray, rounds: int = 5) -> np.ndarray:
    """A group for each entry: a few of Lloyd's iterations among the entries themselves."""
    n = len(entries)
    heads = entries[np.linspace(0, n - 1, max(1, n // GROUP)).astype(int)].astype(float) if n else np.zeros((0, 0))
    at = np.zeros(n, np.int64)
    for _ in range(rounds if n else 0):
        at = ((entries[:, None, :] - heads[None, :, :]) ** 2).sum(2).argmin(1)
        for g in range(len(heads)):
            if (at == g).any():
                heads[g] = entries[at == g].mean(0)
    return np.unique(at, return_inverse=True)[1].astype(np.int64)


@dataclass(frozen=True)
class Book:
    """One part position's entries and their groups; ``drift`` is how far each moved in the last round, rounded up."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    @property
    def groups(self) -> int:
        return int(self.group.max(initial=-1)) + 1

    def moved(self, entries: np.ndarray) -> Book:
        return Book(entries, self.group, ceil_root(((entries - self.entries) ** 2).sum(1)))


def assign(x: np.ndarray, book: Book, own: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entries and squared distances of rows, bounds by group, and how many groups were scanned.

    ``own``: the entries that rows had, -1 at first; ``low``: their bounds before the entries moved.
    """
    n, groups = len(x), book.groups
    if (own < 0).any():  # at first every group is scanned
        own, low = np.zeros(n, np.int64), np.zeros((n, groups), np.int64)
    else:
        fall = np.zeros(groups, np.int64)
        np.maximum.at(fall, book.group, book.drift)
        low = np.maximum(low - fall, 0)
    before = own
    mine = ((x - book.entries[own]) ** 2).sum(1)
    best, dist, second = own.copy(), mine.copy(), np.zeros(n, np.int64)
    far = np.iinfo(np.int64).max >> 1
    reach, scanned = ceil_root(mine), 0
    for g in range(groups):
        rows = np.flatnonzero(low[:, g] <= reach)
        if not len(rows):
            continue
        scanned += len(rows)
        members = np.flatnonzero(book.group == g)
        d = squares(x[rows], book.entries[members])
        k = d.argmin(1)  # the first of equals
        near, index = d[np.arange(len(rows)), k], members[k]
        # the bound leaves out the row's entry so far; the one that is chosen at last is left out below
        others = np.where(members[None, :] == before[rows][:, None], far, d)
        low[rows, g] = floor_root(others.min(1))
        wins = np.flatnonzero((near < dist[rows]) | ((near == dist[rows]) & (index < best[rows])))
        best[rows[wins]], dist[rows[wins]] = index[wins], near[wins]
        others[wins, k[wins]] = far
        second[rows[wins]] = others[wins].min(1)
    # a row that moved: its new entry counts in its group's bound no longer, its former one now does
    changed = np.flatnonzero(best != before)
    low[changed, book.group[best[changed]]] = floor_root(second[changed])
    g = book.group[before[changed]]
    low[changed, g] = np.minimum(low[changed, g], floor_root(mine[changed]))
    return best, dist, low, scanned


STATE = "vec_id long, label int, x binary, own binary, low binary, dist binary, scanned long"
_KIND = pa.schema(
    [("vec_id", pa.int64()), ("label", pa.int32()), *((k, pa.binary()) for k in ("x", "own", "low", "dist")), ("scanned", pa.int64())]
)


def _matrix(col: pa.Array, kind: str) -> np.ndarray:
    """Rows of a binary column of equal lengths."""
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), -1)


def _rows(m: np.ndarray, kind: str) -> list[bytes]:
    m = np.ascontiguousarray(m.astype(kind))
    return [r.tobytes() for r in m]


def _pass(state: DataFrame, books: list[Book]) -> DataFrame:
    """All rows assigned anew."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column(2), "<i4").astype(np.int64)
                width = x.shape[1] // len(books)
                first = part.column(3).null_count > 0
                own = None if first else _matrix(part.column(3), "<i2")
                low = None if first else _matrix(part.column(4), "<i4")
                new, dists, lows, total, col = [], [], [], 0, 0
                for p, book in enumerate(books):
                    mine = np.full(len(x), -1) if own is None else own[:, p].astype(np.int64)
                    bound = np.zeros((len(x), 0), np.int64) if low is None else low[:, col : col + book.groups].astype(np.int64)
                    col += book.groups
                    got, dist, bound, n = assign(x[:, p * width : (p + 1) * width], book, mine, bound)
                    new.append(got)
                    dists.append(dist)
                    lows.append(np.minimum(bound, (1 << 31) - 1))
                    total += n
                scanned = np.zeros(len(x), np.int64)
                scanned[0] = total
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), part.column(2), pa.array(_rows(np.stack(new, 1), "<i2"), pa.binary()),
                        pa.array(_rows(np.concatenate(lows, 1), "<i4"), pa.binary()),
                        pa.array(_rows(np.stack(dists, 1), "<i8"), pa.binary()), pa.array(scanned)
                    ], schema=_KIND
                )

    return map_arrow(state, step, STATE)


def _sums(state: DataFrame, books: list[Book]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part the number and the sums of each entry's parts: added up in the tasks, then by part and entry."""
    parts = len(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sums = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _matrix(batch.column(0), "<i4").astype(np.int64), _matrix(batch.column(1), "<i2").astype(np.int64)
            width = x.shape[1] // parts
            if n is None:
                n, sums = np.zeros((parts, ENTRIES), np.int64), np.zeros((parts, ENTRIES, width), np.int64)
            for p in range(parts):
                n[p] += np.bincount(own[:, p], minlength=ENTRIES)
                np.add.at(sums[p], own[:, p], x[:, p * width : (p + 1) * width])
        if n is not None:
            p, e = np.nonzero(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]),
                    pa.array(list(sums[p, e]), pa.list_(pa.int64()))
                ], ["part", "entry", "n", "sums"]
            )

    found = map_arrow(state.select("x", "own"), add, "part int, entry int, n long, sums array<long>")
    width = books[0].entries.shape[1]
    added = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
    out = [(np.zeros(len(b.entries), np.int64), np.zeros(b.entries.shape, np.int64)) for b in books]
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*added).alias("sums")).collect():
        out[r.part][0][r.entry], out[r.part][1][r.entry] = r.n, r.sums
    return out


@dataclass(frozen=True)
class Coded:
    """Rows (vec_id, label, own, dist, ...) of the final state, the codebooks, and the groups scanned in each pass."""

    rows: DataFrame
    books: list[Book]
    scanned: list[int]


def kept_rows(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows whose components are all finite, as whole numbers still in doubles."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    good = F.coalesce(
        (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)
    )
    return rows.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), v.alias("v"))


def encode(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Coded | None:
    """Train codebooks on all rows and code all rows; None if no row is kept."""
    spark = rows.sparkSession
    kept = kept_rows(rows)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    head = kept.orderBy(*order).first()
    if head is None:
        return None
    width = len(head.v)
    if width % parts or entries > ENTRIES:
        raise ValueError(f"vectors of {width} components aren't cut into {parts} equal parts of at most {ENTRIES} entries")
    kept = kept.where(F.size("v") == width)
    most = kept.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    if 4 * most * most * width >= 1 << 62 or most >= 1 << 31:
        raise ValueError(f"components of {most:.0f} are too large for squared distances in 64 bits")
    seeds = kept.where("vec_id is not null").orderBy(*order).limit(entries).collect()  # a codebook's rows
    first = np.array([s.v for s in seeds] or [head.v], np.int64)
    books = [Book(b, grouped(b), np.zeros(len(b), np.int64)) for b in np.split(first, parts, axis=1)]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            none = pa.nulls(batch.num_rows, pa.binary())
            cols = [batch.column(0), batch.column(1), pa.array(_rows(flat, "<i4"), pa.binary()), none, none, none]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(batch.num_rows, pa.int64())], schema=_KIND)

    state, path, scanned = map_arrow(kept, begin, STATE), None, []
    for k in range(rounds + 1):
        new = f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}"
        _pass(state, books).write.option("compression", "zstd").parquet(new)
        state, last, path = spark.read.schema(STATE).parquet(new), path, new
        if last:
            remove(spark, last)
        scanned.append(state.agg(F.sum("scanned")).first()[0])
        if k < rounds:
            books = [
                b.moved(np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], b.entries))
                for b, (n, sums) in zip(books, _sums(state, books), strict=True)
            ]
    return Coded(state, books, scanned)


def codebooks_digest(books: list[Book]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.entries.ravel().tolist()).encode()).hexdigest()


def _nothing(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame([], kind)


def vector_codes(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each kept row."""
    kind = "vec_id long, code string, error long"
    got = encode(rows)
    if got is None:
        return _nothing(rows.sparkSession, kind + ", label_error long, codebooks_sha256 string")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = [r.astype(np.uint8).tobytes().hex() for r in _matrix(batch.column(2), "<i2")]
                error = _matrix(batch.column(3), "<i8").sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes), pa.array(error)], ["vec_id", "label", "code", "error"])

    coded = map_arrow(got.rows.select("vec_id", "label", "own", "dist"), spell, "vec_id long, label int, code string, error long")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    both = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(got.books)).alias("codebooks_sha256"))
