"""Exact removal of byte strings that occurred before, by suffix order.

A string of LENGTH bytes is a *window*. Equal windows agree on their minimizer,
the least hash of their GRAM-byte grams, so dealing windows out by it brings
equal ones together. Consecutive windows with the same minimizer form a
*segment*:

1. Scans emit the hash of each segment. Equal segments of one minimizer need
   no sorting: all but the earliest are repeats.
2. The bytes of the distinct segments are fetched for the minimizers that have
   several of them (or repeat inside one), and dealt out by minimizer. Shards of
   them are sorted by external induced sorting; runs of suffixes with a common
   prefix of LENGTH bytes are equal windows, and all but the earliest are repeats.
   A minimizer with more than SHARD bytes of them is *hot*: its windows are
   dealt out one by one by their own hash instead, and streamed.
3. Repeats come back to their documents, where covered bytes are removed.

Equal grams, segments and windows are those of equal hashes: 64 bits for the gram
and 64 for the segment or window, so only unlike segments of one minimizer can meet,
2^-64 a pair. Rows are numbered once, in a table of the shared folder that every
later job reads.

Earlier means smaller doc_id, then the earlier row of equal doc_ids, then the
earlier start; a null doc_id comes last. Null texts are empty. Matches never
cross documents. Results have one row for each input row; other columns are
ignored. Of a minimizer no more than SHARD bytes are held, whatever the number
of its segments; a document is held whole, with arrays of its length.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import cut, key_groups, map_arrow, parts_for, raw, release, slices, stored, texts
from ._bytes import chunks, mix
from .induced import IN_MEMORY, room, suffixes

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1  # grams of a window
SLICE = 1 << 20
#: Most bytes of segments sorted together.
SHARD = 4 << 20

REPEAT, FETCH, HOT = 0, 1, 2
_U = np.uint64


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values."""
    m = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place."""
    at, m = chunks(data), len(data) - GRAM + 1
    h = at[:m] * _U(0x9E3779B97F4A7C15)
    for k in range(8, GRAM, 8):
        h ^= h >> _U(32)
        h += at[k : k + m]
        h *= _U(0xBF58476D1CE4E5B9)
    return mix(h)


def _joined(gram: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the spans [start, end), of GRAM bytes at least, by the grams that cover them."""
    h = mix((end - start).astype(_U))
    todo, at = np.arange(len(start)), start.copy()
    while len(todo):
        h[todo] = mix(h[todo] ^ gram[at])
        more = at + GRAM < end[todo]
        todo, at = todo[more], at[more]
        at = np.minimum(at + GRAM, end[todo] - GRAM)
    return h


def segments(data: np.ndarray, offs: np.ndarray, gram: np.ndarray | None = None):
    """Document, first window, windows, minimizer, hash of the bytes, and whether the minimizer's place changes within.

    Equal windows have their minimizer at the same distance, so those of one segment have it in two places.
    """
    if len(data) < LENGTH:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(_U), z.astype(_U), z.astype(bool)
    gram = grams(data) if gram is None else gram
    i = np.arange(len(gram))
    bits = _U(max(21, int(len(gram)).bit_length()))
    low = (_U(1) << bits) - _U(1)
    left = (_window_min((gram & ~low) | i.astype(_U), SPAN) & low).astype(np.int64)
    m = len(left)
    least = gram[left]
    doc = np.searchsorted(offs, np.arange(m), "right") - 1
    valid = np.arange(m) + LENGTH <= offs[doc + 1]
    new = np.ones(m, bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    new &= valid
    start = np.flatnonzero(new)
    edge = np.append(np.flatnonzero(new | ~valid), m)
    stop = edge[np.searchsorted(edge, start, "right")]
    own = _joined(gram, start, stop + LENGTH - 1)
    d = doc[start]
    return d, start - offs[d], stop - start, least[start], own, left[stop - 1] != left[start]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offs = raw(texts(batch))
        for i, j in slices(offs, SLICE):
            d, at, n, gram, own, twice = segments(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram.view(np.int64)), pa.array(own.view(np.int64)), pa.array(ids[i + d]),
                    pa.array(rows[i + d]), pa.array(at.astype(np.int32)),
                    pa.array(np.where(twice, -n, n).astype(np.int32))
                ],
                ["gram", "own", "doc", "row", "at", "n"],
            )


_RESOLVED = "kind int, gram long, doc long, row long, at int, n int"


def _resolve(batches: Iterator[pa.RecordBatch], shard: int = SHARD) -> Iterator[pa.RecordBatch]:
    """Segments sorted by minimizer, hash, and place: repeats, the first ones that need their bytes, and hot minimizers.

    Only the last minimizer, its last hash, the bytes of its first segments and
    one waiting segment are carried from batch to batch, however many segments
    share a minimizer.
    """
    last_gram = last_own = None
    waiting = None
    held = 0

    def out(kind, c, idx):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(idx), kind, np.int32)),
                *(pa.array(c[k][idx]) for k in ("gram", "doc", "row", "at")), pa.array(np.abs(c["n"][idx]))
            ],
            ["kind", "gram", "doc", "row", "at", "n"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        c = {k: batch.column(i).to_numpy() for i, k in enumerate(batch.schema.names)}
        gram, own, n = c["gram"], c["own"], c["n"]
        new_gram = np.concatenate([[last_gram is None or gram[0] != last_gram], gram[1:] != gram[:-1]])
        new = new_gram | np.concatenate([[last_own is None or own[0] != last_own], own[1:] != own[:-1]])
        yield out(REPEAT, c, np.flatnonzero(~new))
        group = np.cumsum(new_gram)
        firsts = np.flatnonzero(new)
        count = np.bincount(group[firsts], minlength=int(group[-1]) + 1)
        if count[0]:
            count[0] += 1  # group 0 goes on from the batch before, which had one first segment at least
        alone = count[group[firsts]] == 1
        if count[0] and waiting is not None:
            yield waiting
            waiting = None
        inside = n[firsts] < 0
        tail = group[firsts] == group[-1]
        ready = firsts[(~alone) | inside]
        if len(ready):
            yield out(FETCH, c, ready)
        # a minimizer is reported once, where its bytes come to be too many
        size = np.bincount(
            group[firsts], weights=np.abs(n[firsts].astype(np.int64)) + LENGTH - 1, minlength=int(group[-1]) + 1
        ).astype(np.int64)
        old = np.zeros(len(size), np.int64)
        if not new_gram[0]:
            old[0] = held
        held = int(old[-1] + size[-1])
        hot = np.flatnonzero((old <= shard) & (old + size > shard))
        if len(hot):
            yield out(HOT, c, np.searchsorted(group, hot))
        if group[-1] > 0:  # a minimizer began in this batch
            waiting = None
            mine = firsts[tail & alone & ~inside]
            if len(mine):
                waiting = out(FETCH, c, mine)
        last_gram, last_own = gram[-1], own[-1]


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of one row id: wanted segments first, then its text."""
    cols: list[list] = [[] for _ in range(6)]
    size = 0

    def flush():
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["gram", "doc", "row", "at", "n", "bytes"]
        )

    for t in key_groups(batches, "row"):
        if t.num_rows < 2:
            continue
        body = (t.column("text")[t.num_rows - 1].as_py() or "").encode()
        for r in t.slice(0, t.num_rows - 1).select(["gram", "doc", "row", "at", "n"]).to_pylist():
            piece = body[r["at"] : r["at"] + r["n"] + LENGTH - 1]
            for c, v in zip(cols, (*r.values(), piece), strict=True):
                c.append(v)
            size += len(piece)
        if size > SLICE:
            yield flush()
            cols, size = [[] for _ in range(6)], 0
    yield flush()


def _windows(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Hash and place of each window whose minimizer is hot."""
    for batch in batches:
        rows, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offs = raw(texts(batch))
        for i, j in slices(offs, SLICE):
            part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            if len(part) < LENGTH:
                continue
            gram = grams(part)
            d, at, n, least, _, _ = segments(part, o, gram)
            mine = np.isin(least.view(np.int64), hot)
            d, at, n = d[mine], at[mine], n[mine]
            ends = np.cumsum(n)
            for a in range(0, int(ends[-1]) if len(n) else 0, SLICE // 4):
                k = np.arange(a, min(a + SLICE // 4, int(ends[-1])))
                s = np.searchsorted(ends, k, "right")
                p = at[s] + k - (ends[s] - n[s])
                b = o[d[s]] + p
                own = _joined(gram, b, b + LENGTH)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.view(np.int64)), pa.array(ids[i + d[s]]), pa.array(rows[i + d[s]]), pa.array(p.astype(np.int32))],
                    ["own", "doc", "row", "at"]
                )


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by hash and place: all but the first of each hash."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column("own").to_numpy()
        again = np.flatnonzero(np.concatenate([[last is not None and own[0] == last], own[1:] == own[:-1]]))
        last = own[-1]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row").take(pa.array(again)), batch.column("at").take(pa.array(again)), pa.array(np.ones(len(again), np.int32))],
            ["row", "at", "n"]
        )


class _Shard:
    """Segments and their bytes, which go to a file of the task's own when they are many."""

    def __init__(self):
        self.held, self.file, self.cols, self.size = [], None, [], 0

    def add(self, t: pa.Table) -> None:
        for b in t.column("bytes").chunks:
            self.held.append(raw(b.cast(pa.large_binary()))[0].tobytes())
        self.cols.append(t.drop_columns(["bytes"]))
        self.size += int((t.column("n").to_numpy() + LENGTH - 1).sum())
        if sum(map(len, self.held)) > 8 * IN_MEMORY:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(b"".join(self.held))
            self.held = []

    def bytes(self) -> np.ndarray:
        if self.file is None:
            return np.frombuffer(b"".join(self.held), np.uint8)
        self.file.write(b"".join(self.held))
        self.file.flush()
        return np.memmap(self.file, np.uint8, "r", shape=(self.size,))


def _sort_shards(batches: Iterator[pa.RecordBatch], shard: int = SHARD) -> Iterator[pa.RecordBatch]:
    """Segments sorted by minimizer: repeated windows as runs (row, at, n)."""
    held = _Shard()
    for t in key_groups(batches, "gram"):
        more = t.column("bytes").nbytes
        if held.size and held.size + more > shard:
            yield _repeats(held)
            held = _Shard()
        held.add(t)
    if held.size:
        yield _repeats(held)


def _repeats(shard: _Shard) -> pa.RecordBatch:
    t = pa.concat_tables(shard.cols)
    doc, row, at = (t.column(k).to_numpy() for k in ("doc", "row", "at"))
    n = t.column("n").to_numpy()
    came = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    order = np.lexsort((at, row, doc))
    doc, row, at, n, came = doc[order], row[order], at[order], n[order], came[order]
    begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)  # places in body are in the order of the corpus
    file, body = shard.bytes(), room((shard.size,), "u1")
    for a, b, k in zip(begin.tolist(), came.tolist(), (n + LENGTH - 1).tolist(), strict=True):
        body[a : a + k] = file[b : b + k]
    edge = np.zeros(len(body) + 1, np.int8)
    edge[begin] += 1
    np.add.at(edge, begin + n, -1)
    own = np.cumsum(edge[:-1], dtype=np.int8) > 0
    repeat = room((len(body),), "bool")
    carry: list[np.ndarray] = []

    def close():
        if carry:
            run = np.concatenate(carry)
            if len(run) > 1:
                repeat[run] = True
                repeat[run.min()] = False
            carry.clear()

    for pos, lcp in suffixes(body, LENGTH):
        new = lcp < LENGTH
        mine = own[pos]
        group = np.cumsum(new)
        pos, group = pos[mine], group[mine]
        if new.any():
            # the run that was open ends where the first new one begins
            head = pos[group == 0]
            if len(head):
                carry.append(head)
            close()
            end = group == new.sum()
            inner = (group > 0) & ~end
            p, g = pos[inner], group[inner]
            if len(p):
                b = np.concatenate([[True], g[1:] != g[:-1]])
                least = np.minimum.reduceat(p, np.flatnonzero(b))
                repeat[p] = p != least[np.cumsum(b) - 1]
            if end.any():
                carry.append(pos[end])
        elif len(pos):
            carry.append(pos)
    close()
    # runs of repeated windows within each segment
    which = np.repeat(np.arange(len(n)), n)
    place = begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    r = repeat[place]
    first = r & np.concatenate([[True], ~r[:-1] | (which[1:] != which[:-1])])
    final = r & np.concatenate([~r[1:] | (which[1:] != which[:-1]), [True]])
    a, b = np.flatnonzero(first), np.flatnonzero(final)
    s = which[a]
    return pa.RecordBatch.from_arrays(
        [pa.array(row[s]), pa.array((at[s] + place[a] - begin[s]).astype(np.int32)), pa.array((b - a + 1).astype(np.int32))],
        ["row", "at", "n"]
    )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of one row id: repeats first, then its text."""
    rows: list[tuple] = []
    size = 0

    def flush():
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        c = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(c, kinds, strict=True)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        )

    for t in key_groups(batches, "row"):
        k = t.num_rows - 1
        body = (t.column("text")[k].as_py() or "").encode()
        kept, removed, spans = body, 0, 0
        if k:
            at, n = (t.column(c).slice(0, k).to_numpy().astype(np.int64) for c in ("at", "n"))
            gone = np.zeros(len(body) + 1, np.int32)
            np.add.at(gone, at, 1)
            np.add.at(gone, at + n + LENGTH - 1, -1)
            gone = np.cumsum(gone)[:-1] > 0
            removed = int(gone.sum())
            spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
            kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
        rows.append((t.column("doc_id")[k].as_py(), len(body), removed, spans, hashlib.sha256(kept).hexdigest(), None))
        size += len(body)
        if len(rows) >= 1024:
            yield flush()
            rows, size = [], 0
    yield flush()


def remove_repeats(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    # rows are numbered once, and stored with their texts
    docs = stored(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"),
        "repeats"
    )
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parts_for(docs.sparkSession, size)
    last = F.lit((1 << 63) - 1)
    keyed = docs.select("row", F.coalesce("doc_id", last).alias("doc"), "text")
    found = map_arrow(keyed, _scan, "gram long, own long, doc long, row long, at int, n int")
    found = found.repartition(parts, "gram").sortWithinPartitions("gram", "own", "doc", "row", "at")
    resolved = cut(map_arrow(found, partial(_resolve, shard=shard), _RESOLVED))
    del found
    release(docs.sparkSession)

    hot_grams = resolved.where(f"kind = {HOT}").select("gram")
    hot = np.array(sorted(r.gram for r in hot_grams.collect()), np.int64)
    none = lambda kind: F.lit(None).cast(kind)
    wanted = resolved.where(f"kind = {FETCH}")
    if len(hot):
        wanted = wanted.join(F.broadcast(hot_grams), "gram", "left_anti")
    wanted = wanted.select("row", F.lit(0).alias("step"), "gram", "doc", "at", "n", none("string").alias("text"))
    bodies = docs.select(
        "row", F.lit(1).alias("step"), none("long").alias("gram"), none("long").alias("doc"), none("int").alias("at"),
        none("int").alias("n"), "text"
    )
    both = wanted.unionByName(bodies).repartition(parts, "row").sortWithinPartitions("row", "step")
    fetched = map_arrow(both.drop("step"), _fetch, "gram long, doc long, row long, at int, n int, bytes binary")
    fetched = fetched.repartition(parts, "gram").sortWithinPartitions("gram")
    sorted_repeats = cut(map_arrow(fetched, partial(_sort_shards, shard=shard), "row long, at int, n int"))
    del both, fetched
    release(docs.sparkSession)

    repeats = resolved.where(f"kind = {REPEAT}").select("row", "at", "n").unionByName(sorted_repeats)
    if len(hot):
        windows = map_arrow(keyed, partial(_windows, hot=hot), "own long, doc long, row long, at int")
        windows = windows.repartition(parts, "own").sortWithinPartitions("own", "doc", "row", "at")
        repeats = repeats.unionByName(map_arrow(windows, _later, "row long, at int, n int"))
    marks = repeats.select("row", F.lit(0).alias("step"), "at", "n", none("long").alias("doc_id"), none("string").alias("text"))
    bodies = docs.select("row", F.lit(1).alias("step"), none("int").alias("at"), none("int").alias("n"), "doc_id", "text")
    every = marks.unionByName(bodies).repartition(parts, "row").sortWithinPartitions("row", "step")
    return map_arrow(
        every.drop("step"), _remove,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    ).drop("kept")
