"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. One scan splits the texts into pre-tokens. A *block* is a run of a task's
   documents with about ``BLOCK_WORDS`` distinct pre-tokens at most; a document
   becomes the positions' indices into its block's word list. Blocks' words and
   documents are written to a table of the shared folder, so blocks are made once.
2. Words are dealt out by their hash, those of a block for one task packed in a
   row with their indices. The task encodes each distinct word once and sends
   its ids back to every block that holds it; a block holds a word once, so no
   word is hot. A task remembers KNOWN words at most; beyond that it begins anew,
   so that a word met later may be encoded again.
3. Words' ids come to their blocks, as which the table is bucketed, so documents'
   index sequences stay where they are; there the documents are put together by
   position. Decoding joins ids with the token-byte table
   (one row for each vocabulary entry).

What is shuffled is a few bytes per distinct word and block; texts and sequences are not shuffled, and texts are split once. Null text counts as empty.
Each input row gives one result row; repeated rows and null ids give results
alike; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import bounded_batches, map_arrow, parts_for, ship, stored_by, texts
from ._pretokens import by_tiktoken

BLOCK_WORDS = 300_000
#: Characters of texts in a block at most, but for a longer single text.
BLOCK_CHARS = 32 << 20
#: Distinct words whose ids a task remembers.
KNOWN = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pack(values: np.ndarray) -> bytes:
    """Little-endian base-128 numbers."""
    v = values.astype(np.uint32)
    n = 1 + (v >= 1 << 7).astype(np.int64) + (v >= 1 << 14) + (v >= 1 << 21) + (v >= 1 << 28)
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for j in range(int(n.max()) if len(n) else 0):
        m = n > j
        out[at[m] + j] = ((v[m] >> (7 * j)) & 127) | np.where(n[m] > j + 1, 128, 0)
    return out.tobytes()


def unpack(body: bytes) -> np.ndarray:
    b = np.frombuffer(body, np.uint8)
    last = np.flatnonzero(b < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], last[:-1] + 1])
    pos = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * pos), first)


def squeeze(values: np.ndarray) -> bytes:
    """Numbers as their low and high halves, compressed: repeated runs, as in copies of a text, cost little."""
    import zstandard

    v = values.astype("<u4").view("<u2").reshape(-1, 2)
    return zstandard.compress(np.ascontiguousarray(v.T).tobytes(), 3)


def expand(body: bytes) -> np.ndarray:
    """The numbers of ``squeeze``."""
    import zstandard

    v = np.frombuffer(zstandard.decompress(body), "<u2").reshape(2, -1)
    return np.ascontiguousarray(v.T).view("<u4").ravel().astype(np.int64)


class _Words(dict):
    """Indices in order of first sight, so that frequent words have short ones."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch], part: int, step) -> Iterator:
    """Call step(block, doc ids, split texts, words so far) for the texts of a batch that are in one block, and
    step(block, None, None, words) at each block's end; pass on what it yields."""
    split, words, chars, block = by_tiktoken(), _Words(), 0, part << 24
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, col = batch.column(0), texts(batch)
        start, got = 0, []
        for i, t in enumerate(col.to_pylist()):
            if words and (len(words) > BLOCK_WORDS or chars + len(t) > BLOCK_CHARS):
                if got:
                    yield from step(block, ids.slice(start, i - start), got, words)
                yield from step(block, None, None, words)
                words, start, got, chars, block = _Words(), i, [], 0, block + 1
            chars += len(t)
            pieces = split(t)
            got.append(np.fromiter(map(words.__getitem__, pieces), np.uint32, len(pieces)))
        if got:
            yield from step(block, ids.slice(start), got, words)
    if words:
        yield from step(block, None, None, words)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[list[bytes], list[str]]:
    """The token-byte table, and ids as text; once for each worker."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for b, i in ranks.items():
        table[i] = b
    return table, [str(i) for i in range(len(table))]


NAMES = ["block", "hash", "doc_ids", "seq", "index", "size", "body"]
_IDS = pa.list_(pa.int64())


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start:start + size] for each pair, one after another."""
    at = np.repeat(start - (np.cumsum(size) - size), size)
    return flat[at + np.arange(len(at))]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded bytes."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), "text")
    parts = parts_for(spark, source.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a batch's documents in a block (block, doc_ids, seq), and of a block's words of one hash, in order of index (block, hash, index, size, body)."""
        from pyspark import TaskContext

        def step(block, ids, got, words):
            if got is not None:
                none = pa.nulls(1, pa.binary())
                lengths = pack(np.fromiter(map(len, got), np.int64, len(got)))
                cols = [
                    pa.array([block], pa.int64()), pa.nulls(1, pa.int32()), pa.array([ids.to_pylist()], _IDS),
                    pa.array([squeeze(np.concatenate(got))], pa.binary()), none, pa.array([lengths], pa.binary()), none
                ]
                yield pa.RecordBatch.from_arrays(cols, NAMES)
                return
            keys = [w.encode() for w in words]
            size = np.fromiter(map(len, keys), np.int64, len(keys))
            to = np.fromiter(map(zlib.crc32, keys), np.int64, len(keys)) % parts
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(parts + 1))
            rows = []
            for h in np.flatnonzero(np.diff(cut)).tolist():
                idx = order[cut[h] : cut[h + 1]]
                body = b"".join([keys[i] for i in idx.tolist()])
                rows.append((block, h, None, None, pack(np.diff(idx, prepend=0)), pack(size[idx]), zlib.compress(body, 1)))
            kinds = (pa.int64(), pa.int32(), _IDS, *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)

        return _blocks(batches, TaskContext.get().partitionId(), step)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task has all rows of a hash: each of its distinct words is encoded when first met."""
        import tiktoken

        # each piece whole
        enc = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=read_ranks(vocabulary), special_tokens={})
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            counts, flat = [], []
            for size, body in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                body, at, n, ids = zlib.decompress(body), 0, [], []
                for k in unpack(size).tolist():
                    w = body[at : at + k]
                    at += k
                    got = known.get(w)
                    if got is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        got = known[w] = enc.encode_ordinary(w.decode())
                    n.append(len(got))
                    ids += got
                counts.append(squeeze(np.array(n)))
                flat.append(squeeze(np.array(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.binary()), pa.array(flat, pa.binary())],
                ["block", "index", "count", "ids"]
            )

    def assemble(docs: pa.Table, words: pa.Table) -> pa.Table:
        """Of one block: its documents and its words' ids."""
        index, count, flat = (
            np.concatenate([f(x) for x in words.column(k).to_pylist()]) if words.num_rows else np.zeros(0, np.int64)
            for k, f in (("index", lambda x: np.cumsum(unpack(x))), ("count", expand), ("ids", expand))
        )
        start, n = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
        start[index], n[index] = np.cumsum(count) - count, count
        table, spelled = _vocabulary(vocabulary)
        res: list[list] = [[], [], [], []]
        for ids, seq, size in zip(*(docs.column(k).to_pylist() for k in ("doc_ids", "seq", "size")), strict=True):
            seq, at = expand(seq), 0
            for doc, length in zip(ids, unpack(size).tolist(), strict=True):
                own = seq[at : at + length]
                at += length
                got = ragged(flat, start[own], n[own]).tolist()
                res[0].append(doc)
                res[1].append(len(got))
                res[2].append(hashlib.sha256(",".join(map(spelled.__getitem__, got)).encode()).hexdigest())
                res[3].append(hashlib.sha256(b"".join(map(table.__getitem__, got))).hexdigest())
        return pa.table(
            [pa.array(c, t) for c, t in zip(res, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )

    ship(spark)
    bounded_batches(spark)
    found = map_arrow(source, split, "block long, hash int, doc_ids array<long>, seq binary, index binary, size binary, body binary")
    table = stored_by(found, "words", "block", parts)
    words = table.where("hash is not null").select("hash", "block", "index", "size", "body").repartitionById(parts, "hash").drop("hash")
    ids = map_arrow(words, encode, "block long, index binary, count binary, ids binary").groupBy("block")
    rows = table.where("hash is null").select("block", "doc_ids", "seq", "size").groupBy("block")
    return rows.cogroup(ids).applyInArrow(assemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
