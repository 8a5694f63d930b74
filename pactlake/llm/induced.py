"""Suffix order by external induced sorting, with common prefixes to a depth.

Suffixes are of type L or S as they are larger or smaller than the next one; an
S suffix after an L one is S*. The S* suffixes are sorted first; a scan in
ascending order then induces the L suffixes, one in descending order the S
suffixes. What a scan induces waits in a priority queue whose keys are first
bytes: tuples of a suffix and its common prefix with the one queued before it,
which is one more than the least common prefix between the suffixes that induced
the two. Queues keep a bounded number of tuples in memory and the rest on disk.

Only prefixes of ``depth`` bytes count here: common prefixes are cut to it, and
suffixes equal to that depth may come in any order. So the S* suffixes, a third
of all, are sorted externally where a full suffix array would recurse on their
names: runs of them are sorted by refining ties eight bytes at a time to that
depth, written with their prefixes, and merged block by block.

Text, types, runs and queues beyond ``in_memory`` tuples lie on disk; in memory are
blocks of at most so many, whatever the length of the text (pages of the text that
the system keeps in its cache are its own affair).
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples of a queue kept in memory.
IN_MEMORY = 1 << 21


def room(shape, kind: str, in_memory: int = IN_MEMORY) -> np.ndarray:
    """Zeros; an array larger than so many tuples' positions lies in a file of the task's own, gone with it."""
    if int(np.prod(shape)) * np.dtype(kind).itemsize <= 8 * in_memory:
        return np.zeros(shape, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=shape)


class BucketQueue:
    """First in, first out within each of 256 keys; keys are taken in order, a block at a time."""

    def __init__(self, in_memory: int = IN_MEMORY):
        self.held: list[list] = [[] for _ in range(256)]  # arrays, or (place in the file, tuples of the piece, first, end)
        self.count, self.most, self.file, self.spilled = 0, in_memory, None, 0

    def push(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.held[key].append((pos, lcp))
        self.count += len(pos)
        if self.count > self.most:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for chunks in self.held:
            mem = [c for c in chunks if len(c) == 2]
            if mem:
                pos, lcp = np.concatenate([c[0] for c in mem]), np.concatenate([c[1] for c in mem])
                at = self.file.seek(0, 2)
                self.file.write(pos.tobytes())
                self.file.write(lcp.tobytes())
                # chunks in memory are always later than those on disk
                chunks[:] = [c for c in chunks if len(c) == 4] + [(at, len(pos), 0, len(pos))]
                self.spilled += len(pos)
        self.count = 0

    def _read(self, at: int, n: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(at + 8 * a)
        pos = np.frombuffer(self.file.read(8 * (b - a)), np.int64)
        self.file.seek(at + 8 * n + a)
        return pos, np.frombuffer(self.file.read(b - a), np.uint8)

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """The first block of a key; empty if it has none."""
        chunks = self.held[key]
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        if len(chunks[0]) == 4:
            at, n, a, b = chunks[0]
            stop = min(b, a + self.most)
            chunks[:1] = [(at, n, stop, b)] if stop < b else []
            return self._read(at, n, a, stop)
        mem, chunks[:] = list(chunks), []
        self.count -= sum(len(c[0]) for c in mem)
        return np.concatenate([c[0] for c in mem]), np.concatenate([c[1] for c in mem])

    def pop_last(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """The last block of a key."""
        chunks = self.held[key]
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        c = chunks.pop()
        if len(c) == 2:
            self.count -= len(c[0])
            return c
        at, n, a, b = c
        start = max(a, b - self.most)
        if start > a:
            chunks.append((at, n, a, start))
        return self._read(at, n, start, b)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def types(t: np.ndarray, out: np.ndarray | None = None, block: int = IN_MEMORY) -> np.ndarray:
    """True for S suffixes. The text's end is below every byte. Blocks are taken from the end."""
    n = len(t)
    out = np.zeros(n, bool) if out is None else out
    after, later = None, False  # the first byte and the type of what follows
    for b in range(n, 0, -block):
        a = max(0, b - block)
        x = np.asarray(t[a:b])
        step = np.zeros(b - a, np.int8)  # 1: smaller than the next byte, -1: larger
        step[:-1] = np.sign(x[1:].astype(np.int16) - x[:-1])
        step[-1] = -1 if after is None else int(np.sign(int(after) - int(x[-1]))) or (1 if later else -1)
        known = np.where(step != 0, np.arange(b - a), b - a)
        out[a:b] = step[np.minimum.accumulate(known[::-1])[::-1]] > 0  # of the next byte that differs from its successor
        after, later = x[0], bool(out[a])
    return out


class Text:
    """Bytes with room to read past the end."""

    def __init__(self, t: np.ndarray, depth: int):
        """t: bytes that are followed by depth + 16 zeros."""
        self.n, self.depth = len(t) - depth - 16, depth
        self.t = t
        self.word = np.ndarray((len(self.t) - 8,), ">u8", self.t, strides=(1,))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes, to the depth."""
        out = np.full(len(a), self.depth, np.uint8)
        todo = np.arange(len(a))
        for d in range(0, self.depth, 8):
            x = self.word[a[todo] + d].astype(np.uint64) ^ self.word[b[todo] + d].astype(np.uint64)
            off = x != 0
            if off.any():
                hit = x[off]
                lead = np.zeros(len(hit), np.int64)
                for k in range(8):
                    lead += (hit >> np.uint64(8 * (7 - k))) == 0
                out[todo[off]] = np.minimum(d + lead, self.depth)
                todo = todo[~off]
            if not len(todo):
                break
        return out

    def sort(self, pos: np.ndarray) -> np.ndarray:
        """Suffixes in order to the depth, refining ties."""
        pos = pos[np.argsort(self.word[pos].astype(np.uint64), kind="stable")]
        key = self.word[pos].astype(np.uint64)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        for d in range(8, self.depth, 8):
            alone = new & np.concatenate([new[1:], [True]])
            tied = np.flatnonzero(~alone)
            if not len(tied):
                break
            group = np.cumsum(new[tied])
            p = pos[tied]
            k = self.word[p + d].astype(np.uint64)
            o = np.lexsort((k, group))
            pos[tied] = p[o]
            k, g = k[o], group[o]
            new[tied[1:]] |= (k[1:] != k[:-1]) | (g[1:] != g[:-1])
        return pos


def _merged(runs: list[tuple[np.ndarray, np.ndarray]], in_memory: int) -> Iterator[np.ndarray]:
    """Positions of sorted runs (positions, prefixes) in order, a bounded block at a time."""
    each = max(1, in_memory // (len(runs) + 1))
    at = [0] * len(runs)
    held: list[tuple[np.ndarray, np.ndarray]] = [(r[0][:0], r[1][:0]) for r in runs]
    while True:
        for i, (pos, key) in enumerate(runs):
            if not len(held[i][0]) and at[i] < len(pos):
                stop = min(len(pos), at[i] + each)
                held[i] = (np.array(pos[at[i] : stop]), np.array(key[at[i] : stop]))
                at[i] = stop
        live = [i for i, h in enumerate(held) if len(h[0])]
        if not live:
            return
        more = [bytes(held[i][1][-1]) for i in live if at[i] < len(runs[i][0])]
        take = {i: len(held[i][0]) for i in live}
        if more:  # nothing that comes later is below the least of the last prefixes
            least = min(more)
            for i in live:
                a, b = 0, take[i]
                while a < b:  # how many are at most the least
                    mid = (a + b) // 2
                    a, b = (mid + 1, b) if bytes(held[i][1][mid]) <= least else (a, mid)
                take[i] = a
        pos = np.concatenate([held[i][0][: take[i]] for i in live])
        key = np.concatenate([held[i][1][: take[i]] for i in live])
        words = np.ascontiguousarray(key).view(">u8")
        yield pos[np.lexsort([words[:, j] for j in range(words.shape[1] - 1, -1, -1)])]
        for i in live:
            held[i] = (held[i][0][take[i] :], held[i][1][take[i] :])


def _stars(text: Text, s_type: np.ndarray, in_memory: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """S* suffixes in order, their common prefixes with the one before, and where each first byte begins."""
    runs, total = [], 0
    width = -(-text.depth // 8) * 8
    block, waiting, held, alone = max(2, in_memory), [], 0, np.zeros(0, np.int64)

    def kept(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A run and its prefixes, which count to the depth only."""
        disk, key = room((len(pos),), "i8", in_memory), room((len(pos), width), "u1", in_memory)
        for i in range(0, len(pos), max(1, in_memory // 16)):
            part = pos[i : i + max(1, in_memory // 16)]
            disk[i : i + len(part)] = part
            key[i : i + len(part)] = text.t[part[:, None] + np.arange(width)]
        key[:, text.depth :] = 0
        return disk, key

    for a in range(0, text.n, block):
        b = min(text.n, a + block)
        before = np.concatenate([[True if a == 0 else bool(s_type[a - 1])], np.asarray(s_type[a : b - 1])])
        pos = np.flatnonzero(np.asarray(s_type[a:b]) & ~before) + a
        if held and held + len(pos) > block:
            runs.append(kept(text.sort(np.concatenate(waiting))))
            waiting, held = [], 0
        waiting.append(pos)
        held, total = held + len(pos), total + len(pos)
    if held:
        alone = text.sort(np.concatenate(waiting))
    blocks = _merged([*runs, kept(alone)], in_memory) if runs else iter([alone] if total else [])
    out = room((total,), "i8", in_memory)
    lcp, first, at, last = room((total,), "u1", in_memory), np.zeros(256, np.int64), 0, None
    for pos in blocks:
        out[at : at + len(pos)] = pos
        before = np.concatenate([[pos[0] if last is None else last], pos[:-1]])
        lcp[at : at + len(pos)] = text.common(before, pos)
        first += np.bincount(text.t[pos], minlength=256)
        at, last = at + len(pos), pos[-1]
    if total:
        lcp[0] = 0
    return out, lcp, np.concatenate([[0], np.cumsum(first)])


def _induce(queue: BucketQueue, since: np.ndarray, text: Text, ok: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
    """Push the predecessors of scanned suffixes that are of the wanted type.

    since: for each key the least common prefix scanned after its last push.
    """
    prev = pos - 1
    good = np.flatnonzero((prev >= 0) & ok[np.maximum(prev, 0)])
    keys = text.t[prev[good]]
    low = int(lcp.min()) if len(lcp) else 255
    touched = np.bincount(keys, minlength=256)
    np.minimum(since, low, out=since, where=touched == 0)
    if not len(good):
        return
    order = np.argsort(keys, kind="stable")
    at = 0
    for key in np.flatnonzero(touched).tolist():
        idx = good[order[at : at + touched[key]]]
        at += touched[key]
        edges = np.concatenate([[0], idx[:-1] + 1])
        least = np.minimum.reduceat(lcp[: idx[-1] + 1], edges)
        least[0] = min(int(least[0]), int(since[key]))
        queue.push(key, prev[idx], np.minimum(least + np.uint8(1), text.depth).astype(np.uint8))
        rest = lcp[idx[-1] + 1 :]
        since[key] = int(rest.min()) if len(rest) else 255


def suffixes(t: np.ndarray, depth: int, in_memory: int = IN_MEMORY, counts: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of suffixes in descending order, each with the common prefix, to the depth, with the one before it in this order.

    counts: takes the number of tuples that queues wrote to disk.
    """
    if not len(t):
        return
    if depth > 200:
        raise ValueError("common prefixes are kept in a byte")
    held = room((len(t) + depth + 16,), "u1", in_memory)
    held[: len(t)] = t
    text = Text(held, depth)
    n = text.n
    s_type = types(text.t[:n], room((n,), "bool", in_memory), max(1, in_memory))
    star, star_lcp, cut = _stars(text, s_type, in_memory)

    def blocks(key: int):
        a, b = int(cut[key]), int(cut[key + 1])
        for i in range(a, b, max(1, in_memory)):
            j = min(b, i + max(1, in_memory))
            yield np.array(star[i:j]), np.array(star_lcp[i:j]), i == a

    # ascending: L suffixes from the end of the text, from L and from S* suffixes
    queue, since = BucketQueue(in_memory), np.full(256, 255, np.int64)
    is_l = _Not(s_type)
    found = BucketQueue(in_memory)  # the L suffixes of each first byte, ascending
    opened = np.zeros(256, bool)
    _open = lambda p, v, key: (p, np.concatenate([[0], v[1:]]).astype(np.uint8)) if len(p) and not opened[key] else (p, v)
    queue.push(int(text.t[n - 1]), np.array([n - 1]), np.zeros(1, np.uint8))  # the last suffix is of type L
    for key in range(256):
        last = None
        while True:
            pos, lcp = queue.pop(key)
            if not len(pos):
                break
            pos, lcp = _open(pos, lcp, key)
            opened[key] = True
            found.push(key, pos, lcp)
            last = pos[-1]
            _induce(queue, since, text, is_l, pos, lcp)
        for pos, lcp, first in blocks(key):
            if first:
                lcp[0] = text.common(np.array([last]), pos[:1])[0] if last is not None else 0
            _induce(queue, since, text, is_l, pos, lcp)
    spilled = queue.spilled
    queue.close()

    # descending: S suffixes from S and from L suffixes
    queue, since = BucketQueue(in_memory), np.full(256, 255, np.int64)
    opened[:] = False
    for key in range(255, -1, -1):
        last = None
        while True:
            pos, lcp = queue.pop(key)
            if not len(pos):
                break
            pos, lcp = _open(pos, lcp, key)
            opened[key] = True
            yield pos, lcp
            last = pos[-1]
            _induce(queue, since, text, s_type, pos, lcp)
        before = None  # the common prefix of this block's last suffix with the one after it
        while True:
            pos, up = found.pop_last(key)
            if not len(pos):
                break
            pos, up = pos[::-1], up[::-1]
            lcp = np.zeros(len(pos), np.uint8)
            lcp[1:] = up[:-1]
            lcp[0] = before if before is not None else text.common(np.array([last]), pos[:1])[0] if last is not None else 0
            before = int(up[-1])
            yield pos, lcp
            _induce(queue, since, text, s_type, pos, lcp)
    if counts is not None:
        counts["spilled"] = spilled + queue.spilled + found.spilled
    queue.close()
    found.close()


class _Not:
    """The other types, looked up where they are asked for."""

    def __init__(self, flags: np.ndarray):
        self.flags = flags

    def __getitem__(self, at):
        return ~self.flags[at]
