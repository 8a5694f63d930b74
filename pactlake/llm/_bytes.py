"""Vectorised hashing of bytes, words and word shingles.

A span is hashed eight bytes at a time, each chunk mixed into the state before
the next one, and its length first; spans longer than LONG are digested one by
one. So no two spans meet by the structure of their bytes, whatever their
length, as they do in polynomials modulo 2^64; equal hashes of unlike spans are
left to chance, 2^-64 a pair.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: Five words make a shingle.
SHINGLE = 5
_STEP = [0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Spans of more bytes are digested by blake2b.
LONG = 512
#: Keeps the first n bytes of a little-endian chunk.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], U)


def chunks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of data, with zeros after its end."""
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", held, strides=(1,))


class SpanHash:
    """Hashes of spans [s, e) of one byte array."""

    def __init__(self, data: np.ndarray):
        self.data, self.at = data, chunks(data)

    def __call__(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        n = e - s
        h = mix(mix(n.astype(U)) ^ (self.at[s] & _FIRST[np.minimum(n, 8)]))
        todo = np.flatnonzero((n > 8) & (n <= LONG))
        done = 8
        while len(todo):
            left = n[todo] - done
            h[todo] = mix(h[todo] ^ (self.at[s[todo] + done] & _FIRST[np.minimum(left, 8)]))
            todo, done = todo[left > 8], done + 8
        for i in np.flatnonzero(n > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
        return h


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each document the index of its first word (n + 1)."""
    solid = ~IS_SPACE[data]
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its lower-cased word shingles.

    Fewer than five words make one shingle of the whole sequence; no words, none.
    """
    low = LOWER[data]
    s, e, at = words(low, offs)
    h = SpanHash(low)(s, e)
    full = np.zeros(0, U)
    if len(h) >= SHINGLE:
        m = len(h) - SHINGLE + 1
        full = h[:m] * U(_STEP[0])
        for j in range(1, SHINGLE):
            full = (full ^ (full >> U(29))) + h[j : j + m] * U(_STEP[j])
        full = mix(full)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(full[a : b - SHINGLE + 1]))
        elif b > a:
            x = np.array([b - a], U)
            for j in range(b - a):
                x = (x ^ (x >> U(29))) + h[a + j : a + j + 1] * U(_STEP[j])
            out.append(mix(x * U(0xD6E8FEB86659FD93)))
        else:
            out.append(np.zeros(0, U))
    return out
