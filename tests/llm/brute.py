"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_duplicates(rows):
    """rows (doc_id, text) -> sorted (doc_id, n_shingles, component_id, kept)"""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    out = [(i, len(a), None if i is None else find(i), i is None or find(i) == i) for i, a in sets]
    return sorted(out, key=repr)


def repeats(rows, length=100):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), []
    for k in order:
        b = (rows[k][1] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        spans = sum(1 for s in range(len(b)) if gone[s] and (s == 0 or not gone[s - 1]))
        out.append((rows[k][0], len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return sorted(out, key=repr)


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(int(c) * 2, 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    out, digits = [], lambda m: re.sub("[^0-9]", "", m[0])
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(digits(m)) <= 19 and luhn(digits(m)):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m)) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def water(sizes, weights, cap):
    """Targets: the level at which all of them sum to all sizes, by halving."""
    total, lo, hi = sum(sizes), 0.0, cap * sum(sizes) + 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap * s, w * mid) for s, w in zip(sizes, weights, strict=True)) < total else (lo, mid)
    return [min(cap * s, w * hi) for s, w in zip(sizes, weights, strict=True)]


def rates(docs, goal, cap, ridge):
    """docs (source, size), goal {source: target} -> rate of each document: mu by halving, each lambda by halving within."""
    size = np.array([float(q) for _, q in docs])
    x = np.log1p(size)
    mean = (size * x).sum() / size.sum()
    x = (x - mean) / np.sqrt((size * x * x).sum() / size.sum() - mean**2)
    names = [s for s, _ in docs]

    def at(mu):
        r = np.zeros(len(docs))
        for s in set(names):
            mine = np.array([n == s for n in names])
            lo, hi = -60.0, 60.0
            for _ in range(100):
                mid = (lo + hi) / 2
                got = (size[mine] * np.minimum(cap, np.exp(mid + mu * x[mine]))).sum()
                lo, hi = (mid, hi) if got < goal[s] else (lo, mid)
            r[mine] = np.minimum(cap, np.exp(hi + mu * x[mine]))
        return r

    lo, hi = -30.0, 30.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (size * at(mid) * x).sum() + ridge * size.sum() * mid < 0 else (lo, mid)
    return at((lo + hi) / 2)


def copies(docs, keys, rate, goal, cap, fill):
    """docs (source, size), a 64-bit key of each -> copies: floors, the rest by hash over fraction, then the largest that fit."""
    out = [0] * len(docs)
    for s in {n for n, _ in docs}:
        mine = [i for i, (n, q) in enumerate(docs) if n == s and q]
        for i in mine:
            out[i] = int(rate[i] + 1e-9)
        more = goal[s] - sum(out[i] * docs[i][1] for i in mine)
        v = {i: ((keys[i] % (1 << 64) >> 11) + 0.5) / 2**53 / (rate[i] - out[i]) for i in mine if rate[i] - out[i] > 1e-9}
        whole, got = dict.fromkeys(mine, 0), 0
        for t in sorted(set(v.values())):
            tied = [i for i in v if v[i] == t]
            if got + sum(docs[i][1] for i in tied) > more:
                break
            got += sum(docs[i][1] for i in tied)
            whole |= dict.fromkeys(tied, 1)
        free = [i for i in mine if not whole[i] and out[i] < cap and [keys[j] for j in mine].count(keys[i]) == 1]
        gap = more - got
        least = {}
        for i in free:
            if docs[i][1] < 2 * gap:
                q = docs[i][1]
                least[q] = min(least.get(q, i), i, key=lambda j: keys[j])
        for turn in range(fill + 1):
            fits = [q for q in least if (q <= gap if turn < fill else q < 2 * gap)]
            if fits:
                q = min(fits, key=lambda z: (abs(z - gap), z))
                whole[least.pop(q)] = 1
                gap -= q
        for i in mine:
            out[i] = min(cap, out[i] + whole[i])
    return out


def statistics(text):
    """The quality classifier's statistics of one text, in the order of gbdt.NAMES, by counting."""
    b = text.encode()
    n, words = len(b), re.findall(rb"[^\x20\x09-\x0d]+", b)
    share = lambda chars: sum(map(b.count, map(lambda c: bytes([c]), chars))) / max(n, 1)
    high, digits, lower, upper = range(128, 256), range(48, 58), range(97, 123), range(65, 91)
    of = lambda s: s.encode()
    out = [share(x) for x in (lower, upper, digits, high, of(" \t\n\x0b\x0c\r"), of("\n"), of("!.?"), of(",:;"), of("#$%&*+/<=>@\\^_|~"), of("()[]{}"))]
    letter = lambda c: c in lower or c in upper or c in high
    k, wide = max(len(words), 1), [len(w) for w in words]
    mean = sum(wide) / k
    big = [sum(c in upper for c in w) for w in words]
    out += [
        np.log1p(n), np.log1p(len(words)), mean, max(0.0, sum(x * x for x in wide) / k - mean**2) ** 0.5, np.log1p(max(wide, default=0)),
        sum(u >= 2 and u >= 0.6 * x for u, x in zip(big, wide, strict=True)) / k, sum(w[0] in upper for w in words) / k,
        sum(not any(map(letter, w)) for w in words) / k, sum(not letter(w[-1]) for w in words) / k
    ]
    lines = [x for x in b.split(b"\n") if x]
    seen = Counter(words)
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    bits = [b.count(bytes([c])) / n for c in set(b)] if words else []
    out += [
        len(seen) / k, max(seen.values(), default=0) / k, len(set(threes)) / len(threes) if len(words) >= 5 else float(bool(words)),
        np.log1p(len(lines)), np.log1p(n / max(len(lines), 1)), 1 - len(set(lines)) / len(lines) if lines else 0.0,
        -sum(p * np.log2(p) for p in bits)
    ]
    return np.array(out, np.float32)


def walked(forest, row):
    """One row down every tree, a node at a time."""
    z = forest.base
    for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
        at = 0
        while at < len(f):
            at = 2 * at + 1 + int(row[f[at]] > t[at])
        z += leaf[at - len(f)]
    return 1 / (1 + np.exp(-z))
