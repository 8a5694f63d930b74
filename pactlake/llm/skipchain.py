"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers; these base
spans stay. The random field labels them and the document's other suspicious
tokens (blank-delimited, with a digit or an ``@``; numbers in groups count as one):
neighbours share a transition potential, and tokens that are alike share a skip
potential however distant. Alike are equal tokens, numbers with the same last
ALIKE digits, and addresses with the same part before the ``@``. All tokens of a
likeness class are joined to one hub variable, so each agrees with every other
while edges grow as tokens do. Base spans are clamped, and fix the hub of their
class; damped sum-product messages run until they no longer change, and free
tokens whose most probable label is a kind become spans of that kind.

Weights are learned here by pseudo-likelihood from at most TRAIN_DOCS documents
(those with the smallest hashes of their doc_id). Base spans have their kind, other
tokens none; but tokens alike to a base span are unlabelled. Each labelled token
counts twice, once with its looks and once with them hidden, where only its
neighbours and its likeness class can tell the label; and a base span counts once
more as a mention of itself that lacks what the patterns ask for (a phone's plus,
an address' last part). That teaches how much the agreement weighs against looks.
Tokens are counted by context, a tuple of small buckets, before they reach the driver.

Null text counts as empty and has no spans. Offsets are code points, ends
exclusive. Repeated rows and null ids give rows alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_arrow

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
TRAIN_DOCS = 20_000
SURE = 0.6
#: Log-weight against labels that a base span rules out.
FIXED = 1e6
#: Messages are sent until none changes by more; damping rises after as many rounds each.
SETTLED = 1e-6
DAMPING = ((0.0, 50), (0.3, 200), (0.6, 500), (0.9, 5000))
#: Numbers of as many digits are alike by their last ones.
ALIKE = 7
#: Numbers in groups, as in phone numbers, have as many digits.
GROUPED = (7, 19)
#: Tokens this near in characters are neighbours.
NEAR = 3

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts at the first digit of its run: matches end at the end of a run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile("[0-9@]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_BLANK = " \t\n\x0b\x0c\r"
_TO_BLANK = re.compile(r"[\x20\x09-\x0D]")
_TRIM = ".,;:!?()[]{}<>\"'|"
_NUMERIC = re.compile(r"[+(]?[0-9][0-9().-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted: leftmost non-overlapping for each kind."""
    out = []
    at, after = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            # the local part reaches back over its run of characters, not before the last address
            seg = text[max(after, at - 64) : at]
            if len(seg.rstrip(_LOCAL)) == 0 and at - 64 > after:
                seg = text[after:at]
            start = at - (len(seg) - len(seg.rstrip(_LOCAL)))
            if start < at:
                out.append((start, EMAIL, m.end()))
                after = m.end()
                at = text.find("@", after)
                continue
        at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return sorted(out)
    if text.count(".") >= 3:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def suspicious(text: str) -> list[tuple[int, int]]:
    """Blank-delimited tokens with a digit or an @, without outer punctuation."""
    out, at = [], 0
    while m := _MARK.search(text, at):
        i = m.start()
        b = _TO_BLANK.search(text, i)
        end = b.start() if b else len(text)
        lead = text[at:i]
        cut = max(lead.rfind(c) for c in _BLANK)
        start = at + cut + 1
        at = end
        s = text[start:end]
        core = s.strip(_TRIM)
        if core:
            off = s.find(core)
            out.append((start + off, start + off + len(core)))
    return out


_DIGIT_BUCKETS = [0, 1, 2, 4, 7, 10, 14, 20]


def signature(token: str) -> tuple[int, ...]:
    """Buckets of a token: digits, dots, and whether it has an @, letters, hyphens, a plus, other signs, a card's check digit."""
    only = _NOT_DIGIT.sub("", token)
    digits = len(only)
    bucket = sum(digits >= b for b in _DIGIT_BUCKETS)
    return (
        bucket, min(token.count("."), 4), int("@" in token), int(any(c.isalpha() for c in token)), int("-" in token),
        int("+" in token), int(bool(set(token) & set("_%/:#=$*&"))), int(14 <= digits <= 19 and luhn(only))
    )


def likeness_key(token: str) -> str:
    """Tokens with equal keys are alike."""
    if "@" in token:
        return "@" + token[: token.index("@")].lower() if token[0] != "@" else token.lower()
    d = _NOT_DIGIT.sub("", token)
    return "#" + d[-ALIKE:] if len(d) >= ALIKE else token.lower()


#: Sizes of the buckets of a signature, for one-hot features.
SIZES = (9, 5, 2, 2, 2, 2, 2, 2)
LABELS = 1 + len(KINDS)  # 0: none
WIDTH = sum(SIZES) + 2
#: Features of a token whose looks are hidden.
HIDDEN = np.append(np.zeros(sum(SIZES) + 1), 1.0)


def one_hot(sig: tuple[int, ...]) -> np.ndarray:
    x = np.zeros(WIDTH)
    at = 0
    for v, n in zip(sig, SIZES, strict=True):
        x[at + v] = 1
        at += n
    x[-2] = 1
    return x


def _grouped(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of numeric tokens, a blank apart, as one token where they have a plausible number of digits."""
    out, i = [], 0
    while i < len(tokens):
        j = i
        while j + 1 < len(tokens) and _NUMERIC.fullmatch(text[tokens[j][0] : tokens[j][1]]) and text[tokens[j][1] : tokens[j + 1][0]].strip("()") == " " and _NUMERIC.fullmatch(
            text[tokens[j + 1][0] : tokens[j + 1][1]]
        ):
            j += 1
        whole = (tokens[i][0], tokens[j][1])
        if j > i and GROUPED[0] <= len(_NOT_DIGIT.sub("", text[whole[0] : whole[1]])) <= GROUPED[1]:
            out.append(whole)
        else:
            out += tokens[i : j + 1]
        i = j + 1
    return out


def graph(text: str, base: list[tuple[int, int, int]]):
    """Nodes in order, their clamped labels (-1: free), pairs of neighbours, and the likeness class of each (-1: alike to none)."""
    spans, i = [], 0
    free = []
    for s, e in suspicious(text):
        while i < len(base) and base[i][2] <= s:
            i += 1
        if not any(b[0] < e and b[2] > s for b in base[max(0, i - 2) : i + 3]):
            free.append((s, e))
    spans = [(s, e, k + 1) for s, k, e in base] + [(s, e, -1) for s, e in _grouped(text, free)]
    spans.sort()
    nodes = [(s, e) for s, e, _ in spans]
    clamp = np.array([k for _, _, k in spans], np.int64)
    near = [(i, i + 1) for i in range(len(nodes) - 1) if 0 <= nodes[i + 1][0] - nodes[i][1] <= NEAR]
    members: dict[str, list[int]] = {}
    for i, (s, e) in enumerate(nodes):
        members.setdefault(likeness_key(text[s:e]), []).append(i)
    of = np.full(len(nodes), -1)
    for c, m in enumerate(m for m in members.values() if len(m) > 1):
        of[m] = c
    return nodes, clamp, near, of


class Field:
    """Weights: of signatures (WIDTH x LABELS), of neighbours (LABELS x LABELS), of agreement with the hub of a class."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, agree: float):
        self.unary, self.chain, self.agree = unary, chain, agree
        self.cache: dict[tuple, np.ndarray] = {}

    def of(self, sig: tuple) -> np.ndarray:
        if sig not in self.cache:  # as many as there are signatures
            self.cache[sig] = one_hot(sig) @ self.unary
        return self.cache[sig]

    def added(self, text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], int]:
        """Spans of free tokens, and how many of them only the skip potentials give."""
        nodes, clamp, near, of = graph(text, base)
        if not (clamp < 0).any():
            return [], 0
        z = np.stack([self.of(signature(text[s:e])) for s, e in nodes])
        found = self._kinds(propagate(z, near, of, self.chain, self.agree, clamp), clamp)
        alone = found
        if found and (of >= 0).any():
            alone = self._kinds(propagate(z, near, np.full(len(nodes), -1), self.chain, self.agree, clamp), clamp)
        return [(nodes[i][0], k, nodes[i][1]) for i, k in found], len(set(found) - set(alone))

    @staticmethod
    def _kinds(belief: np.ndarray, clamp: np.ndarray) -> list[tuple[int, int]]:
        best = belief.argmax(axis=1)
        take = np.flatnonzero((clamp < 0) & (best > 0) & (belief.max(axis=1) >= SURE))
        return [(int(i), int(best[i]) - 1) for i in take]


def propagate(z: np.ndarray, near: list, of: np.ndarray, chain: np.ndarray, agree: float, clamp: np.ndarray) -> np.ndarray:
    """Marginals of nodes by sum-product messages along neighbours and between nodes and the hubs of their classes.

    clamp: each node's label if it is fixed, else -1; fixed nodes fix their hub, to
    any of their labels. Exact where the graph has no loop.
    """
    n, labels = z.shape
    z = np.concatenate([z, np.zeros((int(of.max(initial=-1)) + 1, labels))])
    fixed = np.flatnonzero(clamp >= 0)
    hub = fixed[of[fixed] >= 0]
    z[fixed] = z[n + of[hub]] = -FIXED
    z[fixed, clamp[fixed]] = 0
    z[n + of[hub], clamp[hub]] = 0
    tied = np.flatnonzero((of >= 0) & (clamp < 0))
    near = np.array(near, np.int64).reshape(-1, 2)
    edges = np.concatenate([near, np.stack([tied, n + of[tied]], axis=1)])
    if len(edges):
        pot = np.concatenate([np.repeat(chain[None], len(near), 0), np.repeat((agree * np.eye(labels))[None], len(tied), 0)])
        pot = np.exp(np.concatenate([pot, pot.transpose(0, 2, 1)]))
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        msg = np.zeros((len(src), labels))
        for damping, rounds in DAMPING:
            for _ in range(rounds):
                total = z.copy()
                np.add.at(total, dst, msg)
                out = total[src] - msg[back]
                out = np.exp(out - out.max(axis=1, keepdims=True))
                new = np.log(np.einsum("ea,eab->eb", out, pot) + 1e-300)
                new -= new.max(axis=1, keepdims=True)
                change = np.abs(new - msg).max()
                msg = damping * msg + (1 - damping) * new
                if change < SETTLED:
                    break
            if change < SETTLED:
                break
        z = z.copy()
        np.add.at(z, dst, msg)
    p = np.exp(z[:n] - z[:n].max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def contexts(text: str) -> list[list[int]]:
    """Of each labelled token: its signature, the labels of its neighbours (-1: none or unlabelled), the
    number of its mates with each label, and its own label."""
    nodes, clamp, near, of = graph(text, base_spans(text))
    y = np.maximum(clamp, 0)
    classes = int(of.max(initial=-1)) + 1
    known = np.zeros(classes, bool)
    known[of[(clamp > 0) & (of >= 0)]] = True
    labelled = (clamp > 0) | (of < 0) | ~np.append(known, False)[of]
    mates = np.zeros((classes + 1, LABELS), int)
    np.add.at(mates, (of[labelled], y[labelled]), 1)
    left, right = np.full(len(nodes), -1), np.full(len(nodes), -1)
    for a, b in near:
        left[b], right[a] = (y[a] if labelled[a] else -1), (y[b] if labelled[b] else -1)
    out = []
    for i in np.flatnonzero(labelled).tolist():
        n = mates[of[i]].copy() if of[i] >= 0 else np.zeros(LABELS, int)
        n[y[i]] -= of[i] >= 0
        s, e = nodes[i]
        around = [int(left[i]), int(right[i])]
        out.append([*signature(text[s:e]), *around, *np.minimum(n, MATES).tolist(), int(y[i])])
        if clamp[i] > 0:
            n[y[i]] += 1
            out.append([*signature(variant(text[s:e])), -1, -1, *np.minimum(n, MATES).tolist(), int(y[i])])
    return out


def variant(token: str) -> str:
    """A mention that the patterns don't find: without a plus, or the last part of an address."""
    return token[: token.rindex(".")] if "@" in token else token.lstrip("+")


#: Mates of one label that count in learning: more of them tell no more.
MATES = 15


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            if text and _MARK.search(text):
                rows += contexts(text)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], ["node"])


def learn(docs: DataFrame, most: int = TRAIN_DOCS) -> Field:
    """Pseudo-likelihood by gradient steps over counted contexts."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most ``most`` ids
    ids = d.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    nodes = map_arrow(d.join(F.broadcast(ids), "doc_id").select("text"), _contexts, "node array<int>")
    counted = nodes.groupBy("node").count().collect()
    return fit(
        np.array([r["node"] for r in counted], np.int64).reshape(-1, len(SIZES) + 2 + LABELS + 1),
        np.array([r["count"] for r in counted], float)
    )


def _agreement(agree: float, mates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a node's mates say of each label through their hub, and its slope by the weight.

    Mates of a kind are base spans, which fix the hub; those without one only agree with it.
    """
    by = np.repeat(np.eye(LABELS)[None], len(mates), 0)  # node, its label, hub's label
    by[:, :, 0] += mates[:, None, 0]
    s = agree * by
    s[:, :, 1:] += FIXED * (mates[:, None, 1:] > 0)
    top = s.max(axis=2, keepdims=True)
    e = np.exp(s - top)
    total = e.sum(axis=2)
    return np.log(total) + top[:, :, 0], (e * by).sum(axis=2) / total


def fit(nodes: np.ndarray, count: np.ndarray, steps: int = 400) -> Field:
    k, y = len(SIZES), nodes[:, -1]
    x = np.stack([one_hot(tuple(r[:k])) for r in nodes]) if len(nodes) else np.zeros((0, WIDTH))
    x = np.concatenate([x, np.repeat(HIDDEN[None], len(x), 0)])  # each token as it looks, and hidden
    side = [np.tile(np.eye(LABELS + 1)[nodes[:, k + i]][:, :LABELS], (2, 1)) for i in (0, 1)]  # label -1: no neighbour
    mates = np.tile(nodes[:, k + 2 : k + 2 + LABELS].astype(float), (2, 1))
    y, w = np.tile(y, 2), np.tile(count, 2)
    some = mates.sum(axis=1) > 0
    unary, chain, agree = np.zeros((WIDTH, LABELS)), np.zeros((LABELS, LABELS)), 1.0
    w = w / max(w.sum(), 1)
    first = [np.zeros_like(unary), np.zeros_like(chain), 0.0]
    second = [np.zeros_like(unary), np.zeros_like(chain), 0.0]
    for t in range(1, steps + 1):
        z = x @ unary + side[0] @ chain + side[1] @ chain.T
        says, slope = _agreement(agree, mates[some])
        z[some] += says
        p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        p /= p.sum(axis=1, keepdims=True)
        r = (np.eye(LABELS)[y] - p) * w[:, None]
        grad = [x.T @ r - 1e-5 * unary, side[0].T @ r + (side[1].T @ r).T - 1e-5 * chain, float((slope * r[some]).sum()) - 1e-5 * agree]
        step = []
        for i, g in enumerate(grad):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g**2
            step.append(0.1 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-9))
        unary, chain, agree = unary + step[0], chain + step[1], max(0.0, agree + step[2])
    return Field(unary, chain, float(agree))


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of base spans, their digest, all spans, and how many of them only the skip potentials give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                if not text or not _MARK.search(text):
                    rows.append((0, 0, 0, 0, none, "", 0))
                    continue
                base = base_spans(text)
                n = [0] * len(KINDS)
                for _, k, _ in base:
                    n[k] += 1
                added, linked = field.added(text, base)
                rows.append((*n, hashlib.sha256(spell(base).encode()).hexdigest(), spell(sorted([*base, *added])), linked))
            c = list(zip(*rows, strict=True)) or [[]] * 7
            cols = [pa.array(v, pa.string() if i in (4, 5) else pa.int64()) for i, v in enumerate(c)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *cols], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_linked"]
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_linked long"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by their kind; overlapping ones together, by the first's."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """docs with the spans in ``text`` masked, and n_chars, if there, as it then is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            out = []
            for text in batch.column(i).to_pylist():
                if text and _MARK.search(text):
                    base = base_spans(text)
                    text = mask(text, sorted([*base, *field.added(text, base)[0]]))
                out.append(text)
            yield batch.set_column(i, "text", pa.array(out, batch.schema.field(i).type))

    done = map_arrow(docs, run, docs.schema)
    return done.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else done
