"""Alignment of two tokenizers' tokens by bitsets of their ends.

Tokenizer A is a byte-level BPE of the ``tokenizers`` library and reads a space and the
text; B is a ``sentencepiece`` BPE, which puts that space there itself.

1. Texts are cut into the pieces that neither tokenizer merges across (A: its pre-tokens;
   B: runs of spaces with what follows them), and every distinct piece is encoded once for
   each worker while a bounded cache holds it.
2. Over the bytes of a slice of documents, one packed bitset marks where A's tokens end and
   one where B's do. Their AND has the cuts that both share, which bound the groups; popcounts of
   words before a place (rank) turn cuts into token ranges. Every set bit of their OR ends just one
   overlap of an A and a B token, whose indices are the two ranks there: these are the links.
3. Documents form *blocks*. A block's distinct pairs of ids are rows of a stored table with
   their numbers of links; documents keep indices into their block's pairs. Pairs are summed over all blocks,
   B ids get their highest count, and both come back to the blocks, where documents sum them up.

So texts are read and encoded once, and what is shuffled is a row for each pair and block,
and each document's packed indices. A pair that is in all blocks is one row a block, combined before the first shuffle.

Null and empty texts, and texts whose joined token bytes aren't space and text (as those with U+2581), have no tokens: zeros
and an empty digest. Each input row gives one result row, whatever its doc_id; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import bounded_batches, map_arrow, ship, stored, texts
from ._pretokens import by_tokenizers
from .token_counts import byte_letters
from .word_shuffle_bpe import pack, ragged, unpack

#: Pieces whose ids a worker remembers, and their characters in all; then it begins anew.
CACHE, CACHE_CHARS = 400_000, 16 << 20
#: Bytes of text that are aligned at once, but for a longer single text.
SLICE = 2 << 20
#: Bytes of text of a block, and sum of its slices' distinct pairs.
BLOCK, BLOCK_PAIRS = 24 << 20, 1_500_000
MARK = "▁"
U = np.uint64


class Pieces(dict):
    """Ids of pieces: a piece's index in order of first sight, and all pieces' ids one after another."""

    def __init__(self):
        super().__init__()
        self.ids, self.n, self.chars, self.lossy = [], [], 0, set()
        self.held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def encode(self, piece: str) -> list[int]:
        raise NotImplementedError

    def __missing__(self, piece: str) -> int:
        got, at = self.encode(piece), len(self)
        if b"".join([self.bytes[i] for i in got]) != piece.encode():
            self.lossy.add(at)
        self.ids += got
        self.n.append(len(got))
        self.chars += len(piece)
        self[piece] = at
        return at

    def begin(self) -> None:
        if len(self) > CACHE or self.chars > CACHE_CHARS:
            self.clear()
            self.ids, self.n, self.chars, self.lossy = [], [], 0, set()
            self.held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def tokens(self, pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """All token ids of the documents, their number for each, and whether a piece of it lost bytes."""
        own = [np.fromiter(map(self.__getitem__, p), np.int64, len(p)) for p in pieces]
        for k, grown in enumerate((self.n, self.ids)):
            if len(grown) > len(self.held[k]):
                self.held[k] = np.concatenate([self.held[k], np.array(grown[len(self.held[k]) :], np.int64)])
        n, flat = self.held
        start = np.cumsum(n) - n
        flat_of = np.concatenate(own) if own else np.zeros(0, np.int64)
        sizes = np.array([int(n[o].sum()) for o in own], np.int64)
        lost = [bool(self.lossy) and not self.lossy.isdisjoint(o.tolist()) for o in own]
        return ragged(flat, start[flat_of], n[flat_of]), sizes, lost


class ByteLevel(Pieces):
    """Tokenizer A."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        tok = Tokenizer.from_file(path)
        if tok.normalizer is not None:
            raise ValueError("vocabularies that normalise are not aligned by bytes")
        letters, self.model = byte_letters(), tok.model
        self.split, self.letters = by_tokenizers(tok), [c for _, c in sorted(letters.items())]
        back = {c: b for b, c in letters.items()}
        self.bytes = [b""] * tok.get_vocab_size()
        for s, i in tok.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()

    def encode(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, piece.encode())))]


class SentencePiece(Pieces):
    """Tokenizer B: no entry of its vocabulary has a space after something else, so nothing merges across such a place."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.whole = any(re.search(f"[^{MARK}]{MARK}", x) for x in names)
        self.lone = [i for i, x in enumerate(names) if x == MARK]
        self.bytes = [
            bytes([int(x[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else x.replace(MARK, " ").encode() for i, x in enumerate(names)
        ]
        pieces = re.compile(" +[^ ]*").findall
        self.split = (lambda text: [text]) if self.whole or not self.lone else pieces

    def encode(self, piece: str) -> list[int]:
        # the library puts the first space back, but not where nothing follows it
        return self.lone if piece == " " and self.lone else self.model.encode(piece[1:])


class Bits:
    """A packed bitset with rank."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def at(places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-size // 64) * 64, np.uint8)
        marks[places] = 1
        return Bits(np.packbits(marks, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def places(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        w = places >> 6
        below = (U(1) << (places & 63).astype(U)) - U(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)


class Aligned:
    """Links and groups of documents whose A and B tokens spell the same bytes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_bytes: np.ndarray, b_bytes: np.ndarray, doc_bytes: np.ndarray):
        a_end, b_end, doc_end = np.cumsum(a_bytes[a]), np.cumsum(b_bytes[b]), np.cumsum(doc_bytes)
        self.a, self.b, size = a, b, int(doc_end[-1]) if len(doc_end) else 0
        in_a, in_b = Bits.at(a_end - 1, size), Bits.at(b_end - 1, size)
        shared, either = in_a & in_b, in_a | in_b
        cut, self.links = shared.places(), either.places()
        # one past the last token of each group, and the tokens of each link
        self.a_to, self.b_to = in_a.rank(cut) + 1, in_b.rank(cut) + 1
        self.link_a, self.link_b = in_a.rank(self.links), in_b.rank(self.links)
        # a document ends at a cut
        self.doc_groups, self.doc_links = shared.rank(doc_end - 1) + 1, either.rank(doc_end - 1) + 1

    def spelled(self, names: np.ndarray, a_names: int, b_names: int) -> list[str]:
        """``a1,a2|b1;`` for each group, in pieces of one token each; names: A's ids before , and |, B's before , and ;."""
        a_n, b_n = np.diff(self.a_to, prepend=0), np.diff(self.b_to, prepend=0)
        out = np.empty(len(self.a) + len(self.b), np.int64)
        a_last, b_last = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        a_last[self.a_to - 1], b_last[self.b_to - 1] = True, True
        out[np.arange(len(self.a)) + np.repeat(self.b_to - b_n, a_n)] = self.a + a_last * a_names
        out[np.arange(len(self.b)) + np.repeat(self.a_to, b_n)] = self.b + b_last * b_names + 2 * a_names
        return names[out].tolist()


def _names(a: int, b: int) -> np.ndarray:
    return np.array([f"{i}{sep}" for n, seps in ((a, ",|"), (b, ",;")) for sep in seps for i in range(n)], object)


_MODELS: dict[tuple[str, str], tuple[ByteLevel, SentencePiece]] = {}


def _models(a_path: str, b_path: str) -> tuple[ByteLevel, SentencePiece]:
    """Both tokenizers, once for each worker."""
    if (a_path, b_path) not in _MODELS:
        _MODELS[a_path, b_path] = ByteLevel(a_path), SentencePiece(b_path)
    return _MODELS[a_path, b_path]


KIND = (
    "block long, pair long, n long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "places binary, times binary"
)
_NAMES = [x.split()[0] for x in KIND.split(", ")]
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_ARROW = [_TYPES[x.split()[1]] for x in KIND.split(", ")]


def _batch(rows: int, /, **cols) -> pa.RecordBatch:
    arrays = [pa.array(cols[k], t) if k in cols else pa.nulls(rows, t) for k, t in zip(_NAMES, _ARROW, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


class _Block:
    """Documents whose pairs are numbered together."""

    def __init__(self, number: int):
        self.number, self.size, self.pairs, self.slices = number, 0, 0, []

    def add(self, rows: list[tuple], keys: np.ndarray, counts: np.ndarray, places: list, times: list, size: int) -> None:
        self.slices.append((rows, keys, counts, places, times))
        self.size += size
        self.pairs += len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        keys, inverse = np.unique(np.concatenate([s[1] for s in self.slices]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([s[2] for s in self.slices]).astype(float), len(keys)).astype(np.int64)
        for i in range(0, len(keys), 100_000):
            own = keys[i : i + 100_000]
            yield _batch(len(own), block=np.full(len(own), self.number), pair=own, n=n[i : i + 100_000])
        at = 0
        for rows, own, _, places, times in self.slices:
            new = inverse[at : at + len(own)]
            at += len(own)
            cols = dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), zip(*rows, strict=True), strict=True))
            # ascending within a slice's pairs, and so in the block's
            spots = [pack(np.diff(new[p], prepend=0)) for p in places]
            yield _batch(len(rows), block=[self.number] * len(rows), places=spots, times=[pack(t) for t in times], **cols)


_EMPTY = np.zeros(0, np.int64)


def align(ids: list, whole: list[str], a: ByteLevel, b: SentencePiece, names: np.ndarray):
    """Of some documents: result rows, distinct pairs with their links, and for each document the pairs' indices and links."""
    a.begin()
    b.begin()
    own = [k for k, t in enumerate(whole) if t and MARK not in t]
    spaced = [" " + whole[k] for k in own]
    (ta, na, la), (tb, nb, lb) = a.tokens([a.split(t) for t in spaced]), b.tokens([b.split(t) for t in spaced])
    size = np.fromiter((len(t.encode()) for t in spaced), np.int64, len(spaced))
    if any(la) or any(lb):  # what doesn't spell its text has no tokens
        a_to, b_to = np.cumsum(na), np.cumsum(nb)
        spells = lambda m, t, to, n, k: b"".join([m.bytes[i] for i in t[to[k] - n[k] : to[k]].tolist()]) == spaced[k].encode()
        good = np.array([(not la[k] or spells(a, ta, a_to, na, k)) and (not lb[k] or spells(b, tb, b_to, nb, k)) for k in range(len(own))])
        ta, tb = ta[np.repeat(good, na)], tb[np.repeat(good, nb)]
        na, nb, size, own = na[good], nb[good], size[good], [k for k, g in zip(own, good.tolist(), strict=True) if g]
    rows: list = [(i, 0, 0, 0, 0, "") for i in ids]
    places, times = [_EMPTY] * len(ids), [_EMPTY] * len(ids)
    if not own:
        return rows, _EMPTY, _EMPTY, places, times
    lengths = [np.fromiter(map(len, m.bytes), np.int64, len(m.bytes)) for m in (a, b)]
    x = Aligned(ta, tb, *lengths, size)
    said = x.spelled(names, len(a.bytes), len(b.bytes))
    keys, inverse = np.unique((ta[x.link_a] << 32) | tb[x.link_b], return_inverse=True)
    n_groups, n_links = np.diff(x.doc_groups, prepend=0), np.diff(x.doc_links, prepend=0)
    doc = np.repeat(np.arange(len(own)), n_links)
    seen, times_seen = np.unique(doc * len(keys) + inverse, return_counts=True)
    to = np.searchsorted(seen, (np.arange(len(own)) + 1) * len(keys))
    at = before = 0
    for j, k in enumerate(own):
        n = int(na[j] + nb[j])
        digest = hashlib.sha256("".join(said[at : at + n])[:-1].encode()).hexdigest()
        at += n
        rows[k] = (ids[k], int(na[j]), int(nb[j]), int(n_groups[j]), int(n_links[j]), digest)
        places[k], times[k] = seen[before : to[j]] - j * len(keys), times_seen[before : to[j]]
        before = to[j]
    return rows, keys, np.bincount(inverse, minlength=len(keys)), places, times


def token_links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = _models(a_path, b_path)
        names, block = _names(len(a.bytes), len(b.bytes)), _Block(TaskContext.get().partitionId() << 24)
        for batch in batches:
            ids, whole = batch.column(0).to_pylist(), texts(batch).to_pylist()
            i = 0
            while i < len(ids):
                j, size = i, 0
                while j < len(ids) and (j == i or size + len(whole[j]) <= SLICE):
                    size += len(whole[j])
                    j += 1
                block.add(*align(ids[i:j], whole[i:j], a, b, names), size)
                i = j
                if block.size >= BLOCK or block.pairs >= BLOCK_PAIRS:
                    yield from block.rows()
                    block = _Block(block.number + 1)
        if block.slices:
            yield from block.rows()

    def assemble(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        """Of one block: sums of its documents over its pairs, which are numbered in order."""
        order = np.argsort(pairs.column("pair").to_numpy())
        count, best = (pairs.column(k).to_numpy()[order].astype(np.int64) for k in ("count", "best"))
        sums: list[list[int]] = [[], []]
        for p, t in zip(rows.column("places").to_pylist(), rows.column("times").to_pylist(), strict=True):
            at, times = np.cumsum(unpack(p)), unpack(t)
            sums[0].append(int(times @ best[at]))
            sums[1].append(int(times @ count[at]))
        cols = [rows.column(k) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*cols, *(pa.array(s, pa.int64()) for s in sums), rows.column("groups_sha256")], names=out)

    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    ship(spark)
    bounded_batches(spark)
    table = stored(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), encode, KIND), "links")
    pairs = table.where("pair is not null").select("block", "pair", "n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    known = counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).cast("int").alias("best"))
    back = pairs.select("block", "pair").join(known, "pair").groupBy("block")
    rows = table.where("pair is null").drop("pair", "n").withColumnRenamed("block", "own").groupBy("own")
    kind = ", ".join(f"{k} {'string' if k == 'groups_sha256' else 'long'}" for k in out)
    return rows.cogroup(back).applyInArrow(assemble, kind)
