"""Token counts with the whole-token shortcut.

Offline, once per vocabulary: for every vocabulary string the merges are run on
its own bytes, and the strings that come out as that single token, and that the
pre-tokenizer leaves in one piece, are *proven*. Counting then costs one
dictionary look-up for a pre-token among the proven; only the others are merged,
each once per worker while a bounded cache holds it.

Null text counts as empty; empty texts have no tokens. Special strings inside a
text are one token each, as the library has it by default. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_arrow, texts
from ._pretokens import by_tokenizers

#: Pre-tokens kept with their counts; then the cache starts anew.
CACHE = 400_000
#: Longer pre-tokens aren't cached.
CACHED_CHARS = 64


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + k)
    return letters


def prove_whole_tokens(vocabulary: str) -> frozenset[str]:
    """Strings that are a pre-token and encode alone as one token."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary)
    split, model = tok.pre_tokenizer.pre_tokenize_str, tok.model
    back = {c: b for b, c in byte_letters().items()}
    proven = []
    for s in tok.get_vocab(with_added_tokens=False):
        if any(c not in back for c in s):
            continue
        try:
            piece = bytes(back[c] for c in s).decode()
        except UnicodeDecodeError:
            continue  # part of a character: never a pre-token
        if len(model.tokenize(s)) == 1 and len(split(piece)) == 1:
            proven.append(piece)
    return frozenset(proven)


class TokenCounter(dict):
    """Tokens of each pre-token; starts from the proven, merges what is missing."""

    def __init__(self, vocabulary: str, proven: frozenset[str]):
        from tokenizers import Tokenizer

        super().__init__(dict.fromkeys(proven, 1))
        tok = Tokenizer.from_file(vocabulary)
        self.model, self.split, self.proven = tok.model, by_tokenizers(tok), proven
        self.letters = [c for _, c in sorted(byte_letters().items())]
        if tok.normalizer is not None or any(t.lstrip or t.rstrip or t.single_word for t in tok.get_added_tokens_decoder().values()):
            raise ValueError("vocabularies that normalise, or whose added tokens strip or ask for words, are counted otherwise")
        added = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize("".join(map(self.letters.__getitem__, piece.encode()))))
        if len(piece) <= CACHED_CHARS:
            if len(self) > CACHE + len(self.proven):
                self.clear()
                self.update(dict.fromkeys(self.proven, 1))
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.split(p))) for p in parts)


_COUNTERS: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""
    # at most one entry for each vocabulary string, so small whatever the input
    proven = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _COUNTERS:
            _COUNTERS[vocabulary] = TokenCounter(vocabulary, proven.value)
        counter = _COUNTERS[vocabulary]
        for batch in batches:
            col = texts(batch)
            n = [counter.count(t) for t in col.to_pylist()]
            size = pa.compute.binary_length(col).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    import pyarrow.compute  # noqa: F401

    return map_arrow(
        docs.select(F.col("doc_id").cast("long"), "text"), count,
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
