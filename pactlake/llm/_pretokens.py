"""Splitting text into pre-tokens exactly as the tokenizer libraries do.

Below U+0530 the letter and number classes of every library agree, so a
compiled ``re`` pattern of explicit ranges serves nearly all texts. For other
texts the classes are asked of the library itself, once per worker, since the
libraries carry different Unicode versions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

AGREED = 0x530
_OTHER = re.compile("[԰-\U0010ffff]")
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def ranges(points: Iterable[int]) -> str:
    """The body of a character class."""
    out, start, last = [], None, None
    for c in sorted(points):
        if last is None or c != last + 1:
            if start is not None:
                out.append((start, last))
            start = c
        last = c
    if start is not None:
        out.append((start, last))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def splitter(letters: str, numbers: str) -> re.Pattern:
    """The public pattern with its classes spelled out."""
    return re.compile(
        f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{_SPACE}{letters}{numbers}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


@lru_cache(maxsize=1)
def agreed_splitter() -> re.Pattern:
    kind = {c: unicodedata.category(chr(c))[0] for c in range(AGREED)}
    return splitter(*(ranges(c for c, k in kind.items() if k == want) for want in "LN"))


class PreTokens:
    """Pre-tokens of a text; ``classify(code point)`` gives the library's 'L', 'N' or ''."""

    def __init__(self, classify: Callable[[int], str]):
        self.classify, self.fast, self.full = classify, agreed_splitter().findall, None

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not _OTHER.search(text):
            return self.fast(text)
        if self.full is None:
            kind = {c: self.classify(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000}
            self.full = splitter(*(ranges(c for c, k in kind.items() if k == want) for want in "LN")).findall
        return self.full(text)


def by_tokenizers(tokenizer) -> PreTokens:
    """Classes as the ``tokenizers`` library's own byte-level splitter has them."""
    split = tokenizer.pre_tokenizer.pre_tokenize_str

    def classify(c: int) -> str:
        # A letter joins an "a" before it, a number joins a "1", anything else neither.
        if len(split("a" + chr(c))) == 1:
            return "L"
        return "N" if len(split("1" + chr(c))) == 1 else ""

    return PreTokens(classify)


def by_tiktoken() -> PreTokens:
    """Classes as ``tiktoken``'s regular expressions have them."""
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)}
    has = [
        (k, tiktoken.Encoding(f"class {k}", pat_str=rf"\p{{{k}}}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary) for k in "LN"
    ]

    def classify(c: int) -> str:
        return next((k for k, f in has if f(chr(c))), "")

    return PreTokens(classify)
