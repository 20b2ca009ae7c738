"""Exact, fast use of a public byte-level BPE vocabulary.

The tokenizers library encodes each distinct pre-token once; texts are then put together from a bounded
memo. Texts in which the library might split in another way than the pattern below (characters beyond
U+024F, strings of special tokens) go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters, numbers and white space among the code points up to U+024F (fixed values).
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼½¾"
SPACE = "\\t-\\r \\x85\\xa0"
FAR = re.compile("[^\x00-ɏ]")


def _pre_tokens(letter: str, number: str, space: str) -> re.Pattern:
    """The pre-token pattern of the byte-level vocabularies over those classes; runs of one class are never given back."""
    return re.compile(f" ?[{letter}]++| ?[{number}]++|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]++|[{space}]+(?![^{space}])|[{space}]+")


BYTE_LEVEL, ASCII = _pre_tokens(LETTER, NUMBER, SPACE), _pre_tokens("A-Za-z", "0-9", "\\t-\\r ")
#: Memo entries; beyond that the memo starts anew, so that memory stays bounded.
MEMO = 400_000


def byte_alphabet() -> dict[int, str]:
    """The visible character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Memo(dict):
    """Ids of pre-tokens as bytes, made by the library's model where they are missing; starts anew when full."""

    def __init__(self, tokenize, kind: str):
        self.tokenize, self.kind, self.alphabet = tokenize, kind, byte_alphabet()

    def __missing__(self, word: str) -> bytes:
        # of printable ASCII only the space is written otherwise
        shown = word.replace(" ", self.alphabet[32]) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.tokenize(shown)]
        raw = array(self.kind, ids).tobytes()
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 256:
            self[word] = raw
        return raw


class ByteLevelEncoder:
    """Ids of whole texts as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, dtype: str = "<u4"):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.dtype, self.memo = dtype, _Memo(self.tokenizer.model.tokenize, {"<u2": "H", "<u4": "I"}[dtype])

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Encodes a small batch; the order is kept."""
        get, split = self.memo.__getitem__, {True: ASCII.findall, False: BYTE_LEVEL.findall}
        whole = [not t.isascii() and FAR.search(t) or self.special and self.special.search(t) for t in texts]
        far = [t for t, w in zip(texts, whole) if w]
        got = iter(self._library(far) if far else [])
        return [next(got) if w else b"".join(map(get, split[t.isascii()](t))) for t, w in zip(texts, whole)]


_encoders: dict[tuple[str, str], ByteLevelEncoder] = {}


def encoder(path: str, dtype: str = "<u4") -> ByteLevelEncoder:
    """The encoder of this worker process, its memo empty: what a task remembers goes with it."""
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = ByteLevelEncoder(path, dtype)
    got = _encoders[path, dtype]
    got.memo.clear()
    return got


def in_batches(values: list, step: int = 64, most: int = 1 << 18):
    """Slices of at most ``step`` texts, and about ``most`` characters."""
    at = 0
    while at < len(values):
        end, size = at, 0
        while end < len(values) and end - at < step and size < most:
            size += len(values[end])
            end += 1
        yield at, end
        at = end
