"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring characters that occurs inside no token of the vocabulary can never be merged over, so
each pre-token is cut there for certain. The fragments are encoded independently and concatenated; only the
last one of a pre-token carries the end-of-word suffix. White space is such a boundary for every token, so whole
chunks between white space are remembered in a bounded memo.

Defined results: a null text is empty (no ids, empty decoding); repeated rows give equal rows; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import in_batches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of each memo; beyond that it starts anew, so that memory stays bounded.
MEMO = 400_000


class ForcedBoundaryBPE:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        self.printable = _printable_words(config)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        added = self.library.get_added_tokens_decoder()
        self.text = {i: t for t, i in self.ids.items()} | {i: t.content for i, t in added.items()}
        self.spelled = {i: (b"%d " % i, t.encode() + b" ") for i, t in self.text.items()}
        self.special = re.compile("(" + "|".join(re.escape(t.content) for t in added.values()) + ")") if added else None
        self.special_ids = {t.content: i for i, t in added.items()}
        self.inside = set()
        for token in self.ids:
            plain = token.removesuffix(self.suffix) if self.suffix else token
            self.inside.update(plain[k : k + 2] for k in range(len(plain) - 1))
        # the model's merges, for fragments that end their word and for others; own merges where a character is unknown
        self.ending, self.inner = self.library.model, BPE(self.ids, [tuple(m) for m in self.ranks])
        self.known_inner = {t for t in self.ids if len(t) == 1}
        self.known_last = {t.removesuffix(self.suffix) for t in self.ids if t.endswith(self.suffix) and len(t) == 1 + len(self.suffix)}
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.decimal: dict[bytes, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}

    def fragments(self, word: str) -> list[str]:
        """Pieces of a pre-token between certain cuts."""
        if self.inside.issuperset(map(add, word, word[1:])):
            return [word]
        out, start = [], 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in self.inside:
                out.append(word[start:k])
                start = k
        out.append(word[start:])
        return out

    def merge(self, symbols: list[str]) -> list[int]:
        """Merges by rank, leftmost first, with a heap over a linked list: n log n at any length."""
        n = len(symbols)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = []

        def push(i: int) -> None:
            j = right[i]
            if j < n and (rank := self.ranks.get((symbols[i], symbols[j]))) is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i] = a + b
            alive[j] = False
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            if left[i] >= 0:
                push(left[i])
            push(i)
        return [self.ids[s] for s, live in zip(symbols, alive) if live and s in self.ids]

    def _piece(self, piece: str, last: bool) -> list[int]:
        """Ids of one fragment."""
        if self.known_inner.issuperset(piece[:-1]) and piece[-1] in (self.known_last if last else self.known_inner):
            return [t.id for t in (self.ending if last else self.inner).tokenize(piece)]
        return self.merge([*piece[:-1], piece[-1] + self.suffix * last])

    def _word(self, word: str) -> tuple[bytes, bytes]:
        """Decimal ids and tokens of a pre-token, each followed by one space."""
        got = self.words.get(word)
        if got is None:
            pieces = self.fragments(word)
            ids = [i for piece in pieces[:-1] for i in self._piece(piece, False)] + self._piece(pieces[-1], True)
            got = self._spell(ids)
            if len(word) <= 256:
                if len(self.words) >= MEMO:
                    self.words.clear()
                self.words[word] = got
        return got

    def _spell(self, ids: list[int]) -> tuple[bytes, bytes]:
        if len(ids) == 1:
            return self.spelled[ids[0]]
        parts = [self.spelled[i] for i in ids]
        return b"".join([d for d, _ in parts]), b"".join([t for _, t in parts])

    def _normal(self, text: str) -> str:
        return self.library.normalizer.normalize_str(text) if self.library.normalizer else text

    def _joined(self, got: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
        return got[0] if len(got) == 1 else (b"".join([d for d, _ in got]), b"".join([t for _, t in got]))

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """The same for a run between white space."""
        got: list[tuple[bytes, bytes]] = []
        for part in self.special.split(chunk) if self.special else [chunk]:
            if part in self.special_ids:
                got.append(self._spell([self.special_ids[part]]))
            elif part:
                got += [self._word(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self._normal(part)) if w]
        return self._joined(got)

    def _line(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """The same for many, normalised and cut into words as one line, as white space always parts words."""
        line = self._normal(" ".join(chunks))
        parts = line.split(" ")
        if len(parts) != len(chunks) or self.special and self.special.search(line):
            return list(map(self._chunk, chunks))
        out, at, end = [[] for _ in chunks], 0, len(parts[0])
        for word, (a, _) in self.library.pre_tokenizer.pre_tokenize_str(line):
            while a > end:
                at += 1
                end += 1 + len(parts[at])
            if word:
                out[at].append(self._word(word))
        return list(map(self._joined, out))

    def _learn(self, chunks: list[str]) -> None:
        plain, other = [], []
        for c in chunks:
            (plain if self.printable and c.isascii() and c.isprintable() and not (self.special and self.special.search(c)) else other).append(c)
        for c in plain:
            self.decimal[c.encode()], self.decoded[c.encode()] = self._joined(list(map(self._word, self.printable.findall(c.lower()))))
        for at in range(0, len(other), 256):
            for c, (d, t) in zip(other[at : at + 256], self._line(other[at : at + 256])):
                self.decimal[c.encode()], self.decoded[c.encode()] = d, t

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids in decimal and its decoding by the library's rule for a vocabulary without a decoder,
        both joined by one space."""
        split, decimal, decoded = [t.encode().split() for t in texts], self.decimal, self.decoded
        new = {c for p in split for c in p if c not in decimal}
        if len(decimal) + len(new) > MEMO:
            decimal.clear()
            decoded.clear()
            new = {c for p in split for c in p}
        self._learn([c.decode() for c in new])
        ids, text = decimal.__getitem__, decoded.__getitem__
        out = [(b"".join(map(ids, p))[:-1], b"".join(map(text, p))[:-1]) for p in split]
        for c in new:
            if len(c) > 256:
                del decimal[c], decoded[c]
        return out


def _printable_words(config: dict) -> re.Pattern | None:
    """The pre-token pattern over lower-cased printable ASCII, where the file's normaliser and pattern are of the kind
    that such characters pass unchanged but for their case; else None, and the library cuts all texts."""
    normal = (config.get("normalizer") or {}).get("normalizers", [])
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [n["type"] for n in normal] != ["NFC", "Replace", "Lowercase"] or normal[1]["pattern"] != {"Regex": "\\s+"}:
        return None
    if [p["type"] for p in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
        return None
    return re.compile(steps[0]["pattern"]["Regex"].replace("\\p{L}", "A-Za-z").replace("\\p{N}", "0-9"))


_codecs: dict[str, ForcedBoundaryBPE] = {}


def codec(path: str) -> ForcedBoundaryBPE:
    """The codec of this worker process, with what it remembers from its earlier tasks."""
    if path not in _codecs:
        _codecs[path] = ForcedBoundaryBPE(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, ids_text, decoded) of every document."""
    return _map(docs, tokenizer, id_col, text_col, False)


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as above, with texts reduced in the same pass."""
    return _map(docs, tokenizer, id_col, text_col, True)


def _map(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    def run(batches):
        bpe = codec(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_batches(texts, 256, 1 << 20):
                rows = bpe.encode(texts[a:b])
                if digest:
                    n = [i.count(b" ") + 1 if i else 0 for i, _ in rows]
                    sha = lambda raw: hashlib.sha256(raw).hexdigest()
                    cols = [pa.array(n, pa.int64()), pa.array([sha(i) for i, _ in rows], pa.string()), pa.array([sha(d) for _, d in rows], pa.string())]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    cols = [pa.array([list(map(int, i.split())) for i, _ in rows], pa.list_(pa.int32())), pa.array([i.decode() for i, _ in rows], pa.string()), pa.array([d.decode() for _, d in rows], pa.string())]
                    names = ["doc_id", "ids", "ids_text", "decoded"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols], names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, ids_text string, decoded string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)
