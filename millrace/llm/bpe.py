"""Byte-level BPE: a segment tree over the ranks of adjacent pairs gives the leftmost lowest-rank merge."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm._common import _memos, arrow_map, id_type, pick, vocabulary

#: The pre-tokenizer's pattern, and the white space of Unicode.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: Pieces of text in each of the two generations that a worker remembers; spans and words of the encoder.
MEMO, SPANS, PIECES = 300_000, 200_000, 70_000
NONE = 1 << 62
POS = 32


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Memo(dict):
    """A dictionary that computes what it lacks. When it is full it becomes the old generation; what is asked for again comes back from there."""

    def __init__(self, make, most: int = MEMO):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out

    def empty(self) -> None:
        self.clear()
        self.old = {}


class BytePairs:
    """Encodes and decodes as the vocabulary file's model does; special tokens in a text are found first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        value = {c: i for i, c in enumerate(symbols)}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(value[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.first = [vocab[c] for c in symbols]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[a] << 32 | vocab[b], r)
            self.made.append(vocab[a + b])
        self.words = regex.compile(WORDS).findall
        self.ascii = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+").findall
        self.wide = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = Memo(self._piece, PIECES)
        self.spans = Memo(self._span, SPANS)
        _memos.extend([self.pieces.empty, self.spans.empty])

    def merge(self, ids: list[int]) -> list[int]:
        """Merges until no pair has a rank. A leaf of the tree is a pair's ``rank << POS | position``, so the root is the leftmost lowest-rank pair."""
        n, rank, made = len(ids), self.rank, self.made
        if n < 2:
            return ids
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            r = rank.get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                tree[size + i] = r << POS | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, key: int) -> None:
            i += size
            if tree[i] == key:
                return
            tree[i] = key
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    return
                tree[i] = low

        while (root := tree[1]) != NONE:
            i = root & ((1 << POS) - 1)
            j = following[i]
            k = following[j]
            ids[i], ids[j] = made[root >> POS], -1
            following[i] = k
            if j < n - 1:
                put(j, NONE)
            if k < n:
                previous[k] = i
                r = rank.get(ids[i] << 32 | ids[k])
                put(i, NONE if r is None else r << POS | i)
            else:
                put(i, NONE)
            h = previous[i]
            if h >= 0:
                r = rank.get(ids[h] << 32 | ids[i])
                put(h, NONE if r is None else r << POS | h)
        return [x for x in ids if x >= 0]

    def _piece(self, word: str) -> bytes:
        first = self.first
        return np.array(self.merge([first[b] for b in word.encode()]), "<u4").tobytes()

    def _span(self, span: str) -> bytes:
        """White space with the word after it: no match of the pattern reaches over its borders. What is one piece as a whole isn't remembered twice."""
        words, known = self.words(span), self.spans
        if len(words) == 1:
            return self.pieces.get(span) or self._piece(span)
        return b"".join([known.get(w) or self.pieces[w] for w in words])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.spans.__getitem__, self.ascii(text) if text.isascii() else self.wide(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.specials is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if i % 2 else self._plain(x) for i, x in enumerate(self.specials.split(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def pairs(path: str) -> BytePairs:
    """One encoder for each worker process and file."""
    return BytePairs(path)


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) of every row's whole text; no shuffle.

    Null or empty text: no ids. Null ids and repeated rows stay as they are; other columns don't matter.
    """
    path = path or vocabulary("byte_bpe_50k.json")

    def make():
        encode = pairs(path).encode

        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [encode(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

        return part

    return arrow_map(pick(df, id_col, text_col), make, f"doc_id {id_type(df, id_col)}, n_tokens long, ids binary", "text", memos=True)


def bpe_decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded`` to the columns doc_id, n_tokens and ids of ``bpe_encode``; bytes that aren't UTF-8 become U+FFFD. Null ids: empty."""
    path = path or vocabulary("byte_bpe_50k.json")

    def make():
        decode = pairs(path).decode

        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([decode(x or b"") for x in batch.column("ids").to_pylist()], pa.string())], [*batch.schema.names, "decoded"])

        return part

    df = df.select("doc_id", "n_tokens", "ids")
    return arrow_map(df, make, f"doc_id {id_type(df, 'doc_id')}, n_tokens long, ids binary, decoded string", "ids", memos=True)


def bpe_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``bpe_decode(bpe_encode(df))`` in one pass, which needs half as many workers: doc_id, n_tokens, ids, decoded."""
    path = path or vocabulary("byte_bpe_50k.json")

    def make():
        p = pairs(path)

        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [p.encode(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([p.decode(x) for x in ids], pa.string())]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids", "decoded"])

        return part

    return arrow_map(pick(df, id_col, text_col), make, f"doc_id {id_type(df, id_col)}, n_tokens long, ids binary, decoded string", "text", memos=True)
