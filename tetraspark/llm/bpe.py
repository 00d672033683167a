"""Byte-level BPE by prefix dynamic programming (operator 2).

For every prefix of a pre-token exactly one token can be the last of the prefix's BPE encoding. PrefixTable
stores it, so appending costs only the new bytes, and an edit only what follows it in its pre-token.
A token may follow another if re-merging the two by rank gives the same two back; that needs the pair
table only, no merging of the text. Pre-tokens are independent of each other.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cache
from sys import getsizeof

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import tidy

#: Unicode White_Space, as the pattern's \s means it for tiktoken.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space and the run after it. Every boundary between such chunks is one of the pattern's.
CHUNKS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Letters, numbers and white space of Latin-1, for which the standard library's expressions do.
LETTERS, NUMBERS, LATIN_SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
#: The pattern that LATIN_PRETOKENS stands for on texts within Latin-1.
COMMON_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN_PRETOKENS = re.compile(f" ?[{LETTERS}]+| ?[{NUMBERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{LATIN_SPACE}{LETTERS}{NUMBERS}]+|[{LATIN_SPACE}]+(?![^{LATIN_SPACE}])|[{LATIN_SPACE}]+")
#: Bytes of memory for pre-tokens that a worker has met, and as many for those met longer ago.
REMEMBERED = 80 << 20
#: Characters from which on a text's pre-tokens aren't listed all at once.
LONG = 1 << 20


class Remembered(dict):
    """A dict that makes missing values by a function, and holds at most 2 * limit bytes of keys and values.

    Once it is full, what it holds counts as old, and is dropped when it is full again, but for what was asked
    for in between. What takes a noticeable part of the limit isn't held.
    """

    def __init__(self, make, limit: int = REMEMBERED):
        super().__init__()
        self._make, self._limit, self._used, self._old = make, limit, 0, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        size = getsizeof(key) + getsizeof(value) + 100
        if size * 256 > self._limit:
            return value
        if self._used + size > self._limit:
            self._old = dict(self)
            self.clear()
            self._used = 0
        self[key] = value
        self._used += size
        return value


def within_latin1(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pieces_of(pattern, text: str):
    """All matches, those of a long text one at a time."""
    return pattern.findall(text) if len(text) < LONG else (m.group() for m in pattern.finditer(text))


class Vocabulary:
    """Ranks with, for each token, the two tokens whose merge made it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.left, self.right = list(range(len(self.tokens))), list(range(len(self.tokens)))
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and len(parts := self.merged(token, rank)) == 2:
                self.left[rank], self.right[rank] = parts
                self.pairs[parts[0], parts[1]] = rank
        #: Tokens that the merges never make, though they have a rank.
        self.unreachable = {r for t, r in ranks.items() if len(t) > 1 and self.left[r] == r}
        self.follows = Remembered(self._follows, REMEMBERED // 4)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merged(self, data: bytes, below: int) -> list[int]:
        """Plain merging by lowest rank, with ranks under `below` only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1], below)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                return [self.ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, pair: tuple[int, int]) -> bool:
        """Whether the second token can stand after the first.

        Goes back through the merges at the seam, latest first; a pair there that would have merged
        earlier than what took its place shows that it can't.
        """
        a, b = pair
        before = len(self.tokens)
        while True:
            if (made := self.pairs.get((a, b))) is not None and made < before:
                return False
            if a > b and self.right[a] != a:
                before, a = a, self.right[a]
            elif self.left[b] != b:
                before, b = b + 1, self.left[b]
            elif self.right[a] != a:
                before, a = a, self.right[a]
            else:
                return True


class PrefixTable:
    """The last token of every prefix of one pre-token."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self._v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        v, done = self._v, len(self.last)
        self.data += more
        data, last, ranks, follows = self.data, self.last, v.ranks, v.follows
        for end in range(done + 1, len(data) + 1):
            for start in range(max(0, end - v.longest), end):
                token = ranks.get(data[start:end])
                if token is None or token in v.unreachable:
                    continue
                if start == 0 or follows[last[start - 1], token]:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def replace(self, start: int, stop: int, by: bytes) -> None:
        """Puts `by` in place of bytes start to stop; the prefixes before it are kept."""
        tail = by + self.data[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(tail)

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self._v.tokens[out[-1]])
        return out[::-1]


class Codec:
    """Encoding and decoding of texts with a vocabulary and a pre-token pattern."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        space = f"[{SPACE}]"
        self.vocabulary = vocabulary
        self.pattern = regex.compile(pattern.replace(r"\s+(?!\S)", rf"{space}+(?![^{SPACE}])").replace(r"[^\s", f"[^{SPACE}").replace(r"\s", space))
        self._pretokens = Remembered(lambda s: struct.pack(f"<{len(i := PrefixTable(vocabulary, s.encode()).ids())}I", *i))
        self._latin = LATIN_PRETOKENS if pattern == COMMON_PATTERN else None

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        fast = self._latin is not None and within_latin1(text)
        return b"".join(map(self._pretokens.__getitem__, pieces_of(self._latin if fast else self.pattern, text)))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids.tolist()))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One a worker."""
    return Codec(Vocabulary.load(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for each row; a null or empty text has no ids.

    Repeated rows and equal ids are encoded row by row; other columns are left out, whatever their names.
    """

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf["key"], "ids": [c.encode(t or "").astype(np.int32) for t in pdf["text"]]})

    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, data binary) from (id_col, ids); null ids give empty bytes."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf["key"], "data": [b"" if x is None else c.decode(np.asarray(x)) for x in pdf["ids"]]})

    rows = encoded.select(F.col(id_col).alias("key"), "ids")
    return rows.mapInPandas(run, T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("data", T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encodes each text, then decodes the ids; in one pass, so no ids move."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for pdf in batches:
            n, ids_sha, text_sha = [], [], []
            for text in pdf["text"]:
                data = c.encode_bytes(text or "")
                n.append(len(data) // 4)
                ids_sha.append(hashlib.sha256(data).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(np.frombuffer(data, "<u4"))).hexdigest())
            yield pd.DataFrame({id_col: pdf["key"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType
    return rows.mapInPandas(run, T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
