"""Encoding with the tokenizers library, each distinct pre-token once.

Both vocabularies' pre-tokens are encoded independently of each other, so a text's ids are those of its
pre-tokens, one after another. Texts within Latin-1 are split here as the library splits them, many at once
on arrays; of other texts, and of those that may hold a special token, the library gets chunks cut where white space follows
other characters.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np

from . import textkit
from .bpe import CHUNKS, LATIN_PRETOKENS, LATIN_SPACE, LETTERS, NUMBERS, REMEMBERED, Remembered, pieces_of, within_latin1

#: Pre-tokens of the vocabulary that drops white space and case.
LATIN_WORDS = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{LATIN_SPACE}{LETTERS}{NUMBERS}]+")
_SPECIAL = "<|"
#: Text whose pre-tokens are told apart at once, in some 20 bytes of memory a byte.
SLICE_BYTES = 4 << 20
_BLANK, _LETTER, _NUMBER, _OTHER, _NONE = range(5)
_KINDS = np.full(256, _OTHER, np.uint8)
for _kind, _signs in ((_BLANK, LATIN_SPACE), (_LETTER, LETTERS), (_NUMBER, NUMBERS)):
    _KINDS[[k for k in range(256) if re.match(f"[{_signs}]", chr(k))]] = _kind


def pretokens(buf: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of texts in Latin-1, one byte a character, and each text's first one.

    They are those of LATIN_WORDS for texts in lower case, or else of LATIN_PRETOKENS, which keeps white space: a
    blank goes with what follows it, and of a longer run all but the last character stand alone.
    """
    n, texts = len(buf), offsets[:-1][np.diff(offsets) > 0]
    kind = _KINDS[buf]
    before = np.full(n, _NONE, np.uint8)
    before[1:] = kind[:-1]
    before[texts] = _NONE
    start = kind != before
    if words:
        start |= kind == _NUMBER
    runs = np.flatnonzero((kind != _BLANK) & (kind != before))
    quotes = runs
    if not words:
        spaced = runs[before[runs] == _BLANK]
        start[spaced - 1] = True
        joined = spaced[buf[spaced - 1] == 32]
        start[joined] = False
        quotes = np.setdiff1d(runs, joined, assume_unique=True)
    # 's, 't, 'm, 'd, 're, 've and 'll where a pre-token begins
    quotes = quotes[buf[quotes] == 39]
    if len(quotes):
        room = np.append(texts, n)[np.searchsorted(texts, quotes, side="right")] - quotes
        padded = np.append(buf, np.zeros(2, np.uint8))
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = (room > 1) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (room > 2) & (((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108)))
        start[quotes[short | long] + 1] = False
        for found, size in ((short, 2), (long, 3)):
            after = quotes[found & (room > size)] + size
            start[after] |= kind[after] == _LETTER
    at = np.flatnonzero(start)
    end = np.append(at[1:], n)
    if words:
        kept = kind[at] != _BLANK
        at, end = at[kept], end[kept]
    return at, end, np.searchsorted(at, offsets)


_BEFORE_SPACE = re.compile(f"(?<=[^{LATIN_SPACE}])[{LATIN_SPACE}]")


def _stretches(text: str) -> Iterator[str]:
    """A text, cut into stretches of about SLICE_BYTES if it is longer, where white space follows other characters: a pre-token ends there."""
    at = 0
    while len(text) - at > SLICE_BYTES and (found := _BEFORE_SPACE.search(text, at + SLICE_BYTES)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class ChunkEncoder:
    """words: the vocabulary drops white space and case. remembered: bytes of pre-tokens, see bpe.Remembered."""

    def __init__(self, path: str, words: bool = False, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokens = self._tokenizer.model.tokenize
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._alphabet = {c: as_bytes(chr(c))[0][0] for c in range(256)}
        self._blank = self._alphabet[32]
        self._pretokens = Remembered(self._pretoken, remembered)
        self._chunks = Remembered(self._chunk, remembered // 8)
        self._words = words

    def _pretoken(self, piece: bytes) -> bytes:
        """Ids of a pre-token in Latin-1, in lower case if case is dropped: the model's merges are all that is left to do."""
        text = piece.decode("latin-1")
        plain = text.isascii() and text.isprintable()
        spelled = text.replace(" ", self._blank) if plain else text.translate(self._alphabet)
        return array("I", [t.id for t in self._tokens(spelled)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return array("I", self._tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids as little-endian unsigned 32-bit integers; works on about SLICE_BYTES at a time."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[bytes] = []
        places: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not within_latin1(text) or _SPECIAL in text:
                out[i].append(np.frombuffer(b"".join(map(self._chunks.__getitem__, pieces_of(CHUNKS, text))), "<u4"))
                continue
            for piece in _stretches(text):
                held.append((piece.lower() if self._words else piece).encode("latin-1"))
                places.append(i)
                size += len(held[-1])
                if size >= SLICE_BYTES:
                    self._encode_latin(held, places, out)
                    held, places, size = [], [], 0
        if held:
            self._encode_latin(held, places, out)
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, "<u4") for x in out]

    def _encode_latin(self, texts: list[bytes], places: list[int], out: list[list[np.ndarray]]) -> None:
        data = b"".join(texts)
        if not data:
            return
        buf = np.frombuffer(data, np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        start, end, first = pretokens(buf, offsets, self._words)
        which, lead = textkit.Bytes(buf).groups(start, end)
        ids = list(map(self._pretokens.__getitem__, [data[a:b] for a, b in zip(start[lead].tolist(), end[lead].tolist(), strict=True)]))
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4")
        count = sizes[which]
        total = np.concatenate([[0], np.cumsum(count)])
        every = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - total[:-1], count) + np.arange(total[-1])]
        bounds = total[first]
        for i, a, b in zip(places, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i].append(every[a:b])


@cache
def chunk_encoder(path: str, words: bool = False, remembered: int = REMEMBERED) -> ChunkEncoder:
    """One a worker."""
    return ChunkEncoder(path, words, remembered)
