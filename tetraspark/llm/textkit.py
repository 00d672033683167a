"""Vectorised word and shingle hashing over Arrow text columns, and exact naming of words.

A word's hash mixes its bytes eight at a time (long words: xxh3 of them), so nothing algebraic makes different
words agree. Hashes only choose candidates; where a result hangs on equality, exact_sets() compares bytes.
Nothing loops over short words. Working memory is about 20 bytes for each byte of a slice; a slice holds
SLICE_BYTES, or one text if that is longer, which is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
SLICE_BYTES = 1 << 20
#: Bytes up to which words are hashed and compared eight bytes at a time.
SHORT = 64
STEP = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 64, dtype=np.uint64) | U64(1)
_MIX = (U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
#: _LOW[n]: the n low bytes of eight.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: The white space of `[^\x20\x09-\x0D]+` words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * _MIX[0]
    x = x ^ (x >> U64(29))
    x = x * _MIX[1]
    return x ^ (x >> U64(32))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (one more entry at the end)."""
    inside = ~IS_SPACE[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(buf))]
    before[cut], after[cut - 1] = False, False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, offsets)


class Bytes:
    """A buffer whose ranges are hashed and compared eight bytes at a time."""

    def __init__(self, buf: np.ndarray, lower: bool = False):
        self.size = len(buf)
        self.buf = np.zeros(len(buf) + 8, np.uint8)
        np.take(_LOWER, buf, out=self.buf[: len(buf)]) if lower else np.copyto(self.buf[: len(buf)], buf)
        #: The eight bytes from each place on.
        self.eights = np.ndarray(len(buf) + 1, "<u8", self.buf.data, 0, (1,))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each range of bytes."""
        size = end - start
        out = mix(size.astype(np.uint64) * STEP[63])
        at = np.flatnonzero(size <= SHORT)
        for j in range(0, SHORT, 8):
            if j:
                at = at[size[at] > j]
            if not len(at):
                break
            chunk = self.eights[start[at] + j] & _LOW[np.minimum(size[at] - j, 8)]
            out[at] = mix((out[at] + STEP[j // 8]) ^ mix(chunk + STEP[16 + j // 8]))
        for i in np.flatnonzero(size > SHORT):
            out[i] = xxhash.xxh3_64_intdigest(self.buf[start[i] : end[i]])
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the `size` bytes from a and from b on are the same."""
        ok = np.ones(len(size), bool)
        at, j = np.flatnonzero((size <= 256) & (size > 0)), 0
        while len(at):
            same = (self.eights[a[at] + j] ^ self.eights[b[at] + j]) & _LOW[np.minimum(size[at] - j, 8)] == 0
            ok[at[~same]] = False
            j += 8
            at = at[same & (size[at] > j)]
        for i in np.flatnonzero(size > 256):
            ok[i] = bool((self.buf[a[i] : a[i] + size[i]] == self.buf[b[i] : b[i] + size[i]]).all())
        return ok

    def groups(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers from 0 on that ranges share if, and only if, their bytes are the same; and of each number the index of one range."""
        hashes, size = self.hashes(start, end), end - start
        order = np.argsort(hashes)
        same = hashes[order[1:]] == hashes[order[:-1]]
        a, b = order[:-1][same], order[1:][same]
        which = np.empty(len(order), np.int64)
        if (size[a] != size[b]).any() or not self.equal(start[a], start[b], size[a]).all():
            seen: dict[bytes, int] = {}  # different bytes of one hash
            which[:] = [seen.setdefault(self.buf[x:y].tobytes(), len(seen)) for x, y in zip(start, end, strict=True)]
            return which, np.unique(which, return_index=True)[1]
        fresh = np.concatenate([[True], ~same])[: len(order)]
        which[order] = np.cumsum(fresh) - 1
        return which, order[fresh]

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers from 1 on that ranges share if, and only if, their bytes are the same."""
        return self.groups(start, end)[0] + 1


class Words:
    """The words of the texts that lie between offsets in a buffer."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.bytes = Bytes(buf, lower)
        self.start, self.end, self.first = spans(buf, offsets)

    def _places(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each shingle in text order, and each text's first index among them.

        A text with fewer than k words has its whole word sequence as one shingle; one without words has none.
        """
        n = np.diff(self.first)
        count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
        bounds = np.concatenate([[0], np.cumsum(count)])
        return np.arange(bounds[-1]) + np.repeat(self.first[:-1] - bounds[:-1], count), bounds

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word shingles in text order, and each text's first index among them."""
        at, bounds = self._places(k)
        if not len(at):
            return np.zeros(0, np.uint64), bounds
        word = np.concatenate([self.bytes.hashes(self.start, self.end), np.zeros(k, np.uint64)])
        out = np.zeros(len(at), np.uint64)
        for j in range(k):
            out += word[at + j] * STEP[32 + j]
        n = np.diff(self.first)
        for d in np.flatnonzero((n > 0) & (n < k)):
            m = int(n[d])
            tail = np.append(word[self.first[d] : self.first[d] + m] * STEP[32 : 32 + m], np.uint64(m * int(STEP[62]) % (1 << 64)))
            out[bounds[d]] = tail.sum(dtype=np.uint64)
        return mix(out), bounds

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """The texts' words with one space between, and each one's first byte."""
        inner = np.ones(len(self.start), bool)
        inner[self.first[1:][np.diff(self.first) > 0] - 1] = False
        body, gap = self.bytes.buf[: self.bytes.size].copy(), self.end[inner]
        keep = ~IS_SPACE[body]
        keep[gap], body[gap] = True, 32
        sizes = np.concatenate([[0], np.cumsum(self.end - self.start + inner)])
        return body[keep], sizes[self.first]

    def exact_shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in place of the hashes of shingles(): equal only where all words are equal."""
        at, bounds = self._places(k)
        if not len(at):
            return np.zeros(0, np.int64), bounds
        name = np.append(self.bytes.names(self.start, self.end), np.zeros(k, np.int64))
        stop = np.repeat(self.first[1:], np.diff(bounds))
        room, top, out = int(name.max()) + 1, 1, np.zeros(len(at), np.int64)
        for j in range(k):
            if top * room > 1 << 62:
                out = np.unique(out, return_inverse=True)[1]
                top = int(out.max()) + 1
            out = out * room + np.where(at + j < stop, name[at + j], 0)
            top *= room
        return out, bounds


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    return Words(buf, offsets, lower).shingles(k)


def distinct(x: np.ndarray) -> np.ndarray:
    """x sorted, without repetitions."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def exact_sets(sequences: list[bytes], k: int) -> list[np.ndarray]:
    """The set of shingles of each text in lower case, as sorted numbers that mean the same words throughout one call."""
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int64)
    codes, bounds = Words(np.frombuffer(b"".join(sequences), np.uint8), offsets, lower=False).exact_shingles(k)
    return [distinct(codes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
