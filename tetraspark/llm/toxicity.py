"""Toxicity by compression distance (operator 5).

Texts are taken as runs of letters with one space between. Pieces of text, of some lengths in bytes, that far
more toxic than ordinary sample documents hold are marked by a likelihood-ratio test; where they lie, the toxic
documents' stretches make up the toxic zstandard dictionary. Both dictionaries hold the most widespread words of
ordinary documents as well, and the pieces of the toxic stretches that ordinary documents aren't much poorer in, so that a
window's compressed lengths under the two differ by what only toxic text explains.

A text is scored as a whole: a window starts at every byte of it. A window speaks for toxicity
if the toxic dictionary makes it shorter by a threshold than the ordinary one. The threshold, and the
probability that a number of such windows among all stands for, are calibrated on sample rows, each measured by
dictionaries that didn't see it; the final dictionaries are those of all rows. A window is compressed between two
copies of a frame that both dictionaries hold, since zstandard leaves shorter blocks as they are.

Every window counts with what the two compressors make of it. Without a string of LEAST_MATCH bytes or more
that only the toxic dictionary holds (`_telling`) that is the same length twice, so its difference is 0 without a call: the
dictionaries are equally long and differ only in what lies farther than all that they share, the compressor looks at
nearer matches first, takes a farther one only if it is longer, and none shorter than LEAST_MATCH.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property, lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import labelled, textkit
from .memory import release

MODULUS, REMAINDER, THRESHOLD = 4, 2, 0.3
#: Bounds of the labelled sample, and the parts of it whose rows are measured by dictionaries of the other parts.
SAMPLE_ROWS, SAMPLE_CHARS, FOLDS = 4000, 16_000_000, 4
#: Bytes of pieces. A marked one is in LEAST_DOCUMENTS toxic documents, its share of those is LEAST_LIFT times that
#: of ordinary ones, and twice its log likelihood ratio is LEAST_EVIDENCE.
PIECES, LEAST_DOCUMENTS, LEAST_LIFT, LEAST_EVIDENCE = (5, 8), 2, 6.0, 24.0
#: Bytes of a window and from one to the next: at 1 a stretch's differences are the same wherever it stands.
WINDOW, STRIDE = 24, 1
#: Words of ordinary documents in both dictionaries, the most widespread.
ORDINARY_WORDS = 2000
#: Bytes of the compressor's shortest match, and windows whose differences a worker remembers.
LEAST_MATCH, REMEMBERED = 4, 1 << 16
#: Differences in bytes that the threshold is chosen from.
LEVELS = range(1, 7)
#: What no plain text holds: a frame about windows, and an end of stretches.
_FRAME, _END = bytes(range(16, 32)), b"\x01"
_CHUNK = 1 << 20
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_GOLDEN, _SLOTS_LOG = np.uint64(0x9E3779B97F4A7C15), 16


@cache
def _marks() -> re.Pattern:
    """What ends words beyond ASCII: whatever Unicode calls punctuation, a symbol, a number, white space or a control."""
    cut = [k for k in range(128, sys.maxunicode + 1) if unicodedata.category(chr(k)) not in ("Cn", "Co") and unicodedata.category(chr(k))[0] in "PSNZC"]
    ranges = []
    for _, g in groupby(enumerate(cut), lambda x: x[1] - x[0]):
        run = [k for _, k in g]
        ranges.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
    return re.compile("[" + "".join(ranges) + "]+")


def plain(text: str) -> bytes:
    """A text's runs of letters and marks in lower case, with one space between and about them."""
    text = text.lower()
    if not text.isascii():
        text = _marks().sub(" ", text)
    return b" " + b" ".join(text.encode(errors="replace").translate(_LETTERS).split()) + b" "


def _pieces(data: bytes, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """A text's pieces of a length as numbers, place by place: (first place, pieces) of one stretch after another."""
    eights = textkit.Bytes(np.frombuffer(data, np.uint8)).eights[: max(0, len(data) - size + 1)]
    for a in range(0, len(eights), _CHUNK):
        yield a, eights[a : a + _CHUNK] & textkit._LOW[size]


def _held(data: bytes, size: int) -> np.ndarray:
    """A text's distinct pieces of a length."""
    parts = [np.unique(p) for _, p in _pieces(data, size)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))


@dataclass
class Known:
    """A set of pieces of one length, looked up by the place in a table of bits and then exactly."""

    size: int
    values: np.ndarray

    @cached_property
    def _slots(self) -> np.ndarray:
        out = np.zeros(1 << _SLOTS_LOG, bool)
        out[self._slot(self.values)] = True
        return out

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x * _GOLDEN) >> np.uint64(64 - _SLOTS_LOG)

    def places(self, data: bytes) -> np.ndarray:
        """Where a text has one of the pieces."""
        out = [np.zeros(0, np.int64)]
        for a, p in _pieces(data, self.size):
            at = np.flatnonzero(self._slots[self._slot(p)])
            out.append(a + at[self.holds(p[at])])
        return np.concatenate(out)

    def holds(self, pieces: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.values, pieces).clip(max=len(self.values) - 1)] == pieces


def _length_under(content: bytes):
    """A function from a window to its compressed length under a dictionary."""
    logs = len(content).bit_length() + 2  # all of it is within reach
    parameters = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=max(21, logs), chain_log=max(17, logs), hash_log=17, search_log=6, min_match=LEAST_MATCH, target_length=32,
        strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    dictionary = zstandard.ZstdCompressionDict(content + _FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    compress = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress
    return lambda window: len(compress(_FRAME + window + _FRAME))


@dataclass
class Dictionaries:
    known: list[Known]
    toxic: bytes
    ordinary: bytes

    @cached_property
    def _gain(self):
        """A function from a window to the bytes that the toxic dictionary saves on it, which remembers the last windows."""
        # the first byte of a dictionary matches nothing
        ordinary, toxic = _length_under(_END * (1 + len(self.toxic)) + self.ordinary), _length_under(_END + self.toxic + self.ordinary)
        return lru_cache(REMEMBERED)(lambda window: ordinary(window) - toxic(window))

    @cached_property
    def _starts(self) -> Known:
        least = min(k.size for k in self.known)
        return Known(least, np.unique(np.concatenate([k.values & textkit._LOW[least] for k in self.known])))

    def gains(self, data: bytes) -> tuple[np.ndarray, int]:
        """By how many bytes the toxic dictionary makes each window with a known piece shorter, and the number of all windows, of a plain text."""
        windows = -(-len(data) // STRIDE)
        if not self.known:
            return np.zeros(0, np.int64), windows
        at = self._starts.places(data)
        pieces = textkit.Bytes(np.frombuffer(data, np.uint8)).eights[at]
        within = np.zeros(windows + 1, np.int32)
        for known in self.known:
            here = at[known.holds(pieces & textkit._LOW[known.size])]
            np.add.at(within, np.maximum(here + known.size - WINDOW + STRIDE - 1, 0) // STRIDE, 1)
            np.add.at(within, here // STRIDE + 1, -1)
        found = np.flatnonzero(np.cumsum(within, out=within)[:windows])
        starts = (k * STRIDE for a in range(0, len(found), _CHUNK) for k in found[a : a + _CHUNK].tolist())
        gain = self._gain
        return np.fromiter((gain(data[a : a + WINDOW]) for a in starts), np.int64, len(found)), windows

    def __getstate__(self) -> dict:
        return {"known": [Known(k.size, k.values) for k in self.known], "toxic": self.toxic, "ordinary": self.ordinary}


@dataclass
class Model:
    dictionaries: Dictionaries | None
    threshold: int = 1
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))  # of the logarithms of windows beyond it, of their share and of all (`_row`), and of one


def _evidence(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Twice the log likelihood ratio of a of n1 and b of n0 against one share for both."""
    p = (a + b) / (n1 + n0)
    part = lambda x, wanted: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(wanted, 1e-300)), 0.0)
    return 2 * (part(a, n1 * p) + part(b, n0 * p) + part(n1 - a, n1 * (1 - p)) + part(n0 - b, n0 * (1 - p)))


def _counted(texts: list[bytes], group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces that several toxic documents hold, and how many documents of each group (fold + FOLDS * label) do."""
    toxic = [_held(t, size) for t, g in zip(texts, group, strict=True) if g >= FOLDS]
    values, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *toxic]), return_counts=True)
    values = values[n >= LEAST_DOCUMENTS]
    counts = np.zeros((2 * FOLDS, len(values)), np.int32)
    if len(values):
        for text, g in zip(texts, group, strict=True):
            held = _held(text, size)
            at = np.searchsorted(values, held).clip(max=len(values) - 1)
            counts[g, at[values[at] == held]] += 1
    return values, counts


def _stretches(text: bytes, pieces: list[Known]) -> set[bytes]:
    """A text's longest stretches that are covered by pieces."""
    covered = np.zeros(len(text) + 2, np.int32)
    for piece in pieces:
        at = piece.places(text)
        np.add.at(covered, at + 1, 1)
        np.add.at(covered, at + 1 + piece.size, -1)
    edges = np.flatnonzero(np.diff((np.cumsum(covered) > 0).astype(np.int8)))
    return {text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)}


def _longest(text: bytes, pieces: list[Known]) -> set[bytes]:
    """A text's pieces that lie in no other of its pieces."""
    end = np.zeros(len(text), np.int64)
    for piece in pieces:
        at = piece.places(text)
        end[at] = np.maximum(end[at], at + piece.size)
    before = np.concatenate([[0], np.maximum.accumulate(end)[:-1]])
    return {text[a : end[a]] for a in np.flatnonzero(end > before).tolist()}


def _telling(toxic: bytes, ordinary: bytes) -> list[Known]:
    """The strings of LEAST_MATCH bytes or more that the toxic dictionary holds and the ordinary one doesn't: from each place the shortest.

    Of those longer than 8 bytes the first 8 stand for them.
    """
    content = np.frombuffer(toxic, np.uint8)
    eights, at, ends = textkit.Bytes(content).eights, np.arange(len(toxic)), np.append(np.flatnonzero(content == _END[0]), len(toxic))
    room = ends[np.searchsorted(ends, at)] - at  # to the stretch's end
    found = {}
    for size in range(LEAST_MATCH, 9):
        at = at[room[at] >= size]
        pieces = eights[at] & textkit._LOW[size]
        there = np.isin(pieces, _held(ordinary, size))
        found[size], at = pieces[~there], at[there]
    longer = {a: toxic[a : a + min(WINDOW, n)] for a, n in zip(at.tolist(), room[at].tolist(), strict=True)}
    missing = {s for s in set(longer.values()) if s not in ordinary}
    found[8] = np.concatenate([found[8], eights[np.array([a for a, s in longer.items() if s in missing], np.int64)]])
    return [Known(size, np.unique(pieces)) for size, pieces in found.items() if len(pieces)]


def _trained(texts: list[bytes], group: np.ndarray, counted: dict[int, tuple[np.ndarray, np.ndarray]], ordinary: list[Counter], without: int | None) -> Dictionaries:
    """Dictionaries of all folds but one."""
    used = np.array([f for f in range(FOLDS) if f != without])
    mine = np.isin(group % FOLDS, used)
    n1, n0 = int((mine & (group >= FOLDS)).sum()), int((mine & (group < FOLDS)).sum())
    marked, shared = [], []
    for size, (values, counts) in counted.items():
        a, b = counts[used + FOLDS].sum(axis=0), counts[used].sum(axis=0)
        lifted = (a >= LEAST_DOCUMENTS) & (a * n0 >= LEAST_LIFT * (b + 0.5) * n1)
        shared.append(Known(size, values[~lifted]))
        if size in PIECES and (good := lifted & (_evidence(a, b, n1, n0) >= LEAST_EVIDENCE)).any():
            marked.append(Known(size, values[good]))
    stretches: Counter = Counter()
    for k in np.flatnonzero(mine & (group >= FOLDS)):
        stretches.update(_stretches(texts[k], marked))
    # the last content of a dictionary is the nearest
    toxic = sorted((s for s, n in stretches.items() if n >= LEAST_DOCUMENTS), key=lambda s: (stretches[s], s))
    common: Counter = Counter()
    for f in used:
        common.update(ordinary[f])
    words = b" ".join(sorted(common, key=lambda w: (-common[w], w))[:ORDINARY_WORDS][::-1]) + b" "
    both = b"".join(p + _END for p in sorted(set().union(*(_longest(t, shared) for t in toxic))) if p not in words) + words
    toxic = b"".join(s + _END for s in toxic)
    return Dictionaries(_telling(toxic, both), toxic, both)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def _row(gains: np.ndarray, windows: int, threshold: int) -> list[float]:
    """Windows beyond the threshold by the half window and of each WINDOW bytes, and the length in windows side by side; a text shorter than one counts as one."""
    beyond, size = int((gains >= threshold).sum()) * STRIDE, max(windows * STRIDE, WINDOW)
    return [np.log1p(beyond / (WINDOW // 2)), np.log1p(beyond / size * WINDOW), np.log1p(-(-size // WINDOW)), 1.0]


def fit(data: pd.DataFrame) -> Model:
    """data: (text, label), shuffled. With fewer than two rows a fold of either label every score is that label's share, or 0.5."""
    y = data["label"].to_numpy(np.float64)
    if min((y == 1).sum(), (y == 0).sum()) < 2 * FOLDS:
        p = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        return Model(None, weights=np.array([0.0, 0.0, 0.0, np.log(p / (1 - p))]))
    group = np.arange(len(y)) % FOLDS + FOLDS * y.astype(np.int64)
    texts = [plain(t) for t in data["text"]]
    counted = {size: _counted(texts, group, size) for size in range(LEAST_MATCH, 9)}
    ordinary: list[Counter] = [Counter() for _ in range(FOLDS)]
    for text, g in zip(texts, group, strict=True):
        if g < FOLDS:
            ordinary[g].update(set(text.split()))
    measured: list[tuple[np.ndarray, int]] = [(np.zeros(0, np.int64), 0)] * len(y)
    for f in range(FOLDS):
        others = _trained(texts, group, counted, ordinary, f)
        for k in np.flatnonzero(group % FOLDS == f):
            measured[k] = others.gains(texts[k])
    best: tuple[float, int, np.ndarray] | None = None
    for threshold in LEVELS:
        x = np.array([_row(g, n, threshold) for g, n in measured])
        w = _logistic(x, y)
        loss = float(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).mean())
        if best is None or loss < best[0]:
            best = (loss, threshold, w)
    return Model(_trained(texts, group, counted, ordinary, None), best[1], best[2])


def score(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 for each whole text; an empty one has no windows."""
    if model.dictionaries is None:
        logits = np.full(len(texts), model.weights[-1])
    else:
        x = np.array([_row(*model.dictionaries.gains(plain(t.as_py() or "")), model.threshold) for t in texts]).reshape(len(texts), 4)
        logits = (x * model.weights).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(logits, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Model:
    model = fit(labelled.sample(docs, labels, label, MODULUS, REMAINDER, SAMPLE_ROWS, SAMPLE_CHARS, id_col, text_col))
    release()
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """(id_col, held_out, score, predicted): one row for each row of docs; null texts count as empty.

    Equal texts have equal scores. A null id is held out. Without labels every score is 0.5. Texts of any length
    are scored whole, in at most about 35 bytes of memory a byte.
    """
    return labelled.verdicts(docs, train(docs, labels, id_col, text_col, label), score, MODULUS, REMAINDER, THRESHOLD, id_col, text_col)
