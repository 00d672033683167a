"""Quality classifier on pooled random-indexing word vectors (operator 10).

A token's vector sums the sparse random index vectors of its neighbours in the sample. A document is the mean
of its tokens' vectors; a network of two layers gives a logit, which a temperature fitted on sample rows
that the network didn't see turns into a probability. Since pooling is linear, the first layer is applied to
the vocabulary once, so scoring adds one short row a token.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import labelled, textkit
from .memory import release

MODULUS, REMAINDER, THRESHOLD = 5, 0, 0.3
#: Bounds of the labelled sample.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 12_000_000
#: Text whose tokens' full vectors are held at once in fitting.
FITTED_BYTES = 1 << 18
#: Tokens of a text beyond which their rows are summed piece by piece.
LONG_TOKENS = 1 << 20
#: Tokens with a vector of their own, and what a vector and an index vector have.
VOCABULARY, DIMENSIONS, NONZERO, REACH = 20_000, 128, 8, 2
HIDDEN, EPOCHS, RATE, DECAY = 32, 300, 0.01, 1e-3
_SLOTS = 1 << 18
_KIND = np.full(256, 4, np.uint8)  # 0 space, 1 letter, 3 digit, 4 other
_KIND[textkit.IS_SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 3
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Ids of the kinds of tokens without a vector of their own: letters, capitals, digits, other, and the mark of a token that repeats the last one.
_OTHERS = 5


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and kinds of runs of letters, digits and other signs in any case, and each text's first token.

    Kind 1 is a run of capitals of two letters or more; 4 after a token says that it repeats the one before.
    """
    kind = _KIND[buf]
    first = np.ones(len(buf), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[offsets[offsets < len(buf)]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(buf))
    start, end = start[kind[start] > 0], end[kind[start] > 0]
    upper = np.concatenate([[0], np.cumsum(_UPPER[buf], dtype=np.int32)])
    capitals = (upper[end] - upper[start] >= 2) & (upper[end] - upper[start] == end - start)
    kinds = np.where(capitals, 1, np.where(kind[start] == 1, 0, kind[start] - 1)).astype(np.int8)
    hashes = textkit.Bytes(buf, lower=True).hashes(start, end) + capitals.astype(np.uint64)
    return hashes, kinds, np.searchsorted(start, offsets)


@dataclass
class Model:
    slots: np.ndarray  # hash by slot
    ids: np.ndarray  # token id by slot
    rows: np.ndarray  # first layer's row of each token id
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def _placed(top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, ids) of distinct hashes: each is in its slot or, where that is taken, in the next free one."""
    slots, ids = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int64)
    for k, (h, slot) in enumerate(zip(top, _slot(top).tolist(), strict=True)):
        while slots[slot]:
            slot = (slot + 1) % _SLOTS
        slots[slot], ids[slot] = h, k + _OTHERS
    return slots, ids


def _lookup(slots: np.ndarray, ids: np.ndarray, hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    slot = _slot(hashes)
    held = slots[slot]
    out = np.where(held == hashes, ids[slot], kinds)
    at = np.flatnonzero((held != hashes) & (held != 0))
    slot = slot[at]
    while len(at):
        slot = (slot + 1) % _SLOTS
        held = slots[slot]
        found = held == hashes[at]
        out[at[found]] = ids[slot[found]]
        on = ~found & (held != 0)
        at, slot = at[on], slot[on]
    return out


def _with_repeats(ids: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the mark for repetition after each token that repeats the last one."""
    again = np.zeros(len(ids), np.int64)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[first < len(ids)]] = 0
    before = np.concatenate([[0], np.cumsum(1 + again)])
    out = np.full(before[-1], _OTHERS - 1, np.int64)
    out[before[:-1]] = ids
    return out, before[first]


def _stream(texts: pa.Array, limit: int = textkit.SLICE_BYTES):
    """(hashes, kinds, first) slice by slice."""
    buf, offsets = textkit.utf8(texts)
    for a, b in textkit.slices(offsets, limit):
        yield tokens(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _pooled(ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Mean row of each text's tokens; zeros without tokens."""
    out = np.zeros((len(first) - 1, rows.shape[1]), np.float32)
    n = np.diff(first)
    full = np.flatnonzero(n)
    if len(n) == 1 and n[0] > LONG_TOKENS:  # a long text has a slice of its own
        out[0] = sum(rows[ids[a : a + LONG_TOKENS]].sum(axis=0, dtype=np.float64) for a in range(0, len(ids), LONG_TOKENS)) / n[0]
    elif len(full):
        out[full] = np.add.reduceat(rows[ids], first[full], axis=0) / n[full, None]
    return out


def fit(data: pd.DataFrame, seed: int = 11) -> Model:
    """data: (text, label), shuffled. Without both labels every score is the labels' mean, or 0.5 without rows."""
    rng = np.random.Generator(np.random.PCG64(seed))
    parts = list(_stream(pa.array(data["text"].tolist(), pa.large_string()), FITTED_BYTES))
    every = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    seen, count = np.unique(every, return_counts=True)
    top = np.sort(seen[np.argsort(-count, kind="stable")][: int(min(VOCABULARY, (count >= 3).sum()))])
    slots, ids = _placed(top)
    size = len(top) + _OTHERS
    places, signs = rng.integers(0, DIMENSIONS, (size, NONZERO)), rng.choice([-1.0, 1.0], (size, NONZERO))
    vectors = np.zeros(size * DIMENSIONS)
    documents = []
    for hashes, kinds, first in parts:
        own, first = _with_repeats(_lookup(slots, ids, hashes, kinds), hashes, first)
        documents.append((own, first))
        text = np.searchsorted(first, np.arange(len(own)), side="right")
        for reach in range(1, REACH + 1):
            near = np.flatnonzero(text[reach:] == text[:-reach]) if len(own) > reach else np.zeros(0, np.int64)
            for a, b in ((near, near + reach), (near + reach, near)):
                at = own[a, None] * DIMENSIONS + places[own[b]]
                vectors += np.bincount(at.ravel(), signs[own[b]].ravel(), size * DIMENSIONS)
    vectors = vectors.reshape(size, DIMENSIONS)
    # a token's own index vector stands beside its neighbours', so that tokens in like company differ
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    np.add.at(vectors, (np.arange(size)[:, None], places), signs / NONZERO**0.5)
    x = np.concatenate([_pooled(o, f, vectors.astype(np.float32)) for o, f in documents]) if documents else np.zeros((0, DIMENSIONS), np.float32)
    y = data["label"].to_numpy(np.float64)
    zero = Model(slots, ids, np.zeros((size, HIDDEN), np.float32), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    if len(set(y)) < 2:
        p = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        zero.out_bias = float(np.log(p / (1 - p)))
        return zero
    scale = 1 / (x.std(axis=0) + 1e-6)
    mean = x.mean(axis=0)
    x = (x - mean) * scale
    cut = max(1, len(x) // 5)
    w = [rng.normal(0, DIMENSIONS**-0.5, (DIMENSIONS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    train, label = x[cut:], y[cut:]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(train @ w[0] + w[1])
        error = (1 / (1 + np.exp(-(h @ w[2] + w[3][0]))) - label) / len(label)
        back = np.outer(error, w[2]) * (1 - h * h)
        grads = [train.T @ back + DECAY * w[0], back.sum(0), h.T @ error + DECAY * w[2], np.array([error.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    logit = np.tanh(x[:cut] @ w[0] + w[1]) @ w[2] + w[3][0]
    loss = lambda t: np.logaddexp(0, np.where(y[:cut] > 0, -1, 1) * logit / t).mean()
    temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    first = w[0] * scale[:, None]
    return Model(slots, ids, (vectors @ first).astype(np.float32), w[1] - mean @ first, w[2], float(w[3][0]), float(temperature))


def score(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 for each text; an empty one has the score of no tokens at all."""
    out = [np.zeros(0)]
    for hashes, kinds, first in _stream(texts):
        ids, first = _with_repeats(_lookup(model.slots, model.ids, hashes, kinds), hashes, first)
        hidden = np.tanh(_pooled(ids, first, model.rows).astype(np.float64) + model.bias)
        out.append(1 / (1 + np.exp(-np.clip((hidden @ model.out + model.out_bias) / model.temperature, -60, 60))))
    return np.concatenate(out)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Model:
    model = fit(labelled.sample(docs, labels, label, MODULUS, REMAINDER, SAMPLE_ROWS, SAMPLE_CHARS, id_col, text_col))
    release()
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """(id_col, held_out, score, predicted): one row for each row of docs; null texts count as empty.

    Equal texts have equal scores. A null id is held out. Without labels every score is 0.5.
    """
    return labelled.verdicts(docs, train(docs, labels, id_col, text_col, label), score, MODULUS, REMAINDER, THRESHOLD, id_col, text_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score below THRESHOLD; columns as they were."""
    return labelled.scored(docs, train(docs, labels, id_col, text_col), score, text_col).filter(f"score >= {THRESHOLD}").select("doc.*")
