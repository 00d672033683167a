"""MinHash near-duplicates by one-permutation hashing (operator 1).

One hash of each shingle: its top bits choose a bin, and the least hash of a bin is the bin's value. An
empty bin takes the value of a full one, chosen by the empty bin's own random order of all bins (optimal
densification), so that bins agree with the sets' likeness as their probability, however small the sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lsh
from .scratch import Scratch

#: 32 bands of 4: a pair at 0.8 is missed by all bands once in 20 million times.
BINS, ROWS = 128, 4
WORDS, PERCENT = 5, 80
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_EDGES = np.arange(BINS, dtype=np.uint64) << _SHIFT
#: _TURN[j, b]: when bin j's random order comes to bin b.
_TURN = np.argsort(np.random.Generator(np.random.PCG64(7)).random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.int32)


def one_permutation(own: np.ndarray) -> np.ndarray:
    """Signature of a non-empty sorted set of hashes: 32 bits a bin."""
    at = np.searchsorted(own, _EDGES)
    value = own[np.minimum(at, len(own) - 1)]
    full = (at < len(own)) & (value >> _SHIFT == np.arange(BINS, dtype=np.uint64))
    if not full.all():
        givers = np.flatnonzero(full)
        empty = np.flatnonzero(~full)
        value[empty] = value[givers[_TURN[np.ix_(empty, givers)].argmin(axis=1)]]
    return lsh.textkit.mix(value).astype(np.uint32)


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept): one row for each row of docs.

    Documents are linked where 100 * |intersection| >= percent * |union| of their word shingles; component_id is
    the least id reachable. kept: the document whose id that is; of rows that repeat that id, all. Null and
    empty texts are linked with nothing and kept; a null id has a null component and is kept.
    """
    found = lsh.classes(docs, scratch, words, percent, one_permutation, ROWS, id_col, text_col)
    return found.select(F.col("key").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_duplicates() doesn't keep; columns as they were, clashing names included."""
    dropped = near_duplicates(docs, scratch, words, percent, id_col, text_col).filter("not kept").select(F.col(id_col).alias("__dropped")).distinct()
    return docs.join(dropped, docs[id_col] == dropped["__dropped"], "left_anti")
