"""MinHash fingerprints of whole texts (operator 6).

PERMUTATIONS universal hashes a * x + b modulo 2**32 over the 32-bit hashes of 5-word shingles; a fingerprint
keeps 16 mixed bits of each least value, as hex. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lsh, textkit
from .memory import tidy
from .ranges import partitions, with_range
from .scratch import Scratch

PERMUTATIONS = 256
#: Of a signature, the components that bands take, and those of a band.
BANDED, ROWS = 128, 4
WORDS, PERCENT = 5, 80
_RNG = np.random.Generator(np.random.PCG64(31))
_A = _RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_EMPTY = np.uint32(0xFFFFFFFF)


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, PERMUTATIONS) least values of the texts whose 64-bit shingles lie between bounds; no shingles: all ones."""
    out = np.full((len(bounds) - 1, PERMUTATIONS), _EMPTY, np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        y = np.empty_like(x)
        at = bounds[full]
        for j in range(PERMUTATIONS):
            np.multiply(x, _A[j], out=y)
            np.add(y, _B[j], out=y)
            out[full, j] = np.minimum.reduceat(y, at)
    return out


def components16(signature: np.ndarray) -> np.ndarray:
    """The 16 bits that a fingerprint keeps of each least value."""
    x = signature * np.uint32(0x9E3779B1)
    return ((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(16)).astype(">u2")


def fingerprints(texts: pa.Array, words: int = WORDS) -> np.ndarray:
    """(texts, PERMUTATIONS) 16-bit components."""
    buf, offsets = textkit.utf8(texts)
    parts = [np.zeros((0, PERMUTATIONS), ">u2")]
    for a, b in textkit.slices(offsets):
        parts.append(components16(signatures(*textkit.shingles(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words))))
    return np.concatenate(parts)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def minhash(own: np.ndarray) -> np.ndarray:
    """Signature of a non-empty set, for banding."""
    return signatures(own, np.array([0, len(own)]))[0, :BANDED]


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, class_id): bands of the fingerprints joined, links verified by Jaccard likeness.

    Null and empty texts are linked with nothing; rows of one id are one document; a null id has a null class.
    """
    found = lsh.classes(docs, scratch, words, percent, minhash, ROWS, id_col, text_col)
    return found.select(F.col("key").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("class_id"))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, echo, key, text), sorted: in each part the next row is the next document.

    Parts are ranges of ids, and each ends with an echo of the next part's first document (the last part with
    the very first), so no window runs over the whole table. Only one id a part comes to the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_range(rows)
    firsts = sorted((r["part"], r["key"]) for r in rows.groupBy("part").agg(F.min("key").alias("key")).collect())
    echoes = [(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)]
    to = F.broadcast(spark.createDataFrame(echoes, "key long, echo_part int"))  # one row a part
    rows = rows.join(to, "key", "left")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("echo"))
    echo = F.struct(F.col("echo_part").alias("part"), F.lit(True).alias("echo"))
    rows = rows.select(F.explode(F.when(F.col("echo_part").isNull(), F.array(own)).otherwise(F.array(own, echo))).alias("at"), "key", "text").select("at.part", "at.echo", "key", "text")
    return rows.repartition(partitions(docs), "part").sortWithinPartitions("part", "echo", "key", "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Each text's fingerprint, and that of its edited text.

    Edited: the last floor(n / 2) code points give way to the first as many (or all) of the next document by
    ascending id; the last document's next is the first. Null texts are empty; two empty texts are alike (1.0).
    Rows of equal id stand by text; a null id sorts first (as the least 64-bit integer, which counts as null); a sole row's next is itself; no rows give none.
    """

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for pdf in batches:
            pdf = pdf.assign(fp=list(fingerprints(pa.array(pdf["text"], pa.large_string()), words)))
            rows = pd.concat([held, pdf], ignore_index=True)
            held = rows.iloc[-1:]
            this, after = rows.iloc[:-1].reset_index(drop=True), rows.iloc[1:].reset_index(drop=True)
            real = ~this["echo"].astype(bool)
            this, after = this[real], after[real]
            if not len(this):
                continue
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(this["text"], after["text"], strict=True)]
            own, nxt = np.stack(this["fp"].to_list()), np.stack(after["fp"].to_list())
            changed = fingerprints(pa.array(edited, pa.large_string()), words)
            key = this["key"].astype("Int64")
            yield pd.DataFrame({
                id_col: key.mask(key == -(2**63)).reset_index(drop=True), "n_chars": [len(t) for t in this["text"]],
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": [x.tobytes().hex() for x in own], "edited_fingerprint": [x.tobytes().hex() for x in changed],
                "near_edited": likeness(own, changed), "near_next": likeness(own, nxt),
            })

    schema = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInPandas(run, schema)
