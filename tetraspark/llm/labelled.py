"""Bounded samples of labelled documents for fitting, and scoring of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import tidy


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Rows that labels are never learnt from, by the crc32 of the id as text; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most_rows: int, most_chars: int, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """(text, label) of up to most_rows labelled documents of up to most_chars characters together, the same ones each time, in a fixed order.

    They are those with the least hashes of their ids, so they spread over the whole table; one that doesn't fit
    into what is left of most_chars is passed over. An id has one row here, with the shortest of its texts.
    Conflicting labels of an id, null labels and null ids are left out.
    """
    marked = labels.filter(~held_out(id_col, modulus, remainder)).filter(F.col(label).isin(0, 1))
    marked = marked.groupBy(F.col(id_col).alias("key")).agg(F.min(label).alias("a"), F.max(label).alias("label")).filter("a = label").select("key", "label", F.xxhash64("key").alias("turn"))
    chosen = F.broadcast(marked.orderBy("turn", "key").limit(most_rows))  # at most most_rows ids
    texts = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = texts.select("key", F.length("text").alias("n"), F.xxhash64("text").alias("which")).join(chosen, "key").groupBy("key", "turn", "label").agg(F.min(F.struct("n", "which")).alias("least"))
    fitting, left = [], most_chars
    for r in sorted(sizes.collect(), key=lambda r: (r["turn"], r["key"])):  # at most most_rows rows
        if r["least"]["n"] <= left:
            left -= r["least"]["n"]
            fitting.append((r["key"], r["least"]["which"], r["label"]))
    if not fitting:
        return pd.DataFrame({"text": pd.Series([], dtype=object), "label": pd.Series([], dtype="int64")})
    kind = T.StructType([T.StructField("key", sizes.schema["key"].dataType), T.StructField("which", T.LongType()), T.StructField("label", sizes.schema["label"].dataType)])
    wanted = F.broadcast(docs.sparkSession.createDataFrame(fitting, kind))  # at most most_rows ids
    found = texts.withColumn("which", F.xxhash64("text")).join(wanted, ["key", "which"]).groupBy("key").agg(F.min("text").alias("text"), F.first("label").alias("label")).toPandas()
    return found.sort_values("key").sample(frac=1, random_state=5).reset_index(drop=True)[["text", "label"]]


def scored(docs: DataFrame, model, score: Callable[[object, pa.Array], np.ndarray], text_col: str = "text") -> DataFrame:
    """(doc struct of all of docs' columns, score): score(model, texts) for each row, whatever the columns' names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    place = docs.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(score(shared.value, pc.fill_null(batch.column("doc").field(place), "")), pa.float64())], ["doc", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())]))


def verdicts(docs: DataFrame, model, score, modulus: int, remainder: int, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted)."""
    rows = scored(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), model, score).select(F.col("doc.key").alias(id_col), "score")
    return rows.select(id_col, held_out(id_col, modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
