"""From raw documents to packed training sequences.

Each stage takes all that the one before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tetraspark.llm import neardup, packing, quality_model, quality_rules, suffixdup
from tetraspark.llm.memory import small_batches
from tetraspark.llm.scratch import Scratch, opened
from tetraspark.llm.tables import table

END_ID, WINDOW = 1, 2048


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labels of documents that aren't held out.

    Null and empty texts are scored as texts without words; equal texts, repeated rows included, go or stay
    together. Without labels all stay. No documents give none.
    """
    small_batches(spark)
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from their language go.

    Null and empty texts have no words and go; rows of one text and language, repeated ones included, go or stay together.
    """
    small_batches(spark)
    return quality_rules.keep_good(docs, Scratch(spark, "rules"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal documents the one with the least id stays.

    Null and empty texts and null ids stay, and all rows of the id that stays, repeated ones included.
    """
    small_batches(spark)
    return neardup.drop_near_duplicates(docs, Scratch(spark, "near"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier in the corpus go from the texts.

    Every row stays, with an empty text if all of it is gone or it was null; of repeated rows the first keeps its text.
    """
    small_batches(spark)
    return suffixdup.without_repeats(docs, Scratch(spark, "suffix"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of WINDOW tokens.

    A null or empty text is one piece, its end id; repeated rows are packed row by row; very long texts are cut.
    """
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, Scratch(spark, "packing"), WINDOW)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rule_filter),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("packing", sequence_packing),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet and read again; what a stage has left behind goes with it."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with opened() as made:
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        for inner in made:
            inner.remove()
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
