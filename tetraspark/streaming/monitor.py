"""Running totals over cells that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CELLS


def arriving_cells(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files of cells that appear in a folder."""
    return spark.readStream.schema(CELLS).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def group_counts(cells: DataFrame) -> DataFrame:
    """(group, cells, first_cell, last_cell), of a stream or a table; the state has a row a group."""
    return cells.groupBy("group").agg(F.count("*").alias("cells"), F.min("cell_id").alias("first_cell"), F.max("cell_id").alias("last_cell"))
