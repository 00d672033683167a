"""Numbering the rows of a sorted table without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import working_folder


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with the column `name`: each row's place, from 0, in the order of the columns `by`.

    The sorted rows are written once, each with its task and its place there; the rows of the tasks before
    then give the rest. Only those counts, one a task, are summed in one place.
    """
    spark, folder = df.sparkSession, working_folder(df.sparkSession, "numbered")
    marked = df.orderBy(*by).withColumns({"__part": F.spark_partition_id(), "__mark": F.monotonically_increasing_id()})
    marked.write.parquet(folder)
    kept = spark.read.schema(marked.schema).parquet(folder)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = kept.groupBy("__part").agg(F.min("__mark").alias("__first"), F.count("*").alias("__n"))
    starts = parts.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("bigint").alias("__start"))
    found = kept.join(F.broadcast(starts), "__part")  # a row a task
    return found.select(*df.columns, (F.col("__mark") - F.col("__first") + F.col("__start")).alias(name))
