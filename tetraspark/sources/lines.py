"""Text files as numbered lines, in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import working_folder


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a text file, or of a folder's part files one after the other, numbered from 0.

    Splits are read in parallel. A line's number is its place in its split and the number of lines in the
    splits before; only one number a split is gathered and sent to all. Carriage returns at line ends go.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mark"), F.regexp_replace("value", "\\r$", "").alias("value"))
    blocks = raw.groupBy("file", "block").agg(F.min("mark").alias("first"), F.count("*").alias("n"))
    # part files are numbered with five digits or more
    before = Window.orderBy(F.length("file"), "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("start"))
    return raw.join(F.broadcast(starts), ["file", "block"]).select((F.col("mark") - F.col("first") + F.col("start")).alias("line"), "value")


def stored_lines(spark: SparkSession, path: str) -> DataFrame:
    """numbered_lines(), written once as Parquet: sections are ranges of lines, which its statistics leave out unread."""
    folder = working_folder(spark, "lines")
    lines = numbered_lines(spark, path)
    lines.write.parquet(folder)
    return spark.read.schema(lines.schema).parquet(folder)


def tokens(column: str = "value"):
    """A line's words."""
    return F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ")


def between(lines: DataFrame, first: int, n: int) -> DataFrame:
    """n lines from `first`, with their place `at` among them."""
    return lines.filter((F.col("line") >= first) & (F.col("line") < first + n)).withColumn("at", F.col("line") - first)


#: Lines whose ranges are looked up together.
LINES_A_STRETCH = 1 << 16


def in_ranges(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """lines with the columns of the range (low, high, ..; high left out) that each is in; lines outside all go.

    Ranges are unfolded by stretches of lines, so this is an equi-join however many there are.
    """
    stretch = lambda column: F.expr(f"{column} div {LINES_A_STRETCH}")
    spread = ranges.filter("low < high").withColumn("__stretch", F.explode(F.sequence(stretch("low"), stretch("(high - 1)"))))
    found = lines.withColumn("__stretch", stretch("line")).join(spread, "__stretch")
    return found.filter("line >= low and line < high").drop("__stretch")
