"""Summaries of whole meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..mesh import Mesh
from .geometry import insphere

# Lower edges of the aspect-ratio bins.
BIN_EDGES = (0, 2, 4, 6, 10, 20, 40, 100)


def summary(mesh: Mesh) -> DataFrame:
    """One row: cell_count, vertex_count, min_insphere, degenerate_cells."""
    cells = insphere(mesh.cells, mesh.vertices).agg(F.count("*").alias("cell_count"), F.min("insphere").alias("min_insphere"), F.count_if(F.col("insphere").isNull() | (F.col("insphere") == 0)).alias("degenerate_cells"))
    return cells.join(mesh.vertices.agg(F.count("*").alias("vertex_count"))).select("cell_count", "vertex_count", "min_insphere", "degenerate_cells")


def ratio_bin(ratio):
    """The bin of a ratio: half-open, the last without an end; NaN and null are in the last."""
    bin_ = F.when(ratio < BIN_EDGES[1], 0)
    for k in range(2, len(BIN_EDGES)):
        bin_ = bin_.when(ratio < BIN_EDGES[k], k - 1)
    return bin_.otherwise(len(BIN_EDGES) - 1)


def ratio_histogram(ratios: DataFrame, column: str = "aspect_ratio") -> DataFrame:
    """(bin, low, high, cells): all bins, empty ones too; the last has no high."""
    spark = ratios.sparkSession
    rows = [(k, float(low), float(BIN_EDGES[k + 1]) if k + 1 < len(BIN_EDGES) else None) for k, low in enumerate(BIN_EDGES)]
    bins = spark.createDataFrame(rows, "bin int, low double, high double")
    counted = ratios.groupBy(ratio_bin(F.col(column)).alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counted, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("bigint").alias("cells"))
