"""Checks of meshes and of configurations against a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dealing import joined


def dangling_corners(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """(cell_id, corner, vertex_id) of corners whose vertex isn't there."""
    corners = cells.select("cell_id", F.posexplode("vertices").alias("corner", "vertex_id"))
    return joined(corners, vertices.select("vertex_id"), ["vertex_id"], "left_anti").select("cell_id", "corner", "vertex_id")


def unknown_ids(used: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Distinct ids that a configuration uses and the model doesn't have."""
    return used.select(column).distinct().join(known.select(column), column, "left_anti")


def require_empty(rows: DataFrame, message: str) -> None:
    """Raises if there is any row."""
    found = rows.take(1)
    if found:
        raise ValueError(f"{message}: {found[0].asDict()}")


def require_contiguous(ids: DataFrame, column: str, message: str) -> int:
    """The number of rows, if their ids are 0 to that number less one, each once."""
    r = ids.agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.count_distinct(column).alias("different")).first()
    if r["n"] and (r["low"] != 0 or r["high"] != r["n"] - 1 or r["different"] != r["n"]):
        raise ValueError(f"{message}: {r['n']} ids from {r['low']} to {r['high']}, {r['different']} different")
    return r["n"]
