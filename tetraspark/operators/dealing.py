"""Aggregations and joins of tables that grow with the mesh, in tasks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task takes of a table that is dealt by key.
ROWS_A_TASK = 1 << 17


def dealt(df: DataFrame, rows: int, *by) -> DataFrame:
    """df, of about so many rows, dealt by columns to tasks of about ROWS_A_TASK rows. Spark would merge tasks by their compressed bytes, of which a mesh has few."""
    return df.repartition(max(1, -(-rows // ROWS_A_TASK)), *by)


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """left.join(right), of which neither goes through the driver; dealt() if the number of rows is given.

    Spark takes unfolded and well-packed tables for much smaller than they are, and would broadcast them.
    """
    if rows is not None:
        left, right = dealt(left, rows, *on), dealt(right, rows, *on)
    return left.join(right.hint("merge"), on, how)
