"""Lookup of vertex coordinates and shape measures of tetrahedra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dealing import dealt, joined

AXES = ("x", "y", "z")


def folded_corners(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """(cell_id, x0, y0, z0 to x3, y3, z3): coordinates of cells' four corners.

    One join for all corners: cells are unfolded by corner, joined and folded again by cell, so the vertex
    table moves once, not four times. Corners are dealt by vertex and by cell to tasks of bounded size. Corners are a cell's first four nodes, whatever its order. Cells with a
    corner that isn't there keep nulls.
    """
    corners = cells.select("cell_id", F.posexplode(F.slice("vertices", 1, 4)).alias("corner", "vertex_id"))
    rows = 4 * cells.count()
    found = dealt(joined(corners, vertices.select("vertex_id", *AXES), ["vertex_id"], "left", rows), rows, "cell_id")
    return found.groupBy("cell_id").agg(*[F.max(F.when(F.col("corner") == k, F.col(a))).alias(f"{a}{k}") for k in range(4) for a in AXES])


def corner_coordinates(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """cells with the columns of folded_corners()."""
    return joined(cells, folded_corners(cells, vertices), ["cell_id"])


def _edge(a: int, b: int) -> tuple[str, str, str]:
    return tuple(f"({c}{b} - {c}{a})" for c in AXES)


def _cross(u: tuple[str, ...], v: tuple[str, ...]) -> tuple[str, str, str]:
    return (f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})", f"({u[0]} * {v[1]} - {u[1]} * {v[0]})")


def _norm(u: tuple[str, ...]) -> str:
    return f"sqrt({u[0]} * {u[0]} + {u[1]} * {u[1]} + {u[2]} * {u[2]})"


def determinant_sql() -> str:
    """Six times the volume, in SQL that Spark and other engines share."""
    a, c = _edge(0, 1), _cross(_edge(0, 2), _edge(0, 3))
    return f"abs({a[0]} * {c[0]} + {a[1]} * {c[1]} + {a[2]} * {c[2]})"


def surface_sql() -> str:
    """Twice the surface."""
    sides = (_cross(_edge(0, 1), _edge(0, 2)), _cross(_edge(0, 1), _edge(0, 3)), _cross(_edge(0, 2), _edge(0, 3)), _cross(_edge(1, 2), _edge(1, 3)))
    return "(" + " + ".join(_norm(s) for s in sides) + ")"


def longest_edge_sql() -> str:
    return "greatest(" + ", ".join(_norm(_edge(a, b)) for a in range(4) for b in range(a + 1, 4)) + ")"


def largest_side_sql() -> str:
    """Twice the area of the largest face."""
    sides = (_cross(_edge(0, 1), _edge(0, 2)), _cross(_edge(0, 1), _edge(0, 3)), _cross(_edge(0, 2), _edge(0, 3)), _cross(_edge(1, 2), _edge(1, 3)))
    return "greatest(" + ", ".join(_norm(s) for s in sides) + ")"


def insphere(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """(cell_id, insphere): radius of the inscribed sphere; null for a cell without surface."""
    at = folded_corners(cells, vertices)
    return at.select("cell_id", F.expr(f"{determinant_sql()} / nullif({surface_sql()}, 0D)").alias("insphere"))


def aspect_ratio(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """(cell_id, aspect_ratio): longest edge over shortest altitude.

    An open stand-in for a closed kernel's measure. Null for a cell without volume.
    """
    at = folded_corners(cells, vertices)
    return at.select("cell_id", F.expr(f"{longest_edge_sql()} * {largest_side_sql()} / nullif({determinant_sql()}, 0D)").alias("aspect_ratio"))
