"""A structured mesh of hexahedra cut into six tetrahedra each, in place of a closed mesher."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..mesh import Mesh
from ..operators.faces import exterior_faces

# Corners of the six tetrahedra, whose bits are steps along x, y and z.
TETRAHEDRA = ((0, 1, 3, 7), (0, 1, 5, 7), (0, 2, 3, 7), (0, 2, 6, 7), (0, 4, 5, 7), (0, 4, 6, 7))


#: Hexahedra that a task unfolds, and successive ones that are dealt together since they share faces.
HEXES_A_TASK, HEXES_TOGETHER = 1 << 14, 1 << 9


def box(hexes: DataFrame, column: str, nx: int = 20, ny: int = 10) -> Mesh:
    """The mesh of hexahedra numbered by a column from 0: nx along x, ny along y, then layers along z.

    Groups are 1 to 4 by layer. Facets of the outside are tagged 101 at the bottom, 103 at x = 0, else 105.
    A hexahedron has 24 faces, and a small file very many hexahedra; so these are dealt to tasks before they unfold.
    """
    n = hexes.count()
    hexes = hexes.select(column).repartition(max(1, ceil(n / HEXES_A_TASK)), F.expr(f"{column} div {HEXES_TOGETHER}"))
    h = F.col(column)
    place = hexes.select(h.alias("h"), (h % nx).alias("i"), F.expr(f"{column} div {nx} % {ny}").alias("j"), F.expr(f"{column} div {nx * ny}").alias("k"))
    corner = lambda c: (F.col("i") + (c & 1)) + (nx + 1) * (F.col("j") + (c >> 1 & 1)) + (nx + 1) * (ny + 1) * (F.col("k") + (c >> 2 & 1))
    tets = F.array(*[F.struct(F.lit(t).alias("t"), F.array(*[corner(c) for c in cs]).alias("vertices")) for t, cs in enumerate(TETRAHEDRA)])
    cells = place.select("h", "k", F.inline(tets)).select((F.col("h") * 6 + F.col("t")).alias("cell_id"), "vertices", (F.col("k") % 4 + 1).cast("int").alias("group"))
    used = place.select(F.explode(F.array(*[corner(c) for c in range(8)])).alias("vertex_id")).distinct()
    v, row, layer = F.col("vertex_id"), nx + 1, (nx + 1) * (ny + 1)
    vertices = used.select("vertex_id", (v % row).cast("double").alias("x"), F.expr(f"vertex_id div {row} % {ny + 1}").cast("double").alias("y"), F.expr(f"vertex_id div {layer}").cast("double").alias("z"))
    outside = exterior_faces(cells, len(TETRAHEDRA) * n)
    on = lambda f: f(F.col("a")) & f(F.col("b")) & f(F.col("c"))
    tag = F.when(on(lambda n: n < layer), 101).when(on(lambda n: n % row == 0), 103).otherwise(105)
    facets = outside.select((F.col("cell_id") * 4 + F.col("face")).alias("facet_id"), F.array("a", "b", "c").alias("nodes"), tag.alias("tag"))
    return Mesh(vertices, cells, facets)
