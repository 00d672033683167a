"""Faces of cells, and the tags that facets give them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strip_tag_offset
from ..schema import FACE_NODES, FACE_PERMUTATION
from .dealing import dealt, joined


def face_table(cells: DataFrame) -> DataFrame:
    """(cell_id, face, nodes, a, b, c): a row for each face, with its nodes in order and sorted."""
    faces = F.array(*[F.struct(F.lit(k).alias("face"), F.array(*[F.get("vertices", F.lit(i)) for i in nodes]).alias("nodes")) for k, nodes in enumerate(FACE_NODES)])
    rows = cells.select("cell_id", F.inline(faces)).withColumn("key", F.array_sort("nodes"))
    return rows.select("cell_id", "face", "nodes", *[F.get("key", F.lit(i)).alias(n) for i, n in enumerate("abc")])


def exterior_faces(cells: DataFrame, n_cells: int | None = None) -> DataFrame:
    """(a, b, c, cell_id, face) of faces that one cell only has. n_cells: the number of cells, where it is known."""
    rows = dealt(face_table(cells).drop("nodes"), 4 * (cells.count() if n_cells is None else n_cells), "a", "b", "c")
    return rows.groupBy("a", "b", "c").agg(F.count("*").alias("n"), F.min("cell_id").alias("cell_id"), F.min("face").alias("face")).filter("n = 1").drop("n")


def facet_keys(facets: DataFrame) -> DataFrame:
    """(a, b, c, tag): facets by their three sorted corner nodes."""
    key = F.array_sort(F.slice("nodes", 1, 3))
    return facets.select(*[F.get(key, F.lit(i)).alias(n) for i, n in enumerate("abc")], "tag")


def repeated_facets(facets: DataFrame) -> DataFrame:
    """(a, b, c, n): facets that a surface mesh holds more than once."""
    return facet_keys(facets).groupBy("a", "b", "c").agg(F.count("*").alias("n")).filter("n > 1")


def match_facets(cells: DataFrame, facets: DataFrame) -> DataFrame:
    """(cell_id, face, bc) for every face of every cell: its facet's tag without offset, 0 without a facet.

    Orientation doesn't matter. A facet given twice is an error at run time.
    """
    one = facet_keys(facets).groupBy("a", "b", "c").agg(F.count("*").alias("n"), F.min("tag").alias("tag"))
    found = joined(face_table(cells).select("cell_id", "face", "a", "b", "c"), one, ["a", "b", "c"], "left", 4 * cells.count())
    tag = F.when(F.col("n") > 1, F.raise_error(F.lit("a facet occurs twice in the surface mesh")).cast("int")).otherwise(strip_tag_offset(F.col("tag")))
    return found.select("cell_id", "face", F.coalesce(tag, F.lit(0)).cast("int").alias("bc"))


def tags_by_model_face(cells: DataFrame, classified: DataFrame, model_face_bc: DataFrame) -> DataFrame:
    """(cell_id, face, bc): tags of model faces on the mesh faces classified on them, from all cells that have them.

    classified: (nodes, model_face); model_face_bc: (model_face, bc), a row a model face, where bc 0 means none.
    """
    key = F.array_sort("nodes")
    tagged = classified.join(F.broadcast(model_face_bc.filter("bc <> 0")), "model_face").select(*[F.get(key, F.lit(i)).alias(n) for i, n in enumerate("abc")], "bc")
    return joined(face_table(cells).select("cell_id", "face", "a", "b", "c"), tagged, ["a", "b", "c"], rows=4 * cells.count()).select("cell_id", "face", "bc")


def permute_faces(column: str):
    """Tags in the partitioned format's face order, in this library's."""
    return F.array(*[F.get(column, F.lit(i)) for i in FACE_PERMUTATION])
