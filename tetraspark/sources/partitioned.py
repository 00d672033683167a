"""Meshes in parts with local vertex numbers, as Parquet tables of the partitioned format's variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mesh import Mesh
from ..operators.dealing import dealt, joined
from ..operators.faces import permute_faces
from ..operators.groups import owned
from ..operators.numbering import numbered
from ..operators.vertices import connect, distinct_vertices, global_ids


def assemble(raw_vertices: DataFrame, raw_cells: DataFrame, tolerance: str = "exact") -> Mesh:
    """raw_vertices: (part, local_id, x, y, z); raw_cells: (part, local_cell, v, b, group), the group optional.

    Vertices that several parts have become one. Tags come in the format's face order. A group not given is 0.
    """
    distinct = distinct_vertices(raw_vertices.select("x", "y", "z"), tolerance)
    ids = global_ids(raw_vertices, distinct, tolerance)
    group = F.coalesce(F.col("group"), F.lit(0)) if "group" in raw_cells.columns else F.lit(0)
    rest = raw_cells.select("part", "local_cell", permute_faces("b").alias("b"), group.cast("int").alias("group"))
    cells = numbered(joined(connect(raw_cells, ids), rest, ["part", "local_cell"]), ["part", "local_cell"], "cell_id")
    bcs = cells.select("cell_id", F.posexplode("b").alias("face", "bc")).filter("bc <> 0")
    return Mesh(distinct.select("vertex_id", "x", "y", "z"), cells.select("cell_id", "vertices", "group"), face_bcs=bcs)


def read(spark: SparkSession, path: str, tolerance: str = "exact") -> Mesh:
    """A folder with raw_vertices.parquet and raw_cells.parquet."""
    return assemble(spark.read.parquet(f"{path}/raw_vertices.parquet"), spark.read.parquet(f"{path}/raw_cells.parquet"), tolerance)


def owned_entities(vertices: DataFrame, cells: DataFrame, tags: DataFrame | None = None) -> Mesh:
    """A mesh of parts that mark what they own: vertices (part, vertex_key, x, y, z, is_owned), cells (part, cell_key,
    vertex_keys, group, is_owned), tags (nodes of vertex keys, tag). Only owned entities count; ids follow the keys."""
    v = numbered(owned(vertices).select("vertex_key", "x", "y", "z"), ["vertex_key"], "vertex_id")
    c = numbered(owned(cells).select("cell_key", "vertex_keys", "group"), ["cell_key"], "cell_id")
    ids = v.select("vertex_key", "vertex_id")

    def renamed(df: DataFrame, key: str, column: str) -> DataFrame:
        rows = 4 * df.count()
        found = dealt(joined(df.select(key, F.posexplode(column).alias("at", "vertex_key")), ids, ["vertex_key"], rows=rows), rows, key)
        return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "vertex_id"))), lambda s: s["vertex_id"]).alias("vertices"))

    found = joined(c.select("cell_id", "group"), renamed(c, "cell_id", "vertex_keys"), ["cell_id"]).select("cell_id", "vertices", F.col("group").cast("int").alias("group"))
    facets = None
    if tags is not None:
        marked = tags.withColumn("facet_id", F.monotonically_increasing_id())
        facets = joined(renamed(marked, "facet_id", "nodes"), marked.select("facet_id", "tag"), ["facet_id"]).select("facet_id", F.col("vertices").alias("nodes"), "tag")
    return Mesh(v.select("vertex_id", "x", "y", "z"), found, facets)
