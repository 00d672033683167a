"""A conversion from source to sink."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..mesh import Mesh
from ..operators.faces import repeated_facets
from ..operators.geometry import aspect_ratio
from ..operators.quality import ratio_histogram, summary
from ..operators.validate import dangling_corners, require_empty
from ..sinks import columnar
from ..sources.registry import read_mesh
from ..storage import working_folder


def materialise(mesh: Mesh, folder: str) -> Mesh:
    """The mesh with its tables written once, since checks, summary and sink all read them."""

    def kept(df, name: str):
        if df is None:
            return None
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.parquet(f"{folder}/{name}")

    return mesh.with_(vertices=kept(mesh.vertices, "vertices"), cells=kept(mesh.cells, "cells"), facets=kept(mesh.facets, "facets"), face_bcs=kept(mesh.face_bcs, "face_bcs"))


def check(mesh: Mesh) -> None:
    """Raises for corners without a vertex and for facets given twice."""
    require_empty(dangling_corners(mesh.cells, mesh.vertices), "a cell's corner has no vertex")
    if mesh.facets is not None:
        require_empty(repeated_facets(mesh.facets), "a facet occurs twice in the surface mesh")


def convert(
    spark: SparkSession, source_path: str, output: str | None = None, source: str = "gambit", boundary: str = "i32", compactify: bool = False, compression: str = "zstd",
    rows_a_file: int = 0, aspect_ratios: bool = False, **options,
) -> dict:
    """Reads, checks and writes a mesh; returns the manifest with the smallest insphere, and the histogram of aspect ratios if asked for.

    Without an output it is named after the source (columnar.output_name). compression and rows_a_file: as columnar.write().
    """
    mesh = materialise(read_mesh(spark, source_path, source, **options), working_folder(spark, "convert"))
    check(mesh)
    found = summary(mesh).select(F.col("min_insphere"), "degenerate_cells").first().asDict()
    if aspect_ratios:
        found["aspect_ratios"] = [r.asDict() for r in ratio_histogram(aspect_ratio(mesh.cells, mesh.vertices)).orderBy("bin").collect()]
    return columnar.write(mesh, columnar.output_name(source_path, output), boundary, compactify, compression, rows_a_file) | found
