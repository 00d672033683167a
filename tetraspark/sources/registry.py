"""Readers by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..mesh import Mesh
from . import gambit, gmsh, partitioned

#: Sources that need kernels that aren't open, or a library that isn't here; meshes exported from them can be read as 'partitioned'.
CLOSED, MISSING = ("apf", "simmodsuite", "simmodsuite-apf"), ("netcdf",)


def _gmsh(major: int):
    def read(spark: SparkSession, path: str, order: int = 1) -> Mesh:
        return gmsh.read(spark, path, order, major)

    return read


READERS = {"gambit": gambit.read, "msh2": _gmsh(2), "msh4": _gmsh(4), "partitioned": partitioned.read}


def read_mesh(spark: SparkSession, path: str, source: str = "gambit", **options) -> Mesh:
    if source in CLOSED:
        raise ValueError(f"source {source!r} needs a closed library; export its mesh to the partitioned tables")
    if source in MISSING:
        raise ValueError(f"source {source!r} needs a library that isn't here; export its variables to the partitioned tables")
    if source not in READERS:
        raise ValueError(f"unknown source {source!r}: one of {sorted(READERS)}")
    return READERS[source](spark, path, **options)
