"""A mesh as a holder of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Mesh:
    """vertices and cells always; tagged facets, or tags by cell and face, if the source has them (see schema)."""

    vertices: DataFrame
    cells: DataFrame
    facets: DataFrame | None = None
    face_bcs: DataFrame | None = None
    order: int = 1

    def with_(self, **changes) -> Mesh:
        return replace(self, **changes)
