"""Schemas of the canonical tables and fixed tables of element types and faces."""

from __future__ import annotations

from math import comb

VERTICES = "vertex_id bigint, x double, y double, z double"
CELLS = "cell_id bigint, vertices array<bigint>, `group` int"
FACETS = "facet_id bigint, nodes array<bigint>, tag int"
FACE_BCS = "cell_id bigint, face int, bc int"
ENTITIES = "dim int, entity_tag bigint, physical_tag int"

# The nodes of a tetrahedron's faces, and where the partitioned format keeps each face.
FACE_NODES = ((1, 0, 2), (0, 1, 3), (1, 2, 3), (2, 0, 3))
FACE_PERMUTATION = (0, 1, 3, 2)

# Element type codes of the mesh format by dimension, for orders 1 to 10.
ELEMENT_TYPES = {
    0: (15, 15, 15, 15, 15, 15, 15, 15, 15, 15),
    1: (1, 8, 26, 27, 28, 62, 63, 64, 65, 66),
    2: (2, 9, 21, 23, 25, 42, 43, 44, 45, 46),
    3: (4, 11, 29, 30, 31, 71, 72, 73, 74, 75),
}

#: Bits of a face in a packed boundary; None: one integer a face.
BOUNDARY_SHIFT = {"i32": 8, "i64": 16, "i32x4": None}
BOUNDARY_NAMES = {"int32": "i32", "int64": "i64", "i32": "i32", "i64": "i64", "i32x4": "i32x4"}


def simplex_nodes(dim: int, order: int) -> int:
    """Nodes of a simplex element."""
    return comb(dim + order, dim)


def element_type(dim: int, order: int) -> int:
    if order not in range(1, 11):
        raise ValueError(f"order must be between 1 and 10, not {order}")
    return ELEMENT_TYPES[dim][order - 1]


def boundary_format(name: str) -> str:
    if name not in BOUNDARY_NAMES:
        raise ValueError(f"unknown boundary format {name!r}: one of {sorted(BOUNDARY_NAMES)}")
    return BOUNDARY_NAMES[name]
