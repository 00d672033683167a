"""Distinct vertices with dense ids, offsets and distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import positive_zero, truncate_low_bits
from .dealing import dealt, joined
from .numbering import numbered

_AXES = ("x", "y", "z")


def _keyed(raw: DataFrame, tolerance: str) -> DataFrame:
    if tolerance not in ("exact", "truncate"):
        raise ValueError(f"tolerance must be 'exact' or 'truncate', not {tolerance!r}")
    key = (lambda c: positive_zero(truncate_low_bits(c))) if tolerance == "truncate" else positive_zero
    return raw.withColumns({f"k{a}": key(F.col(a)) for a in _AXES})


def distinct_vertices(raw: DataFrame, tolerance: str = "exact") -> DataFrame:
    """(vertex_id, x, y, z, kx, ky, kz): ids from 0 in the order of x, y, z.

    Of vertices that 'truncate' merges the least one stands for all.
    """
    keyed = _keyed(raw, tolerance).groupBy("kx", "ky", "kz").agg(F.min(F.struct(*[positive_zero(F.col(a)).alias(a) for a in _AXES])).alias("v"))
    found = numbered(keyed.select("v.x", "v.y", "v.z", "kx", "ky", "kz"), ["kx", "ky", "kz"], "vertex_id")
    return found.select("vertex_id", *_AXES, "kx", "ky", "kz")


def global_ids(raw: DataFrame, distinct: DataFrame, tolerance: str = "exact") -> DataFrame:
    """raw with the vertex_id of each row."""
    keyed = _keyed(raw, tolerance)
    return joined(keyed, distinct.select("kx", "ky", "kz", "vertex_id"), ["kx", "ky", "kz"]).select(*raw.columns, "vertex_id")


def part_offsets(rows: DataFrame, part: str = "part") -> DataFrame:
    """(part, n, start): rows of each part, and those of all parts before it. One row a part."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy(part).agg(F.count("*").alias("n"))
    return counted.select(part, "n", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("start"))


def connect(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """Part-local vertex numbers of cells (part, local_cell, v) as global ones: (part, local_cell, vertices)."""
    corner = cells.select("part", "local_cell", F.posexplode("v").alias("at", "local_id"))
    rows = 4 * cells.count()
    found = dealt(joined(corner, ids.select("part", "local_id", "vertex_id"), ["part", "local_id"], rows=rows), rows, "part", "local_cell")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "vertex_id"))), lambda s: s["vertex_id"])
    return found.groupBy("part", "local_cell").agg(listed.alias("vertices"))


def block_size(total: int, block: int, blocks: int) -> int:
    """Rows of a block when the first ones have one more."""
    return total // blocks + (block < total % blocks)


def block_start(total: int, block: int, blocks: int) -> int:
    return block * (total // blocks) + min(block, total % blocks)


def block_of(row: Column, total: int, blocks: int) -> Column:
    """The block of a row number from 0."""
    size, longer = divmod(total, blocks)
    cut = longer * (size + 1)
    return F.when(row < cut, F.expr("0") + F.floor(row / (size + 1))).otherwise(longer + F.floor((row - cut) / max(size, 1))).cast("int")
