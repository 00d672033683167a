"""Encoding of face tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BOUNDARY_SHIFT, boundary_format
from .dealing import joined


def in_range(bc: Column, form: str) -> Column:
    """Whether a format can hold a tag."""
    shift = BOUNDARY_SHIFT[boundary_format(form)]
    return F.lit(True) if shift is None else (bc >= 0) & (bc < 1 << shift)


def encode(face_bcs: DataFrame, cells: DataFrame, form: str = "i32") -> DataFrame:
    """(cell_id, boundary) for every cell.

    i32 and i64 pack 8 and 16 bits a face into one integer, whose top face may make it negative; repeated tags of
    a face are or-ed together. i32x4 lists one integer a face; of repeated tags the last by `ordinal` stays, if
    there is such a column, else the greatest. Tags that a packed format can't hold are an error at run time.
    """
    form = boundary_format(form)
    shift = BOUNDARY_SHIFT[form]
    if shift is None:
        last = F.max_by("bc", "ordinal") if "ordinal" in face_bcs.columns else F.max("bc")
        one = face_bcs.groupBy("cell_id", "face").agg(last.alias("bc"))
        sides = one.groupBy("cell_id").agg(*[F.max(F.when(F.col("face") == k, F.col("bc"))).alias(f"b{k}") for k in range(4)])
        listed = F.array(*[F.coalesce(F.col(f"b{k}"), F.lit(0)).cast("int") for k in range(4)])
        return joined(cells.select("cell_id"), sides, ["cell_id"], "left").select("cell_id", listed.alias("boundary"))
    kind = "int" if form == "i32" else "bigint"
    checked = F.when(in_range(F.col("bc"), form), F.col("bc")).otherwise(F.raise_error(F.lit(f"a boundary tag doesn't fit {form}")).cast("int")).cast(kind)
    moved = F.when(F.col("face") == 0, checked)
    for k in range(1, 4):
        moved = moved.when(F.col("face") == k, F.shiftleft(checked, shift * k))
    packed = face_bcs.filter("bc <> 0").groupBy("cell_id").agg(F.bit_or(moved).alias("boundary"))
    return joined(cells.select("cell_id"), packed, ["cell_id"], "left").select("cell_id", F.coalesce("boundary", F.lit(0).cast(kind)).alias("boundary"))


def decode(boundary: DataFrame, form: str = "i32") -> DataFrame:
    """(cell_id, face, bc) for every face, from encode()'s result."""
    form = boundary_format(form)
    shift = BOUNDARY_SHIFT[form]
    side = (lambda k: F.col("boundary")[k]) if shift is None else (lambda k: F.shiftrightunsigned("boundary", shift * k).bitwiseAND(F.lit((1 << shift) - 1)))
    faces = F.array(*[F.struct(F.lit(k).alias("face"), side(k).cast("int").alias("bc")) for k in range(4)])
    return boundary.select("cell_id", F.inline(faces))
