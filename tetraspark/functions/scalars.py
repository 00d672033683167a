"""Scalar column functions of mesh conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest double, the mesh size where nothing asks for a finer one.
UNBOUNDED = 1.7976931348623157e308


def truncate_low_bits(x: Column) -> Column:
    """x with the four lowest bits of its binary pattern cleared (finite normal numbers and zero)."""
    magnitude = F.abs(x)
    guess = F.floor(F.log2(magnitude)).cast("double")
    exponent = guess - F.when(F.pow(F.lit(2.0), guess) > magnitude, 1.0).otherwise(0.0)
    unit = F.pow(F.lit(2.0), exponent - 48)
    cut = F.when(x < 0, F.ceil(x / unit)).otherwise(F.floor(x / unit)).cast("double") * unit
    return F.when(x == 0, x).otherwise(cut)


def positive_zero(x: Column) -> Column:
    """x, with negative zero made positive."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def bit_length(n: Column) -> Column:
    """Bits that a non-negative integer takes; none for 0."""
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n.cast("bigint"))))


def compact_bytes(most: Column) -> Column:
    """Bytes that hold integers up to `most`."""
    return F.ceil(bit_length(most) / 8).cast("int")


def strip_tag_offset(tag: Column) -> Column:
    """A tag without the offset of 100 that some mesh generators add."""
    return F.when(tag >= 100, tag - 100).otherwise(tag)


def tag_of_set_name(name: Column) -> Column:
    """The number at the end of a set's name, 0 without one, without the offset."""
    digits = F.regexp_extract(name, r"([0-9]*)$", 1)
    return strip_tag_offset(F.when(digits == "", 0).otherwise(F.expr("0") + digits.try_cast("int")))


def boundary_code(name: Column) -> Column:
    """The code of a boundary's name; other names are an error."""
    number = F.regexp_extract(name, r"^BC([0-9]{9})$", 1)
    return (
        F.when(name == "freeSurface", 1)
        .when(name == "dynamicRupture", 3)
        .when(name == "absorbing", 5)
        .when(number != "", F.expr("0") + number.try_cast("int"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown boundary condition: "), name)).cast("int"))
    )


def boundary_name(code: Column) -> Column:
    return F.concat(F.lit("BC"), F.lpad(code.cast("string"), 9, "0"))


def int_list(text: Column) -> Column:
    """Integers of a comma-separated list; what isn't a number counts as 0, as far as digits go."""
    number = lambda t: F.coalesce(F.regexp_extract(t, r"^\s*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))
    return F.transform(F.split(F.regexp_replace(text, ",$", ""), ","), number)


def single_precision(x: Column) -> Column:
    """A double that went through a float."""
    return x.cast("float").cast("double")


def wave_speed(lam: Column, mu: Column, rho: Column) -> Column:
    """Of shear waves, or of pressure waves in a fluid."""
    return F.when(mu < 1e-13, F.sqrt((lam + 2 * mu) / rho)).otherwise(F.sqrt(mu / rho))
