"""Mesh sizes that follow wave lengths in refinement cuboids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import UNBOUNDED, wave_speed

#: Cuboids up to this number are broadcast against all points; more are an error, as a settings file lists them one by one.
MOST_CUBOIDS = 10_000


def with_rotation(cuboids: DataFrame) -> DataFrame:
    """cuboids with c and s, the cosine and sine of their rotation about z in degrees."""
    return cuboids.withColumns({"c": F.cos(F.radians("rotation")), "s": F.sin(F.radians("rotation"))})


def targeted(points: DataFrame, cuboids: DataFrame) -> DataFrame:
    """points with frequency, the highest of the cuboids they lie in (0 outside all), and bypass_group of that cuboid.

    cuboids: (ordinal, frequency, cx, cy, cz, hx, hy, hz, c, s, bypass_group). Sides belong to a cuboid. Of cuboids
    with the same frequency the last one counts.
    """
    n = cuboids.count()
    if n > MOST_CUBOIDS:
        raise ValueError(f"{n} refinement cuboids; at most {MOST_CUBOIDS} are supported")
    inside = F.expr("""abs((x - cx) * c + (y - cy) * s) <= hx
        and abs((x - cx) * -s + (y - cy) * c) <= hy and abs(z - cz) <= hz""")
    near = points.select("point_id", "x", "y", "z").join(F.broadcast(cuboids), inside)
    best = near.groupBy("point_id").agg(F.max(F.struct("frequency", "ordinal", "bypass_group")).alias("best"))
    return points.join(best, "point_id", "left").select(
        *points.columns, F.coalesce("best.frequency", F.lit(0.0)).alias("frequency"), F.coalesce("best.bypass_group", F.lit(0)).cast("int").alias("bypass_group")
    )


def locate(points: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """points with region_group: 1 if there is one region (no boxes), else that of the first box, by ordinal, that has
    the point, or -1. boxes: (ordinal, region_group, x0, x1, y0, y1, z0, z1), a model's regions."""
    if boxes is None:
        return points.withColumn("region_group", F.lit(1))
    if boxes.count() > MOST_CUBOIDS:
        raise ValueError(f"at most {MOST_CUBOIDS} regions are supported")
    inside = F.expr("x between x0 and x1 and y between y0 and y1 and z between z0 and z1")
    first = points.select("point_id", "x", "y", "z").join(F.broadcast(boxes), inside).groupBy("point_id").agg(F.min_by("region_group", "ordinal").alias("region_group"))
    return points.join(first, "point_id", "left").withColumn("region_group", F.coalesce("region_group", F.lit(-1)))


def mesh_size(points: DataFrame, cuboids: DataFrame, materials: DataFrame, elements_per_wave: float, boxes: DataFrame | None = None) -> DataFrame:
    """points with frequency, the material group that counts and mesh_size.

    materials: (group, lambda, mu, rho). A point outside all cuboids, or of a group of 0 or less, has UNBOUNDED;
    one whose group has no material too.
    """
    found = locate(targeted(points, cuboids), boxes)
    found = found.withColumn("material", F.when(F.col("bypass_group") != 0, F.col("bypass_group")).otherwise(F.col("region_group")))
    speeds = materials.select(F.col("group").alias("material"), wave_speed(F.col("lambda"), F.col("mu"), F.col("rho")).alias("speed"))
    size = F.when((F.col("frequency") == 0) | (F.col("material") <= 0) | F.col("speed").isNull(), F.lit(UNBOUNDED)).otherwise(F.col("speed") / F.nullif(F.col("frequency"), F.lit(0.0)) / F.lit(float(elements_per_wave)))
    return found.join(speeds, "material", "left").select(*points.columns, "frequency", "material", size.alias("mesh_size"))
