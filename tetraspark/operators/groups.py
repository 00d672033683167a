"""Groups of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dealing import joined


def assign_groups(cells: DataFrame, element_groups: DataFrame) -> DataFrame:
    """cells with the group listed for each, 0 for those that no list has; of several the last by `ordinal`, else the greatest."""
    pick = F.max_by("group", "ordinal") if "ordinal" in element_groups.columns else F.max("group")
    one = element_groups.groupBy("cell_id").agg(pick.cast("int").alias("found"))
    rest = [c for c in cells.columns if c != "group"]
    return joined(cells, one, ["cell_id"], "left").select(*rest, F.coalesce("found", F.lit(0)).alias("group"))


def entity_tags(elements: DataFrame, entities: DataFrame) -> DataFrame:
    """elements (.., dim, entity_tag) with tag: the entity's physical tag, 0 without one."""
    known = entities.select("dim", "entity_tag", "physical_tag")
    return elements.join(known, ["dim", "entity_tag"], "left").withColumn("tag", F.coalesce("physical_tag", F.lit(0)).cast("int")).drop("physical_tag")


def region_groups(cells: DataFrame, regions: DataFrame, base: int = 0) -> DataFrame:
    """cells (cell_id, region) with group: the region's place among the model's regions, from base on.

    regions: (region, ordinal), few. A cell in an unknown region is an error at run time.
    """
    numbered = regions.select("region", (F.row_number().over(Window.orderBy("ordinal")) - 1 + base).alias("group"))
    unknown = F.raise_error(F.lit("a cell lies in an unknown region")).cast("int")
    return cells.drop("group").join(numbered, "region", "left").withColumn("group", F.coalesce("group", unknown))


def owned(rows: DataFrame) -> DataFrame:
    """Rows that this part owns."""
    return rows.filter("is_owned")


def owned_counts(rows: DataFrame) -> DataFrame:
    """(part, total, owned, first): first is the number of owned rows in all parts before."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy("part").agg(F.count("*").alias("total"), F.count_if("is_owned").alias("owned"))
    return counted.withColumn("first", F.coalesce(F.sum("owned").over(before), F.lit(0)).cast("bigint"))
