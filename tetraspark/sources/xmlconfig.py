"""Meshing settings and boundary conditions from XML with several roots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import int_list, single_precision

# The settings' elements and attributes, and what holds where they are absent.
_SIZES = {"vertexMSize": "vertex", "edgeMSize": "edge", "surfaceMSize": "face", "regionMSize": "region"}
_PLAIN_TAGS = {"freeSurface": 1, "dynamicRupture": 3, "absorbing": 5}
_GLOBALS = ("globalMSize", "gradation", "area_AspectRatio", "vol_AspectRatio")
_DEFAULTS = {
    "surface_smoothing_level": 2, "surface_smoothing_type": "Gradient", "surface_angle": 5.0, "surface_snap": 0,
    "volume_smoothing_level": 1, "volume_smoothing_type": "Gradient", "volume_optimisation": 1,
}
_CUBOID = "frequency centerX centerY centerZ halfSizeX halfSizeY halfSizeZ".split()


def _schema() -> str:
    text = "_TEXT string"
    listed = lambda attributes: f"array<struct<{text.replace(' ', ':')}{''.join(f',_{a}:string' for a in attributes)}>>"
    vector = "array<struct<_x:string,_y:string,_z:string>>"
    fields = [f"{n} {listed([])}" for n in (*_PLAIN_TAGS, "surfaceNoMesh", "regionNoMesh")]
    fields += [f"{n} {listed(['value'])}" for n in (*_SIZES, *_GLOBALS)]
    fields += [f"boundaryCondition {listed(['tag'])}", f"UseDiscreteMesh {listed(['noModification'])}", f"MeshSizePropagation {listed(['ScalingFactor', 'Distance'])}"]
    fields += [f"SurfaceMeshing {listed(['SmoothingLevel', 'SmoothingType', 'DiscreteAngle', 'Snap'])}", f"VolumeMeshing {listed(['SmoothingLevel', 'SmoothingType', 'SetOptimisation'])}"]
    fields += [f"MeshRefinementZoneCube array<struct<_value:string,Center:{vector},HalfWidth:{vector},HalfHeight:{vector},HalfDepth:{vector}>>"]
    cuboid = ",".join(f"_{a}:string" for a in (*_CUBOID, "rotationZAnticlockwiseFromX", "bypassFindRegionAndUseGroup"))
    fields += [f"VelocityAwareMeshing array<struct<_easiFile:string,_elementsPerWaveLength:string,VelocityRefinementCuboid:array<struct<{cuboid}>>>>"]
    return ", ".join(fields)


def parse(text: DataFrame, column: str = "value") -> DataFrame:
    """One column `xml` with all settings of each document."""
    body = F.regexp_replace(F.regexp_replace(F.col(column), r"(?s)<\?xml.*?\?>", ""), r"(?s)<!--.*?-->", "")
    return text.select(F.from_xml(F.concat(F.lit("<root>"), body, F.lit("</root>")), _schema(), {"valueTag": "_TEXT", "mode": "FAILFAST"}).alias("xml"))


def _first(name: str) -> Column:
    return F.try_element_at(F.col(f"xml.{name}"), F.lit(1))


def _real(text: Column) -> Column:
    return F.trim(text).cast("double")


def boundary_conditions(xml: DataFrame) -> DataFrame:
    """(model_face, bc): faces from 1. Of the plainly named elements only the first counts; a face may have several tags."""
    rows = [xml.select(F.explode(int_list(_first(n)["_TEXT"])).alias("model_face"), F.lit(tag).alias("bc")) for n, tag in _PLAIN_TAGS.items()]
    rows.append(xml.select(F.explode("xml.boundaryCondition").alias("e")).select(F.explode(int_list(F.col("e._TEXT"))).alias("model_face"), F.col("e._tag").cast("int").alias("bc")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def entity_sizes(xml: DataFrame) -> DataFrame:
    """(kind, id, size) asked of single vertices, edges, faces and regions."""
    parts = [xml.select(F.explode(f"xml.{n}").alias("e")).select(F.lit(kind).alias("kind"), F.explode(int_list(F.col("e._TEXT"))).alias("id"), _real(F.col("e._value")).alias("size")) for n, kind in _SIZES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def id_lists(xml: DataFrame) -> DataFrame:
    """(kind, id): faces and regions without a mesh, faces with a given mesh, and faces that sizes spread from."""
    names = {"surfaceNoMesh": "face without mesh", "regionNoMesh": "region without mesh", "UseDiscreteMesh": "face with given mesh", "MeshSizePropagation": "face that sizes spread from"}
    out = None
    for n, kind in names.items():
        rows = xml.select(F.lit(kind).alias("kind"), F.explode(int_list(_first(n)["_TEXT"])).alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _attribute(element: str, name: str, default, kind: str) -> Column:
    """An attribute; the default without the element, an error without the attribute."""
    e = _first(element)
    missing = F.raise_error(F.lit(f"XML element {element} has no attribute {name}")).cast(kind)
    return F.when(e.isNull(), F.lit(default).cast(kind)).otherwise(F.coalesce(F.trim(e[f"_{name}"]).cast(kind), missing))


def _smoothing(element: str, default: str) -> Column:
    kind = _attribute(element, "SmoothingType", default, "string")
    return F.when(kind.isin("Laplacian", "Gradient"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown smoothing type: "), kind)).cast("string"))


def scalars(xml: DataFrame) -> DataFrame:
    """One row of single settings; null or 0 where a setting isn't active."""
    d = _DEFAULTS
    return xml.select(
        *[_attribute(n, "value", 0.0, "double").alias(n) for n in _GLOBALS],
        _attribute("SurfaceMeshing", "SmoothingLevel", d["surface_smoothing_level"], "int").alias("surface_smoothing_level"),
        _smoothing("SurfaceMeshing", d["surface_smoothing_type"]).alias("surface_smoothing_type"),
        _attribute("SurfaceMeshing", "DiscreteAngle", d["surface_angle"], "double").alias("surface_angle"),
        _attribute("SurfaceMeshing", "Snap", d["surface_snap"], "int").alias("surface_snap"),
        _attribute("VolumeMeshing", "SmoothingLevel", d["volume_smoothing_level"], "int").alias("volume_smoothing_level"),
        _smoothing("VolumeMeshing", d["volume_smoothing_type"]).alias("volume_smoothing_type"),
        _attribute("VolumeMeshing", "SetOptimisation", d["volume_optimisation"], "int").alias("volume_optimisation"),
        _attribute("UseDiscreteMesh", "noModification", 0, "int").alias("discrete_no_modification"),
        _attribute("MeshSizePropagation", "ScalingFactor", 0.0, "double").alias("propagation_factor"),
        _attribute("MeshSizePropagation", "Distance", 0.0, "double").alias("propagation_distance"),
    )


def refinement_cubes(xml: DataFrame) -> DataFrame:
    """(ordinal, size, center, width, height, depth): the last four arrays of x, y, z."""
    vector = lambda n: F.array(*[F.coalesce(_real(F.col(f"e.{n}")[0][f"_{a}"]), F.lit(0.0)) for a in "xyz"])
    rows = xml.select(F.posexplode("xml.MeshRefinementZoneCube").alias("ordinal", "e"))
    return rows.select("ordinal", _real(F.col("e._value")).alias("size"), *[vector(n).alias(c) for n, c in (("Center", "center"), ("HalfWidth", "width"), ("HalfHeight", "height"), ("HalfDepth", "depth"))])


def _waves(xml: DataFrame) -> DataFrame:
    many = F.raise_error(F.lit("VelocityAwareMeshing is defined more than once"))
    e = F.when(F.size("xml.VelocityAwareMeshing") > 1, many.cast("string").isNotNull()).otherwise(F.lit(True))
    return xml.filter(F.size("xml.VelocityAwareMeshing") >= 1).filter(e).select(F.col("xml.VelocityAwareMeshing")[0].alias("w"))


def wave_settings(xml: DataFrame) -> DataFrame:
    """(easi_file, elements_per_wave, cuboids): at most one row. Numbers went through single precision."""
    return _waves(xml).select(F.col("w._easiFile").alias("easi_file"), single_precision(_real(F.col("w._elementsPerWaveLength"))).alias("elements_per_wave"), F.coalesce(F.size("w.VelocityRefinementCuboid"), F.lit(0)).alias("cuboids"))


def cuboids(xml: DataFrame) -> DataFrame:
    """(ordinal, frequency, cx, cy, cz, hx, hy, hz, rotation, bypass_group); see operators.sizing."""
    rows = _waves(xml).select(F.posexplode("w.VelocityRefinementCuboid").alias("ordinal", "e"))
    real = lambda a: single_precision(_real(F.col(f"e._{a}")))
    names = ("frequency", "cx", "cy", "cz", "hx", "hy", "hz")
    return rows.select(
        "ordinal", *[real(a).alias(n) for a, n in zip(_CUBOID, names, strict=True)],
        F.coalesce(real("rotationZAnticlockwiseFromX"), F.lit(0.0)).alias("rotation"), F.coalesce(F.trim("e._bypassFindRegionAndUseGroup").cast("int"), F.lit(0)).alias("bypass_group"),
    )


@dataclass(frozen=True)
class MeshConfig:
    """All settings of one document as tables."""

    boundary_conditions: DataFrame
    entity_sizes: DataFrame
    id_lists: DataFrame
    scalars: DataFrame
    refinement_cubes: DataFrame
    wave_settings: DataFrame
    cuboids: DataFrame

    def rows(self) -> DataFrame:
        """(kind, entity, id, params): every setting as a row, params as JSON."""
        j = lambda *c: F.to_json(F.struct(*c))
        out = [
            self.boundary_conditions.select(F.lit("boundary condition").alias("kind"), F.lit("face").alias("entity"), F.col("model_face").alias("id"), j("bc").alias("params")),
            self.entity_sizes.select(F.lit("size").alias("kind"), F.col("kind").alias("entity"), "id", j("size").alias("params")),
            self.id_lists.select(F.lit("list").alias("kind"), F.col("kind").alias("entity"), "id", F.lit("{}").alias("params")),
            self.scalars.select(F.lit("scalars").alias("kind"), F.lit("mesh").alias("entity"), F.lit(0).alias("id"), j(*self.scalars.columns).alias("params")),
            self.refinement_cubes.select(F.lit("cube").alias("kind"), F.lit("zone").alias("entity"), F.col("ordinal").alias("id"), j(*self.refinement_cubes.columns).alias("params")),
            self.wave_settings.select(F.lit("waves").alias("kind"), F.lit("mesh").alias("entity"), F.lit(0).alias("id"), j(*self.wave_settings.columns).alias("params")),
            self.cuboids.select(F.lit("cuboid").alias("kind"), F.lit("zone").alias("entity"), F.col("ordinal").alias("id"), j(*self.cuboids.columns).alias("params")),
        ]
        every = out[0]
        for o in out[1:]:
            every = every.unionByName(o)
        return every


def config_of(text: DataFrame, column: str = "value") -> MeshConfig:
    xml = parse(text, column)
    return MeshConfig(boundary_conditions(xml), entity_sizes(xml), id_lists(xml), scalars(xml), refinement_cubes(xml), wave_settings(xml), cuboids(xml))


def read(spark: SparkSession, path: str) -> MeshConfig:
    return config_of(spark.read.text(path, wholetext=True))
