"""Converted meshes as four tables, a manifest and an XDMF description."""

from __future__ import annotations

import json
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import compact_bytes
from ..mesh import Mesh
from ..operators.boundary import encode
from ..operators.faces import match_facets
from ..schema import boundary_format

# The endings of outputs and the name of the described grid.
OUTPUT_ENDINGS, GRID_NAME = (".puml.h5", ".h5"), "puml mesh"
TABLES = ("connect", "geometry", "group", "boundary")
_KINDS = {1: "tinyint", 2: "smallint", 3: "int", 4: "int"}


def output_name(source: str, output: str | None = None) -> str:
    """The output's name: as given, or the source's without its last extension."""
    if output:
        return output
    stem = source[: source.rfind(".")] if "." in source else source
    return stem + OUTPUT_ENDINGS[0]


def description_name(output: str) -> str:
    """The name of the XDMF description beside an output."""
    for ending in OUTPUT_ENDINGS:
        if output.endswith(ending):
            return output[: -len(ending)] + ".xdmf"
    return f"{output}.xdmf"


def face_tags(mesh: Mesh) -> DataFrame:
    """(cell_id, face, bc[, ordinal]) from the mesh's tags or facets; no rows without either."""
    if mesh.face_bcs is not None:
        return mesh.face_bcs
    if mesh.facets is not None:
        return match_facets(mesh.cells, mesh.facets)
    return mesh.cells.sparkSession.createDataFrame([], "cell_id long, face int, bc int")


def tables(mesh: Mesh, form: str = "i32") -> dict[str, DataFrame]:
    """The four tables, each in the order of its ids when sorted by them."""
    return {
        "connect": mesh.cells.select("cell_id", "vertices"),
        "geometry": mesh.vertices.select("vertex_id", "x", "y", "z"),
        "group": mesh.cells.select("cell_id", "group"),
        "boundary": encode(face_tags(mesh), mesh.cells, form),
    }


def compact(df: DataFrame, column: str) -> DataFrame:
    """A column of non-negative integers, or of arrays of them, in the narrowest type that holds its largest value."""
    many = isinstance(df.schema[column].dataType, T.ArrayType)
    low, high = (F.array_min(column), F.array_max(column)) if many else (F.col(column), F.col(column))
    bounds = df.agg(F.min(low).cast("bigint").alias("low"), F.coalesce(F.max(high), F.lit(0)).cast("bigint").alias("high")).first()
    if bounds["low"] is not None and bounds["low"] < 0:
        return df
    width = df.sparkSession.range(1).select(compact_bytes(F.lit(bounds["high"])).alias("n")).first()["n"]
    # types are signed: a value that needs all bits of a width goes one wider
    size = next((k for k in range(max(1, width), 9) if bounds["high"] < 1 << (8 * k - 1)), 8)
    kind = _KINDS.get(size, "bigint")
    return df.withColumn(column, F.col(column).cast(f"array<{kind}>" if many else kind))


def xdmf(base: str, cells: int, vertices: int, form: str) -> str:
    """The description of a mesh of tetrahedra as one HDF5 container would hold it; this sink's tables hold the same arrays by the same names."""
    precision, second = (8, "") if form == "i64" else (4, " 4" if form == "i32x4" else "")

    def item(kind: str, size: int, dims: str, name: str) -> str:
        return f'    <DataItem NumberType="{kind}" Precision="{size}" Format="HDF" Dimensions="{dims}">{base}:/{name}</DataItem>\n'

    return (
        '<?xml version="1.0" ?>\n<!DOCTYPE Xdmf SYSTEM "Xdmf.dtd" []>\n<Xdmf Version="2.0">\n <Domain>\n'
        f'  <Grid Name="{GRID_NAME}" GridType="Uniform">\n'
        f'   <Topology TopologyType="Tetrahedron" NumberOfElements={quoteattr(str(cells))}>\n{item("Int", 8, f"{cells} 4", "connect")}   </Topology>\n'
        f'   <Geometry name="geo" GeometryType="XYZ" NumberOfElements={quoteattr(str(vertices))}>\n{item("Float", 8, f"{vertices} 3", "geometry")}   </Geometry>\n'
        f'   <Attribute Name="group" Center="Cell">\n{item("Int", 4, str(cells), "group")}   </Attribute>\n'
        f'   <Attribute Name="boundary" Center="Cell">\n{item("Int", precision, f"{cells}{second}", "boundary")}   </Attribute>\n'
        "  </Grid>\n </Domain>\n</Xdmf>\n"
    )


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text file through Spark's file systems."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def _get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def write(mesh: Mesh, path: str, form: str = "i32", compactify: bool = False, compression: str = "zstd", rows_a_file: int = 0) -> dict:
    """Writes the tables sorted by id below path, with manifest.json and mesh.xdmf; returns the manifest.

    compactify narrows vertex numbers' and groups' integers by their largest values. rows_a_file 0: as Spark does.
    """
    spark, form = mesh.cells.sparkSession, boundary_format(form)
    parts = tables(mesh, form)
    if compactify:
        parts["group"], parts["connect"] = compact(parts["group"], "group"), compact(parts["connect"], "vertices")
    for name, df in parts.items():
        df.orderBy(df.columns[0]).write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", rows_a_file).parquet(f"{path}/{name}")
    size = spark.read.parquet(f"{path}/connect").select(F.count("*").alias("n"), F.max(F.size("vertices")).alias("k")).first()
    manifest = {
        "cell_count": size["n"], "vertex_count": spark.read.parquet(f"{path}/geometry").count(), "cell_size": size["k"] or 4,
        "vertex_size": 3, "order": mesh.order, "boundary_format": form,
    }
    _put_text(spark, f"{path}/manifest.json", json.dumps(manifest, indent=1))
    _put_text(spark, f"{path}/mesh.xdmf", xdmf(path.rstrip("/").rsplit("/", 1)[-1], manifest["cell_count"], manifest["vertex_count"], form))
    return manifest


def read(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The four tables and the manifest that write() left."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}, json.loads(_get_text(spark, f"{path}/manifest.json"))
