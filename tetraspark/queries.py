"""Queries over the driver's tables, one for each operator, and their SQL.

No mesh lies among the tables, so meshes are projections of them: part as a box of hexahedra, part numbers
as random tetrahedra on the first coordinates of embeddings, and quantities of line items as vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars
from .mesh import Mesh
from .operators import boundary, faces, geometry, groups, quality, sizing, validate, vertices
from .operators.dealing import dealt, joined
from .operators.numbering import numbered
from .schema import ELEMENT_TYPES, simplex_nodes
from .sinks import columnar
from .sources import gambit, gmsh, partitioned, xmlconfig
from .sources.boxmesh import TETRAHEDRA, box
from .sources.tables import table
from .storage import stored, working_folder
from .streaming.monitor import group_counts

#: A settings document with every kind of element; @K@ stands for a number of its own.
SETTINGS = """<?xml version="1.0"?><!-- settings of mesh @K@ -->
<freeSurface>4</freeSurface><dynamicRupture>6, 1@K@</dynamicRupture><absorbing>7,8</absorbing>
<boundaryCondition tag="71">2@K@</boundaryCondition><boundaryCondition tag="66">11,12</boundaryCondition>
<globalMSize value="3@K@.5"/><gradation value="0.75"/><area_AspectRatio value="4"/><vol_AspectRatio value="6e1"/>
<vertexMSize value="12">3,@K@</vertexMSize><edgeMSize value="7.5">9</edgeMSize><surfaceMSize value="1@K@">5,3</surfaceMSize><regionMSize value="8e2">2</regionMSize>
<MeshSizePropagation Distance="25@K@" ScalingFactor="2.5">3,9</MeshSizePropagation>
<SurfaceMeshing SmoothingLevel="4" SmoothingType="Laplacian" DiscreteAngle="7.5" Snap="0"/>
<MeshRefinementZoneCube value="45@K@"><Center x="1" y="-2" z="@K@"/><HalfWidth x="3" y="0.5" z="0"/><HalfHeight x="0" y="4" z="0"/><HalfDepth x="0" y="0" z="5"/></MeshRefinementZoneCube>
<UseDiscreteMesh noModification="1">8</UseDiscreteMesh><surfaceNoMesh>6,7</surfaceNoMesh><regionNoMesh>3</regionNoMesh>
<VelocityAwareMeshing easiFile="ground@K@.yaml" elementsPerWaveLength="3">
  <VelocityRefinementCuboid frequency="4" centerX="0.5" centerY="@K@" centerZ="-1" halfSizeX="2" halfSizeY="1.5" halfSizeZ="0.25" rotationZAnticlockwiseFromX="45"/>
  <VelocityRefinementCuboid frequency="8" centerX="0" centerY="0.25" centerZ="0" halfSizeX="0.5" halfSizeY="0.5" halfSizeZ="0.75" bypassFindRegionAndUseGroup="2"/>
</VelocityAwareMeshing>
"""

#: Rows of cuboids (ordinal, frequency, cx, cy, cz, hx, hy, hz, c, s, bypass_group); the turned ones' cosines and sines as literals.
CUBOIDS = (
    (0, 2.0, 0.0, 0.0, 0.0, 1.5, 1.0, 2.0, 0.8660254037844387, 0.49999999999999994, 0),
    (1, 10.0, 0.05, 0.0, 0.0, 0.1, 0.1, 0.2, 1.0, 0.0, 1),
    (2, 10.0, 0.1, 0.05, 0.0, 0.1, 0.15, 0.2, 1.0, 0.0, 2),
    (3, 5.0, -0.1, -0.1, 0.0, 0.2, 0.2, 0.2, 0.7071067811865476, 0.7071067811865475, 3),
)
#: Rows of materials (group, lambda, mu, rho): rock, water, rock.
MATERIALS = ((1, 30e9, 30e9, 2700.0), (2, 2.25e9, 0.0, 1000.0), (3, 20e9, 10e9, 2500.0))


# Meshes


def _box(spark: SparkSession, sf_dir: str) -> Mesh:
    return box(table(spark, sf_dir, "part"), "p_partkey")


def _random_tets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cells of four different vertices, and the vertices that embeddings' first coordinates are."""
    p, n = F.col("p_partkey"), table(spark, sf_dir, "embeddings").count()
    cells = table(spark, sf_dir, "part").select(p.alias("cell_id"), F.array(p % n, (p * 7 + 1) % n, (p * 13 + 2) % n, (p * 29 + 3) % n).alias("vertices"))
    cells = cells.filter(F.size(F.array_distinct("vertices")) == 4)
    return cells, _points(spark, sf_dir).withColumnRenamed("point_id", "vertex_id")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), *[F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")])


def _raw_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as vertices of the parts that their suppliers are, numbered in each part."""
    w = Window.partitionBy("part").orderBy("l_orderkey", "l_linenumber", "l_partkey", "x", "y", "z")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("part"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    return rows.select("part", (F.row_number().over(w) - 1).cast("bigint").alias("local_id"), "x", "y", "z")


def _tagged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, face, bc) of line items: their order as cell, their line as face."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell_id"), (F.col("l_linenumber") % 4).cast("int").alias("face"), (F.col("l_partkey") % 201).cast("int").alias("bc"))
    return rows.groupBy("cell_id", "face").agg(F.max("bc").alias("bc"))


def _order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell_id")).distinct()


# Queries


def insphere_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.insphere(*_random_tets(spark, sf_dir))


def mesh_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.summary(_box(spark, sf_dir))


def vertex_filter_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertices.distinct_vertices(_raw_vertices(spark, sf_dir).select("x", "y", "z")).select("vertex_id", "x", "y", "z")


def vertex_filter_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw_vertices(spark, sf_dir)
    found = vertices.global_ids(raw, vertices.distinct_vertices(raw.select("x", "y", "z")))
    return found.groupBy("vertex_id").agg(F.count("*").alias("copies"))


def vertex_filter_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, and the same points with another last bit, merge."""
    points = _points(spark, sf_dir)
    near = points.select("point_id", *[F.when(F.col(a) == 0, F.col(a)).otherwise(F.col(a) * (1 + 2.0**-52)).alias(a) for a in "xyz"])
    raw = points.unionByName(near)
    return vertices.distinct_vertices(raw.select("x", "y", "z"), "truncate").agg(F.count("*").alias("merged")).crossJoin(raw.agg(F.count("*").alias("raw")))


def vertex_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return points.select("point_id", *[scalars.truncate_low_bits(F.col(a) / 3).alias(a) for a in "xyz"])


def partition_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertices.part_offsets(_raw_vertices(spark, sf_dir))


def owned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("part"), (F.col("l_linenumber") % 3 == 0).alias("is_owned"))
    return groups.owned_counts(rows)


def localid_to_globalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw_vertices(spark, sf_dir)
    found = vertices.global_ids(raw, vertices.distinct_vertices(raw.select("x", "y", "z")))
    return found.select("part", "local_id", "vertex_id")


def partitioned_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box, cut into parts by layer with vertices of their own, put together again."""
    mesh = _box(spark, sf_dir)
    cells = mesh.cells.select((F.col("group") - 1).alias("part"), "cell_id", "vertices", "group")
    rows = 4 * cells.count()
    corner = cells.select("part", "cell_id", F.posexplode("vertices").alias("at", "vertex_id"))
    used = numbered(corner.select("part", "vertex_id").distinct(), ["part", "vertex_id"], "k")
    used = used.join(F.broadcast(used.groupBy("part").agg(F.min("k").alias("first"))), "part").select("part", "vertex_id", (F.col("k") - F.col("first")).alias("local_id"))
    raw = joined(used, mesh.vertices, ["vertex_id"]).select("part", "local_id", "x", "y", "z")
    local = dealt(joined(corner, used, ["part", "vertex_id"], rows=rows), rows, "part", "cell_id").groupBy("part", "cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "local_id"))), lambda s: s["local_id"]).alias("v"))
    tags = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: ((F.col("cell_id") + k) % 7).cast("int"))
    raw_cells = joined(local, cells.select("cell_id", "group"), ["cell_id"]).select("part", F.col("cell_id").alias("local_cell"), "v", tags.alias("b"), "group")
    found = partitioned.assemble(stored(raw, "raw_vertices"), stored(raw_cells, "raw_cells"))
    return found.cells.select("cell_id", *[F.col("vertices")[k].alias(f"v{k}") for k in range(4)], "group")


def owned_entities_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box held twice: each half of its layers owned by one of two parts."""
    mesh = _box(spark, sf_dir)
    parts = F.broadcast(spark.createDataFrame([(0,), (1,)], "part int"))
    v = mesh.vertices.join(parts).select("part", F.col("vertex_id").alias("vertex_key"), "x", "y", "z", (F.col("vertex_id") % 2 == F.col("part")).alias("is_owned"))
    c = mesh.cells.join(parts).select("part", F.col("cell_id").alias("cell_key"), F.col("vertices").alias("vertex_keys"), "group", (F.col("group") % 2 == F.col("part")).alias("is_owned"))
    found = partitioned.owned_entities(v, c)
    return found.cells.select("cell_id", *[F.col("vertices")[k].alias(f"v{k}") for k in range(4)], "group")


def face_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.face_table(_box(spark, sf_dir).cells).select("cell_id", "face", *[F.col("nodes")[k].alias(f"n{k}") for k in range(3)])


def exterior_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.exterior_faces(_box(spark, sf_dir).cells)


def surface_bc_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = _box(spark, sf_dir)
    return faces.match_facets(mesh.cells, mesh.facets)


def model_face_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces inside the box on the plane between two layers, tagged for the cells on both sides."""
    cells = _box(spark, sf_dir).cells
    on = faces.face_table(cells).filter("a div 231 = 1 and b div 231 = 1 and c div 231 = 1").select("nodes", "a", "b", "c").dropDuplicates(["a", "b", "c"])
    classified = on.select("nodes", (F.col("a") % 3 + 1).cast("int").alias("model_face"))
    tags = spark.createDataFrame([(1, 65), (2, 0), (3, 68)], "model_face int, bc int")
    return faces.tags_by_model_face(cells, classified, tags)


def boundary_pack_i32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.encode(_tagged_cells(spark, sf_dir), _order_cells(spark, sf_dir), "i32")


def boundary_pack_i64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.encode(_tagged_cells(spark, sf_dir), _order_cells(spark, sf_dir), "i64")


def boundary_pack_i32x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = boundary.encode(_tagged_cells(spark, sf_dir), _order_cells(spark, sf_dir), "i32x4")
    return packed.select("cell_id", *[F.col("boundary")[k].alias(f"b{k}") for k in range(4)])


def boundary_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.decode(boundary.encode(_tagged_cells(spark, sf_dir), _order_cells(spark, sf_dir), "i32"), "i32").filter("bc <> 0")


def boundary_pack_range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell_id"), (F.col("o_custkey") * 701 - 500).cast("int").alias("bc"))
    return rows.select("cell_id", boundary.in_range(F.col("bc"), "i32").alias("fits_i32"), boundary.in_range(F.col("bc"), "i64").alias("fits_i64"), boundary.in_range(F.col("bc"), "i32x4").alias("fits_i32x4"))


def dense_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of tags given to a face several times the last one stays."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("cell_id"), (F.col("l_linenumber") % 4).cast("int").alias("face"), (F.col("l_partkey") % 1000).cast("int").alias("bc"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10).alias("at"), "l_partkey")
    last = rows.select("cell_id", "face", "bc", F.struct("at", "l_partkey").alias("ordinal"))
    cells = rows.select("cell_id").distinct()
    return boundary.encode(last, cells, "i32x4").select("cell_id", *[F.col("boundary")[k].alias(f"b{k}") for k in range(4)])


def bc_tag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 300).cast("int").alias("tag"))
    named = rows.select("o_orderkey", F.concat(F.lit("surface"), F.when(F.col("tag") % 7 == 0, "").otherwise(F.col("tag").cast("string"))).alias("set_name"), "tag")
    code = F.when(F.col("tag") % 4 == 0, "freeSurface").when(F.col("tag") % 4 == 1, "dynamicRupture").when(F.col("tag") % 4 == 2, "absorbing").otherwise(scalars.boundary_name(F.col("tag")))
    return named.select("o_orderkey", "set_name", scalars.tag_of_set_name(F.col("set_name")).alias("set_tag"), code.alias("name"), scalars.boundary_code(code).alias("code"))


def int_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.lit(" 12x"), F.lit("y"), (F.col("o_custkey") % 10).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(scalars.int_list(text)).alias("place", "value"))


def group_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"))
    listed = table(spark, sf_dir, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("cell_id"), (F.col("c_nationkey") + 1).alias("group"))
    return groups.assign_groups(cells, listed)


def entity_tag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 0").select(F.when(F.col("n_nationkey") % 2 == 0, 2).otherwise(3).alias("dim"), F.col("n_nationkey").cast("bigint").alias("entity_tag"), (F.col("n_regionkey") + 101).alias("physical_tag"))
    elements = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("element"), (F.col("s_suppkey") % 2 + 2).cast("int").alias("dim"), F.col("s_nationkey").cast("bigint").alias("entity_tag"))
    return groups.entity_tags(elements, known).select("element", "dim", "entity_tag", "tag")


def region_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("region"))
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("region"), F.col("n_name").alias("ordinal"))
    first, second = groups.region_groups(cells, regions, 0), groups.region_groups(cells, regions, 1)
    return first.select("cell_id", "region", F.col("group").alias("group0")).join(second.select("cell_id", F.col("group").alias("group1")), "cell_id")


def netcdf_face_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array(*[((F.col("o_custkey") + k) % 50).cast("int") for k in range(4)]).alias("b"))
    return rows.select("o_orderkey", faces.permute_faces("b").alias("b")).select("o_orderkey", *[F.col("b")[k].alias(f"b{k}") for k in range(4)])


def aspect_ratio_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ratio_histogram(geometry.aspect_ratio(*_random_tets(spark, sf_dir)))


def aspect_ratio_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.aspect_ratio(*_random_tets(spark, sf_dir))


def velocity_mesh_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuboids = spark.createDataFrame(CUBOIDS, "ordinal int, frequency double, cx double, cy double, cz double, hx double, hy double, hz double, c double, s double, bypass_group int")
    materials = spark.createDataFrame(MATERIALS, "`group` int, lambda double, mu double, rho double")
    found = sizing.mesh_size(_points(spark, sf_dir), cuboids, materials, 2.0)
    return found.select("point_id", "frequency", "material", "mesh_size")


def points_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spark.createDataFrame([(0, 1, -0.1, 0.1, -0.1, 0.1, -0.2, 0.2), (1, 2, 0.0, 0.3, -0.3, 0.3, -0.3, 0.3)], "ordinal int, region_group int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    return sizing.locate(_points(spark, sf_dir), boxes).select("point_id", "region_group")


def compact_int_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = None
    for name in ("region", "nation", "customer", "orders", "lineitem"):
        one = table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("name", "n", scalars.bit_length(F.col("n")).alias("bits"), scalars.compact_bytes(F.col("n")).alias("bytes"))


def block_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    total = orders.count()
    rows = orders.select("o_orderkey", vertices.block_of(F.col("o_orderkey"), total, 7).alias("block"))
    return rows.groupBy("block").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def dangling_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = _box(spark, sf_dir)
    return validate.dangling_corners(mesh.cells, mesh.vertices.filter("vertex_id % 50 <> 0"))


def unknown_model_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("region"))
    known = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("region"))
    return validate.unknown_ids(used, known, "region")


def distinct_bc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged_cells(spark, sf_dir).filter("bc <> 0").select("bc").distinct()


def duplicate_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    facets = _box(spark, sf_dir).facets
    return faces.repeated_facets(facets.unionByName(facets.filter("facet_id % 10 = 0")))


def simplex_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(d, k + 1, code, simplex_nodes(d, k + 1)) for d, codes in ELEMENT_TYPES.items() for k, code in enumerate(codes)]
    return spark.createDataFrame(rows, "dim int, `order` int, type int, nodes int")


def xml_config_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings of a document for each nation, in which its key stands for @K@."""
    documents = table(spark, sf_dir, "nation").select(F.replace(F.lit(SETTINGS), F.lit("@K@"), F.col("n_nationkey").cast("string")).alias("value"))
    return xmlconfig.config_of(documents).rows()


def _written(mesh: Mesh, text_of, name: str) -> str:
    folder = working_folder(mesh.cells.sparkSession, name)
    text_of(mesh).orderBy("line").select("value").write.text(folder)
    return folder


def _read_back(mesh: Mesh) -> DataFrame:
    """Cells with their corners' coordinates and their tags packed."""
    at = geometry.corner_coordinates(mesh.cells, mesh.vertices)
    tags = boundary.encode(columnar.face_tags(mesh), mesh.cells, "i32")
    return joined(at, tags, ["cell_id"]).select("cell_id", "group", *[f"{a}{k}" for k in range(4) for a in "xyz"], "boundary")


def gambit_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = _box(spark, sf_dir)
    tagged = mesh.with_(face_bcs=stored(faces.match_facets(mesh.cells, mesh.facets).filter("bc <> 0"), "tags"))
    return _read_back(gambit.read(spark, _written(tagged, gambit.text_of, "gambit")))


def msh2_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(gmsh.read(spark, _written(_box(spark, sf_dir), gmsh.text22, "msh2")))


def msh4_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(gmsh.read(spark, _written(_box(spark, sf_dir), gmsh.text41, "msh4")))


def puml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = working_folder(spark, "puml")
    columnar.write(_box(spark, sf_dir), folder, "i32")
    parts, _ = columnar.read(spark, folder)
    cells = joined(parts["connect"], parts["group"], ["cell_id"])
    at = geometry.corner_coordinates(cells, parts["geometry"])
    return joined(at, parts["boundary"], ["cell_id"]).select("cell_id", "group", *[f"{a}{k}" for k in range(4) for a in "xyz"], "boundary")


def cells_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_counts(_box(spark, sf_dir).cells)


QUERIES = {
    f.__name__: f
    for f in (
        insphere_cells, mesh_summary, vertex_filter_ids, vertex_filter_unique, vertex_filter_truncate, vertex_truncate, partition_offsets, owned_counts,
        localid_to_globalid, partitioned_mesh, owned_entities_mesh, face_table, exterior_faces, surface_bc_match, model_face_tags, boundary_pack_i32, boundary_pack_i64,
        boundary_pack_i32x4, boundary_unpack, boundary_pack_range_check, dense_boundaries, bc_tag_parse, int_lists, group_assign, entity_tag_lookup, region_groups,
        netcdf_face_permute, aspect_ratio_histogram, aspect_ratio_cells, velocity_mesh_size, points_in_regions, compact_int_width, block_distribution, dangling_vertices,
        unknown_model_ids, distinct_bc_types, duplicate_faces, simplex_node_counts, xml_config_rows, gambit_roundtrip, msh2_roundtrip, msh4_roundtrip, puml_roundtrip, cells_by_group,
    )
}


# SQL

_TETS = ", ".join(f"({t}, {a}, {b}, {c}, {d})" for t, (a, b, c, d) in enumerate(TETRAHEDRA))
_CORNER = "(i + (c{0} & 1)) + 21 * (j + ((c{0} >> 1) & 1)) + 231 * (k + ((c{0} >> 2) & 1))"
_BOX = f"""hexes AS (SELECT p_partkey AS h, p_partkey % 20 AS i, p_partkey // 20 % 10 AS j, p_partkey // 200 AS k FROM part),
cells AS (SELECT h * 6 + t AS cell_id, {", ".join(f"{_CORNER.format(n)} AS v{n}" for n in range(4))}, CAST(k % 4 + 1 AS INTEGER) AS "group"
    FROM hexes, (VALUES {_TETS}) AS tets(t, c0, c1, c2, c3)),
vertices AS (SELECT DISTINCT vertex_id, CAST(vertex_id % 21 AS DOUBLE) AS x, CAST(vertex_id // 21 % 11 AS DOUBLE) AS y, CAST(vertex_id // 231 AS DOUBLE) AS z
    FROM (SELECT unnest([v0, v1, v2, v3]) AS vertex_id FROM cells)),
corners AS (SELECT cell_id, "group", v0, v1, v2, v3, {", ".join(f"CAST(v{n} % 21 AS DOUBLE) AS x{n}, CAST(v{n} // 21 % 11 AS DOUBLE) AS y{n}, CAST(v{n} // 231 AS DOUBLE) AS z{n}" for n in range(4))} FROM cells),
all_faces AS (SELECT cell_id, 0 AS face, v1 AS n0, v0 AS n1, v2 AS n2 FROM cells UNION ALL SELECT cell_id, 1, v0, v1, v3 FROM cells
    UNION ALL SELECT cell_id, 2, v1, v2, v3 FROM cells UNION ALL SELECT cell_id, 3, v2, v0, v3 FROM cells),
keyed AS (SELECT *, least(n0, n1, n2) AS a, n0 + n1 + n2 - least(n0, n1, n2) - greatest(n0, n1, n2) AS b, greatest(n0, n1, n2) AS c FROM all_faces),
outside AS (SELECT a, b, c, min(cell_id) AS cell_id, CAST(min(face) AS INTEGER) AS face FROM keyed GROUP BY a, b, c HAVING count(*) = 1),
facets AS (SELECT cell_id * 4 + face AS facet_id, a, b, c, CASE WHEN c < 231 THEN 101 WHEN a % 21 = 0 AND b % 21 = 0 AND c % 21 = 0 THEN 103 ELSE 105 END AS tag FROM outside),
matched AS (SELECT f.cell_id, CAST(f.face AS INTEGER) AS face, CAST(coalesce(t.tag - 100, 0) AS INTEGER) AS bc FROM keyed f LEFT JOIN facets t ON f.a = t.a AND f.b = t.b AND f.c = t.c)"""
_POINTS = "points AS (SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
_RANDOM = f"""{_POINTS},
tets AS (SELECT p_partkey AS cell_id, p_partkey % n AS v0, (p_partkey * 7 + 1) % n AS v1, (p_partkey * 13 + 2) % n AS v2, (p_partkey * 29 + 3) % n AS v3 FROM part, (SELECT count(*) AS n FROM embeddings)),
placed AS (SELECT cell_id, {", ".join(f"p{n}.x AS x{n}, p{n}.y AS y{n}, p{n}.z AS z{n}" for n in range(4))}
    FROM tets {" ".join(f"JOIN points p{n} ON p{n}.point_id = v{n}" for n in range(4))}
    WHERE v0 <> v1 AND v0 <> v2 AND v0 <> v3 AND v1 <> v2 AND v1 <> v3 AND v2 <> v3)"""
_RAW = """raw AS (SELECT CAST(l_suppkey % 10 AS INTEGER) AS part,
    row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax) - 1 AS local_id,
    l_quantity AS x, l_discount AS y, l_tax AS z FROM lineitem)"""
_TAGGED = """tagged AS (SELECT l_orderkey AS cell_id, CAST(l_linenumber % 4 AS INTEGER) AS face, CAST(max(l_partkey % 201) AS INTEGER) AS bc FROM lineitem GROUP BY ALL),
order_cells AS (SELECT DISTINCT o_orderkey AS cell_id FROM orders)"""
_WRAP = "CAST(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS INTEGER)"
_INSPHERE = f"{geometry.determinant_sql()} / nullif({geometry.surface_sql()}, 0)"
_RATIO = f"{geometry.longest_edge_sql()} * {geometry.largest_side_sql()} / nullif({geometry.determinant_sql()}, 0)"
_EXPONENT = "floor(log2(abs({0}))) - CASE WHEN pow(2.0, floor(log2(abs({0})))) > abs({0}) THEN 1 ELSE 0 END"


def _truncated(column: str) -> str:
    return f"CASE WHEN {column} = 0 THEN {column} ELSE trunc({column} / pow(2.0, {_EXPONENT.format(column)} - 48)) * pow(2.0, {_EXPONENT.format(column)} - 48) END"


_ROUND_TRIP = f"""WITH {_BOX}, packed AS (SELECT cell_id, sum(bc * (1::BIGINT << (8 * face))) AS v FROM matched GROUP BY cell_id)
SELECT c.cell_id, c."group", {", ".join(f"{a}{n}" for n in range(4) for a in "xyz")}, {_WRAP} AS boundary FROM corners c JOIN packed p ON p.cell_id = c.cell_id"""
_EDGES = quality.BIN_EDGES
_CUBOID_ROWS = ", ".join("(" + ", ".join(f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v) for v in row) + ")" for row in CUBOIDS)
_MATERIAL_ROWS = ", ".join("(" + ", ".join(f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v) for v in row) + ")" for row in MATERIALS)

ORACLE_SQL = {
    "insphere_cells": f"WITH {_RANDOM} SELECT cell_id, {_INSPHERE} AS insphere FROM placed",
    "mesh_summary": f"""WITH {_BOX}, r AS (SELECT {_INSPHERE} AS insphere FROM corners)
SELECT count(*) AS cell_count, (SELECT count(*) FROM vertices) AS vertex_count, min(insphere) AS min_insphere, count(*) FILTER (WHERE insphere IS NULL OR insphere = 0) AS degenerate_cells FROM r""",
    "vertex_filter_ids": f"WITH {_RAW} SELECT row_number() OVER (ORDER BY x, y, z) - 1 AS vertex_id, x, y, z FROM (SELECT DISTINCT x, y, z FROM raw)",
    "vertex_filter_unique": f"WITH {_RAW} SELECT dense_rank() OVER (ORDER BY x, y, z) - 1 AS vertex_id, n AS copies FROM (SELECT x, y, z, count(*) AS n FROM raw GROUP BY x, y, z)",
    "vertex_filter_truncate": f"""WITH {_POINTS}, both_ AS (SELECT x, y, z FROM points UNION ALL SELECT {", ".join(f"CASE WHEN {a} = 0 THEN {a} ELSE {a} * (1 + pow(2.0, -52)) END" for a in "xyz")} FROM points)
SELECT (SELECT count(*) FROM (SELECT DISTINCT {", ".join(_truncated(a) + f" AS {a}" for a in "xyz")} FROM both_)) AS merged, count(*) AS raw FROM both_""",
    "vertex_truncate": f"WITH {_POINTS}, third AS (SELECT point_id, x / 3 AS x, y / 3 AS y, z / 3 AS z FROM points) SELECT point_id, {', '.join(_truncated(a) + f' AS {a}' for a in 'xyz')} FROM third",
    "partition_offsets": f"WITH {_RAW} SELECT part, n, CAST(coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT part, count(*) AS n FROM raw GROUP BY part)",
    "owned_counts": """SELECT part, total, owned, CAST(coalesce(sum(owned) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
FROM (SELECT CAST(l_suppkey % 10 AS INTEGER) AS part, count(*) AS total, count(*) FILTER (WHERE l_linenumber % 3 = 0) AS owned FROM lineitem GROUP BY 1)""",
    "localid_to_globalid": f"WITH {_RAW} SELECT part, local_id, dense_rank() OVER (ORDER BY x, y, z) - 1 AS vertex_id FROM raw",
    "partitioned_mesh": f"""WITH {_BOX}, ids AS (SELECT vertex_id, row_number() OVER (ORDER BY x, y, z) - 1 AS id FROM vertices)
SELECT row_number() OVER (ORDER BY "group", cell_id) - 1 AS cell_id, a.id AS v0, b.id AS v1, c.id AS v2, d.id AS v3, "group"
FROM cells JOIN ids a ON a.vertex_id = v0 JOIN ids b ON b.vertex_id = v1 JOIN ids c ON c.vertex_id = v2 JOIN ids d ON d.vertex_id = v3""",
    "owned_entities_mesh": f'WITH {_BOX} SELECT row_number() OVER (ORDER BY cell_id) - 1 AS cell_id, {", ".join(f"(SELECT count(*) FROM vertices w WHERE w.vertex_id < v{n}) AS v{n}" for n in range(4))}, "group" FROM cells',
    "face_table": f"WITH {_BOX} SELECT cell_id, CAST(face AS INTEGER) AS face, n0, n1, n2 FROM keyed",
    "exterior_faces": f"WITH {_BOX} SELECT a, b, c, cell_id, face FROM outside",
    "surface_bc_match": f"WITH {_BOX} SELECT cell_id, face, bc FROM matched",
    "model_face_tags": f"""WITH {_BOX}, plane AS (SELECT DISTINCT a, b, c, a % 3 + 1 AS model_face FROM keyed WHERE a // 231 = 1 AND b // 231 = 1 AND c // 231 = 1)
SELECT f.cell_id, CAST(f.face AS INTEGER) AS face, t.bc FROM keyed f JOIN plane p ON f.a = p.a AND f.b = p.b AND f.c = p.c JOIN (VALUES (1, 65), (3, 68)) t(model_face, bc) ON t.model_face = p.model_face""",
    "boundary_pack_i32": f"""WITH {_TAGGED}, packed AS (SELECT c.cell_id, coalesce(sum(bc * (1::BIGINT << (8 * face))), 0) AS v FROM order_cells c LEFT JOIN tagged t ON t.cell_id = c.cell_id GROUP BY c.cell_id)
SELECT cell_id, {_WRAP} AS boundary FROM packed""",
    "boundary_pack_i64": f"""WITH {_TAGGED} SELECT c.cell_id, CAST(coalesce(sum(bc * (1::BIGINT << (16 * face))), 0) AS BIGINT) AS boundary FROM order_cells c LEFT JOIN tagged t ON t.cell_id = c.cell_id GROUP BY c.cell_id""",
    "boundary_pack_i32x4": f"""WITH {_TAGGED} SELECT c.cell_id, {", ".join(f"CAST(coalesce(max(bc) FILTER (WHERE face = {k}), 0) AS INTEGER) AS b{k}" for k in range(4))} FROM order_cells c LEFT JOIN tagged t ON t.cell_id = c.cell_id GROUP BY c.cell_id""",
    "boundary_unpack": f"WITH {_TAGGED} SELECT t.cell_id, face, bc FROM tagged t JOIN order_cells c ON t.cell_id = c.cell_id WHERE bc <> 0",
    "boundary_pack_range_check": "SELECT o_orderkey AS cell_id, o_custkey * 701 - 500 BETWEEN 0 AND 255 AS fits_i32, o_custkey * 701 - 500 BETWEEN 0 AND 65535 AS fits_i64, TRUE AS fits_i32x4 FROM orders",
    "dense_boundaries": f"""WITH t AS (SELECT l_orderkey % 100 AS cell_id, l_linenumber % 4 AS face, arg_max(CAST(l_partkey % 1000 AS INTEGER), row(l_orderkey * 100 + l_linenumber * 10, l_partkey)) AS bc FROM lineitem GROUP BY 1, 2)
SELECT cell_id, {", ".join(f"CAST(coalesce(max(bc) FILTER (WHERE face = {k}), 0) AS INTEGER) AS b{k}" for k in range(4))} FROM t GROUP BY cell_id""",
    "bc_tag_parse": """WITH t AS (SELECT o_orderkey, CAST(o_custkey % 300 AS INTEGER) AS tag FROM orders),
n AS (SELECT *, 'surface' || CASE WHEN tag % 7 = 0 THEN '' ELSE CAST(tag AS VARCHAR) END AS set_name,
    CASE tag % 4 WHEN 0 THEN 'freeSurface' WHEN 1 THEN 'dynamicRupture' WHEN 2 THEN 'absorbing' ELSE 'BC' || lpad(CAST(tag AS VARCHAR), 9, '0') END AS name FROM t)
SELECT o_orderkey, set_name, CAST(CASE WHEN tag % 7 = 0 THEN 0 WHEN tag >= 100 THEN tag - 100 ELSE tag END AS INTEGER) AS set_tag, name,
    CAST(CASE tag % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE tag END AS INTEGER) AS code FROM n""",
    "int_lists": "SELECT o_orderkey, CAST(i - 1 AS INTEGER) AS place, CAST([o_orderkey, 12, 0, o_custkey % 10][i] AS INTEGER) AS value FROM orders, range(1, 5) r(i)",
    "group_assign": 'SELECT c_custkey AS cell_id, CAST(CASE WHEN c_nationkey < 20 THEN c_nationkey + 1 ELSE 0 END AS INTEGER) AS "group" FROM customer',
    "entity_tag_lookup": """SELECT s_suppkey AS element, CAST(s_suppkey % 2 + 2 AS INTEGER) AS dim, CAST(s_nationkey AS BIGINT) AS entity_tag, CAST(coalesce(n.n_regionkey + 101, 0) AS INTEGER) AS tag
FROM supplier LEFT JOIN nation n ON n.n_nationkey = s_nationkey AND n.n_nationkey % 5 <> 0 AND CASE WHEN n.n_nationkey % 2 = 0 THEN 2 ELSE 3 END = s_suppkey % 2 + 2""",
    "region_groups": "SELECT c_custkey AS cell_id, c_nationkey AS region, CAST(r - 1 AS INTEGER) AS group0, CAST(r AS INTEGER) AS group1 FROM customer JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_name) AS r FROM nation) ON n_nationkey = c_nationkey",
    "netcdf_face_permute": "SELECT o_orderkey, " + ", ".join(f"CAST((o_custkey + {k}) % 50 AS INTEGER) AS b{i}" for i, k in enumerate((0, 1, 3, 2))) + " FROM orders",
    "aspect_ratio_histogram": f"""WITH {_RANDOM}, ratios AS (SELECT {_RATIO} AS r FROM placed),
bins(bin, low, high) AS (VALUES {", ".join(f"({k}, CAST({low} AS DOUBLE), CAST({_EDGES[k + 1] if k + 1 < len(_EDGES) else 'NULL'} AS DOUBLE))" for k, low in enumerate(_EDGES))}),
n AS (SELECT CASE {" ".join(f"WHEN r < {high} THEN {k}" for k, high in enumerate(_EDGES[1:]))} ELSE {len(_EDGES) - 1} END AS bin, count(*) AS cells FROM ratios GROUP BY 1)
SELECT bins.bin, low, high, coalesce(cells, 0) AS cells FROM bins LEFT JOIN n ON n.bin = bins.bin""",
    "aspect_ratio_cells": f"WITH {_RANDOM} SELECT cell_id, {_RATIO} AS aspect_ratio FROM placed",
    "velocity_mesh_size": f"""WITH {_POINTS}, cuboids(ordinal, frequency, cx, cy, cz, hx, hy, hz, c, s, bypass_group) AS (VALUES {_CUBOID_ROWS}), materials(m, la, mu, rho) AS (VALUES {_MATERIAL_ROWS}),
near AS (SELECT point_id, max(frequency) AS frequency, arg_max(bypass_group, row(frequency, ordinal)) AS g FROM points JOIN cuboids
    ON abs((x - cx) * c + (y - cy) * s) <= hx AND abs((x - cx) * -s + (y - cy) * c) <= hy AND abs(z - cz) <= hz GROUP BY point_id),
found AS (SELECT p.point_id, coalesce(frequency, 0) AS frequency, CASE WHEN coalesce(g, 0) <> 0 THEN g ELSE 1 END AS material FROM points p LEFT JOIN near n ON n.point_id = p.point_id)
SELECT point_id, frequency, material, CASE WHEN frequency = 0 THEN {scalars.UNBOUNDED!r} ELSE CASE WHEN mu < 1e-13 THEN sqrt((la + 2 * mu) / rho) ELSE sqrt(mu / rho) END / frequency / 2.0 END AS mesh_size
FROM found JOIN materials ON m = material""",
    "points_in_regions": f"""WITH {_POINTS} SELECT point_id, CASE WHEN x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AND z BETWEEN -0.2 AND 0.2 THEN 1
    WHEN x BETWEEN 0.0 AND 0.3 AND y BETWEEN -0.3 AND 0.3 AND z BETWEEN -0.3 AND 0.3 THEN 2 ELSE -1 END AS region_group FROM points""",
    "compact_int_width": """SELECT name, n, CAST(CASE WHEN n = 0 THEN 0 ELSE length(bin(n)) END AS INTEGER) AS bits, CAST(ceil(CASE WHEN n = 0 THEN 0 ELSE length(bin(n)) END / 8.0) AS INTEGER) AS bytes FROM (
SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer
UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem)""",
    "block_distribution": "SELECT CAST(b - 1 AS INTEGER) AS block, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) AS b FROM orders) GROUP BY b",
    "dangling_vertices": f"WITH {_BOX} SELECT cell_id, CAST(i - 1 AS INTEGER) AS corner, [v0, v1, v2, v3][i] AS vertex_id FROM cells, range(1, 5) r(i) WHERE [v0, v1, v2, v3][i] % 50 = 0",
    "unknown_model_ids": "SELECT DISTINCT c_nationkey AS region FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)",
    "distinct_bc_types": f"WITH {_TAGGED} SELECT DISTINCT bc FROM tagged WHERE bc <> 0",
    "duplicate_faces": f"WITH {_BOX} SELECT a, b, c, CAST(2 AS BIGINT) AS n FROM facets WHERE facet_id % 10 = 0",
    "simplex_node_counts": "SELECT * FROM (VALUES " + ", ".join(f"({d}, {k + 1}, {code}, {simplex_nodes(d, k + 1)})" for d, codes in ELEMENT_TYPES.items() for k, code in enumerate(codes)) + ') t(dim, "order", type, nodes)',
    # a nation's key stands in its document; what the document says, element by element
    "xml_config_rows": """WITH keys AS (SELECT CAST(n_nationkey AS VARCHAR) AS k FROM nation),
lists(kind, entity, ids, params) AS (
    SELECT kind, entity, ids, replace(params, '@K@', k) FROM keys, LATERAL (VALUES
        ('boundary condition', 'face', ['4'], '{"bc":1}'), ('boundary condition', 'face', ['6', '1' || k], '{"bc":3}'), ('boundary condition', 'face', ['7', '8'], '{"bc":5}'),
        ('boundary condition', 'face', ['2' || k], '{"bc":71}'), ('boundary condition', 'face', ['11', '12'], '{"bc":66}'),
        ('size', 'vertex', ['3', k], '{"size":12.0}'), ('size', 'edge', ['9'], '{"size":7.5}'), ('size', 'face', ['5', '3'], '{"size":1@K@.0}'), ('size', 'region', ['2'], '{"size":800.0}'),
        ('list', 'face without mesh', ['6', '7'], '{}'), ('list', 'region without mesh', ['3'], '{}'), ('list', 'face with given mesh', ['8'], '{}'), ('list', 'face that sizes spread from', ['3', '9'], '{}'),
        ('scalars', 'mesh', ['0'], '{"globalMSize":3@K@.5,"gradation":0.75,"area_AspectRatio":4.0,"vol_AspectRatio":60.0,"surface_smoothing_level":4,"surface_smoothing_type":"Laplacian","surface_angle":7.5,'
            || '"surface_snap":0,"volume_smoothing_level":1,"volume_smoothing_type":"Gradient","volume_optimisation":1,"discrete_no_modification":1,"propagation_factor":2.5,"propagation_distance":25@K@.0}'),
        ('cube', 'zone', ['0'], '{"ordinal":0,"size":45@K@.0,"center":[1.0,-2.0,@K@.0],"width":[3.0,0.5,0.0],"height":[0.0,4.0,0.0],"depth":[0.0,0.0,5.0]}'),
        ('waves', 'mesh', ['0'], '{"easi_file":"ground@K@.yaml","elements_per_wave":3.0,"cuboids":2}'),
        ('cuboid', 'zone', ['0'], '{"ordinal":0,"frequency":4.0,"cx":0.5,"cy":@K@.0,"cz":-1.0,"hx":2.0,"hy":1.5,"hz":0.25,"rotation":45.0,"bypass_group":0}'),
        ('cuboid', 'zone', ['1'], '{"ordinal":1,"frequency":8.0,"cx":0.0,"cy":0.25,"cz":0.0,"hx":0.5,"hy":0.5,"hz":0.75,"rotation":0.0,"bypass_group":2}')) v(kind, entity, ids, params))
SELECT kind, entity, CAST(unnest(ids) AS INTEGER) AS id, params FROM lists""",
    "gambit_roundtrip": _ROUND_TRIP,
    "msh2_roundtrip": _ROUND_TRIP,
    # the file lists cells group by group
    "msh4_roundtrip": _ROUND_TRIP.replace("SELECT c.cell_id, c.\"group\"", "SELECT row_number() OVER (ORDER BY c.\"group\", c.cell_id) - 1 AS cell_id, c.\"group\""),
    "puml_roundtrip": _ROUND_TRIP,
    "cells_by_group": f'WITH {_BOX} SELECT "group", count(*) AS cells, min(cell_id) AS first_cell, max(cell_id) AS last_cell FROM cells GROUP BY 1',
}
