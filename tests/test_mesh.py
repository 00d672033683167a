"""Small meshes with known results."""

import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tetraspark.functions import scalars
from tetraspark.mesh import Mesh
from tetraspark.operators import boundary, faces, geometry, groups, quality, sizing, validate, vertices
from tetraspark.plans.convert import convert
from tetraspark.schema import boundary_format, element_type, simplex_nodes
from tetraspark.sinks import columnar
from tetraspark.sources import gambit, gmsh, partitioned, registry, xmlconfig
from tetraspark.sources.boxmesh import box
from tetraspark.streaming.monitor import arriving_cells, group_counts

TET = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)]


def points(spark, rows):
    return spark.createDataFrame(rows, "vertex_id long, x double, y double, z double")


def cells(spark, *vertices_):
    return spark.createDataFrame([(k, list(v), 1) for k, v in enumerate(vertices_)], "cell_id long, vertices array<bigint>, `group` int")


def small_box(spark, hexes=1, nx=1, ny=1):
    return box(spark.range(hexes), "id", nx, ny)


def raises(message):
    return pytest.raises(Exception, match=message)


def test_insphere_of_unit_tetrahedron(spark):
    r = geometry.insphere(cells(spark, (0, 1, 2, 3)), points(spark, TET)).first()["insphere"]
    assert r == pytest.approx(1 / (3 + 3**0.5), abs=1e-12)


def test_kuhn_cube(spark):
    mesh = small_box(spark)
    r = [x["insphere"] for x in geometry.insphere(mesh.cells, mesh.vertices).collect()]
    assert r == pytest.approx([1 / (2 + 2 * 2**0.5)] * 6)
    at = geometry.corner_coordinates(mesh.cells, mesh.vertices)
    assert at.agg(F.sum(F.expr(geometry.determinant_sql())) / 6).first()[0] == pytest.approx(1.0)
    assert faces.exterior_faces(mesh.cells).count() == 12 == mesh.facets.count()
    assert mesh.vertices.count() == 8


def test_two_tetrahedra_share_a_face(spark):
    two = cells(spark, (0, 1, 2, 3), (1, 2, 3, 4))
    keys = faces.face_table(two).groupBy("a", "b", "c").count()
    assert keys.count() == 7 and keys.filter("count = 2").count() == 1


def test_degenerate_cell_has_no_insphere(spark):
    same = points(spark, [(k, 1.0, 1.0, 1.0) for k in range(4)] + [(k + 4, *r[1:]) for k, r in enumerate(TET)])
    mesh = Mesh(same, cells(spark, (0, 1, 2, 3), (4, 5, 6, 7)))
    r = quality.summary(mesh).first()
    assert (r["cell_count"], r["degenerate_cells"]) == (2, 1) and r["min_insphere"] > 0


def test_shared_vertices_become_one(spark):
    raw = spark.createDataFrame([(p, k, *r[1:]) for p in (0, 1) for k, r in enumerate(TET if p == 0 else [*TET[1:], (9, 1.0, 1.0, 1.0)])], "part int, local_id long, x double, y double, z double")
    distinct = vertices.distinct_vertices(raw.select("x", "y", "z"))
    ids = {tuple(r)[1:4]: r["vertex_id"] for r in distinct.collect()}
    assert [ids[k] for k in sorted(ids)] == list(range(5))
    assert vertices.global_ids(raw, distinct).count() == 8


def test_zero_and_near_duplicates(spark):
    one = spark.createDataFrame([(0.0, 0.0, 0.0), (-0.0, 0.0, 0.0)], "x double, y double, z double")
    assert vertices.distinct_vertices(one).count() == 1
    near = spark.createDataFrame([(1.0, 0.0, 0.0), (1.0 + 2**-52, 0.0, 0.0)], "x double, y double, z double")
    assert vertices.distinct_vertices(near).count() == 2
    assert [r["x"] for r in vertices.distinct_vertices(near, "truncate").collect()] == [1.0]
    with pytest.raises(ValueError, match="tolerance"):
        vertices.distinct_vertices(near, "loose")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-2, 2), st.integers(-2, 2), st.integers(-2, 2)), min_size=1, max_size=40), st.integers(1, 6))
def test_ids_are_dense_ranks_whatever_the_partitions(spark, rows, parts):
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "x double, y double, z double").repartition(parts)
    found = sorted((r["vertex_id"], (r["x"], r["y"], r["z"])) for r in vertices.distinct_vertices(df).collect())
    assert found == list(enumerate(sorted({tuple(map(float, r)) for r in rows})))


def face_rows(spark, rows):
    return spark.createDataFrame(rows, "cell_id long, face int, bc int")


def packed(spark, tags, form):
    one = spark.createDataFrame([(0,)], "cell_id long")
    return boundary.encode(face_rows(spark, [(0, k, t) for k, t in enumerate(tags)]), one, form).first()["boundary"]


def test_boundary_packing(spark):
    assert packed(spark, (1, 0, 3, 5), "i32") == 84082689
    assert packed(spark, (0, 0, 0, 200), "i32") == -939524096
    assert packed(spark, (1, 0, 3, 5), "i64") == 1 + (3 << 32) + (5 << 48)
    assert packed(spark, (1, 0, 3, 5), "i32x4") == [1, 0, 3, 5]
    for form, tag in (("i32", 256), ("i64", 65536), ("i32", -1), ("i64", -1)):
        with raises("doesn't fit"):
            packed(spark, (tag, 0, 0, 0), form)
    assert boundary_format("int64") == "i64"
    with pytest.raises(ValueError):
        boundary_format("i8")


def test_repeated_tags_are_ored_or_the_last(spark):
    one = spark.createDataFrame([(0,), (1,)], "cell_id long")
    twice = spark.createDataFrame([(0, 1, 5, 1), (0, 1, 2, 2)], "cell_id long, face int, bc int, ordinal long")
    assert {r["cell_id"]: r["boundary"] for r in boundary.encode(twice, one, "i32").collect()} == {0: 7 << 8, 1: 0}
    assert {r["cell_id"]: r["boundary"] for r in boundary.encode(twice, one, "i32x4").collect()} == {0: [0, 2, 0, 0], 1: [0, 0, 0, 0]}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.integers(0, 255)] * 4), min_size=1, max_size=10))
def test_unpacking_inverts_packing(spark, rows):
    tags = face_rows(spark, [(c, k, t) for c, r in enumerate(rows) for k, t in enumerate(r)])
    ids = spark.createDataFrame([(c,) for c in range(len(rows))], "cell_id long")
    for form in ("i32", "i64", "i32x4"):
        back = {(r["cell_id"], r["face"]): r["bc"] for r in boundary.decode(boundary.encode(tags, ids, form), form).collect()}
        assert back == {(c, k): t for c, r in enumerate(rows) for k, t in enumerate(r)}


def test_tags_and_names(spark):
    tags = spark.createDataFrame([(99,), (100,), (101,), (205,)], "t int")
    assert [r[0] for r in tags.select(scalars.strip_tag_offset(F.col("t"))).collect()] == [99, 0, 1, 105]
    names = spark.createDataFrame([("freeSurface",), ("dynamicRupture",), ("absorbing",), ("BC000000065",)], "n string")
    assert [r[0] for r in names.select(scalars.boundary_code(F.col("n"))).collect()] == [1, 3, 5, 65]
    with raises("unknown boundary"):
        spark.createDataFrame([("BC65",)], "n string").select(scalars.boundary_code(F.col("n"))).collect()
    sets = spark.createDataFrame([("wall105",), ("wall",), ("101",), ("a250b3",)], "n string")
    assert [r[0] for r in sets.select(scalars.tag_of_set_name(F.col("n"))).collect()] == [5, 0, 1, 3]
    lists = spark.createDataFrame([("1, 2x,y,-4",)], "t string")
    assert lists.select(scalars.int_list(F.col("t"))).first()[0] == [1, 2, 0, -4]


def test_facet_matching(spark):
    two = cells(spark, (0, 1, 2, 3), (1, 2, 3, 4))
    facets = spark.createDataFrame([(0, [3, 2, 1], 103), (1, [2, 0, 1], 7)], "facet_id long, nodes array<bigint>, tag int")
    tags = {(r["cell_id"], r["face"]): r["bc"] for r in faces.match_facets(two, facets).filter("bc <> 0").collect()}
    assert tags == {(0, 2): 3, (1, 0): 3, (0, 0): 7}
    doubled = facets.unionByName(facets.limit(1))
    assert faces.repeated_facets(doubled).count() == 1
    with raises("occurs twice"):
        faces.match_facets(two, doubled).collect()


def test_histogram_keeps_empty_bins(spark):
    ratios = spark.createDataFrame([(x,) for x in (0.0, 1.99, 2.0, 10.0, 99.9, 100.0, 1e9)], "aspect_ratio double")
    found = {r["low"]: r["cells"] for r in quality.ratio_histogram(ratios).collect()}
    assert found == {0: 2, 2: 1, 4: 0, 6: 0, 10: 1, 20: 0, 40: 1, 100: 2}


def test_groups(spark):
    regions = spark.createDataFrame([("b", 2), ("a", 1)], "region string, ordinal int")
    known = spark.createDataFrame([(0, "a"), (1, "b")], "cell_id long, region string")
    assert [r["group"] for r in groups.region_groups(known, regions, 1).orderBy("cell_id").collect()] == [1, 2]
    with raises("unknown region"):
        groups.region_groups(spark.createDataFrame([(0, "c")], "cell_id long, region string"), regions).collect()


CUBOID = "ordinal int, frequency double, cx double, cy double, cz double, hx double, hy double, hz double, rotation double, bypass_group int"


def test_mesh_size(spark):
    cuboids = sizing.with_rotation(spark.createDataFrame([(0, 2.0, 0.0, 0.0, 0.0, 2.0, 1.0, 1.0, 90.0, 2), (1, 2.0, 0.0, 0.0, 0.0, 0.5, 0.5, 0.5, 0.0, 1)], CUBOID))
    materials = spark.createDataFrame([(1, 1.0, 4.0, 1.0), (2, 9.0, 0.0, 1.0)], "`group` int, lambda double, mu double, rho double")
    at = spark.createDataFrame([(0, 0.5, 0.0, 0.0), (1, 0.0, 1.9, 0.0), (2, 1.9, 0.0, 0.0)], "point_id long, x double, y double, z double")
    found = {r["point_id"]: (r["frequency"], r["material"], r["mesh_size"]) for r in sizing.mesh_size(at, cuboids, materials, 2.0).collect()}
    # on the side of both cuboids: the later one of equal frequency; turned by 90 degrees, x and y swap
    assert found[0] == (2.0, 1, 2.0 / 2.0 / 2.0)
    assert found[1] == (2.0, 2, 3.0 / 2.0 / 2.0)
    assert found[2][0] == 0.0 and found[2][2] == scalars.UNBOUNDED


def test_blocks():
    for total in (0, 1, 7, 20):
        for blocks in (1, 3, 7):
            sizes = [vertices.block_size(total, b, blocks) for b in range(blocks)]
            assert sum(sizes) == total and max(sizes) - min(sizes) <= 1
            assert [vertices.block_start(total, b, blocks) for b in range(blocks)] == [sum(sizes[:b]) for b in range(blocks)]


def test_element_types():
    assert [simplex_nodes(3, p) for p in range(1, 11)] == [4, 10, 20, 35, 56, 84, 120, 165, 220, 286]
    assert element_type(2, 2) == 9
    for order in (0, 11, -1):
        with pytest.raises(ValueError):
            element_type(3, order)


def test_validation(spark):
    mesh = small_box(spark)
    validate.require_empty(validate.dangling_corners(mesh.cells, mesh.vertices), "corner")
    with pytest.raises(ValueError, match="corner"):
        validate.require_empty(validate.dangling_corners(mesh.cells, mesh.vertices.limit(5)), "corner")
    with pytest.raises(ValueError, match="ids"):
        validate.require_contiguous(mesh.vertices.filter("vertex_id <> 3"), "vertex_id", "bad")


def write(df, folder):
    df.orderBy("line").select("value").coalesce(1).write.text(str(folder))
    return str(folder)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_gambit_round_trip(spark, tmp_path):
    mesh = small_box(spark, 12, 2, 3)
    tags = faces.match_facets(mesh.cells, mesh.facets).filter("bc <> 0")
    back = registry.read_mesh(spark, write(gambit.text_of(mesh.with_(face_bcs=tags)), tmp_path / "m"))
    assert same(back.vertices, mesh.vertices) and same(back.cells, mesh.cells.select(*back.cells.columns))
    assert same(back.face_bcs.select("cell_id", "face", "bc"), tags)


GAMBIT = """head
** GAMBIT NEUTRAL FILE
m
PROGRAM
date
NUMNP NELEM NGRPS NBSETS NDFCD NDFVL
4 1 1 1 3 3
ENDOFSECTION
NODAL COORDINATES
{}
ENDOFSECTION
ELEMENTS/CELLS
       1  6  4        1       2       3       4
ENDOFSECTION
ELEMENT GROUP
GROUP: 3 ELEMENTS: 1 MATERIAL: 2
g
0
       1
ENDOFSECTION
BOUNDARY CONDITIONS
 wall105 1 2 0 6
1 6 2
         1     6    4
ENDOFSECTION
"""


def test_gambit_fixed_and_variable_lines(spark, tmp_path):
    nodes = "\n".join(f"{k + 1:10d}{x:20.11e}{y:20.11e}{z:20.11e}" for k, x, y, z in TET)
    (tmp_path / "a.neu").write_text(GAMBIT.format(nodes).replace("\n", "\r\n"))
    mesh = gambit.read(spark, str(tmp_path / "a.neu"))
    assert [tuple(r) for r in mesh.vertices.orderBy("vertex_id").collect()] == TET
    assert mesh.cells.first().asDict() == {"cell_id": 0, "vertices": [0, 1, 2, 3], "group": 3}
    assert sorted((r["face"], r["bc"]) for r in mesh.face_bcs.collect()) == [(1, 5), (3, 5)]
    for broken, message in ((GAMBIT.format(nodes).replace("** G", "** X"), "not a Gambit"), (GAMBIT.format(nodes).replace("4 1 1 1 3 3", "4 1 1 1 2 2"), "3 dimensions"), (GAMBIT.format(nodes[: len(nodes) // 2]), "end of coordinates")):
        (tmp_path / "b.neu").write_text(broken)
        with pytest.raises(ValueError, match=message):
            gambit.read(spark, str(tmp_path / "b.neu"))


@pytest.mark.parametrize("text_of, source", [(gmsh.text22, "msh2"), (gmsh.text41, "msh4")])
def test_msh_round_trip(spark, tmp_path, text_of, source):
    mesh = small_box(spark, 6, 2, 3)
    path = write(text_of(mesh), tmp_path / "m")
    back = registry.read_mesh(spark, path, source)
    assert same(back.vertices, mesh.vertices) and same(back.cells, mesh.cells)
    assert same(faces.match_facets(back.cells, back.facets), faces.match_facets(mesh.cells, mesh.facets))
    with pytest.raises(ValueError, match="format"):
        registry.read_mesh(spark, path, "msh4" if source == "msh2" else "msh2")


MSH4 = """$MeshFormat
{version} 0 8
$EndMeshFormat
$PhysicalNames
1
3 9 "rock"
$EndPhysicalNames
$Entities
0 0 1 1
7 0 0 0 1 1 0 2 103 4 0
5 0 0 0 1 1 1 {volume} 0
$EndEntities
$Nodes
2 4 1 4
2 7 0 3
1
2
3
0 0 0
1 0 0
0 1 0
3 5 0 1
4
0 0 1
$EndNodes
$Elements
3 3 1 3
0 1 15 1
1 1
2 7 2 1
2 1 3 2
3 5 4 1
3 1 2 3 4
$EndElements
"""


def test_msh4_blocks_entities_and_errors(spark, tmp_path):
    f = tmp_path / "a.msh"
    f.write_text(MSH4.format(version=4.1, volume="1 9"))
    mesh = gmsh.read(spark, str(f))
    assert [tuple(r) for r in mesh.vertices.orderBy("vertex_id").collect()] == TET
    assert mesh.cells.first().asDict() == {"cell_id": 0, "vertices": [0, 1, 2, 3], "group": 9}
    assert [(r["nodes"], r["tag"]) for r in mesh.facets.collect()] == [([0, 2, 1], 103)]
    for text, message in (
        (MSH4.format(version=4.0, volume="1 9"), "isn't supported"), (MSH4.format(version=4.1, volume="0"), "no physical tag"),
        (MSH4.format(version=4.1, volume="1 9").replace("$EndNodes\n", ""), "expected"), (MSH4.format(version=4.1, volume="1 9").replace("3 1 2 3 4\n", "3 1 2 3 x\n"), "nodes"),
    ):
        f.write_text(text)
        with pytest.raises(ValueError, match=message):
            gmsh.read(spark, str(f)).cells.collect()
    with pytest.raises(ValueError, match="order"):
        gmsh.read(spark, str(f), order=11)


def test_second_order_elements(spark, tmp_path):
    """Corners are the first nodes; facets of six nodes match by theirs."""
    nodes = "\n".join(f"{k + 1} {k % 3} {k // 3} {k % 2}" for k in range(10))
    (tmp_path / "a.msh").write_text(f"$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n10\n{nodes}\n$EndNodes\n$Elements\n2\n1 9 2 103 1 1 2 3 5 6 7\n2 11 2 4 1 1 2 3 4 5 6 7 8 9 10\n$EndElements\n")
    mesh = gmsh.read(spark, str(tmp_path / "a.msh"), 2)
    assert mesh.cells.first()["vertices"] == list(range(10)) and mesh.cells.first()["group"] == 4
    assert [r["face"] for r in faces.match_facets(mesh.cells, mesh.facets).filter("bc = 3").collect()] == [0]


def test_sources_by_name(spark):
    with pytest.raises(ValueError, match="closed"):
        registry.read_mesh(spark, "x", "apf")
    with pytest.raises(ValueError, match="library that isn't here"):
        registry.read_mesh(spark, "x", "netcdf")
    with pytest.raises(ValueError, match="unknown source"):
        registry.read_mesh(spark, "x", "stl")


def test_partitioned_source(spark, tmp_path):
    raw = [(0, k, *r[1:]) for k, r in enumerate(TET)] + [(1, k, *r[1:]) for k, r in enumerate([*TET[1:], (9, 1.0, 1.0, 1.0)])]
    spark.createDataFrame(raw, "part int, local_id long, x double, y double, z double").write.parquet(str(tmp_path / "raw_vertices.parquet"))
    spark.createDataFrame([(0, 0, [0, 1, 2, 3], [1, 2, 3, 4]), (1, 0, [0, 1, 2, 3], [0, 0, 0, 9])], "part int, local_cell long, v array<bigint>, b array<int>").write.parquet(str(tmp_path / "raw_cells.parquet"))
    mesh = partitioned.read(spark, str(tmp_path))
    assert mesh.vertices.count() == 5 and [r["group"] for r in mesh.cells.collect()] == [0, 0]
    assert sorted((r["cell_id"], r["face"], r["bc"]) for r in mesh.face_bcs.collect()) == [(0, 0, 1), (0, 1, 2), (0, 2, 4), (0, 3, 3), (1, 2, 9)]


SETTINGS = '<a/><!-- note --><freeSurface>1</freeSurface><freeSurface>9</freeSurface><boundaryCondition tag="65">7</boundaryCondition><boundaryCondition tag="67">7</boundaryCondition><gradation value="0.3"/>'


def test_settings(spark):
    c = xmlconfig.config_of(spark.createDataFrame([(SETTINGS,)], "value string"))
    assert sorted(map(tuple, c.boundary_conditions.collect())) == [(1, 1), (7, 65), (7, 67)]
    one = c.scalars.first()
    assert (one["gradation"], one["globalMSize"], one["surface_smoothing_type"], one["surface_smoothing_level"]) == (0.3, 0.0, "Gradient", 2)
    assert c.entity_sizes.count() == c.cuboids.count() == c.wave_settings.count() == 0
    for text, message in (
        ('<SurfaceMeshing SmoothingLevel="3" SmoothingType="Odd" DiscreteAngle="1" Snap="0"/>', "smoothing type"), ("<gradation/>", "no attribute"),
    ):
        with raises(message):
            xmlconfig.config_of(spark.createDataFrame([(text,)], "value string")).scalars.collect()
    with raises("more than once"):
        xmlconfig.config_of(spark.createDataFrame([('<VelocityAwareMeshing easiFile="a" elementsPerWaveLength="2"/>' * 2,)], "value string")).wave_settings.collect()


def test_conversion(spark, tmp_path):
    path = write(gmsh.text41(small_box(spark, 6, 2, 3)), tmp_path / "m")
    out = str(tmp_path / "out")
    manifest = convert(spark, path, out, "msh4", boundary="i64", compactify=True)
    assert (manifest["cell_count"], manifest["vertex_count"], manifest["boundary_format"], manifest["degenerate_cells"]) == (36, 24, "i64", 0)
    tables, stored = columnar.read(spark, out)
    assert stored["cell_count"] == 36 and tables["group"].schema["group"].dataType.simpleString() == "tinyint"
    assert 'Dimensions="36 4"' in (tmp_path / "out" / "mesh.xdmf").read_text() and json.loads((tmp_path / "out" / "manifest.json").read_text()) == stored


def test_conversion_by_default(spark, tmp_path):
    write(gmsh.text22(small_box(spark, 6, 2, 3)), tmp_path / "m.msh")
    manifest = convert(spark, str(tmp_path / "m.msh"), source="msh2", rows_a_file=10, compactify=True, aspect_ratios=True)
    tables, _ = columnar.read(spark, str(tmp_path / "m.puml.h5"))
    assert tables["connect"].schema["vertices"].dataType.simpleString() == "array<tinyint>" and tables["connect"].count() == 36
    assert len(list((tmp_path / "m.puml.h5" / "connect").glob("part-*"))) >= 4
    assert sum(b["cells"] for b in manifest["aspect_ratios"]) == 36 and len(manifest["aspect_ratios"]) == 8


def test_block_heads_among_lines_like_them(spark, tmp_path):
    """Triangles numbered 0 to 3, and integer coordinates with a parameter, look like heads."""
    text = ["$MeshFormat", "4.1 0 8", "$EndMeshFormat", "$Entities", "0 0 1 1", "1 0 0 0 1 1 1 1 7 0", "1 0 0 0 1 1 1 1 9 0", "$EndEntities", "$Nodes", "2 4 1 4", "1 1 1 2", "1", "2"]
    text += ["0 0 0 1", "1 0 0 2", "3 1 0 2", "3", "4", "0 1 0", "0 0 1", "$EndNodes", "$Elements", "2 3 1 3", "2 1 2 2", "1 1 3 2", "2 1 2 4", "3 1 4 1", "3 1 2 3 4", "$EndElements"]
    (tmp_path / "m").write_text("\n".join(text) + "\n")
    mesh = gmsh.read(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, mesh.vertices.collect())) == [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)]
    assert [(r["vertices"], r["group"]) for r in mesh.cells.collect()] == [([0, 1, 2, 3], 9)] and sorted(r["tag"] for r in mesh.facets.collect()) == [7, 7]


def test_names():
    assert columnar.output_name("a/mesh.neu") == "a/mesh.puml.h5" and columnar.output_name("mesh") == "mesh.puml.h5" and columnar.output_name("x", "y") == "y"
    assert [columnar.description_name(n) for n in ("a.puml.h5", "a.h5", "a")] == ["a.xdmf", "a.xdmf", "a.xdmf"]


def test_compact_types(spark):
    for most, kind in ((127, "tinyint"), (128, "smallint"), (40000, "int"), (3_000_000_000, "bigint")):
        assert columnar.compact(spark.createDataFrame([(0,), (most,)], "v long"), "v").schema["v"].dataType.simpleString() == kind
    widths = spark.createDataFrame([(0,), (1,), (255,), (256,)], "n long").select(scalars.compact_bytes(F.col("n")))
    assert [r[0] for r in widths.collect()] == [0, 1, 1, 2]


def test_streamed_counts(spark, tmp_path):
    mesh = small_box(spark, 12, 2, 3)
    (tmp_path / "in").mkdir()
    query = group_counts(arriving_cells(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        for group in (1, 2):
            mesh.cells.filter(F.col("group") == group).write.mode("append").parquet(str(tmp_path / "in"))
            query.processAllAvailable()
        assert same(spark.table("counts"), group_counts(mesh.cells))
    finally:
        query.stop()


def test_truncation_matches_the_bit_pattern(spark):
    import struct

    values = [1.0, -1.5, math.pi, 1e-300, 123456.789, -2**-30 / 3, 1e300 / 7, 0.0]
    wanted = [struct.unpack("<d", struct.pack("<Q", struct.unpack("<Q", struct.pack("<d", v))[0] & ~0xF))[0] for v in values if abs(v) > 1e-250]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values) if abs(v) > 1e-250 or v == 0], "k int, x double")
    found = [r[1] for r in df.select("k", scalars.truncate_low_bits(F.col("x"))).orderBy("k").collect()]
    assert [f for f in found if f] == [w for w in wanted if w]


def test_owned_entities_of_parts(spark):
    v = spark.createDataFrame([(p, 10 + k, *r[1:], k % 2 == p) for p in (0, 1) for k, r in enumerate(TET)], "part int, vertex_key long, x double, y double, z double, is_owned boolean")
    c = spark.createDataFrame([(0, 7, [10, 11, 12, 13], 2, True), (1, 7, [10, 11, 12, 13], 2, False)], "part int, cell_key long, vertex_keys array<bigint>, `group` int, is_owned boolean")
    tags = spark.createDataFrame([([12, 10, 11], 105)], "nodes array<bigint>, tag int")
    mesh = partitioned.owned_entities(v, c, tags)
    assert [tuple(r) for r in mesh.vertices.orderBy("vertex_id").collect()] == TET
    assert mesh.cells.first().asDict() == {"cell_id": 0, "vertices": [0, 1, 2, 3], "group": 2}
    assert [(r["face"], r["bc"]) for r in faces.match_facets(mesh.cells, mesh.facets).filter("bc <> 0").collect()] == [(0, 5)]
