"""Tables that grow with the mesh stay out of the driver, and tasks take bounded parts of them."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tetraspark import queries
from tetraspark.operators import dealing, faces
from tetraspark.sources import boxmesh, gmsh
from tetraspark.sources.lines import numbered_lines


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def most_in_a_task(df) -> int:
    return max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect())


def test_box_unfolds_in_many_tasks(spark):
    """duplicate_faces, exterior_faces, surface_bc_match, mesh_summary: one split of numbers unfolded in one task."""
    n = 8 * boxmesh.HEXES_A_TASK
    cells = boxmesh.box(spark.range(n).coalesce(1), "id").cells
    assert cells.count() == 6 * n
    assert most_in_a_task(cells) < 6 * 4 * boxmesh.HEXES_A_TASK


def test_exterior_faces_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(dealing, "ROWS_A_TASK", 1000)
    found = faces.exterior_faces(boxmesh.box(spark.range(2000), "id").cells)
    assert found.rdd.getNumPartitions() == 48
    assert found.count() == 4 * (20 * 10 + 20 * 10 + 10 * 10)


@pytest.mark.parametrize("name", ["mesh_summary", "surface_bc_match", "model_face_tags", "dangling_vertices", "puml_roundtrip", "gambit_roundtrip"])
def test_no_mesh_table_is_broadcast(spark, name):
    text = plan(queries.QUERIES[name](spark, SMALL)).replace("BroadcastHashJoin [__stretch", "")  # sections of a file, a row each
    if name == "model_face_tags":  # but for the tags of model faces, a row each
        assert text.count("BroadcastHashJoin") == 1 and "BuildLeft" not in text
    else:
        assert "BroadcastHashJoin" not in text


def test_parts_are_broadcast_not_the_box(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.partitioned, "owned_entities", lambda v, c: seen.extend([v, c]) or queries.Mesh(v, c.withColumnsRenamed({"cell_key": "cell_id", "vertex_keys": "vertices"})))
    queries.owned_entities_mesh(spark, SMALL)
    for df in seen:
        assert "BroadcastNestedLoopJoin BuildRight" in plan(df)


def test_assembled_parts_are_not_broadcast(spark, monkeypatch):
    """partitioned_mesh: raw vertices pack well, and went through the driver."""
    seen, whole = [], queries.partitioned.global_ids
    monkeypatch.setattr(queries.partitioned, "global_ids", lambda *a: seen.append(whole(*a)) or seen[-1])
    queries.partitioned_mesh(spark, SMALL)
    assert "BroadcastHashJoin [k" not in plan(seen[0]) and "SortMergeJoin [k" in plan(seen[0])


def test_lines_of_part_files_follow_each_other(spark, tmp_path):
    """A mesh file was written by one task, since a folder's files were numbered by their splits' offsets alone."""
    spark.range(1000).repartitionByRange(12, "id").sortWithinPartitions("id").select(F.col("id").cast("string").alias("value")).write.text(str(tmp_path / "parts"))
    found = numbered_lines(spark, str(tmp_path / "parts"))
    assert found.count() == 1000 and found.filter("line <> cast(value as bigint)").count() == 0


def test_round_trips_write_many_files(spark):
    mesh = boxmesh.box(spark.range(200), "id")
    folder = queries._written(mesh, lambda m: gmsh.text22(m).repartitionByRange(5, "line"), "msh2")
    read = spark.read.text(folder)
    assert read.select(F.input_file_name()).distinct().count() > 1
    assert gmsh.read(spark, folder).cells.count() == 1200
