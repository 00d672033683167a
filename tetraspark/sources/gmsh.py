"""ASCII mesh files of the formats 2.2 and 4.1."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mesh import Mesh
from ..operators.dealing import joined
from ..operators.groups import entity_tags
from ..operators.numbering import numbered
from ..operators.validate import require_contiguous, require_empty
from ..schema import element_type, simplex_nodes
from ..storage import stored
from .lines import between, in_ranges, stored_lines, tokens


@dataclass(frozen=True)
class Part:
    """Lines between a section's marks: first to end - 1."""

    first: int
    end: int


def parts(lines: DataFrame) -> dict[str, Part]:
    """Sections by name; unknown ones too. Only marks come to the driver."""
    marks = sorted((r["line"], r["value"].strip()[1:]) for r in lines.filter(F.col("value").rlike(r"^\s*\$")).collect())
    found: dict[str, Part] = {}
    opened: tuple[int, str] | None = None
    for line, name in marks:
        if opened and name == f"End{opened[1]}":
            found[opened[1]] = Part(opened[0] + 1, line)
            opened = None
        elif opened is None:
            opened = (line, name)
        else:
            raise ValueError(f"expected $End{opened[1]}, found ${name}")
    if opened:
        raise ValueError(f"expected $End{opened[1]}")
    return found


def version(lines: DataFrame, found: dict[str, Part]) -> float:
    if "MeshFormat" not in found:
        raise ValueError("not a mesh file: $MeshFormat is missing")
    words = lines.filter(F.col("line") == found["MeshFormat"].first).first()["value"].split()
    if words[1] != "0":
        raise ValueError("only ASCII mesh files are supported")
    return float(words[0])


def _require(found: dict[str, Part], *names: str) -> None:
    missing = [n for n in names if n not in found]
    if missing:
        raise ValueError(f"sections are missing: {missing}")


def _words(lines: DataFrame, part: Part, skip: int = 0) -> DataFrame:
    """(line, w): words of a section's lines, the first `skip` left out."""
    return lines.filter((F.col("line") >= part.first + skip) & (F.col("line") < part.end)).select("line", tokens().alias("w"))


def _integer(column):
    """A word as a non-negative integer, null if it isn't one. Bad words are found once rows are known (see build)."""
    return F.when(column.rlike("^[0-9]+$"), column.try_cast("bigint"))


def entities(lines: DataFrame, part: Part) -> DataFrame:
    """(dim, entity_tag, physical_tag) of surfaces and volumes with a physical tag; of several the first."""
    head = [int(x) for x in lines.filter(F.col("line") == part.first).first()["value"].split()]
    rows, at = [], part.first + 1 + head[0] + head[1]
    for dim, n in ((2, head[2]), (3, head[3])):
        own = between(lines, at, n).select(F.lit(dim).alias("dim"), tokens().alias("w"))
        rows.append(own.select("dim", _integer(F.get("w", F.lit(0))).alias("entity_tag"), F.get("w", F.lit(7)).try_cast("int").alias("n"), F.get("w", F.lit(8)).try_cast("int").alias("tag")))
        at += n
    both = rows[0].unionByName(rows[1])
    require_empty(both.filter("dim = 3 and coalesce(n, 0) = 0").select("entity_tag"), "a volume has no physical tag")
    return both.filter("n > 0").select("dim", "entity_tag", F.col("tag").alias("physical_tag"))


def _block_heads(words: DataFrame, part: Part, lines_each: int) -> DataFrame:
    """(line, h, n): heads of blocks, which follow each other: a head with n entries has lines_each * n lines below.

    A head is four integers, the first of which is a dimension; so are few other lines (an element's number of
    0 to 3 with three nodes, integer places on a curve with their parameter). Of these, which are as few as the file's blocks, the heads
    are found by going through them in order, and written once.
    """
    able = words.filter((F.size("w") == 4) & F.col("w")[0].isin("0", "1", "2", "3") & F.forall("w", lambda x: x.rlike("^[0-9]+$")))
    able = able.select("line", F.transform("w", lambda x: x.try_cast("bigint")).alias("h")).filter(F.col("line") + 1 + lines_each * F.col("h")[3] <= part.end)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due = part.first + 1
        for pdf in batches:
            rows = []
            for line, h in zip(pdf["line"], pdf["h"], strict=True):
                if line == due:
                    rows.append((line, list(h), int(h[3])))
                    due += 1 + lines_each * int(h[3])
            yield pd.DataFrame(rows, columns=["line", "h", "n"])

    return stored(able.orderBy("line").coalesce(1).mapInPandas(run, "line long, h array<long>, n long"), "heads")


def _in_blocks(words: DataFrame, heads: DataFrame, lines_each: int) -> DataFrame:
    """(line, w, head, at, ..): lines below heads, each one's place below its head, and the head's columns."""
    below = heads.select(F.col("line").alias("head"), *[c for c in heads.columns if c != "line"], (F.col("line") + 1).alias("low"), (F.col("line") + 1 + lines_each * F.col("n")).alias("high"))
    return in_ranges(words, below).withColumn("at", F.col("line") - F.col("low"))


def nodes41(lines: DataFrame, part: Part) -> DataFrame:
    """Blocks of node tags, then as many lines of coordinates."""
    words = _words(lines, part, 1)
    rows = _in_blocks(words, _block_heads(words, part, 2), 2)
    tag = rows.filter("at < n").select("head", F.col("at").alias("k"), (_integer(F.get("w", F.lit(0))) - 1).alias("vertex_id"))
    xyz = rows.filter("at >= n").select("head", (F.col("at") - F.col("n")).alias("k"), *[F.get("w", F.lit(i)).try_cast("double").alias(a) for i, a in enumerate("xyz")])
    return joined(tag, xyz, ["head", "k"]).select("vertex_id", "x", "y", "z")


def elements41(lines: DataFrame, part: Part, tags: DataFrame) -> DataFrame:
    """(element, type, nodes, tag): entries of all blocks with their entity's physical tag, 0 without one; tags are looked up for heads, not for each entry."""
    words = _words(lines, part, 1)
    heads = _block_heads(words, part, 1).select("line", "h", "n", F.col("h")[0].cast("int").alias("dim"), F.col("h")[1].alias("entity_tag"))
    rows = _in_blocks(words, stored(entity_tags(heads, tags), "tagged"), 1)
    ids = F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x: x.try_cast("bigint") - 1)
    return rows.select(F.col("line").alias("element"), F.col("h")[2].cast("int").alias("type"), ids.alias("nodes"), "tag")


def nodes22(lines: DataFrame, part: Part) -> DataFrame:
    w = _words(lines, part, 1)
    return w.select((_integer(F.get("w", F.lit(0))) - 1).alias("vertex_id"), *[F.get("w", F.lit(i + 1)).try_cast("double").alias(a) for i, a in enumerate("xyz")])


def elements22(lines: DataFrame, part: Part) -> DataFrame:
    """An entry is its number, type, number of tags, the tags (the first is the physical one) and the nodes."""
    w = _words(lines, part, 1).withColumn("n_tags", F.get("w", F.lit(2)).try_cast("int"))
    ids = F.transform(F.slice("w", F.col("n_tags") + 4, F.greatest(F.size("w") - 3 - F.col("n_tags"), F.lit(0))), lambda x: x.try_cast("bigint") - 1)
    tag = F.when(F.col("n_tags") > 0, F.get("w", F.lit(3)).try_cast("int")).otherwise(0)
    return w.select(F.col("line").alias("element"), F.get("w", F.lit(1)).try_cast("int").alias("type"), ids.alias("nodes"), tag.alias("tag"))


def simplices(elements: DataFrame, dim: int, order: int) -> DataFrame:
    """(element, nodes, tag) of simplices of one dimension and order; others are dropped."""
    return elements.filter(F.col("type") == element_type(dim, order)).select("element", "nodes", "tag")


def misshapen(elements: DataFrame, order: int) -> DataFrame:
    """Simplices of an order that haven't as many nodes as they need, or a word that isn't a number among them."""
    wrong = [(F.col("type") == element_type(d, order)) & ((F.size("nodes") != simplex_nodes(d, order)) | F.exists("nodes", lambda x: x.isNull())) for d in (2, 3)]
    return elements.filter(wrong[0] | wrong[1])


def build(vertices: DataFrame, elements: DataFrame, order: int) -> Mesh:
    """Cells and facets among elements; cells are numbered in the order of the file. Both tables are written once, since checks read them, too."""
    vertices, elements = stored(vertices, "nodes"), stored(elements, "elements")
    require_empty(vertices.filter("vertex_id is null or x is null or y is null or z is null"), "a node's line doesn't hold numbers")
    require_contiguous(vertices, "vertex_id", "node numbers must be 1 to the number of nodes")
    require_empty(misshapen(elements, order), "an element has too few or too many nodes")
    cells = numbered(simplices(elements, 3, order), ["element"], "cell_id").select("cell_id", F.col("nodes").alias("vertices"), F.col("tag").alias("group"))
    return Mesh(vertices, cells, simplices(elements, 2, order).select(F.col("element").alias("facet_id"), "nodes", "tag"), order=order)


def read(spark: SparkSession, path: str, order: int = 1, major: int | None = None) -> Mesh:
    """Format 2.2 or 4.1 by the file's version, which must be of `major` if that is given; 4.0, whose layout is another one, is refused."""
    element_type(3, order)
    lines = stored_lines(spark, path)
    found = parts(lines)
    v = version(lines, found)
    if major not in (None, int(v)):
        raise ValueError(f"the file has format {v}, not {major}")
    if 2 <= v < 3:
        _require(found, "Nodes", "Elements")
        return build(nodes22(lines, found["Nodes"]), elements22(lines, found["Elements"]), order)
    if 4 < v < 5:
        _require(found, "Entities", "Nodes", "Elements")
        return build(nodes41(lines, found["Nodes"]), elements41(lines, found["Elements"], entities(lines, found["Entities"])), order)
    raise ValueError(f"mesh format {v} isn't supported: 2.x or 4.1")


def _assemble(spark: SparkSession, pieces: list) -> DataFrame:
    """(line, value) from texts and (frame of (k, value), rows) in order."""
    fixed, frames, at = [], [], 0
    for piece in pieces:
        if isinstance(piece, str):
            fixed.append((at, piece))
            at += 1
        else:
            frame, n = piece
            frames.append(frame.select((F.col("k") + at).cast("long").alias("line"), "value"))
            at += n
    out = spark.createDataFrame(fixed, "line long, value string")
    for f in frames:
        out = out.unionByName(f)
    return out


def _runs(df: DataFrame, group: str, by: str, ids: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(k, entity, by, ids) in the order (group, by), and each group's rows; entity: the group's place from 0."""
    sizes = [(r[group], r["n"]) for r in df.groupBy(group).agg(F.count("*").alias("n")).orderBy(group).collect()]
    place = F.broadcast(df.sparkSession.createDataFrame([(g, i) for i, (g, _) in enumerate(sizes)], f"`{group}` {df.schema[group].dataType.simpleString()}, entity long"))  # a row a group
    return numbered(df.select(group, by, ids), [group, by], "k").join(place, group).select("k", "entity", by, ids), sizes


def text22(mesh: Mesh) -> DataFrame:
    """(line, value): the mesh in format 2.2, for tests and exports."""
    spark, nv, nc, nf = mesh.vertices.sparkSession, mesh.vertices.count(), mesh.cells.count(), mesh.facets.count()
    node = mesh.vertices.select(F.col("vertex_id").alias("k"), F.concat_ws(" ", F.col("vertex_id") + 1, "x", "y", "z").alias("value"))
    ids = lambda c: F.concat_ws(" ", F.transform(c, lambda i: (i + 1).cast("string")))
    facet = numbered(mesh.facets, ["facet_id"], "k").select("k", F.concat_ws(" ", F.col("k") + 1, F.lit(f"{element_type(2, mesh.order)} 2"), "tag", F.lit(1), ids("nodes")).alias("value"))
    cell = mesh.cells.select(F.col("cell_id").alias("k"), F.concat_ws(" ", F.col("cell_id") + nf + 1, F.lit(f"{element_type(3, mesh.order)} 2"), "group", F.lit(1), ids("vertices")).alias("value"))
    return _assemble(spark, ["$MeshFormat", "2.2 0 8", "$EndMeshFormat", "$Nodes", str(nv), (node, nv), "$EndNodes", "$Elements", str(nf + nc), (facet, nf), (cell, nc), "$EndElements"])


def text41(mesh: Mesh) -> DataFrame:
    """(line, value): the mesh in format 4.1, an entity for each tag and for each group."""
    spark, nv, nc, nf = mesh.vertices.sparkSession, mesh.vertices.count(), mesh.cells.count(), mesh.facets.count()
    (facets, tags), (cells, groups) = _runs(mesh.facets, "tag", "facet_id", "nodes"), _runs(mesh.cells, "group", "cell_id", "vertices")
    pieces: list = ["$MeshFormat", "4.1 0 8", "$EndMeshFormat", "$Entities", f"1 1 {len(tags)} {len(groups)}", "1 0 0 0 0", "1 0 0 0 1 0 0 0 0"]
    pieces += [f"{k + 1} 0 0 0 1 1 1 1 {t} 0" for k, (t, _) in enumerate(tags)] + [f"{k + 1} 0 0 0 1 1 1 1 {g} 0" for k, (g, _) in enumerate(groups)]
    tag = mesh.vertices.select(F.col("vertex_id").alias("k"), (F.col("vertex_id") + 1).cast("string").alias("value"))
    xyz = mesh.vertices.select(F.col("vertex_id").alias("k"), F.concat_ws(" ", "x", "y", "z").alias("value"))
    pieces += ["$EndEntities", "$Nodes", f"1 {nv} 1 {nv}", f"3 1 0 {nv}", (tag, nv), (xyz, nv), "$EndNodes", "$Elements", f"{len(tags) + len(groups)} {nf + nc} 1 {nf + nc}"]
    ids = lambda c: F.concat_ws(" ", F.transform(c, lambda i: (i + 1).cast("string")))
    heads, before = [], 0
    for dim, sizes in ((2, tags), (3, groups)):
        for e, (_, n) in enumerate(sizes):
            heads.append((before + len(heads), f"{dim} {e + 1} {element_type(dim, mesh.order)} {n}"))
            before += n
    # an element stands below the heads of all blocks up to its own
    rows = spark.createDataFrame(heads, "k long, value string")
    rows = rows.unionByName(facets.select((F.col("k") + F.col("entity") + 1).alias("k"), F.concat_ws(" ", F.col("facet_id") + 1, ids("nodes")).alias("value")))
    rows = rows.unionByName(cells.select((F.col("k") + nf + len(tags) + F.col("entity") + 1).alias("k"), F.concat_ws(" ", F.col("cell_id") + nf + 1, ids("vertices")).alias("value")))
    return _assemble(spark, [*pieces, (rows, before + len(heads)), "$EndElements"])
