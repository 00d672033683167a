"""Gambit neutral files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mesh import Mesh
from ..operators.dealing import dealt
from ..operators.groups import assign_groups
from ..operators.numbering import numbered
from ..operators.validate import require_empty
from ..storage import stored
from .lines import between, in_ranges, stored_lines, tokens

# The format's marks, the width of a coordinate and the elements on a line of a group.
FILE_MARK = "** GAMBIT NEUTRAL FILE"
END, COORDINATES, ELEMENTS, GROUP, BOUNDARY = "ENDOFSECTION", "NODAL COORDINATES", "ELEMENTS/CELLS", "ELEMENT GROUP", "BOUNDARY CONDITIONS"
COORDINATE_WIDTH, ELEMENTS_A_LINE = 20, 10


@dataclass(frozen=True)
class Section:
    """Lines first to first + lines - 1; rows: entries in them; value: a group's number or a boundary's tag."""

    first: int
    lines: int
    rows: int
    value: int = 0


@dataclass(frozen=True)
class Index:
    vertices: Section
    elements: Section
    groups: tuple[Section, ...]
    boundaries: tuple[Section, ...]


def _tag(name: str) -> int:
    number = int(re.search(r"[0-9]*$", name)[0] or 0)
    return number - 100 if number >= 100 else number


def index(lines: DataFrame) -> Index:
    """Where the sections are. Only the header and the lines around section marks come to the driver."""
    head = {r["line"]: r["value"].strip() for r in lines.filter("line < 9").collect()}
    if head.get(1) != FILE_MARK:
        raise ValueError("not a Gambit neutral file")
    counts = head.get(6, "").split()
    if len(counts) < 5 or counts[4] != "3":
        raise ValueError("a Gambit file must hold a mesh of 3 dimensions")
    if head.get(7) != END:
        raise ValueError(f"end of header expected, found {head.get(7)!r}")
    n_vertices, n_elements, n_groups, n_boundaries = map(int, counts[:4])
    marks = lines.filter(F.col("value").rlike(f"^\\s*({END})\\s*$|{COORDINATES}|{ELEMENTS}|{GROUP}|{BOUNDARY}"))
    # each section's mark, the line after it and its end
    wanted = marks.select("line").union(marks.select(F.col("line") + 1)).distinct()
    found = {r["line"]: r["value"] for r in lines.join(F.broadcast(wanted), "line", "left_semi").collect()}
    ends = sorted(k for k, v in found.items() if v.strip() == END)

    def closed(first: int, n: int, what: str) -> int:
        if found.get(first + n, "").strip() != END:
            raise ValueError(f"end of {what} expected at line {first + n + 1}")
        return first

    def section(mark: str) -> list[int]:
        return sorted(k for k, v in found.items() if mark in v)

    starts = section(COORDINATES), section(ELEMENTS)
    if not all(starts):
        raise ValueError("coordinates or elements are missing")
    vertices = Section(closed(starts[0][0] + 1, n_vertices, "coordinates"), n_vertices, n_vertices)
    elements = Section(closed(starts[1][0] + 1, n_elements, "elements"), n_elements, n_elements)
    groups = []
    for k in section(GROUP):
        words = found[k + 1].split()
        n = int(words[3])
        size = -(-n // ELEMENTS_A_LINE)
        groups.append(Section(closed(k + 4, size, "group"), size, n, int(words[1])))
    boundaries = []
    for k in section(BOUNDARY):
        words = found[k + 1].split()
        n = int(words[2])
        boundaries.append(Section(closed(k + 2, n, "boundaries"), n, n, _tag(words[0])))
    if (len(groups), len(boundaries)) != (n_groups, n_boundaries) or len(ends) < 3 + n_groups + n_boundaries:
        raise ValueError(f"{n_groups} groups and {n_boundaries} boundaries expected, found {len(groups)} and {len(boundaries)}")
    return Index(vertices, elements, tuple(groups), tuple(boundaries))


def read_vertices(lines: DataFrame, at: Section) -> DataFrame:
    """Coordinates are the last three fields of a fixed width."""
    field = lambda k: F.trim(F.expr(f"substring(value, length(value) - {(3 - k) * COORDINATE_WIDTH} + 1, {COORDINATE_WIDTH})")).try_cast("double")
    return between(lines, at.first, at.rows).select(F.col("at").alias("vertex_id"), field(0).alias("x"), field(1).alias("y"), field(2).alias("z"))


def read_elements(lines: DataFrame, at: Section) -> DataFrame:
    """(cell_id, vertices): four ids of equal width, which needn't have blanks between them."""
    lead = r"^\s*\d+\s+\d+\s+\d+\s"
    first = lines.filter(F.col("line") == at.first).first()
    if first is not None:
        text = first["value"].rstrip()
        start = re.match(lead, text)
        if start is None or (len(text) - start.end()) % 4:
            raise ValueError("the mesh doesn't seem to hold tetrahedra")
        start, width = start.end(), (len(text) - start.end()) // 4
    else:
        start, width = 0, 1
    ids = [F.trim(F.substring("value", start + 1 + k * width, width)).try_cast("bigint") - 1 for k in range(4)]
    return between(lines, at.first, at.rows).select(F.col("at").alias("cell_id"), F.array(*ids).alias("vertices"))


def _of_sections(lines: DataFrame, sections: tuple[Section, ...]) -> DataFrame:
    """(line, value, tag, number): lines of sections, and each section's number among them."""
    spark = lines.sparkSession
    rows = [(s.first, s.first + s.lines, s.value, k) for k, s in enumerate(sections)]
    return in_ranges(lines, F.broadcast(spark.createDataFrame(rows, "low long, high long, tag int, number int")))  # a row a section


def read_groups(lines: DataFrame, sections: tuple[Section, ...]) -> DataFrame:
    """(cell_id, group, ordinal) of all groups' lists."""
    rows = _of_sections(lines, sections).select("line", "tag", F.posexplode(tokens()).alias("place", "id"))
    return rows.filter("id <> ''").select((F.col("id").try_cast("bigint") - 1).alias("cell_id"), F.col("tag").alias("group"), (F.col("line") * ELEMENTS_A_LINE + F.col("place")).alias("ordinal"))


def read_boundaries(lines: DataFrame, sections: tuple[Section, ...]) -> DataFrame:
    """(cell_id, face, bc, ordinal): element and face numbers of all sections, whatever the lengths of their lines."""
    rows = _of_sections(lines, sections).withColumn("w", tokens())
    return rows.select((F.get("w", F.lit(0)).try_cast("bigint") - 1).alias("cell_id"), (F.get("w", F.lit(2)).try_cast("int") - 1).alias("face"), F.col("tag").alias("bc"), F.col("line").alias("ordinal"))


def read(spark: SparkSession, path: str) -> Mesh:
    lines = stored_lines(spark, path)
    at = index(lines)
    vertices, cells = read_vertices(lines, at.vertices), read_elements(lines, at.elements)
    require_empty(vertices.filter("x is null or y is null or z is null"), "a vertex's line doesn't hold numbers")
    require_empty(cells.filter(F.exists("vertices", lambda v: v.isNull())), "an element's line doesn't hold numbers")
    if at.groups:
        cells = assign_groups(cells, dealt(read_groups(lines, at.groups), sum(s.rows for s in at.groups), "cell_id"))
    else:
        cells = cells.withColumn("group", F.lit(0))
    cells = stored(cells, "cells")
    bcs = read_boundaries(lines, at.boundaries) if at.boundaries else spark.createDataFrame([], "cell_id long, face int, bc int, ordinal long")
    return Mesh(vertices, cells, face_bcs=bcs)


def text_of(mesh: Mesh) -> DataFrame:
    """(line, value): the mesh as a neutral file, for tests and exports. Tags are written as they are."""
    spark = mesh.vertices.sparkSession
    n_v, n_c = mesh.vertices.count(), mesh.cells.count()
    groups = [(r["group"], r["n"]) for r in mesh.cells.groupBy("group").agg(F.count("*").alias("n")).orderBy("group").collect()]
    bcs = mesh.face_bcs.filter("bc <> 0") if mesh.face_bcs is not None else None
    tags = [(r["bc"], r["n"]) for r in bcs.groupBy("bc").agg(F.count("*").alias("n")).orderBy("bc").collect()] if bcs is not None else []
    fixed, parts, at = [], [], 0

    def put(*text: str) -> None:
        nonlocal at
        for t in text:
            fixed.append((at, t))
            at += 1

    put("        CONTROL INFO 2.0.0", FILE_MARK, "mesh", "PROGRAM:                Gambit     VERSION:  2.0.0", "", "     NUMNP     NELEM     NGRPS    NBSETS     NDFCD     NDFVL")
    put(f"{n_v:10d}{n_c:10d}{len(groups):10d}{len(tags):10d}{3:10d}{3:10d}", END, f"   {COORDINATES} 2.0.0")
    number = lambda c: F.lpad(c.cast("string"), COORDINATE_WIDTH, " ")
    parts.append(mesh.vertices.select((F.col("vertex_id") + at).alias("line"), F.concat(F.lpad((F.col("vertex_id") + 1).cast("string"), 10, " "), *[number(F.col(a)) for a in "xyz"]).alias("value")))
    at += n_v
    put(END, f"      {ELEMENTS} 2.0.0")
    ids = [F.lpad((F.col("vertices")[k] + 1).cast("string"), 10, " ") for k in range(4)]
    parts.append(mesh.cells.select((F.col("cell_id") + at).alias("line"), F.concat(F.lpad((F.col("cell_id") + 1).cast("string"), 10, " "), F.lit("  6  4 "), *ids).alias("value")))
    at += n_c
    put(END)
    # rows in the order of their groups, or tags, and each one's first row and first line
    places, before = [], 0
    for group, n in groups:
        put(f"       {GROUP} 2.0.0", f"GROUP: {group:10d} ELEMENTS: {n:10d} MATERIAL: 2.000 NFLAGS: 1", f"group {group}", "       0")
        places.append((group, before, at))
        before, at = before + n, at + -(-n // ELEMENTS_A_LINE)
        put(END)
    where = F.broadcast(spark.createDataFrame(places, "`group` int, first long, low long"))  # a row a group
    own = numbered(mesh.cells.select(F.col("group").cast("int").alias("group"), "cell_id"), ["group", "cell_id"], "k").join(where, "group")
    own = own.select((F.col("low") + F.floor((F.col("k") - F.col("first")) / ELEMENTS_A_LINE)).alias("line"), "cell_id")
    listed = own.groupBy("line").agg(F.array_sort(F.collect_list("cell_id")).alias("ids"))
    parts.append(listed.select("line", F.concat_ws("", F.transform("ids", lambda i: F.lpad((i + 1).cast("string"), 10, " "))).alias("value")))
    places, before = [], 0
    for tag, n in tags:
        put(f" {BOUNDARY} 2.0.0", f"{tag + 100:32d}{1:8d}{n:10d}{0:8d}{6:8d}")
        places.append((tag, before, at))
        before, at = before + n, at + n
        put(END)
    if places:
        where = F.broadcast(spark.createDataFrame(places, "bc int, first long, low long"))  # a row a tag
        own = numbered(bcs.select(F.col("bc").cast("int").alias("bc"), "cell_id", "face"), ["bc", "cell_id", "face"], "k").join(where, "bc")
        parts.append(own.select((F.col("low") + F.col("k") - F.col("first")).alias("line"), F.concat(F.lpad((F.col("cell_id") + 1).cast("string"), 10, " "), F.lit("     6"), F.lpad((F.col("face") + 1).cast("string"), 5, " ")).alias("value")))
    out = spark.createDataFrame(fixed, "line long, value string")
    for p in parts:
        out = out.unionByName(p)
    return out
