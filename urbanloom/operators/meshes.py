"""Triangle and tetrahedral meshes as tables of vertices, faces and cells."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_corners(faces: DataFrame, vertices: DataFrame, corners: tuple[str, ...] = ("v0", "v1", "v2")) -> DataFrame:
    """`faces` with x, y, z of every corner as <corner>_x and so on: one equi-join per corner."""
    for c in corners:
        at = vertices.select(F.col("vid").alias(c), *(F.col(k).alias(f"{c}_{k}") for k in "xyz"))
        faces = faces.join(at, c)
    return faces


def _edge(a: str, b: str) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{b}_{k}") - F.col(f"{a}_{k}") for k in "xyz")


def _dot(a, b) -> Column:  # noqa: ANN001
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a, b) -> tuple[Column, Column, Column]:  # noqa: ANN001
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _norm(a) -> Column:  # noqa: ANN001
    return F.sqrt(_dot(a, a))


def _or_one(c: Column) -> Column:
    return F.when(c > 0, c).otherwise(1.0)


def triangle_quality(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """fid, quality, aspect_ratio, edge_ratio, skewness of every triangle; zero denominators count as one."""
    held = with_corners(faces, vertices)
    e = [_edge("v0", "v1"), _edge("v1", "v2"), _edge("v2", "v0")]
    held = held.select("fid", (_norm(_cross(e[0], _edge("v0", "v2"))) / 2).alias("a"), *(_norm(s).alias(f"l{k}") for k, s in enumerate(e)))
    a, l0, l1, l2 = (F.col(c) for c in ("a", "l0", "l1", "l2"))
    root = 4 * math.sqrt(3)
    longest, shortest = F.greatest(l0, l1, l2), F.least(l0, l1, l2)
    radius = l0 * l1 * l2 / (4.0 * _or_one(a))
    ideal = _or_one((3.0 * math.sqrt(3.0) / 4.0) * radius * radius)
    return held.select(
        "fid",
        (root * a / _or_one(l0 * l0 + l1 * l1 + l2 * l2)).alias("quality"),
        (longest * (l0 + l1 + l2) / (root * _or_one(a))).alias("aspect_ratio"),
        (longest / _or_one(shortest)).alias("edge_ratio"),
        (1.0 - a / ideal).alias("skewness"),
    )


TET_EDGES = (("v0", "v1"), ("v0", "v2"), ("v0", "v3"), ("v1", "v2"), ("v1", "v3"), ("v2", "v3"))


def tetrahedron_quality(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """cid, volume, quality, aspect_ratio, edge_ratio, skewness of every tetrahedron; zero denominators count as one."""
    held = with_corners(cells, vertices, ("v0", "v1", "v2", "v3"))
    edges = [_edge(a, b) for a, b in TET_EDGES]
    area = lambda a, b, c: 0.5 * _norm(_cross(_edge(a, b), _edge(a, c)))
    faces = area("v1", "v2", "v3") + area("v0", "v2", "v3") + area("v0", "v1", "v3") + area("v0", "v1", "v2")
    # the circumcentre from v0: the edge cross products, weighted by the squared edges, over twelve volumes
    parts = [tuple(_dot(edges[k], edges[k]) * c for c in _cross(edges[i], edges[j])) for k, i, j in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]
    centre = tuple(sum(p[k] for p in parts[1:]) + parts[0][k] for k in range(3))
    held = held.select("cid", (F.abs(_dot(edges[0], _cross(edges[1], edges[2]))) / 6.0).alias("v"), faces.alias("faces"), _norm(centre).alias("centre"), *(_norm(s).alias(f"l{k}") for k, s in enumerate(edges)))
    v, lengths = F.col("v"), [F.col(f"l{k}") for k in range(6)]
    squares = sum((s * s for s in lengths[1:]), lengths[0] * lengths[0])
    inner = 3.0 * v / _or_one(F.col("faces"))
    outer = F.when(v > 0, F.col("centre") / (12.0 * v)).otherwise(0.0)
    p1, p2, p3 = lengths[0] * lengths[5], lengths[1] * lengths[4], lengths[2] * lengths[3]
    radius = F.sqrt(F.abs((p1 + p2 + p3) * (p1 - p2 + p3) * (p1 + p2 - p3) * (-p1 + p2 + p3))) / (24.0 * _or_one(v))
    ideal = _or_one((8.0 * math.sqrt(3.0) / 27.0) * radius * radius * radius)
    return held.select(
        "cid",
        v.alias("volume"),
        (72.0 * math.sqrt(3.0) * v / _or_one(F.sqrt(squares * squares * squares))).alias("quality"),
        (outer / (3.0 * _or_one(inner))).alias("aspect_ratio"),
        (F.greatest(*lengths) / _or_one(F.least(*lengths))).alias("edge_ratio"),
        (1.0 - v / ideal).alias("skewness"),
    )


def summary(quality: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: num_cells, and least, greatest and mean of every metric."""
    return quality.agg(F.count("*").alias("num_cells"), *(f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))))


def weld(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices at one position become one, the first by vid; faces point to it."""
    first = vertices.groupBy("x", "y", "z").agg(F.min("vid").alias("kept"))
    mapped = vertices.join(first, ["x", "y", "z"]).select("vid", "kept")
    for c in ("v0", "v1", "v2"):
        faces = faces.join(mapped.withColumnsRenamed({"vid": c, "kept": f"_{c}"}), c).drop(c).withColumnRenamed(f"_{c}", c)
    return first.select(F.col("kept").alias("vid"), "x", "y", "z"), faces.select("fid", "v0", "v1", "v2")


def merge(meshes: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Several meshes (mesh_id, vid, x, y, z and mesh_id, fid, v0, v1, v2; ids from 0) as one, in the order of mesh_id.

    The offset of a mesh is the sum of the sizes before it: a running sum over
    one row per mesh."""
    size = meshes.groupBy("mesh_id").agg(F.count("*").alias("n"))
    count = faces.groupBy("mesh_id").agg(F.count("*").alias("m"))
    both = size.join(count, "mesh_id", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    before = Window.orderBy("mesh_id").rowsBetween(Window.unboundedPreceding, -1)
    start = both.select("mesh_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_v"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("_f"))
    moved = meshes.join(start, "mesh_id").select((F.col("vid") + F.col("_v")).alias("vid"), "x", "y", "z")
    return moved, faces.join(start, "mesh_id").select((F.col("fid") + F.col("_f")).alias("fid"), *((F.col(c) + F.col("_v")).alias(c) for c in ("v0", "v1", "v2")))


def quads_to_triangles(quads: DataFrame) -> DataFrame:
    """Two triangles per quad: fid, part, v0, v1, v2."""
    halves = F.array(F.struct(F.lit(0).alias("part"), F.col("v0"), F.col("v1"), F.col("v2")), F.struct(F.lit(1).alias("part"), F.col("v0"), F.col("v2"), F.col("v3").alias("v2_")).cast("struct<part:int,v0:bigint,v1:bigint,v2:bigint>"))
    return quads.select("fid", F.inline(halves))


#: The corners of a prism's three tetrahedra: which corner of the triangle, in ascending order, and 0 below or 1 above.
PRISM = (((0, 0), (1, 0), (2, 0), (2, 1)), ((0, 0), (1, 0), (1, 1), (2, 1)), ((0, 0), (0, 1), (1, 1), (2, 1)))


def layers(faces: DataFrame, count: int, vertices_a_layer: int) -> DataFrame:
    """Prisms over every triangle in `count` layers, three tetrahedra each: cid, v0..v3. Vertex v of layer k is v + k * vertices_a_layer.

    Corners are taken in ascending order, so neighbouring prisms cut their shared side alike."""
    low = F.sort_array(F.array("v0", "v1", "v2"))
    held = faces.select("fid", low.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k"))
    at = lambda i, up: F.col("s")[i] + (F.col("k").cast("bigint") + up) * vertices_a_layer
    cells = F.array(*(F.struct(F.lit(j).alias("j"), *(at(*c).alias(f"v{i}") for i, c in enumerate(t))) for j, t in enumerate(PRISM)))
    return held.select("fid", "k", F.inline(cells)).select(prism_cell(count).alias("cid"), "v0", "v1", "v2", "v3")


def prism_cell(count: int) -> Column:
    """The number of tetrahedron j in layer k (of `count`) over triangle fid."""
    return (F.col("k") * F.lit(3) + F.col("j")) + F.col("fid") * (3 * count)


def prism_places(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """fid, j, x, y, z0, z1, z2: where the centre of every tetrahedron of `layers` lies in plan, alike in all layers, and the z of the triangle's corners in ascending order."""
    corner = lambda c: F.struct(F.col(c).alias("vid"), *(F.col(f"{c}_{k}").alias(k) for k in "xyz"))
    held = with_corners(faces, vertices).select("fid", F.sort_array(F.array(*(corner(c) for c in ("v0", "v1", "v2")))).alias("s"))
    mean = lambda t, k: _mean([F.col("s")[i][k] for i, _ in t])
    places = F.array(*(F.struct(F.lit(j).alias("j"), mean(t, "x").alias("x"), mean(t, "y").alias("y")) for j, t in enumerate(PRISM)))
    return held.select("fid", *(F.col("s")[i]["z"].alias(f"z{i}") for i in range(3)), F.inline(places))


def prism_height(lift: Callable[[Column, Column], Column]) -> Column:
    """The z of the centre of tetrahedron j in layer k of `prism_places`; `lift` gives the z of a corner in a layer."""
    first, second, third = (_mean([lift(F.col(f"z{i}"), F.col("k") + up) for i, up in t]) for t in PRISM)
    return F.when(F.col("j") == 0, first).when(F.col("j") == 1, second).otherwise(third)


def _mean(four: list[Column]) -> Column:
    return sum(four[1:], four[0]) / 4


def quantise(vertices: DataFrame, scale: float) -> DataFrame:
    """vid and the integer position (half to even) of every vertex, with `first`, the rank of the position by first occurrence."""
    at = vertices.select("vid", *(F.rint(F.col(k) / scale).cast("bigint").alias(k) for k in "xyz"))
    seen = at.groupBy("x", "y", "z").agg(F.min("vid").alias("first"))
    return at.join(seen, ["x", "y", "z"]).select("vid", "x", "y", "z", "first")


def solid(vertices: DataFrame, faces: DataFrame, base: float, vertices_above: int) -> tuple[DataFrame, DataFrame]:
    """A surface closed to a solid: a flat bottom at z = `base` and walls along its open edges.

    The bottom vertex of v is v + `vertices_above`. Walls keep the orientation of
    the faces above. The faces have no numbers of their own.
    """
    directed = F.array(*(F.struct(F.col(p).alias("a"), F.col(q).alias("b"), F.least(p, q).alias("l"), F.greatest(p, q).alias("h")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    sides = faces.select(F.inline(directed))
    rim = sides.groupBy("l", "h").agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")).where("n = 1")
    low = lambda c: F.col(c) + vertices_above
    three = lambda *t: F.struct(*(c.alias(f"v{k}") for k, c in enumerate(t)))
    walls = rim.select(F.inline(F.array(three(F.col("b"), F.col("a"), low("a")), three(F.col("b"), low("a"), low("b")))))
    bottom = faces.select(low("v0").alias("v0"), low("v2").alias("v1"), low("v1").alias("v2"))
    under = vertices.select((F.col("vid") + vertices_above).alias("vid"), "x", "y", F.lit(float(base)).alias("z"))
    return vertices.select("vid", "x", "y", "z").union(under), faces.select("v0", "v1", "v2").union(bottom).union(walls)


def open_boundary(faces: DataFrame, vertices: DataFrame, axis: str, at: float, tolerance: float = 1e-3) -> DataFrame:
    """The faces that don't lie whole on the plane `axis` = `at`."""
    on = vertices.where(F.abs(F.col(axis) - at) <= tolerance).select("vid")
    held = faces
    for c in ("v0", "v1", "v2"):
        held = held.join(on.select(F.col("vid").alias(c), F.lit(1).alias(f"_{c}")), c, "left")
    return held.where("_v0 IS NULL OR _v1 IS NULL OR _v2 IS NULL").select(*faces.columns)


def sides_of(faces: DataFrame) -> DataFrame:
    """fid, a, b: the edges of every face, the lesser vertex first."""
    return faces.select("fid", F.inline(F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))))


def edge_connections(faces: DataFrame) -> DataFrame:
    """Pairs fid, other (fid < other) of faces that share an edge, each once."""
    held = sides_of(faces)
    return held.join(held.withColumnRenamed("fid", "other"), ["a", "b"]).where("fid < other").select("fid", "other").distinct()


def neighbours_of(cells: DataFrame, corners: tuple[str, ...] = ("v0", "v1", "v2")) -> DataFrame:
    """Pairs vid, other of vertices that share a face (or a cell, with four corners), both ways, each once."""
    pairs = F.array(*(F.struct(F.col(p).alias("vid"), F.col(q).alias("other")) for p in corners for q in corners if p != q))
    return cells.select(F.inline(pairs)).where("vid != other").distinct()


def smooth_mesh(vertices: DataFrame, cells: DataFrame, sweeps: int = 1, z_only: bool = False, corners: tuple[str, ...] = ("v0", "v1", "v2")) -> DataFrame:
    """Every vertex moved to the mean of its neighbours (only z of it with `z_only`), all at once per sweep; a vertex of no face stays."""
    pairs = neighbours_of(cells, corners)
    moved = ("z",) if z_only else ("x", "y", "z")
    for _ in range(sweeps):
        means = pairs.join(vertices.select(F.col("vid").alias("other"), *moved), "other").groupBy("vid").agg(*(F.avg(c).alias(f"_{c}") for c in moved))
        vertices = vertices.join(means, "vid", "left").select("vid", *(F.coalesce(f"_{c}", c).alias(c) if c in moved else F.col(c) for c in "xyz"))
    return vertices


def boundary_vertices(vertices: DataFrame, within: float = 1e-3) -> DataFrame:
    """side (east, west, north, south), vid, place: the vertices within a distance of each side of the mesh's box, numbered along the side, then by z."""
    from urbanloom.plans.tables import numbered

    ends = vertices.agg(*(f(c).alias(f"{c}{n}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max")))).first()
    if ends.xmin is None:
        return vertices.select(F.lit("").alias("side"), "vid", F.lit(0).alias("place")).limit(0)
    near = {"east": F.col("x") >= ends.xmax - within, "west": F.col("x") <= ends.xmin + within, "north": F.col("y") >= ends.ymax - within, "south": F.col("y") <= ends.ymin + within}
    each = F.filter(F.array(*(F.struct(F.lit(s).alias("side"), F.col("y" if s in ("east", "west") else "x").alias("along"), on.alias("on")) for s, on in near.items())), lambda e: e.on)
    held = numbered(vertices.select("vid", "z", F.inline(each)).select("side", "along", "z", "vid"), ["side", "along", "z", "vid"], "_n")
    first = held.groupBy("side").agg(F.min("_n").alias("_first"))
    return held.join(first, "side").select("side", "vid", (F.col("_n") - F.col("_first")).cast("int").alias("place"))


def to_origin(vertices: DataFrame) -> DataFrame:
    """The mesh moved so that its least x, y and z are 0."""
    low = vertices.agg(*(F.min(c).alias(c) for c in "xyz")).first()
    return vertices.withColumns({c: F.col(c) - (low[c] or 0.0) for c in "xyz"})


def to_surfaces(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """fid and ring (three corners of x, y, z) of every face."""
    held = with_corners(faces, vertices)
    corner = lambda c: F.struct(*(F.col(f"{c}_{k}").alias(k) for k in "xyz"))
    return held.select("fid", F.array(corner("v0"), corner("v1"), corner("v2")).alias("ring"))


def domain_markers(faces: DataFrame, inside: DataFrame) -> DataFrame:
    """fid, marker: the building (`inside`: fid, building) of a face, else -1 beside one that has a building, else -2."""
    corners = faces.select("fid", F.explode(F.array("v0", "v1", "v2")).alias("v"))
    halo = corners.join(inside, "fid").select("v").distinct()
    beside = corners.join(halo, "v", "left_semi").select("fid").distinct().withColumn("_beside", F.lit(-1))
    return faces.join(inside, "fid", "left").join(beside, "fid", "left").select("fid", F.coalesce("building", "_beside", F.lit(-2)).alias("marker"))


def facet_markers(facets: DataFrame, markers: DataFrame, buildings: int) -> DataFrame:
    """`facets` (v0, v1, v2) with the marker that their vertices' markers (vid, marker) make.

    Ground markers are negative, building b has b at its foot and b + `buildings` at its roof. All negative: -2 if one
    is, else the greatest. One building only and nothing above ground level: that building; foot and roof of one
    building: the foot; anything else is -1."""
    held = facets
    for c in ("v0", "v1", "v2"):
        held = held.join(markers.select(F.col("vid").alias(c), F.col("marker").alias(f"_{c}")), c)
    three = F.array_sort(F.array("_v0", "_v1", "_v2"))
    low, middle, high = (three[k] for k in range(3))
    pair = F.when((low == middle) & (middle == high), low).when((low >= 0) & ((low == middle) | (middle == high)) & (high == low + buildings), low).otherwise(-1)
    return held.select(*facets.columns, F.when(high < 0, F.when((low == -2) | (high == -2), -2).otherwise(high)).when(low < 0, -1).otherwise(pair).alias("marker"))


def trimmed(cells: DataFrame, vertices: DataFrame, inside: DataFrame) -> DataFrame:
    """The tetrahedra (cid, v0..v3) that are not inside: `inside` has the cid of those to drop."""
    return cells.join(inside.select("cid"), "cid", "left_anti")


def cell_centres(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """cid, x, y, z: the mean of every tetrahedron's corners."""
    held = with_corners(cells, vertices, ("v0", "v1", "v2", "v3"))
    return held.select("cid", *((sum((F.col(f"v{k}_{c}") for k in range(1, 4)), F.col(f"v0_{c}")) / 4).alias(c) for c in "xyz"))
