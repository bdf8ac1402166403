"""Further queries over regions, meshes, rays, names, objects and datasets, with their SQL."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanloom.functions import geometry as geo
from urbanloom.functions import names, planar, solids
from urbanloom.operators import cells as cl
from urbanloom.operators import boxes, meshes, nearby, points, polygons, roofs, sensors, trees
from urbanloom.operators import rasters as rs
from urbanloom.operators.graphs import connected_components
from urbanloom.plans import registry
from urbanloom.plans.tables import table, written
from urbanloom.queries.city import _B, _F, _INSIDE, _PD, _V, _boxes, _components, _footprints, _mesh
from urbanloom.queries.clouds import _GRID, _OK, BOX, CELL, _dem, _points


def _cells(spark: SparkSession, sf: str) -> tuple[DataFrame, rs.Grid]:
    """The elevation raster with its holes."""
    grid = rs.Grid.around(table(spark, sf, "points"), CELL)
    return written(rs.rasterize(_points(spark, sf), grid, per_unit=1000).select("row", "col", "value"), "cells"), grid


def remove_small_masks(spark: SparkSession, sf: str) -> DataFrame:
    cells, grid = _cells(spark, sf)
    return cl.remove_small_regions(cells, grid.cols, 3)


def small_holes(spark: SparkSession, sf: str) -> DataFrame:
    cells, grid = _cells(spark, sf)
    return cl.small_holes(cells, grid.cols, 4)


def smooth_raster(spark: SparkSession, sf: str) -> DataFrame:
    return cl.smooth(_dem(spark, sf)[0]).select("row", "col", F.round("value", 6).alias("value"))


def blur_raster(spark: SparkSession, sf: str) -> DataFrame:
    return cl.binomial(_dem(spark, sf)[0]).select("row", "col", F.round("value", 8).alias("value"))


def terrain_mesh(spark: SparkSession, sf: str) -> DataFrame:
    cells, grid = _dem(spark, sf)
    return cl.grid_triangles(grid.rows, grid.cols, cells)


def flat_terrain(spark: SparkSession, sf: str) -> DataFrame:
    """One cell at the lowest point, over the extent of all points."""
    return table(spark, sf, "points").where("z IS NOT NULL AND NOT isnan(z)").agg(F.min("z").alias("value"), F.min("x").alias("west"), F.max(F.nanvl("y", F.lit(None).cast("double"))).alias("north"))


def mosaic_max(spark: SparkSession, sf: str) -> DataFrame:
    """The rasters of all clouds on one grid, highest value first."""
    grid = rs.Grid.around(table(spark, sf, "points"), CELL)
    held = _points(spark, sf).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)")
    tiles = held.groupBy("cloud_id", grid.row(F.col("y")).alias("row"), grid.col(F.col("x")).alias("col")).agg(F.max("z").alias("value"))
    from urbanloom.sources.grids import mosaic

    return mosaic(tiles.withColumnRenamed("cloud_id", "tile"), "max")


def snap_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Trees chained by gaps of at most a metre, as one: the least id stands for all."""
    held = table(spark, sf, "trees").where(_OK)
    pairs = nearby.neighbours(held, "tree_id", ["x", "y"], 1.0)
    alone = held.select(F.col("tree_id").alias("src"), F.col("tree_id").alias("dst"))
    return connected_components(pairs.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst")).union(alone))


def tree_nms(spark: SparkSession, sf: str) -> DataFrame:
    """Tree tops that greedy suppression within their crowns keeps, the highest survey of a position counting.

    A crown's radius is the surveyed one (the largest of equal heights), else the usual one at the height; crowns under 0.6 m are dropped.
    """
    held = table(spark, sf, "trees").where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND height > 0 AND height < 100")
    crown = F.when((F.col("crown_radius") > 0) & ~F.isnan("crown_radius"), F.col("crown_radius"))
    tops = held.groupBy("x", "y").agg(F.max(F.struct("height", crown.alias("r"))).alias("top")).select("x", "y", "top.*")
    return trees.suppress_peaks(tops, F.coalesce("r", trees.crown_radius(F.col("height"))), least_radius=0.6)


def ray_roofs(spark: SparkSession, sf: str) -> DataFrame:
    """Rays straight down from 1,000 m at a place of every box: the nearest of the box tops (two triangles each) they meet."""
    tops = _boxes(spark, sf).where("zmax IS NOT NULL AND NOT isnan(zmax)")
    rays = tops.select(F.col("bounds_id").alias("ray_id"), (F.col("xmin") + 0.3 * (F.col("xmax") - F.col("xmin"))).alias("x"), (F.col("ymin") + 0.4 * (F.col("ymax") - F.col("ymin"))).alias("y"))
    tiled = tops.select("bounds_id", *("xmin ymin xmax ymax zmax".split()), F.inline(geo.tiles_of(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), 64.0)))
    near = rays.withColumns({"tx": F.floor(F.col("x") / 64.0).cast("bigint"), "ty": F.floor(F.col("y") / 64.0).cast("bigint")}).join(tiled, ["tx", "ty"])
    corner = lambda a, b: (F.col(a), F.col(b), F.col("zmax"))
    ll, lr, ur, ul = corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax")
    origin, down = (F.col("x"), F.col("y"), F.lit(1000.0)), (F.lit(0.0), F.lit(0.0), F.lit(-1.0))
    hit = F.least(*(solids.ray_triangle(origin, down, *t) for t in ((ll, lr, ur), (ll, ur, ul))))
    met = near.withColumn("t", hit).where("t IS NOT NULL")
    return met.groupBy("ray_id").agg(F.round(1000.0 - F.min("t"), 3).alias("z"))


def edge_connections(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of faces that share an edge."""
    faces = _mesh(spark, sf)[1]
    sides = F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    held = faces.select("fid", F.inline(sides))
    other = held.select(F.col("fid").alias("other"), "a", "b")
    return held.join(other, ["a", "b"]).where("fid < other").select("fid", "other").distinct()


def boundary_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """The vertices within 40 of the greatest x, in the order of y, then z."""
    vertices = _mesh(spark, sf)[0]
    most = vertices.agg(F.max("x")).first()[0]
    return vertices.where(F.col("x") >= most - 40.0).withColumn("place", F.row_number().over(Window.orderBy("y", "z", "vid"))).select("vid", "place")  # an edge of the domain is small


def mesh_to_origin(spark: SparkSession, sf: str) -> DataFrame:
    vertices = _mesh(spark, sf)[0]
    low = vertices.agg(*(F.min(c).alias(c) for c in "xyz")).first()
    return vertices.select("vid", *(F.round(F.col(c) - low[c], 3).alias(c) for c in "xyz"))


def transform_points(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter turn, doubled, and moved."""
    x, y, z = geo.affine(F.col("x"), F.col("y"), F.col("z"), [[0, -2, 0, 5], [2, 0, 0, -7], [0, 0, 1, 1], [0, 0, 0, 1]])
    whole = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz")
    return table(spark, sf, "points").where(whole).select("point_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


def sphere_mesh(spark: SparkSession, sf: str) -> DataFrame:
    return solids.sphere(spark, 2.0, 8)[0].select("vid", *((F.round(c, 6) + 0.0).alias(c) for c in "xyz"))


def cylinder_mesh(spark: SparkSession, sf: str) -> DataFrame:
    return solids.cylinder(spark, 2.0, 5.0, 12)[1]


def cone_mesh(spark: SparkSession, sf: str) -> DataFrame:
    return solids.cylinder(spark, 2.0, 5.0, 12, top=0.0)[0].select("vid", *((F.round(c, 6) + 0.0).alias(c) for c in "xyz"))


def resolve_parameters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "observations").select("field").distinct().select("field", names.parameter_column("weather", F.col("field")).alias("weather"), names.parameter_column("ocean", F.col("field")).alias("ocean"))


def geometry_types(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([("VolumeMesh",), ("PointCloud",), ("Mesh",), ("MultiLineString",)], "name string").select("name", names.geometry_type(F.col("name")).alias("geometry_type"))


def air_quality_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The last value of every air-quality station by arrival, from the JSON of its snapshots."""
    return sensors.latest_value(table(spark, sf, "sensor_snapshots").where("feed = 'air_quality'"))


def last_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Per station and field the last quality flag that isn't missing."""
    held = table(spark, sf, "observations").where("quality IS NOT NULL AND quality != '' AND ts IS NOT NULL")
    return held.groupBy("station_id", "field").agg(F.max_by("quality", F.struct("ts", "obs_id")).alias("quality"))


def daily_means(spark: SparkSession, sf: str) -> DataFrame:
    from urbanloom.streaming.latest import windowed_means

    held = windowed_means(table(spark, sf, "observations").distinct(), "1 day")
    return held.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "field", F.round("mean", 8).alias("mean"), "n")


def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The boxes that hold a 5 m request box around the middle of another box whole: a cached download could serve it."""
    held = _boxes(spark, sf)
    middle = boxes.measures(held).select(F.col("bounds_id").alias("request"), *((F.col(m)).alias(c) for m, c in (("cx", "xmin"), ("cy", "ymin"), ("cx", "xmax"), ("cy", "ymax"))))
    return boxes.supersets(boxes.buffered(middle, 2.5), held, "request", "bounds_id")


def roof_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of building-class points inside a footprint that lie far from their five neighbours there."""
    inside = polygons.points_in_polygons(_points(spark, sf).where("classification = 6 AND z IS NOT NULL AND NOT isnan(z)"), _footprints(spark, sf), "building_id")
    return roofs.neighbour_outliers(inside, "building_id").select("building_id", "x", "y", "z")


def vegetation_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """The share of the 5 m tiles that a box meets which hold a vegetation point inside the box."""
    boxes = _boxes(spark, sf)
    tiles = boxes.select("bounds_id", F.inline(geo.tiles_of(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), 5.0)))
    ring = geo.ring_of((F.col("xmax"), F.col("ymax")), (F.col("xmin"), F.col("ymax")), (F.col("xmin"), F.col("ymin")), (F.col("xmax"), F.col("ymin")))
    green = _points(spark, sf).where("classification IN (3, 4, 5)")
    held = polygons.points_in_polygons(green, boxes.select("bounds_id", geo.translate(ring, 0.00037, 0.00037).alias("ring")), "bounds_id")
    return roofs.coverage(held, "bounds_id", tiles, 5.0).select("bounds_id", F.round("coverage", 8).alias("coverage"))


def clip_to_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The area of every box in each 50 m tile, by clipping its ring."""
    boxes = _boxes(spark, sf).select("bounds_id", "xmin", "ymin", "xmax", "ymax", F.inline(geo.tiles_of(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), 50.0)))
    moved = lambda c, t: F.col(c) - F.col(t) * 50.0
    x0, y0, x1, y1 = moved("xmin", "tx"), moved("ymin", "ty"), moved("xmax", "tx"), moved("ymax", "ty")
    part = planar.clipped(geo.ring_of((x1, y1), (x0, y1), (x0, y0), (x1, y0)), 0.0, 0.0, 50.0, 50.0)
    return boxes.withColumn("part", part).select("bounds_id", "tx", "ty", F.round(geo.area(F.col("part")), 3).alias("area"))


def mesh_markers(spark: SparkSession, sf: str) -> DataFrame:
    """The footprint (last by name) that holds the centre of every terrain triangle, else -1 beside one that does, else -2."""
    cells, grid = _dem(spark, sf)
    faces = written(cl.grid_triangles(grid.rows, grid.cols, cells), "faces")
    x, y = (lambda v: grid.x(F.col(v) % grid.cols)), (lambda v: grid.y(F.floor(F.col(v) / grid.cols)))
    centres = faces.select("fid", ((x("v0") + x("v1") + x("v2")) / 3).alias("x"), ((y("v0") + y("v1") + y("v2")) / 3).alias("y"))
    inside = polygons.points_in_polygons(centres, _footprints(spark, sf), "building_id").groupBy("fid").agg(F.max(F.substring("building_id", 2, 10).cast("int")).alias("building"))
    corners = faces.select("fid", F.explode(F.array("v0", "v1", "v2")).alias("v"))
    halo = corners.join(inside, "fid").select("v").distinct()
    beside = corners.join(halo, "v", "left_semi").select("fid").distinct().withColumn("_beside", F.lit(-1))
    return faces.join(inside, "fid", "left").join(beside, "fid", "left").select("fid", F.coalesce("building", "_beside", F.lit(-2)).alias("marker"))


def printable_mesh(spark: SparkSession, sf: str) -> DataFrame:
    """The terrain mesh closed to a solid."""
    cells, grid = _dem(spark, sf)
    faces = cl.grid_triangles(grid.rows, grid.cols, cells)
    vertices = cells.select((F.col("row").cast("bigint") * grid.cols + F.col("col")).alias("vid"), grid.x(F.col("col")).alias("x"), grid.y(F.col("row")).alias("y"), F.col("value").alias("z"))
    return meshes.solid(vertices, faces, -10.0, grid.rows * grid.cols)[1]


@dataclass(frozen=True)
class CloudArguments:
    """Arguments of the point-cloud dataset."""

    folder: str
    bounds: tuple
    classifications: str | None = None
    outliers: float = 3.0


def _cloud(spark: SparkSession, a: CloudArguments) -> DataFrame:
    held = points.crop(table(spark, a.folder, "points"), points.Box(*a.bounds[:2], *a.bounds[len(a.bounds) // 2 :][:2]))
    held = held if a.classifications is None else points.by_class(held, list(names.classes_of(a.classifications)))
    return points.global_outliers(held, a.outliers)


@dataclass(frozen=True)
class WeatherArguments:
    """Arguments of the weather dataset; bounds are degrees."""

    folder: str
    bounds: tuple
    parameters: tuple = ("air_temperature", "wind_speed")
    max_stations: int = 20


def _weather(spark: SparkSession, a: WeatherArguments) -> DataFrame:
    held = sensors.stations_within(table(spark, a.folder, "observations").distinct(), (a.bounds[0], a.bounds[2]), (a.bounds[1], a.bounds[3])).where(F.col("field").isin(*a.parameters))
    return sensors.first_stations(sensors.drop_all_missing(sensors.latest(held)), a.max_stations)


registry.register(registry.Dataset("point_cloud", CloudArguments, _cloud, "points in bounds, of named classes, without outliers"))
registry.register(registry.Dataset("weather", WeatherArguments, _weather, "latest readings of the first stations in bounds"))


def dataset_point_cloud(spark: SparkSession, sf: str) -> DataFrame:
    return registry.get("point_cloud")(spark, folder=sf, bounds=(BOX.xmin, BOX.ymin, BOX.xmax, BOX.ymax), classifications="vegetation").select("cloud_id", "point_id")


def dataset_weather(spark: SparkSession, sf: str) -> DataFrame:
    return registry.get("weather")(spark, folder=sf, bounds=(12.0, 56.0, 22.0, 64.0)).select("station_id", "field", "value")


_ALL = (remove_small_masks, small_holes, smooth_raster, blur_raster, terrain_mesh, flat_terrain, mosaic_max, snap_trees, tree_nms, ray_roofs, edge_connections, boundary_vertices, mesh_to_origin, transform_points, sphere_mesh, cylinder_mesh, cone_mesh, resolve_parameters, geometry_types, air_quality_latest, last_quality, daily_means, cache_hits, dataset_point_cloud, dataset_weather, roof_outliers, vegetation_coverage, clip_to_tiles, mesh_markers, printable_mesh)
QUERIES = {f.__name__: f for f in _ALL}

_CASE = lambda kind: "CASE field " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in names.PARAMETERS[kind].items()) + " END"


def _stencil(parts: list[tuple[int, int, int]], by: int, digits: int) -> str:
    """Weighted sums of neighbours, edges clamped."""
    values = ", ".join(map(str, parts))
    return f"""WITH {_GRID}, mx AS (SELECT max("row") AS mr, max(col) AS mc FROM d) SELECT a."row", a.col, round(sum(b.v * w) / {by}, {digits}) AS value FROM d a CROSS JOIN (VALUES {values}) s(i, j, w) CROSS JOIN mx JOIN d b ON b."row" = least(greatest(a."row" + i, 0), mr) AND b.col = least(greatest(a.col + j, 0), mc) GROUP BY 1, 2"""


_REGION = lambda which, corners: f"""h AS (SELECT "row" * 1000000 + col AS k, "row", col FROM cells WHERE value IS {which}), e AS (SELECT a.k AS src, b.k AS dst FROM h a JOIN h b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 {"" if corners else 'AND abs(a."row" - b."row") + abs(a.col - b.col) <= 1'}), {_components("e")}, n AS (SELECT component, count(*) AS n FROM cc GROUP BY 1)"""
SQL = {
    "remove_small_masks": f"""WITH RECURSIVE {_GRID}, {_REGION("NOT NULL", True)} SELECT c."row", c.col, CASE WHEN n.n > 3 THEN value END AS value FROM cells c LEFT JOIN cc ON cc.node = c."row" * 1000000 + c.col LEFT JOIN n ON n.component = cc.component""",
    "small_holes": f"""WITH RECURSIVE {_GRID}, {_REGION("NULL", False)} SELECT (node // 1000000)::INT AS "row", (node % 1000000)::INT AS col FROM cc JOIN n USING (component) WHERE n <= 4""",
    "smooth_raster": _stencil([(-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1)], 4, 6),
    "blur_raster": _stencil([(i, j, (2 - abs(i)) * (2 - abs(j))) for i in (-1, 0, 1) for j in (-1, 0, 1)], 16, 8),
    "terrain_mesh": f"""WITH {_GRID}, mx AS (SELECT max("row") AS mr, max(col) AS mc FROM d), q AS (SELECT "row"::BIGINT * (mc + 1) + col AS q, mc + 1 AS w FROM d, mx WHERE "row" < mr AND col < mc) SELECT q * 2 AS fid, q AS v0, q + w AS v1, q + 1 AS v2 FROM q UNION ALL SELECT q * 2 + 1, q + 1, q + w, q + w + 1 FROM q""",
    "flat_terrain": "SELECT min(z) AS value, min(x) AS west, max(y) FILTER (NOT isnan(y)) AS north FROM points WHERE z IS NOT NULL AND NOT isnan(z)",
    "mosaic_max": f"""WITH {_GRID}, t AS (SELECT cloud_id, floor((n * {CELL} - y) / {CELL})::INT AS "row", floor((x - w * {CELL}) / {CELL})::INT AS col, max(z) AS z FROM p, g WHERE {_OK} AND z IS NOT NULL AND NOT isnan(z) GROUP BY 1, 2, 3) SELECT "row", col, max(z) AS value FROM t GROUP BY 1, 2""",
    "snap_trees": f"WITH RECURSIVE t AS (SELECT DISTINCT tree_id, x, y FROM trees WHERE {_OK}), e AS (SELECT DISTINCT a.tree_id AS src, b.tree_id AS dst FROM t a JOIN t b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1), {_components('e')} SELECT node, component FROM cc",
    "tree_nms": f"""WITH RECURSIVE t AS (SELECT x, y, height, CASE WHEN crown_radius > 0 AND NOT isnan(crown_radius) THEN crown_radius END AS c FROM trees WHERE {_OK} AND height > 0 AND height < 100), m AS (SELECT x, y, max(height) AS height FROM t GROUP BY 1, 2),
      p AS (SELECT x, y, height, coalesce(max(c), least(greatest(0.22 * pow(height, 0.87), 0.8), 6.0)) AS r FROM m JOIN t USING (x, y, height) GROUP BY x, y, height), q AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY height DESC, x DESC, y DESC) - 1 AS i FROM p WHERE r >= 0.6), k AS MATERIALIZED (SELECT count(*) AS k FROM q),
      u AS MATERIALIZED (SELECT a.i, list(b.i) AS w FROM q a JOIN q b ON b.i > a.i AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= a.r AND a.height - b.height < 8 AND a.height - b.height < 0.3 * a.height GROUP BY 1),
      s(i, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT s.i + 1, CASE WHEN list_contains(gone, s.i) THEN gone ELSE list_concat(gone, coalesce(w, []::BIGINT[])) END FROM s LEFT JOIN u ON u.i = s.i CROSS JOIN k WHERE s.i < k)
      SELECT x, y, height FROM q WHERE i NOT IN (SELECT unnest(gone) FROM s, k WHERE s.i = k)""",
    "ray_roofs": f"WITH {_B}, z AS (SELECT * FROM b WHERE zmax IS NOT NULL AND NOT isnan(zmax)), r AS (SELECT bounds_id AS ray_id, xmin + 0.3 * (xmax - xmin) AS x, ymin + 0.4 * (ymax - ymin) AS y FROM z) SELECT ray_id, round(max(zmax), 3) AS z FROM r JOIN z ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax WHERE xmax > xmin AND ymax > ymin GROUP BY 1",
    "edge_connections": f"WITH {_V}, s AS (SELECT fid, unnest([struct_pack(a := least(v0, v1), b := greatest(v0, v1)), struct_pack(a := least(v1, v2), b := greatest(v1, v2)), struct_pack(a := least(v2, v0), b := greatest(v2, v0))]) AS e FROM f) SELECT DISTINCT s.fid, o.fid AS other FROM s JOIN s o ON s.e = o.e WHERE s.fid < o.fid",
    "boundary_vertices": f"WITH {_V} SELECT vid, row_number() OVER (ORDER BY y, z, vid)::INT AS place FROM v WHERE x >= (SELECT max(x) FROM v) - 40",
    "mesh_to_origin": f"WITH {_V}, l AS (SELECT min(x) AS a, min(y) AS b, min(z) AS c FROM v) SELECT vid, round(x - a, 3) AS x, round(y - b, 3) AS y, round(z - c, 3) AS z FROM v, l",
    "transform_points": "SELECT point_id, round(-2 * y + 5, 3) AS x, round(2 * x - 7, 3) AS y, round(z + 1, 3) AS z FROM points WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)",
    "sphere_mesh": "SELECT vid, round(2 * sin((vid // 16) * pi() / 8) * cos((vid % 16) * pi() / 8), 6) + 0.0 AS x, round(2 * sin((vid // 16) * pi() / 8) * sin((vid % 16) * pi() / 8), 6) + 0.0 AS y, round(2 * cos((vid // 16) * pi() / 8), 6) + 0.0 AS z FROM (SELECT unnest(range(144)) AS vid)",
    "cylinder_mesh": "WITH b AS (SELECT unnest(range(12)) AS j) SELECT j * 2 AS fid, j AS v0, j + 12 AS v1, (j + 1) % 12 AS v2 FROM b UNION ALL SELECT j * 2 + 1, (j + 1) % 12, j + 12, (j + 1) % 12 + 12 FROM b",
    "cone_mesh": "SELECT vid, round(CASE WHEN vid < 12 THEN 2.0 ELSE 0.0 END * cos((vid % 12) * pi() / 6), 6) + 0.0 AS x, round(CASE WHEN vid < 12 THEN 2.0 ELSE 0.0 END * sin((vid % 12) * pi() / 6), 6) + 0.0 AS y, (CASE WHEN vid < 12 THEN 0 ELSE 5 END)::DOUBLE AS z FROM (SELECT unnest(range(24)) AS vid)",
    "resolve_parameters": f"SELECT field, {_CASE('weather')} AS weather, {_CASE('ocean')} AS ocean FROM (SELECT DISTINCT field FROM observations)",
    "geometry_types": "SELECT * FROM (VALUES ('VolumeMesh', 'VOLUME_MESH'), ('PointCloud', 'POINT_CLOUD'), ('Mesh', 'MESH'), ('MultiLineString', 'MULTI_LINE_STRING')) t(name, geometry_type)",
    "air_quality_latest": "SELECT station_id, arg_max(struct_pack(v := value), struct_pack(a := received_at, b := snapshot_id)).v AS value, count(*) AS n FROM (SELECT DISTINCT station_id, snapshot_id, received_at, TRY_CAST(json_extract_string(attributes, '$.lastValue.value') AS DOUBLE) AS value FROM sensor_snapshots WHERE feed = 'air_quality' AND received_at IS NOT NULL) GROUP BY 1",
    "last_quality": "SELECT station_id, field, arg_max(quality, struct_pack(a := ts, b := obs_id)) AS quality FROM observations WHERE quality IS NOT NULL AND quality != '' AND ts IS NOT NULL GROUP BY 1, 2",
    "daily_means": "SELECT strftime(ts, '%Y-%m-%d') AS day, field, round(avg(value), 8) AS mean, count(*) AS n FROM (SELECT DISTINCT * FROM observations) WHERE ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2",
    "cache_hits": f"WITH {_B} SELECT l.bounds_id AS request, r.bounds_id FROM b l JOIN b r ON r.xmin <= (l.xmin + l.xmax) / 2 - 2.5 AND r.ymin <= (l.ymin + l.ymax) / 2 - 2.5 AND r.xmax >= (l.xmin + l.xmax) / 2 + 2.5 AND r.ymax >= (l.ymin + l.ymax) / 2 + 2.5",
    "dataset_point_cloud": f"WITH p AS (SELECT * FROM points WHERE x BETWEEN {BOX.xmin} AND {BOX.xmax} AND y BETWEEN {BOX.ymin} AND {BOX.ymax} AND classification IN (3, 4, 5, 7) AND z IS NOT NULL AND NOT isnan(z)) SELECT cloud_id, point_id FROM p JOIN (SELECT cloud_id, avg(z) AS m, stddev_pop(z) AS s FROM p GROUP BY 1) USING (cloud_id) WHERE NOT abs(z - m) > 3 * s",
    "dataset_weather": "WITH l AS (SELECT station_id, field, arg_max(struct_pack(value := CASE WHEN isnan(value) THEN NULL ELSE value END), struct_pack(a := ts, b := obs_id)) AS l FROM observations WHERE ts IS NOT NULL AND lon BETWEEN 12 AND 22 AND lat BETWEEN 56 AND 64 AND field IN ('air_temperature', 'wind_speed') GROUP BY 1, 2), k AS (SELECT station_id FROM l WHERE l.value IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 20) SELECT station_id, field, l.value AS value FROM l WHERE station_id IN (SELECT station_id FROM k)",
    "roof_outliers": f"""WITH {_F}, {_PD}, h AS (SELECT DISTINCT building_id, x, y, z FROM pd JOIN f ON {_INSIDE} WHERE classification = 6 AND z IS NOT NULL AND NOT isnan(z)),
      k AS (SELECT a.building_id, a.x, a.y, a.z, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dd, row_number() OVER (PARTITION BY a.building_id, a.x, a.y, a.z ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS rk FROM h a JOIN h b ON a.building_id = b.building_id AND (a.x != b.x OR a.y != b.y OR a.z != b.z)),
      m AS (SELECT building_id, x, y, z, avg(dd) AS m FROM k WHERE rk <= 5 GROUP BY 1, 2, 3, 4 HAVING count(*) = 5), l AS (SELECT building_id, avg(m) + 1.5 * stddev_samp(m) AS l FROM m GROUP BY 1)
      SELECT building_id, x, y, z FROM m JOIN l USING (building_id) WHERE m > l""",
    "vegetation_coverage": f"""WITH {_B}, {_PD}, t AS (SELECT bounds_id, tx, unnest(range(floor(ymin / 5)::BIGINT, floor(ymax / 5)::BIGINT + 1)) AS ty FROM (SELECT *, unnest(range(floor(xmin / 5)::BIGINT, floor(xmax / 5)::BIGINT + 1)) AS tx FROM b)),
      h AS (SELECT DISTINCT bounds_id, floor(x / 5)::BIGINT AS tx, floor(y / 5)::BIGINT AS ty FROM pd JOIN b ON x > xmin + 0.00037 AND x < xmax + 0.00037 AND y > ymin + 0.00037 AND y < ymax + 0.00037 WHERE classification IN (3, 4, 5))
      SELECT t.bounds_id, round(count(h.tx) / count(*), 8) AS coverage FROM t LEFT JOIN h ON h.bounds_id = t.bounds_id AND h.tx = t.tx AND h.ty = t.ty GROUP BY 1""",
    "clip_to_tiles": f"""WITH {_B}, t AS (SELECT *, unnest(range(floor(ymin / 50)::BIGINT, floor(ymax / 50)::BIGINT + 1)) AS ty FROM (SELECT *, unnest(range(floor(xmin / 50)::BIGINT, floor(xmax / 50)::BIGINT + 1)) AS tx FROM b))
      SELECT bounds_id, tx, ty, round((least(xmax - tx * 50, 50) - greatest(xmin - tx * 50, 0)) * (least(ymax - ty * 50, 50) - greatest(ymin - ty * 50, 0)), 3) AS area FROM t""",
    "mesh_markers": f"""WITH {_GRID}, {_F.replace(", f AS", ", fp AS")}, mx AS (SELECT max("row") AS mr, max(col) AS mc FROM d), q AS (SELECT "row"::BIGINT * (mc + 1) + col AS q, mc + 1 AS w FROM d, mx WHERE "row" < mr AND col < mc),
      fc AS (SELECT q * 2 AS fid, q AS v0, q + w AS v1, q + 1 AS v2, w FROM q UNION ALL SELECT q * 2 + 1, q + 1, q + w, q + w + 1, w FROM q),
      ct AS (SELECT fid, g.w * {CELL} + {CELL} * ((v0 % fc.w + v1 % fc.w + v2 % fc.w) / 3.0 + 0.5) AS x, g.n * {CELL} - {CELL} * ((v0 // fc.w + v1 // fc.w + v2 // fc.w) / 3.0 + 0.5) AS y FROM fc, g),
      i AS (SELECT fid, max(substring(building_id, 2, 10)::INT) AS building FROM ct JOIN fp ON {_INSIDE} GROUP BY 1), co AS (SELECT fid, unnest([v0, v1, v2]) AS v FROM fc), ha AS (SELECT DISTINCT v FROM co JOIN i USING (fid)), be AS (SELECT DISTINCT fid FROM co JOIN ha USING (v))
      SELECT fc.fid, coalesce(building, CASE WHEN be.fid IS NOT NULL THEN -1 ELSE -2 END) AS marker FROM fc LEFT JOIN i USING (fid) LEFT JOIN be USING (fid)""",
    "printable_mesh": f"""WITH {_GRID}, mx AS (SELECT max("row") AS mr, max(col) AS mc FROM d), q AS (SELECT "row"::BIGINT * (mc + 1) + col AS q, mc + 1 AS w, (mr + 1) * (mc + 1) AS n FROM d, mx WHERE "row" < mr AND col < mc),
      fc AS (SELECT q AS v0, q + w AS v1, q + 1 AS v2, n FROM q UNION ALL SELECT q + 1, q + w, q + w + 1, n FROM q), s AS (SELECT v0 AS a, v1 AS b, n FROM fc UNION ALL SELECT v1, v2, n FROM fc UNION ALL SELECT v2, v0, n FROM fc),
      r AS (SELECT any_value(a) AS a, any_value(b) AS b, any_value(n) AS n FROM s GROUP BY least(a, b), greatest(a, b) HAVING count(*) = 1)
      SELECT v0, v1, v2 FROM fc UNION ALL SELECT v0 + n, v2 + n, v1 + n FROM fc UNION ALL SELECT b, a, a + n FROM r UNION ALL SELECT b, a + n, b + n FROM r""",
}
