"""Queries over boxes, footprints, roads, meshes, land use, sensors and trees, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.functions import crs, names, surfaces
from urbanloom.functions import geometry as geo
from urbanloom.operators import boxes, graphs, meshes, points, polygons, rasters, sensors, trees
from urbanloom.plans.city import City
from urbanloom.plans.tables import numbered, table, written
from urbanloom.queries.clouds import _GRID, _OK, _dem, _points

SIDES = ["xmin", "ymin", "xmax", "ymax"]
#: The test table has no land-use codes; its part types stand for five of them, the sixth is unlisted.
CODES = {"STANDARD": "BEBSLUT", "SMALL": "ÖPMARK", "MEDIUM": "SKOGSMARK", "LARGE": "ÅKERMARK", "ECONOMY": "VATTEN"}


# boxes


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Every usable survey box once."""
    return table(spark, sf, "survey_bounds").distinct().where("xmin <= xmax AND ymin <= ymax AND NOT isnan(xmin) AND NOT isnan(ymin) AND NOT isnan(xmax) AND NOT isnan(ymax)")


def bounds_measures(spark: SparkSession, sf: str) -> DataFrame:
    held = boxes.measures(_boxes(spark, sf))
    return held.select("bounds_id", *(F.round(c, 3).alias(c) for c in ("width", "height", "depth", "area", "volume")), *(F.round(c, 4).alias(c) for c in ("cx", "cy")), "is_point")


def bounds_buffer(spark: SparkSession, sf: str) -> DataFrame:
    return boxes.buffered(_boxes(spark, sf), 5.0).select("bounds_id", *(F.round(c, 3).alias(c) for c in SIDES))


def bounds_union(spark: SparkSession, sf: str) -> DataFrame:
    return boxes.union(_boxes(spark, sf))


def bounds_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of boxes that meet, with their intersection."""
    return boxes.overlaps(_boxes(spark, sf), "bounds_id")


def bounds_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of an outer and an inner box, edges included."""
    return boxes.nested(_boxes(spark, sf), "bounds_id")


def bounds_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 m tiles of every box, columns first, cut at its far edges."""
    return boxes.tiles(_boxes(spark, sf), 20.0).select("bounds_id", "i", "j", *(F.round(c, 3).alias(c) for c in SIDES))


# footprints: a diamond in every box


def _footprints(spark: SparkSession, sf: str) -> DataFrame:
    cx, cy = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    return _boxes(spark, sf).select(F.col("bounds_id").alias("building_id"), geo.ring_of((F.col("xmax"), cy), (cx, F.col("ymax")), (F.col("xmin"), cy), (cx, F.col("ymin"))).alias("ring"))


def _seen(spark: SparkSession, sf: str) -> DataFrame:
    """Every point as it stands; repeats are dropped after the spatial test, where few are left."""
    return table(spark, sf, "points").select("cloud_id", "strip_id", "point_id", "x", "y", "z", "classification")


def _solid_points(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).where("z IS NOT NULL AND NOT isnan(z)")


def points_in_polygons(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.points_in_polygons(_seen(spark, sf), _footprints(spark, sf), "building_id").distinct().select("building_id", "point_id")


def points_semi(spark: SparkSession, sf: str) -> DataFrame:
    inside = polygons.points_in_polygons(_seen(spark, sf), _footprints(spark, sf), "building_id")
    return points.keep_points(_points(spark, sf), inside).select("point_id")


def points_anti(spark: SparkSession, sf: str) -> DataFrame:
    inside = polygons.points_in_polygons(_seen(spark, sf), _footprints(spark, sf), "building_id")
    return points.remove_points(_points(spark, sf), inside).select("point_id")


def footprint_measures(spark: SparkSession, sf: str) -> DataFrame:
    c = geo.vertex_mean(F.col("ring"))
    return _footprints(spark, sf).select("building_id", F.round(geo.area(F.col("ring")), 2).alias("area"), F.round(geo.perimeter(F.col("ring")), 4).alias("perimeter"), (geo.signed_area(F.col("ring")) > 0).alias("counter_clockwise"), geo.is_convex(F.col("ring")).alias("convex"), F.round(c.x, 3).alias("cx"), F.round(c.y, 3).alias("cy"))


def footprint_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Footprints of at least 200 square metres."""
    held = City().with_footprints(_footprints(spark, sf), 200.0).buildings
    return held.select("building_id", F.round(geo.area(F.col("ring")), 2).alias("area"))


def largest_footprint(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.largest(_footprints(spark, sf), "building_id")


def split_walls(spark: SparkSession, sf: str) -> DataFrame:
    return _footprints(spark, sf).select("building_id", F.size(geo.split_sides(F.col("ring"), 10.0)).alias("vertices"), F.round(geo.area(geo.split_sides(F.col("ring"), 10.0)), 1).alias("area"))


def lod1_wall_area(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of 12 m over the footprints: surfaces, wall area and volume."""
    held = _footprints(spark, sf).withColumn("block", geo.extrude(F.col("ring"), F.lit(0.0), F.lit(12.0)))
    walls = geo.total(F.transform(F.slice("block", 3, F.size("block")), surfaces.area))
    return held.select("building_id", F.size("block").alias("surfaces"), F.round(walls, 3).alias("wall_area"), F.round(surfaces.area(F.get("block", F.lit(0))) * 12.0, 1).alias("volume"))


def dwithin_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.boxes_within(_boxes(spark, sf), "bounds_id", 15.0)


def merge_groups(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.merge_groups(_boxes(spark, sf), "bounds_id", 15.0)


def merge_footprint_heights(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of close boxes: members, total area, area-weighted mean height, last name."""
    usable = _boxes(spark, sf).where("zmin IS NOT NULL AND zmax IS NOT NULL AND NOT isnan(zmin) AND NOT isnan(zmax)")
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    held = usable.join(polygons.merge_groups(usable, "bounds_id", 15.0), F.col("bounds_id") == F.col("node"))
    return held.groupBy("component").agg(F.count("*").alias("members"), F.round(F.sum(area), 1).alias("area"), F.round(F.sum(F.col("zmin") * area) / F.sum(area), 4).alias("height"), F.max("bounds_id").alias("last"))


def building_heights(spark: SparkSession, sf: str) -> DataFrame:
    cells, grid = _dem(spark, sf)
    prints = _footprints(spark, sf)
    centres = prints.select("building_id", geo.vertex_mean(F.col("ring")).alias("c")).select("building_id", "c.*")
    ground = rasters.sample(centres, cells, grid)
    held = polygons.building_heights(prints, _solid_points(spark, sf), ground)
    return held.select("building_id", "ground_height", F.round("roof", 4).alias("roof"), F.round("height", 4).alias("height"))


def heights_from_attribute(spark: SparkSession, sf: str) -> DataFrame:
    """Heights stated on the boxes (zmax - zmin, 10 where unknown), at least 2.5, over the terrain."""
    cells, grid = _dem(spark, sf)
    held = boxes.measures(_boxes(spark, sf)).select("bounds_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "depth")
    held = polygons.heights_from_attribute(rasters.sample(held, cells, grid), F.col("depth"))
    return held.select("bounds_id", F.round("height", 3).alias("height"), "ground")


def zonal_stats(spark: SparkSession, sf: str) -> DataFrame:
    cells, grid = _dem(spark, sf)
    centred = cells.select(grid.x(F.col("col")).alias("x"), grid.y(F.col("row")).alias("y"), "value")
    held = polygons.zonal_stats(centred, _footprints(spark, sf), "building_id")
    return held.select("building_id", "count", "min", "max", *(F.round(c, 4).alias(c) for c in ("mean", "sum", "std", "var", "median", "p90")), "unique", "majority", "minority")


def burn_polygons(spark: SparkSession, sf: str) -> DataFrame:
    cells, grid = _dem(spark, sf)
    centred = cells.select("row", "col", grid.x(F.col("col")).alias("x"), grid.y(F.col("row")).alias("y"), "value")
    prints = _footprints(spark, sf).withColumns({"ord": F.col("building_id"), "mark": F.substring("building_id", 2, 10).cast("double")})
    return polygons.burn(centred, prints, "building_id", "ord", "mark")


# roads


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "road_edges").distinct().where("length > 1e-8 AND NOT isnan(length)")


def road_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.adjacency(_edges(spark, sf), keys=("network_id",)).select("network_id", "src", "dst", F.round("length", 3).alias("length"))


def road_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.degrees(_edges(spark, sf))


def road_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct ends of the roads of every network, numbered from 0 in their order."""
    ends = _edges(spark, sf).select("network_id", F.explode(F.array("src", "dst")).alias("vertex")).distinct()
    placed = numbered(ends, ["network_id", "vertex"], "_n")
    first = placed.groupBy("network_id").agg(F.min("_n").alias("_first"))
    return placed.join(first, "network_id").select("network_id", "vertex", (F.col("_n") - F.col("_first")).cast("int").alias("vid"))


def road_components(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.connected_components(_edges(spark, sf))


def road_component_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.connected_components(_edges(spark, sf)).groupBy("component").agg(F.count("*").alias("nodes"))


def length_stats(spark: SparkSession, sf: str) -> DataFrame:
    from urbanloom.operators.ranked import exact_percentiles

    edges = _edges(spark, sf)
    basic = edges.groupBy("network_id").agg(F.count("*").alias("n_edges"), F.min("length").alias("minimum"), F.max("length").alias("maximum"), F.round(F.avg("length"), 6).alias("mean"))
    return basic.join(exact_percentiles(edges, ["network_id"], "length", {"median": 0.5, "p90": 0.9}), "network_id")


# meshes over the embeddings: vertex = first three components, face i = (i, i + 1, i + 2)


def _mesh(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    held = table(spark, sf, "embeddings")
    n = held.count()
    vertices = held.select(F.col("vec_id").alias("vid"), *(F.round(F.col("embedding")[k].cast("double") * 16, 1).alias(c) for k, c in enumerate("xyz")))
    face = held.where(F.col("vec_id") < n - 2).select(F.col("vec_id").alias("fid"), *((F.col("vec_id") + k).alias(f"v{k}") for k in range(3)))
    cells = held.where(F.col("vec_id") < n - 3).select(F.col("vec_id").alias("cid"), *((F.col("vec_id") + k).alias(f"v{k}") for k in range(4)))
    return vertices, face, cells


def _rounded(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, *(F.round(c, 5).alias(c) for c in df.columns if c != key))


def tri_quality(spark: SparkSession, sf: str) -> DataFrame:
    vertices, faces, _ = _mesh(spark, sf)
    return _rounded(meshes.triangle_quality(faces, vertices), "fid")


def tri_summary(spark: SparkSession, sf: str) -> DataFrame:
    vertices, faces, _ = _mesh(spark, sf)
    return _rounded(meshes.summary(meshes.triangle_quality(faces, vertices), ["quality", "aspect_ratio", "edge_ratio", "skewness"]), "num_cells")


def tet_quality(spark: SparkSession, sf: str) -> DataFrame:
    vertices, _, cells = _mesh(spark, sf)
    held = meshes.tetrahedron_quality(cells, vertices).where("volume > 1e-6")
    return held.select("cid", F.round("quality", 5).alias("quality"), F.round("edge_ratio", 5).alias("edge_ratio"), F.round(F.least("aspect_ratio", F.lit(1e4)), 3).alias("aspect_ratio"), F.round("skewness", 5).alias("skewness"))


def naked_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.naked_edges(_mesh(spark, sf)[1])


def tet_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.tet_boundary(_mesh(spark, sf)[2])


def weld_mesh(spark: SparkSession, sf: str) -> DataFrame:
    vertices, faces, _ = _mesh(spark, sf)
    coarse = vertices.select("vid", *(F.rint(F.col(c) / 8).alias(c) for c in "xyz"))
    return meshes.weld(coarse, faces)[1]


def vertex_quantise(spark: SparkSession, sf: str) -> DataFrame:
    return meshes.quantise(_mesh(spark, sf)[0], 8.0)


def mesh_layers(spark: SparkSession, sf: str) -> DataFrame:
    vertices, faces, _ = _mesh(spark, sf)
    return meshes.layers(faces, 2, vertices.count())


def merge_meshes(spark: SparkSession, sf: str) -> DataFrame:
    """Two halves of the mesh (by label parity) as one, with new numbers."""
    held = table(spark, sf, "embeddings").select((F.col("label") % 2).cast("string").alias("mesh_id"), "vec_id")
    from pyspark.sql import Window

    numbered = held.withColumn("vid", F.row_number().over(Window.partitionBy("mesh_id").orderBy("vec_id")) - 1)
    vertices = numbered.select("mesh_id", "vid", F.col("vec_id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    size = vertices.groupBy("mesh_id").agg(F.max("vid").alias("last"))
    faces = vertices.join(size, "mesh_id").where("vid <= last - 2").select("mesh_id", F.col("vid").alias("fid"), *((F.col("vid") + k).alias(f"v{k}") for k in range(3)))
    return meshes.merge(vertices, faces)[1]


# land use


def landuse_classes(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    return table(spark, sf, "part").select("p_partkey", names.landuse_class(F.try_element_at(codes, F.col("p_type"))).alias("landuse"))


# sensors

LON, LAT, STATIONS = (11.0, 24.0), (55.0, 66.0), 50


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "observations").distinct()


def _all_readings(spark: SparkSession, sf: str) -> DataFrame:
    """The observations as they stand: repeats can't change which is last."""
    return table(spark, sf, "observations")


def latest_observations(spark: SparkSession, sf: str) -> DataFrame:
    """The latest readings of the first 50 stations of a region that have any value."""
    held = sensors.latest(sensors.stations_within(_all_readings(spark, sf), LON, LAT))
    return sensors.first_stations(sensors.drop_all_missing(held), STATIONS).select("station_id", "field", "value", "unit", "quality", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def all_latest(spark: SparkSession, sf: str) -> DataFrame:
    return sensors.latest(_all_readings(spark, sf)).select("station_id", "field", "value", "quality")


def sensor_summary(spark: SparkSession, sf: str) -> DataFrame:
    return sensors.summarise(_readings(spark, sf)).withColumn("mean", F.round("mean", 5))


def sensor_wide(spark: SparkSession, sf: str) -> DataFrame:
    return sensors.to_wide(sensors.latest(_all_readings(spark, sf)), ["air_temperature", "wind_speed", "pm10"])


def sensor_merge(spark: SparkSession, sf: str) -> DataFrame:
    held = _all_readings(spark, sf)
    merged = sensors.merge_stations(sensors.latest(held), held)
    return merged.select("station_id", "station_name", "lon", "lat", "elevation", F.size("values").alias("fields"), F.try_element_at("values", F.lit("pm10")).alias("pm10"))


def sensor_stale(spark: SparkSession, sf: str) -> DataFrame:
    return sensors.stale(sensors.latest(_all_readings(spark, sf)), 7).select("station_id", "field")


def reproject_3006(spark: SparkSession, sf: str) -> DataFrame:
    """Stations in SWEREF 99 TM."""
    x, y = crs.to_plane("lon", "lat")
    held = table(spark, sf, "observations").select("station_id", "lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL").distinct()
    return held.select("station_id", F.round(F.expr(x), 3).alias("x"), F.round(F.expr(y), 3).alias("y"))


def reproject_4326(spark: SparkSession, sf: str) -> DataFrame:
    """Trees in longitude and latitude."""
    lon, lat = crs.to_sphere("x", "y")
    held = table(spark, sf, "trees").where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select("tree_id", "x", "y").distinct()
    return held.select("tree_id", "x", "y", F.round(F.expr(lon), 8).alias("lon"), F.round(F.expr(lat), 8).alias("lat"))


# trees


def tree_crowns(spark: SparkSession, sf: str) -> DataFrame:
    """Crown radius by height, where none was measured: 0.22 h ^ 0.87 within 0.8 and 6 m."""
    by_height = trees.crown_radius(F.col("height"))
    return table(spark, sf, "trees").distinct().where("height > 0 AND height < 100").select("tree_id", "seen_at", F.round(F.coalesce("crown_radius", by_height), 6).alias("crown_radius")).withColumn("seen_at", F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss"))


def tree_circles(spark: SparkSession, sf: str) -> DataFrame:
    """Crowns as polygons of 64 corners: their area and length."""
    import math

    held = table(spark, sf, "trees").distinct().where("crown_radius > 0 AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    corner = lambda k: geo.point(F.col("crown_radius") * F.cos(k * (2 * math.pi / 64)), F.col("crown_radius") * F.sin(k * (2 * math.pi / 64)))
    ring = F.transform(F.sequence(F.lit(0), F.lit(63)), corner)
    return held.select("tree_id", "crown_radius", F.round(geo.area(ring), 5).alias("area"), F.round(geo.perimeter(ring), 5).alias("length"))


def tree_in_box_counts(spark: SparkSession, sf: str) -> DataFrame:
    trees = table(spark, sf, "trees").select("tree_id", "x", "y").distinct()
    return polygons.points_in_polygons(trees, _footprints(spark, sf), "building_id").groupBy("building_id").agg(F.countDistinct("tree_id").alias("trees"))


def disjoint_meshes(spark: SparkSession, sf: str) -> DataFrame:
    """Component of every vertex when three of every ten faces are missing, so that the mesh falls into parts."""
    faces = _mesh(spark, sf)[1].where("fid % 10 NOT IN (7, 8, 9)")
    edges = faces.select(F.inline(F.array(*(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("v0", "v1"), ("v1", "v2"))))))
    return graphs.connected_components(written(edges, "mesh-edges"))


_ALL = (bounds_measures, bounds_buffer, bounds_union, bounds_overlaps, bounds_nested, bounds_tiles, points_in_polygons, points_semi, points_anti, footprint_measures, footprint_filter, largest_footprint, split_walls, lod1_wall_area, dwithin_pairs, merge_groups, merge_footprint_heights, building_heights, heights_from_attribute, zonal_stats, burn_polygons, road_matrix, road_degrees, road_vertices, road_components, road_component_sizes, length_stats, tri_quality, tri_summary, tet_quality, naked_edges, tet_boundary, weld_mesh, vertex_quantise, mesh_layers, merge_meshes, landuse_classes, latest_observations, all_latest, sensor_summary, sensor_wide, sensor_merge, sensor_stale, reproject_3006, reproject_4326, tree_crowns, tree_circles, tree_in_box_counts, disjoint_meshes)
QUERIES = {f.__name__: f for f in _ALL}

_B = "b AS (SELECT DISTINCT * FROM survey_bounds WHERE xmin <= xmax AND ymin <= ymax AND NOT isnan(xmin) AND NOT isnan(ymin) AND NOT isnan(xmax) AND NOT isnan(ymax))"
_F = f"{_B}, f AS (SELECT bounds_id AS building_id, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy, (xmax - xmin) / 2 AS hw, (ymax - ymin) / 2 AS hh, xmin, ymin, xmax, ymax FROM b)"
_PD = "pd AS (SELECT DISTINCT cloud_id, strip_id, point_id, x, y, z, classification, intensity, return_number, num_returns FROM points)"
_INSIDE = "x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax AND abs(x - cx) * hh + abs(y - cy) * hw < hw * hh"
#: The same for data that lie on edges: between the two edges on the level of y, upper ones above cy, lower ones below; the left edge is inside, the right one outside.
_LEFT_OF = lambda x0, y0, x1, y1: f"({x1} - {x0}) * (y - {y0}) - ({y1} - {y0}) * (x - {x0}) > 0"
_WINDS = f"""y >= ymin AND y < ymax AND CASE WHEN y >= cy THEN {_LEFT_OF("xmax", "cy", "cx", "ymax")} AND NOT ({_LEFT_OF("xmin", "cy", "cx", "ymax")})
  ELSE {_LEFT_OF("cx", "ymin", "xmax", "cy")} AND NOT ({_LEFT_OF("cx", "ymin", "xmin", "cy")}) END"""
_GAP = "sqrt(pow(greatest(r.xmin - l.xmax, l.xmin - r.xmax, 0), 2) + pow(greatest(r.ymin - l.ymax, l.ymin - r.ymax, 0), 2))"
_E = "e AS (SELECT DISTINCT * FROM road_edges WHERE length > 1e-8 AND NOT isnan(length))"
_V = "v AS (SELECT vec_id AS vid, round(embedding[1]::DOUBLE * 16, 1) AS x, round(embedding[2]::DOUBLE * 16, 1) AS y, round(embedding[3]::DOUBLE * 16, 1) AS z FROM embeddings), n AS (SELECT count(*) AS n FROM embeddings), f AS (SELECT vec_id AS fid, vec_id AS v0, vec_id + 1 AS v1, vec_id + 2 AS v2 FROM embeddings, n WHERE vec_id < n - 2), c AS (SELECT vec_id AS cid, vec_id AS v0, vec_id + 1 AS v1, vec_id + 2 AS v2, vec_id + 3 AS v3 FROM embeddings, n WHERE vec_id < n - 3)"
_D = lambda a, b: f"sqrt(pow({a}.x - {b}.x, 2) + pow({a}.y - {b}.y, 2) + pow({a}.z - {b}.z, 2))"
_TRI = f"""{_V}, t AS (SELECT fid, {_D("a", "b")} AS l0, {_D("b", "c")} AS l1, {_D("c", "a")} AS l2,
  sqrt(pow((b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y), 2) + pow((b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z), 2) + pow((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x), 2)) / 2 AS s
  FROM f JOIN v a ON a.vid = v0 JOIN v b ON b.vid = v1 JOIN v c ON c.vid = v2),
q AS (SELECT fid, 4 * sqrt(3) * s / CASE WHEN l0 * l0 + l1 * l1 + l2 * l2 > 0 THEN l0 * l0 + l1 * l1 + l2 * l2 ELSE 1 END AS quality, greatest(l0, l1, l2) * (l0 + l1 + l2) / (4 * sqrt(3) * CASE WHEN s > 0 THEN s ELSE 1 END) AS aspect_ratio,
  greatest(l0, l1, l2) / CASE WHEN least(l0, l1, l2) > 0 THEN least(l0, l1, l2) ELSE 1 END AS edge_ratio, pow(l0 * l1 * l2 / (4 * CASE WHEN s > 0 THEN s ELSE 1 END), 2) * 3 * sqrt(3) / 4 AS ideal, s FROM t),
k AS (SELECT fid, quality, aspect_ratio, edge_ratio, 1 - s / CASE WHEN ideal > 0 THEN ideal ELSE 1 END AS skewness FROM q)"""
_M = ("quality", "aspect_ratio", "edge_ratio", "skewness")
_LAST = "SELECT station_id, field, arg_max(struct_pack(value := CASE WHEN isnan(value) THEN NULL ELSE value END, unit := unit, quality := quality, ts := ts), struct_pack(a := ts, b := obs_id)) AS l FROM (SELECT DISTINCT * FROM observations) WHERE ts IS NOT NULL"
_CC = "SELECT src AS u, dst AS v FROM {e} UNION ALL SELECT dst, src FROM {e}"


def _components(edges: str) -> str:
    """Least label of every node by a recursive query that keeps one row per node."""
    return f"""u AS MATERIALIZED (SELECT DISTINCT u, v FROM ({_CC.format(e=edges)})),
    cc(node, component) USING KEY (node) AS (
      SELECT u AS node, least(u, min(v)) AS component FROM u GROUP BY u
      UNION SELECT u.u, min(cc.component) FROM cc JOIN u ON u.v = cc.node JOIN recurring.cc old ON old.node = u.u WHERE cc.component < old.component GROUP BY u.u)"""


_x3, _y3 = crs.to_plane("lon", "lat")
_lon, _lat = crs.to_sphere("x", "y")
SQL = {
    "bounds_measures": f"WITH {_B} SELECT bounds_id, round(xmax - xmin, 3) AS width, round(ymax - ymin, 3) AS height, round(zmax - zmin, 3) AS depth, round((xmax - xmin) * (ymax - ymin), 3) AS area, round((xmax - xmin) * (ymax - ymin) * (zmax - zmin), 3) AS volume, round((xmin + xmax) / 2, 4) AS cx, round((ymin + ymax) / 2, 4) AS cy, (xmax = xmin AND ymax = ymin) AS is_point FROM b",
    "bounds_buffer": f"WITH {_B} SELECT bounds_id, round(xmin - 5, 3) AS xmin, round(ymin - 5, 3) AS ymin, round(xmax + 5, 3) AS xmax, round(ymax + 5, 3) AS ymax FROM b",
    "bounds_union": f"WITH {_B} SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, count(*) AS n FROM b",
    "bounds_overlaps": f"WITH {_B} SELECT l.bounds_id AS a, r.bounds_id AS b, greatest(l.xmin, r.xmin) AS xmin, greatest(l.ymin, r.ymin) AS ymin, least(l.xmax, r.xmax) AS xmax, least(l.ymax, r.ymax) AS ymax FROM b l JOIN b r ON l.bounds_id < r.bounds_id WHERE l.xmin <= r.xmax AND r.xmin <= l.xmax AND l.ymin <= r.ymax AND r.ymin <= l.ymax",
    "bounds_nested": f'WITH {_B} SELECT l.bounds_id AS "outer", r.bounds_id AS "inner" FROM b l JOIN b r ON l.bounds_id != r.bounds_id WHERE l.xmin <= r.xmin AND l.ymin <= r.ymin AND l.xmax >= r.xmax AND l.ymax >= r.ymax',
    "bounds_tiles": f"""WITH {_B}, i AS (SELECT *, unnest(range(greatest(ceil((xmax - xmin) / 20)::INT, 1)))::INT AS i FROM b), j AS (SELECT *, unnest(range(greatest(ceil((ymax - ymin) / 20)::INT, 1)))::INT AS j FROM i)
      SELECT bounds_id, i, j, round(xmin + i * 20, 3) AS xmin, round(ymin + j * 20, 3) AS ymin, round(least(xmin + (i + 1) * 20, xmax), 3) AS xmax, round(least(ymin + (j + 1) * 20, ymax), 3) AS ymax FROM j""",
    "points_in_polygons": f"WITH {_F}, {_PD} SELECT building_id, point_id FROM pd JOIN f ON {_INSIDE}",
    "points_semi": f"WITH {_F}, {_PD} SELECT point_id FROM pd WHERE point_id IN (SELECT point_id FROM pd JOIN f ON {_INSIDE})",
    "points_anti": f"WITH {_F}, {_PD} SELECT point_id FROM pd WHERE point_id NOT IN (SELECT point_id FROM pd JOIN f ON {_INSIDE})",
    "footprint_measures": f"WITH {_F} SELECT building_id, round(2 * hw * hh, 2) AS area, round(4 * sqrt(hw * hw + hh * hh), 4) AS perimeter, hw * hh > 0 AS counter_clockwise, true AS convex, round(cx, 3) AS cx, round(cy, 3) AS cy FROM f",
    "footprint_filter": f"WITH {_F} SELECT building_id, round(2 * hw * hh, 2) AS area FROM f WHERE round(2 * hw * hh, 2) >= 200",
    "largest_footprint": f"WITH {_F} SELECT building_id, round(2 * hw * hh, 2) AS area FROM f ORDER BY 2 DESC, 1 DESC LIMIT 1",
    "split_walls": f"WITH {_F} SELECT building_id, (4 * greatest(ceil(sqrt(hw * hw + hh * hh) / 10), 1))::INT AS vertices, round(2 * hw * hh, 1) AS area FROM f",
    "lod1_wall_area": f"WITH {_F} SELECT building_id, 6 AS surfaces, round(48 * sqrt(hw * hw + hh * hh), 3) AS wall_area, round(24 * hw * hh, 1) AS volume FROM f",
    "dwithin_pairs": f"WITH {_B} SELECT l.bounds_id AS a, r.bounds_id AS b FROM b l JOIN b r ON l.bounds_id < r.bounds_id WHERE {_GAP} <= 15",
    "merge_groups": f"WITH RECURSIVE {_B}, e AS (SELECT l.bounds_id AS src, r.bounds_id AS dst FROM b l JOIN b r ON l.bounds_id <= r.bounds_id WHERE {_GAP} <= 15), {_components('e')} SELECT node, component FROM cc",
    "merge_footprint_heights": f"""WITH RECURSIVE {_B.replace("WHERE", "WHERE zmin IS NOT NULL AND zmax IS NOT NULL AND NOT isnan(zmin) AND NOT isnan(zmax) AND")}, e AS (SELECT l.bounds_id AS src, r.bounds_id AS dst FROM b l JOIN b r ON l.bounds_id <= r.bounds_id WHERE {_GAP} <= 15), {_components('e')}
      SELECT component, count(*) AS members, round(sum((xmax - xmin) * (ymax - ymin)), 1) AS area, round(sum(zmin * (xmax - xmin) * (ymax - ymin)) / sum((xmax - xmin) * (ymax - ymin)), 4) AS height, max(bounds_id) AS last FROM cc JOIN b ON bounds_id = node GROUP BY component""",
    "building_heights": f"""WITH {_GRID}, {_F.replace(", f AS", ", fp AS")}, {_PD}, r AS (SELECT building_id, quantile_cont(z, 0.9) AS roof FROM pd JOIN fp ON {_INSIDE} WHERE z IS NOT NULL AND NOT isnan(z) AND coalesce(classification NOT IN (2, 9), true) GROUP BY 1),
      q AS (SELECT building_id, d.v AS ground_height FROM fp CROSS JOIN g LEFT JOIN d ON d."row" = floor((g.n * 10.0 - cy) / 10.0)::INT AND d.col = floor((cx - g.w * 10.0) / 10.0)::INT)
      SELECT building_id, ground_height, round(roof, 4) AS roof, round(greatest(coalesce(roof - ground_height, 2.5), 2.5), 4) AS height FROM q LEFT JOIN r USING (building_id)""",
    "heights_from_attribute": f"""WITH {_GRID}, {_F.replace(", f AS", ", fp AS")} SELECT bounds_id, round(greatest(coalesce(CASE WHEN isnan(zmax - zmin) THEN NULL ELSE zmax - zmin END, 10.0), 2.5), 3) AS height, d.v AS ground FROM b CROSS JOIN g LEFT JOIN d ON d."row" = floor((g.n * 10.0 - (ymin + ymax) / 2) / 10.0)::INT AND d.col = floor(((xmin + xmax) / 2 - g.w * 10.0) / 10.0)::INT""",
    "zonal_stats": f"""WITH {_GRID}, {_F.replace(", f AS", ", fp AS")}, h AS (SELECT building_id, v FROM (SELECT g.w * 10.0 + 10.0 * (col + 0.5) AS x, g.n * 10.0 - 10.0 * ("row" + 0.5) AS y, v FROM d, g) JOIN fp ON {_INSIDE}),
      o AS (SELECT building_id, v, count(*) AS n FROM h GROUP BY 1, 2), o2 AS (SELECT building_id, arg_min(v, struct_pack(a := -n, b := v)) AS majority, arg_min(v, struct_pack(a := n, b := v)) AS minority FROM o GROUP BY 1)
      SELECT building_id, count(*) AS count, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(sum(v), 4) AS sum, round(stddev_pop(v), 4) AS std, round(var_pop(v), 4) AS var, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.9), 4) AS p90, count(DISTINCT v) AS "unique", any_value(majority) AS majority, any_value(minority) AS minority FROM h JOIN o2 USING (building_id) GROUP BY building_id""",
    "burn_polygons": f"""WITH {_GRID}, {_F.replace(", f AS", ", fp AS")}, h AS (SELECT "row", col, max(building_id) AS last FROM (SELECT "row", col, g.w * 10.0 + 10.0 * (col + 0.5) AS x, g.n * 10.0 - 10.0 * ("row" + 0.5) AS y FROM d, g) JOIN fp ON {_INSIDE} GROUP BY 1, 2)
      SELECT d."row", d.col, coalesce(substring(last, 2, 10)::DOUBLE, v) AS value FROM d LEFT JOIN h ON h."row" = d."row" AND h.col = d.col""",
    "road_matrix": f"WITH {_E} SELECT network_id, src, dst, round(sum(length), 3) AS length FROM (SELECT network_id, src, dst, length FROM e UNION ALL SELECT network_id, dst, src, length FROM e WHERE src != dst) GROUP BY 1, 2, 3",
    "road_degrees": f"WITH {_E} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1",
    "road_vertices": f"WITH {_E} SELECT network_id, node AS vertex, (row_number() OVER (PARTITION BY network_id ORDER BY node) - 1)::INT AS vid FROM (SELECT network_id, src AS node FROM e UNION SELECT network_id, dst FROM e)",
    "road_components": f"WITH RECURSIVE {_E}, {_components('e')} SELECT node, component FROM cc",
    "road_component_sizes": f"WITH RECURSIVE {_E}, {_components('e')} SELECT component, count(*) AS nodes FROM cc GROUP BY 1",
    "length_stats": f"WITH {_E} SELECT network_id, count(*) AS n_edges, min(length) AS minimum, max(length) AS maximum, round(avg(length), 6) AS mean, quantile_cont(length, 0.5) AS median, quantile_cont(length, 0.9) AS p90 FROM e GROUP BY 1",
    "tri_quality": f"WITH {_TRI} SELECT fid, " + ", ".join(f"round({m}, 5) AS {m}" for m in _M) + " FROM k",
    "tri_summary": f"WITH {_TRI} SELECT count(*) AS num_cells, " + ", ".join(f"round({f}({m}), 5) AS {m}_{n}" for m in _M for f, n in (("min", "min"), ("max", "max"), ("avg", "mean"))) + " FROM k",
    "tet_quality": f"""WITH {_V}, t AS (SELECT cid, {_D("a", "b")} AS l0, {_D("a", "c4")} AS l1, {_D("a", "e")} AS l2, {_D("b", "c4")} AS l3, {_D("b", "e")} AS l4, {_D("c4", "e")} AS l5,
      abs((b.x - a.x) * ((c4.y - a.y) * (e.z - a.z) - (c4.z - a.z) * (e.y - a.y)) + (b.y - a.y) * ((c4.z - a.z) * (e.x - a.x) - (c4.x - a.x) * (e.z - a.z)) + (b.z - a.z) * ((c4.x - a.x) * (e.y - a.y) - (c4.y - a.y) * (e.x - a.x))) / 6 AS vol
      FROM c JOIN v a ON a.vid = v0 JOIN v b ON b.vid = v1 JOIN v c4 ON c4.vid = v2 JOIN v e ON e.vid = v3),
      h AS (SELECT *, l0 * l5 AS p1, l1 * l4 AS p2, l2 * l3 AS p3, sqrt(abs((l0 * l5 + l1 * l4 + l2 * l3) * (l0 * l5 - l1 * l4 + l2 * l3) * (l0 * l5 + l1 * l4 - l2 * l3) * (-l0 * l5 + l1 * l4 + l2 * l3))) / (24 * vol) AS big,
        (SELECT sum(sqrt(greatest((x + y + z) * (-x + y + z) * (x - y + z) * (x + y - z), 0)) / 4) FROM (VALUES (l3, l4, l5), (l1, l2, l5), (l0, l2, l4), (l0, l1, l3)) w(x, y, z)) AS faces FROM t WHERE vol > 1e-6)
      SELECT cid, round(72 * sqrt(3) * vol / pow(l0 * l0 + l1 * l1 + l2 * l2 + l3 * l3 + l4 * l4 + l5 * l5, 1.5), 5) AS quality, round(greatest(l0, l1, l2, l3, l4, l5) / least(l0, l1, l2, l3, l4, l5), 5) AS edge_ratio, round(least(big / (3 * (3 * vol / faces)), 1e4), 3) AS aspect_ratio, round(1 - vol / (8 * sqrt(3) / 27 * pow(big, 3)), 5) AS skewness FROM h""",
    "naked_edges": f"WITH {_V} SELECT a, b FROM (SELECT least(v0, v1) AS a, greatest(v0, v1) AS b FROM f UNION ALL SELECT least(v1, v2), greatest(v1, v2) FROM f UNION ALL SELECT least(v2, v0), greatest(v2, v0) FROM f) GROUP BY 1, 2 HAVING count(*) = 1",
    "tet_boundary": f"WITH {_V} SELECT min(cid) AS cid, v0, v1, v2 FROM (SELECT cid, v0, v1, v2 FROM c UNION ALL SELECT cid, v0, v1, v3 FROM c UNION ALL SELECT cid, v0, v2, v3 FROM c UNION ALL SELECT cid, v1, v2, v3 FROM c) GROUP BY v0, v1, v2 HAVING count(*) = 1",
    "weld_mesh": f"WITH {_V}, k AS (SELECT vid, min(vid) OVER (PARTITION BY round_even(x / 8, 0), round_even(y / 8, 0), round_even(z / 8, 0)) AS kept FROM v) SELECT fid, a.kept AS v0, b.kept AS v1, c.kept AS v2 FROM f JOIN k a ON a.vid = v0 JOIN k b ON b.vid = v1 JOIN k c ON c.vid = v2",
    "vertex_quantise": f"WITH {_V}, k AS (SELECT vid, round_even(x / 8, 0)::BIGINT AS x, round_even(y / 8, 0)::BIGINT AS y, round_even(z / 8, 0)::BIGINT AS z FROM v) SELECT vid, x, y, z, min(vid) OVER (PARTITION BY x, y, z) AS first FROM k",
    "mesh_layers": f"WITH {_V}, l AS (SELECT fid, v0 + k * n AS a, v1 + k * n AS b, v2 + k * n AS c, k, n FROM f, n, (VALUES (0), (1)) kk(k)) SELECT fid * 6 + k * 3 AS cid, a AS v0, b AS v1, c AS v2, c + n AS v3 FROM l UNION ALL SELECT fid * 6 + k * 3 + 1, a, b, b + n, c + n FROM l UNION ALL SELECT fid * 6 + k * 3 + 2, a, a + n, b + n, c + n FROM l",
    "merge_meshes": "WITH s AS (SELECT label % 2 AS m, count(*) AS n FROM embeddings GROUP BY 1), o AS (SELECT m, n, coalesce(sum(n) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS v0, coalesce(sum(n - 2) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f0 FROM s), k AS (SELECT v0, f0, unnest(range(n - 2)) AS i FROM o) SELECT (f0 + i)::BIGINT AS fid, (v0 + i)::BIGINT AS v0, (v0 + i + 1)::BIGINT AS v1, (v0 + i + 2)::BIGINT AS v2 FROM k",
    "landuse_classes": "SELECT p_partkey, CASE p_type " + " ".join(f"WHEN '{k}' THEN '{names.LANDUSE[v]}'" for k, v in CODES.items()) + " ELSE 'UNKNOWN' END AS landuse FROM part",
    "latest_observations": f"WITH l AS ({_LAST} AND lon BETWEEN {LON[0]} AND {LON[1]} AND lat BETWEEN {LAT[0]} AND {LAT[1]} GROUP BY 1, 2), k AS (SELECT station_id FROM l WHERE l.value IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT {STATIONS}) SELECT station_id, field, l.value AS value, l.unit AS unit, l.quality AS quality, strftime(l.ts, '%Y-%m-%d %H:%M:%S') AS ts FROM l WHERE station_id IN (SELECT station_id FROM k)",
    "all_latest": f"SELECT station_id, field, l.value AS value, l.quality AS quality FROM ({_LAST} GROUP BY 1, 2)",
    "sensor_summary": "SELECT field, count(DISTINCT station_id) AS stations, count(v) AS n, min(v) AS min, max(v) AS max, round(avg(v), 5) AS mean FROM (SELECT DISTINCT *, CASE WHEN isnan(value) THEN NULL ELSE value END AS v FROM observations) GROUP BY field",
    "sensor_wide": f"SELECT station_id, max(l.value) FILTER (field = 'air_temperature') AS air_temperature, max(l.value) FILTER (field = 'wind_speed') AS wind_speed, max(l.value) FILTER (field = 'pm10') AS pm10 FROM ({_LAST} GROUP BY 1, 2) GROUP BY 1",
    "sensor_merge": f"WITH l AS ({_LAST} GROUP BY 1, 2), m AS (SELECT station_id, arg_min(struct_pack(n := station_name, lon := lon, lat := lat, e := elevation), struct_pack(a := ts, b := obs_id)) AS m FROM (SELECT DISTINCT * FROM observations) WHERE ts IS NOT NULL GROUP BY 1) SELECT station_id, any_value(m.n) AS station_name, any_value(m.lon) AS lon, any_value(m.lat) AS lat, any_value(m.e) AS elevation, count(*)::INT AS fields, max(l.value) FILTER (field = 'pm10') AS pm10 FROM m JOIN l USING (station_id) GROUP BY 1",
    "sensor_stale": f"SELECT station_id, field FROM (SELECT station_id, field, l.ts AS ts, max(l.ts) OVER (PARTITION BY field) AS newest FROM ({_LAST} GROUP BY 1, 2)) WHERE ts < newest - INTERVAL 7 DAYS",
    "reproject_3006": f"SELECT station_id, round({_x3}, 3) AS x, round({_y3}, 3) AS y FROM (SELECT DISTINCT station_id, lon, lat FROM observations WHERE lon IS NOT NULL AND lat IS NOT NULL)",
    "reproject_4326": f"SELECT tree_id, x, y, round({_lon}, 8) AS lon, round({_lat}, 8) AS lat FROM (SELECT DISTINCT tree_id, x, y FROM trees WHERE {_OK})",
    "tree_crowns": "SELECT tree_id, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS seen_at, round(coalesce(crown_radius, least(greatest(0.22 * pow(height, 0.87), 0.8), 6.0)), 6) AS crown_radius FROM (SELECT DISTINCT * FROM trees) WHERE height > 0 AND height < 100",
    "tree_circles": f"SELECT tree_id, crown_radius, round(32 * crown_radius * crown_radius * sin(2 * pi() / 64), 5) AS area, round(128 * crown_radius * sin(pi() / 64), 5) AS length FROM (SELECT DISTINCT * FROM trees) WHERE crown_radius > 0 AND {_OK}",
    "tree_in_box_counts": f"WITH {_F} SELECT building_id, count(DISTINCT tree_id) AS trees FROM (SELECT tree_id, x, y, f.* EXCLUDE (building_id), building_id FROM trees JOIN f ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax WHERE {_OK}) WHERE {_WINDS} GROUP BY 1",
    "disjoint_meshes": f"WITH RECURSIVE {_V}, e AS (SELECT v0 AS src, v1 AS dst FROM f WHERE fid % 10 NOT IN (7, 8, 9) UNION ALL SELECT v1, v2 FROM f WHERE fid % 10 NOT IN (7, 8, 9)), {_components('e')} SELECT node, component FROM cc",
}
