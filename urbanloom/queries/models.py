"""Queries over lattices, meshes, crowns, city meshes, objects and datasets, with their SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.functions import crs, names, overlay, planar
from urbanloom.functions import geometry as geo
from urbanloom.functions import surfaces as sf
from urbanloom.operators import boxes as bx
from urbanloom.operators import graphs, meshes, points, polygons, sensors, trees
from urbanloom.operators import rasters as rs
from urbanloom.plans import city, registry
from urbanloom.plans.tables import table, written
from urbanloom.queries.city import _B, _D, _F, _INSIDE, _TRI, _V, SIDES, _boxes, _footprints, _mesh
from urbanloom.queries.clouds import _GRID, _OK, CELL, _dem, _points
from urbanloom.queries.shapes import _R, _ROOMY, _at, _box_ring, _round

# lattices


def grid_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vertex of the elevation raster's lattice, the neighbours over sides and over corners: how many, and their sum."""
    _, grid = _dem(spark, sf_dir)
    held = spark.range(grid.rows * grid.cols).withColumnRenamed("id", "index")
    four, eight = (rs.vertex_neighbours(grid.cols, grid.rows, F.col("index"), c) for c in (False, True))
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    return held.select("index", F.size(four).alias("sides"), F.size(eight).alias("all"), add(eight).alias("total"))


def volume_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices of a lattice of 10 m steps, two cells high, over the elevation raster."""
    _, grid = _dem(spark, sf_dir)
    return rs.volume_vertices(spark, (0.0, 0.0, 5.0), (CELL, CELL, 2.5), (grid.cols, grid.rows, 2))


def grid_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elevation raster as a field over a lattice, from the south."""
    cells, grid = _dem(spark, sf_dir)
    return rs.bottom_up(cells, grid)


def raster_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the elevation raster that are the highest of 5 x 5."""
    return rs.tops(_dem(spark, sf_dir)[0], 5, 0.0)


def raster_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elevation raster blurred by half a cell (two cells are looked at)."""
    return rs.gaussian(_dem(spark, sf_dir)[0], 0.5).select("row", "col", F.round("value", 4).alias("value"))


def raster_of_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, faces, _ = _mesh(spark, sf_dir)
    grid = rs.Grid.around(vertices, 8.0)
    return rs.from_mesh(vertices.withColumn("classification", F.lit(2)), faces, grid).select("row", "col", F.round("value", 4).alias("value"))


def burn_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that every box touches."""
    _, grid = _dem(spark, sf_dir)
    held = _boxes(spark, sf_dir).where(_ROOMY).select("bounds_id", _box_ring().alias("ring"))
    return rs.touched(held, "bounds_id", grid)


# meshes


def mesh_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices within 40 of each side of the mesh, numbered along it."""
    return meshes.boundary_vertices(_mesh(spark, sf_dir)[0], 40.0).drop("place")


def mesh_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mesh after one sweep."""
    vertices, faces, _ = _mesh(spark, sf_dir)
    return meshes.smooth_mesh(vertices, faces).select("vid", *(F.round(c, 5).alias(c) for c in "xyz"))


def mesh_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, faces, _ = _mesh(spark, sf_dir)
    return meshes.to_surfaces(faces, vertices).select("fid", F.round(sf.area(F.col("ring")), 4).alias("area"))


def facet_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of the boundary facets of the cells, from vertex markers -2 to 3 by number (two buildings)."""
    vertices, _, cells = _mesh(spark, sf_dir)
    marks = vertices.select("vid", ((F.floor(F.col("vid") / 3) * 7) % 6 - 2).cast("int").alias("marker"))
    return meshes.facet_markers(graphs.tet_boundary(cells), marks, 2).select("v0", "v1", "v2", "marker")


def tet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, _, cells = _mesh(spark, sf_dir)
    held = meshes.tetrahedron_quality(cells, vertices)
    return meshes.summary(held, ["quality", "edge_ratio"]).select("num_cells", *(F.round(c, 4).alias(c) for c in ("quality_min", "quality_max", "quality_mean", "edge_ratio_min", "edge_ratio_max", "edge_ratio_mean")))


# rings and lines


def ring_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hull of the corners and some inner places of every box."""
    ring = geo.ring_of(_at(0, 0), _at(0.5, 0.3), _at(1, 0), _at(0.2, 0.7), _at(1, 1), _at(0.5, 0.5), _at(0, 1))
    held = _boxes(spark, sf_dir).where(_ROOMY).select("bounds_id", planar.convex_hull(ring).alias("h"))
    return held.select("bounds_id", F.size("h").alias("corners"), _round(geo.area(F.col("h"))).alias("area"))


def ring_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with a hole of a quarter of their area, triangulated: the triangles and their area."""
    hole = geo.ring_of(_at(0.25, 0.25), _at(0.25, 0.75), _at(0.75, 0.75), _at(0.75, 0.25))
    held = _boxes(spark, sf_dir).where(_ROOMY).select("bounds_id", planar.meshed(overlay.as_polygon(_box_ring(), F.array(hole))).alias("t"))
    return held.select("bounds_id", F.size("t").alias("triangles"), _round(geo.total(F.transform("t", geo.area))).alias("area"))


def ring_short_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with a cut corner of 10 cm, without edges of at most 20 cm; moved by (3, -2) and raised to 7."""
    x1, y1 = F.col("xmax"), F.col("ymax")
    ring = geo.ring_of(_at(0, 0), _at(1, 0), (x1, y1 - 0.05), (x1 - 0.05, y1), _at(0, 1))
    long = geo.with_z(geo.translate(geo.without_short_edges(ring, 0.2), 3.0, -2.0), F.lit(7.0))
    return _boxes(spark, sf_dir).where(_ROOMY).select("bounds_id", F.size(long).alias("corners"), F.round(F.get(long, F.lit(0)).x, 3).alias("x"), F.round(F.get(long, F.lit(0)).y, 3).alias("y"), F.get(long, F.lit(0)).z.alias("z"))


def line_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines along two sides of every box: their length, and the number and area of road surfaces 4 m wide along them."""
    line = geo.ring_of(_at(0, 0), _at(1, 0), _at(1, 1))
    roads = geo.road_surfaces(line, 4.0)
    return _boxes(spark, sf_dir).where(_ROOMY).select("bounds_id", F.round(geo.line_length(line), 3).alias("length"), F.size(roads).alias("surfaces"), _round(geo.total(F.transform(roads, geo.area)), 1).alias("area"))


def ring_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of a place 3 m right of every box's upper right corner and 4 m above it, and of one inside."""
    held = _boxes(spark, sf_dir).where(_ROOMY)
    out = geo.ring_distance(_box_ring(), F.col("xmax") + 3.0, F.col("ymax") + 4.0)
    inner = geo.ring_distance(_box_ring(), *_at(0.5, 0.5))
    return held.select("bounds_id", F.round(out, 4).alias("outside"), F.round(inner, 4).alias("inside"))


def reproject_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of the national system in the zones 32633, 3011 and 3857, and back again."""
    held = table(spark, sf_dir, "trees").where(_OK).select("tree_id", "x", "y").distinct()
    web = crs.reprojected(held.select("tree_id", F.col("x").alias("x0"), F.col("y").alias("y0"), "x", "y"), "EPSG:3006", "EPSG:3857")
    back = crs.reprojected(web.select("tree_id", "x0", "y0", F.col("x").alias("wx"), F.col("y").alias("wy"), "x", "y"), 3857, 3006)
    return back.select("tree_id", "x0", "y0", F.round("wx", 2).alias("wx"), F.round("wy", 2).alias("wy"), (F.abs(F.col("x") - F.col("x0")) + F.abs(F.col("y") - F.col("y0")) < 1e-3).alias("same"))


def reproject_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box rings in degrees."""
    source, target = crs.chosen("EPSG:3006", 4326)
    ring = crs.reprojected_ring(_box_ring(), source, target)
    held = _boxes(spark, sf_dir).select("bounds_id", F.posexplode(ring).alias("k", "p"))
    return held.select("bounds_id", "k", F.round("p.x", 7).alias("lon"), F.round("p.y", 7).alias("lat"))


def geometry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of geometry as texts name them."""
    held = spark.createDataFrame([("mesh",), (" Point-Cloud ",), ("volume mesh",), ("LOD1",), ("cube",), (None,)], "name string")
    return held.select("name", names.geometry_type_of(F.col("name")).alias("kind"))


# crowns


def _basins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, rs.Grid]:
    cells, grid = _dem(spark, sf_dir)
    return trees.segments(cells, grid.cols, rs.tops(cells, 3, 0.0), 0.0), grid


def crown_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watershed of the elevation raster, every peak a top."""
    return _basins(spark, sf_dir)[0]


def crown_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, grid = _basins(spark, sf_dir)
    return trees.segment_radius(held, grid.size).select("top", "cells", F.round("radius", 4).alias("radius"))


def crown_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outlines of the watershed's segments: their area."""
    held, grid = _basins(spark, sf_dir)
    return trees.crown_polygons(held, grid, tolerance=0.0).groupBy("top").agg(F.round(F.sum(overlay.measured(F.col("polygon"), overlay.polygon_area))).alias("area"))


def _city(spark: SparkSession, sf_dir: str) -> city.City:
    cells, grid = _dem(spark, sf_dir)
    return city.City(points=_points(spark, sf_dir), buildings=_footprints(spark, sf_dir)).with_terrain(cells, grid)


def trees_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees from the vegetation of the clouds over the terrain."""
    return _city(spark, sf_dir).build_trees().trees


# city meshes


def city_flat_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, faces = _city(spark, sf_dir).flat_mesh()
    return faces.select("fid", "v0", "v1", "v2", "marker")


def city_surface_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of terrain and blocks of 12 m by marker: how many, and their area."""
    held = _city(spark, sf_dir)
    held = city.replace(held, buildings=held.buildings.withColumns({"ground_height": F.lit(0.0), "height": F.lit(12.0)}))
    rings = held.build_lod1().surface_mesh().where("marker >= 0")
    upright = F.abs(sf.normal(F.col("ring")).z) < 1e-9
    return rings.where(sf.area(F.col("ring")) > 1e-9).groupBy("marker").agg(F.count(F.when(upright, 1)).alias("walls"), F.round(F.sum(F.when(upright, sf.area(F.col("ring"))).otherwise(0.0)), 1).alias("wall_area"))


def city_volume_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the air over the terrain, outside blocks of 12 m, by layer: how many."""
    held = _city(spark, sf_dir)
    held = city.replace(held, buildings=held.buildings.withColumns({"ground_height": F.lit(0.0), "height": F.lit(12.0)}))
    _, cells = held.volume_mesh(100.0, 2)
    grid = held.grid
    return cells.select(F.floor(F.least("v0", "v1", "v2", "v3") / (grid.rows * grid.cols)).alias("layer")).groupBy("layer").agg(F.count("*").alias("cells"))


# objects


def _objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The boxes as buildings of one city, with the trees of a place as their children by number, and box geometries."""
    root = spark.createDataFrame([("city", None, "City", "{}")], "object_id string, parent_id string, type string, attributes string")
    held = _boxes(spark, sf_dir)
    own = held.select(F.col("bounds_id").alias("object_id"), F.lit("Building").alias("type"), F.to_json(F.struct((F.col("xmax") - F.col("xmin")).alias("width"))).alias("attributes"))
    parts = held.select(F.concat(F.lit("part-"), "bounds_id").alias("object_id"), F.lit("BuildingPart").alias("type"), F.lit(None).cast("string").alias("attributes"), F.col("bounds_id").alias("_of"))
    rows = city.add_children(city.add_children(root, own, "city"), parts, F.col("_of"))
    geometries = held.select(F.col("bounds_id").alias("object_id"), F.lit("BOUNDS").alias("geometry_type"), F.to_json(F.struct(*SIDES)).alias("geometry"))
    return rows, geometries


def object_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return city.tree_lines(_objects(spark, sf_dir)[0])


def object_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts after each got a number of storeys: the length of its id."""
    rows, _ = _objects(spark, sf_dir)
    values = city.children_of(rows, "BuildingPart").select("object_id", F.length("object_id").alias("value"))
    held = city.set_child_attribute(rows, "BuildingPart", "storeys", values)
    return city.child_attribute(held, "BuildingPart", "storeys", "0")


def object_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometries by kind after parts got one, buildings a second kind and the boxes wide of 20 m or more lost theirs."""
    rows, geometries = _objects(spark, sf_dir)
    parts = city.children_of(rows, "BuildingPart").select("object_id", F.lit("LOD1").alias("geometry_type"), F.lit("[]").alias("geometry"))
    wide = _boxes(spark, sf_dir).where("xmax - xmin >= 20").select(F.col("bounds_id").alias("object_id"))
    held = city.remove_geometry(city.add_geometry(city.add_geometry(geometries, parts), parts), "BOUNDS", wide)
    return held.groupBy("geometry_type").agg(F.count("*").alias("n"))


def object_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects as JSON and back: those that came back as they were."""
    rows, geometries = _objects(spark, sf_dir)
    again, shapes = city.from_json(written(city.to_json(rows, geometries), "objects"))
    return again.intersect(rows).select("object_id").join(shapes.intersect(geometries).select("object_id", "geometry_type"), "object_id", "left")


# datasets


@dataclass(frozen=True)
class StationArguments:
    """Arguments of the station datasets; bounds are degrees."""

    folder: str
    bounds: tuple
    parameters: tuple = ()
    max_stations: int = 20
    drop_missing: bool = True


def _stations(fields: tuple):  # noqa: ANN202
    def build(spark: SparkSession, a: StationArguments) -> DataFrame:
        held = sensors.stations_within(table(spark, a.folder, "observations"), (a.bounds[0], a.bounds[2]), (a.bounds[1], a.bounds[3])).where(F.col("field").isin(*(a.parameters or fields)))
        last = sensors.latest(held)
        return sensors.first_stations(sensors.drop_all_missing(last) if a.drop_missing else last, a.max_stations)

    return build


@dataclass(frozen=True)
class CityArguments:
    """Arguments of the datasets of a whole city; bounds are metres."""

    folder: str
    bounds: tuple
    cell_size: float = CELL
    percentile: float = 0.9
    kind: str = "urban"


def _in_bounds(spark: SparkSession, a: CityArguments) -> city.City:
    half = len(a.bounds) // 2
    box = points.Box(*a.bounds[:2], *a.bounds[half : half + 2])
    held = _footprints(spark, a.folder).join(points.overlapping(_boxes(spark, a.folder), box).select(F.col("bounds_id").alias("building_id")), "building_id", "left_semi")
    return city.City(points=points.crop(_points(spark, a.folder), box), buildings=held).build_terrain(a.cell_size)


for _name, _fields in (("hydrology", ("water_level", "water_discharge")), ("ocean", ("water_level", "air_pressure")), ("air_quality", ("pm10",))):
    registry.register(registry.Dataset(_name, StationArguments, _stations(_fields), f"latest {_name.replace('_', ' ')} readings of the first stations in bounds"))
for _name, _text, _build in (
    ("buildings", "footprints with ground, roof and height", lambda s, a: _in_bounds(s, a).building_heights(a.percentile, outliers=None).buildings.drop("ring")),
    ("terrain_surface_mesh", "faces of the terrain", lambda s, a: _in_bounds(s, a).terrain_mesh()[1]),
    ("city_flat_mesh", "faces of the flat mesh with markers", lambda s, a: _in_bounds(s, a).flat_mesh()[1]),
    ("city_surface_mesh", "triangles of terrain and blocks", lambda s, a: _in_bounds(s, a).building_heights(a.percentile, outliers=None).build_lod1().surface_mesh()),
    ("city_volume_mesh", "cells of the air over the city", lambda s, a: _in_bounds(s, a).building_heights(a.percentile, outliers=None).volume_mesh()[1]),
    ("trees", "trees from the vegetation", lambda s, a: _in_bounds(s, a).build_trees(a.kind).trees),
):
    registry.register(registry.Dataset(_name, CityArguments, _build, _text))

BOUNDS = (12.0, 56.0, 22.0, 64.0)


def _by_name(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return registry.get(name)(spark, folder=sf_dir, bounds=BOUNDS).select("station_id", "field", "value")


def dataset_hydrology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_name(spark, sf_dir, "hydrology")


def dataset_ocean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_name(spark, sf_dir, "ocean")


def dataset_air_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_name(spark, sf_dir, "air_quality")


def _extent(spark: SparkSession, sf_dir: str) -> tuple:
    e = bx.union(table(spark, sf_dir, "points").where(_OK).select(F.col("x").alias("xmin"), F.col("x").alias("xmax"), F.col("y").alias("ymin"), F.col("y").alias("ymax"))).first()
    return e.xmin - 1, e.ymin - 1, e.xmax + 1, e.ymax + 1


def dataset_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buildings that meet the points' extent, with the roof height over all their points."""
    held = registry.get("buildings")(spark, folder=sf_dir, bounds=_extent(spark, sf_dir))
    return held.select("building_id", F.round("roof", 4).alias("roof"))


def dataset_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.get("terrain_surface_mesh")(spark, folder=sf_dir, bounds=_extent(spark, sf_dir))


def dataset_flat_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.get("city_flat_mesh")(spark, folder=sf_dir, bounds=_extent(spark, sf_dir)).select("fid", "marker")


def dataset_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered dataset and its arguments."""
    rows = [(n, a, o["required"]) for n, d in registry.datasets().items() for a, o in d.options().items()]
    return spark.createDataFrame(rows, "dataset string, argument string, required boolean")


_ALL = (
    grid_neighbours, volume_lattice, grid_field, raster_tops, raster_gaussian, raster_of_mesh, burn_touched, mesh_sides, mesh_smooth, mesh_surfaces, facet_markers, tet_summary, ring_hulls, ring_triangles, ring_short_edges, line_measures, ring_distances,
    reproject_zones, reproject_rings, geometry_names, crown_segments, crown_radii, crown_polygons, trees_detected, city_flat_mesh, city_surface_mesh, city_volume_mesh, object_tree, object_attributes, object_geometries, object_json,
    dataset_hydrology, dataset_ocean, dataset_air_quality, dataset_buildings, dataset_terrain, dataset_flat_mesh, dataset_options,
)
QUERIES = {f.__name__: f for f in _ALL}

_MX = 'mx AS (SELECT max("row") AS mr, max(col) AS mc FROM d)'
_lon, _lat = crs.reproject("x", "y", 3006, 4326)
_wx, _wy = crs.reproject("lon", "lat", 4326, 3857)
_T = "t AS (SELECT DISTINCT tree_id, x, y FROM trees WHERE " + _OK + ")"
_UP = f"""{_GRID}, {_MX}, u AS (SELECT a."row", a.col, a."row"::BIGINT * (mc + 1) + a.col AS node, max(struct_pack(v := b.v, r := b."row", c := b.col)) AS m, any_value(mc + 1) AS w FROM d a CROSS JOIN mx JOIN d b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 WHERE a.v >= 0 AND b.v >= 0 GROUP BY 1, 2, 3),
  n AS (SELECT node, "row", col, m.r::BIGINT * w + m.c AS up FROM u),
  go(node, "row", col, here, up) AS (SELECT node, "row", col, node, up FROM n UNION ALL SELECT g.node, g."row", g.col, n.node, n.up FROM go g JOIN n ON n.node = g.up WHERE g.here != g.up),
  seg AS (SELECT "row", col, here AS top FROM go WHERE here = up)"""
_DATASET = lambda fields: f"WITH l AS (SELECT station_id, field, arg_max(struct_pack(value := CASE WHEN isnan(value) THEN NULL ELSE value END), struct_pack(a := ts, b := obs_id)) AS l FROM observations WHERE ts IS NOT NULL AND lon BETWEEN 12 AND 22 AND lat BETWEEN 56 AND 64 AND field IN ({', '.join(map(repr, fields))}) GROUP BY 1, 2), k AS (SELECT station_id FROM l WHERE l.value IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 20) SELECT station_id, field, l.value AS value FROM l WHERE station_id IN (SELECT station_id FROM k)"
_FACES = f"{_GRID}, {_F.replace(', f AS', ', fp AS')}, {_MX}, q AS (SELECT \"row\"::BIGINT * (mc + 1) + col AS q, mc + 1 AS w FROM d, mx WHERE \"row\" < mr AND col < mc), fc AS (SELECT q * 2 AS fid, q AS v0, q + w AS v1, q + 1 AS v2, w FROM q UNION ALL SELECT q * 2 + 1, q + 1, q + w, q + w + 1, w FROM q)"
_MARKED = f"""{_FACES}, no AS (SELECT building_id, (row_number() OVER (ORDER BY building_id) - 1)::INT AS number FROM fp),
  ct AS (SELECT fid, g.w * {CELL} + {CELL} * ((v0 % fc.w + v1 % fc.w + v2 % fc.w) / 3.0 + 0.5) AS x, g.n * {CELL} - {CELL} * ((v0 // fc.w + v1 // fc.w + v2 // fc.w) / 3.0 + 0.5) AS y FROM fc, g),
  i AS (SELECT fid, max(number) AS building FROM ct JOIN fp ON {_INSIDE} JOIN no USING (building_id) GROUP BY 1), co AS (SELECT fid, unnest([v0, v1, v2]) AS v FROM fc), ha AS (SELECT DISTINCT v FROM co JOIN i USING (fid)), be AS (SELECT DISTINCT fid FROM co JOIN ha USING (v)),
  mk AS (SELECT fc.fid, v0, v1, v2, coalesce(building, CASE WHEN be.fid IS NOT NULL THEN -1 ELSE -2 END) AS marker FROM fc LEFT JOIN i USING (fid) LEFT JOIN be USING (fid))"""
#: Of the datasets, only the boxes that meet the points' extent, a metre wider.
_NEAR = lambda text, f: text.replace(f"{f} AS (SELECT bounds_id", f"ext AS (SELECT min(x) - 1 AS e0, min(y) - 1 AS e1, max(x) + 1 AS e2, max(y) + 1 AS e3 FROM points WHERE {_OK}), {f} AS (SELECT bounds_id").replace("xmin, ymin, xmax, ymax FROM b)", "xmin, ymin, xmax, ymax FROM b, ext WHERE xmin <= e2 AND xmax >= e0 AND ymin <= e3 AND ymax >= e1)")
SQL = {
    "grid_neighbours": f"""WITH {_GRID}, {_MX}, v AS (SELECT "row"::BIGINT * (mc + 1) + col AS index, "row" AS r, col AS c FROM d, mx) SELECT a.index, (count(*) FILTER (abs(a.r - b.r) + abs(a.c - b.c) = 1))::INT AS sides, count(*)::INT AS "all", sum(b.index)::BIGINT AS total FROM v a JOIN v b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND a.index != b.index GROUP BY 1""",
    "volume_lattice": f"WITH {_GRID}, {_MX}, s AS (SELECT mc + 2 AS nx, mr + 2 AS ny FROM mx), i AS (SELECT unnest(range(nx * ny * 3)) AS vid, nx, ny FROM s) SELECT vid::BIGINT AS vid, (vid % nx * {CELL})::DOUBLE AS x, (vid // nx % ny * {CELL})::DOUBLE AS y, (5 + vid // (nx * ny) * 2.5)::DOUBLE AS z FROM i",
    "grid_field": f'WITH {_GRID}, {_MX} SELECT (mr - "row")::BIGINT * (mc + 1) + col AS index, v AS value FROM d, mx',
    "raster_tops": f"""WITH {_GRID} SELECT a."row", a.col, any_value(a.v) AS value FROM d a JOIN d b ON b."row" BETWEEN a."row" - 2 AND a."row" + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY 1, 2 HAVING any_value(a.v) = max(b.v) AND any_value(a.v) >= 0""",
    "raster_gaussian": f"""WITH {_GRID}, {_MX}, k AS (SELECT i, exp(-0.5 * i * i / 0.25) AS w FROM (VALUES (-2), (-1), (0), (1), (2)) t(i)), s AS (SELECT sum(w) AS s FROM k)
      SELECT a."row", a.col, round(sum(b.v * p.w * q.w) / any_value(s.s * s.s), 4) AS value FROM d a CROSS JOIN k p CROSS JOIN k q CROSS JOIN s CROSS JOIN mx
      JOIN d b ON b."row" = CASE WHEN a."row" + p.i < 0 THEN -1 - a."row" - p.i WHEN a."row" + p.i > mr THEN 2 * mr + 1 - a."row" - p.i ELSE a."row" + p.i END AND b.col = CASE WHEN a.col + q.i < 0 THEN -1 - a.col - q.i WHEN a.col + q.i > mc THEN 2 * mc + 1 - a.col - q.i ELSE a.col + q.i END GROUP BY 1, 2""",
    "raster_of_mesh": f"""WITH {_V}, g AS (SELECT floor(min(x) / 8)::INT AS w, floor(max(x) / 8)::INT AS e, floor(min(y) / 8)::INT AS s, floor(max(y) / 8)::INT AS n FROM v), ro AS (SELECT unnest(range(n - s + 1))::INT AS "row", e - w + 1 AS cols FROM g), cc AS (SELECT "row", unnest(range(cols))::INT AS col FROM ro),
      used AS (SELECT DISTINCT vid FROM (SELECT v0 AS vid FROM f UNION SELECT v1 FROM f UNION SELECT v2 FROM f)), h AS (SELECT floor(((g.n + 1) * 8 - y) / 8)::INT AS "row", floor((x - g.w * 8) / 8)::INT AS col, avg(z) AS value FROM v JOIN used USING (vid), g GROUP BY 1, 2)
      SELECT cc."row", cc.col, round(value, 4) AS value FROM cc LEFT JOIN h ON h."row" = cc."row" AND h.col = cc.col""",
    "burn_touched": f"""WITH {_GRID}, {_R} SELECT bounds_id, d."row", d.col FROM d, g, r WHERE least(r.xmax, g.w * {CELL} + {CELL} * (col + 1)) - greatest(r.xmin, g.w * {CELL} + {CELL} * col) > 1e-7 AND least(r.ymax, g.n * {CELL} - {CELL} * "row") - greatest(r.ymin, g.n * {CELL} - {CELL} * ("row" + 1)) > 1e-7""",
    "mesh_sides": f"WITH {_V}, e AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM v) SELECT 'east' AS side, vid FROM v, e WHERE x >= b - 40 UNION ALL SELECT 'west', vid FROM v, e WHERE x <= a + 40 UNION ALL SELECT 'north', vid FROM v, e WHERE y >= d - 40 UNION ALL SELECT 'south', vid FROM v, e WHERE y <= c + 40",
    "mesh_smooth": f"WITH {_V}, p AS (SELECT v0 AS a, v1 AS b FROM f UNION SELECT v1, v0 FROM f UNION SELECT v1, v2 FROM f UNION SELECT v2, v1 FROM f UNION SELECT v0, v2 FROM f UNION SELECT v2, v0 FROM f) SELECT a AS vid, round(avg(x), 5) AS x, round(avg(y), 5) AS y, round(avg(z), 5) AS z FROM p JOIN v ON vid = b GROUP BY 1",
    "mesh_surfaces": f"WITH {_TRI} SELECT fid, round(s, 4) AS area FROM t",
    "facet_markers": f"""WITH {_V}, b AS (SELECT v0, v1, v2 FROM (SELECT cid, v0, v1, v2 FROM c UNION ALL SELECT cid, v0, v1, v3 FROM c UNION ALL SELECT cid, v0, v2, v3 FROM c UNION ALL SELECT cid, v1, v2, v3 FROM c) GROUP BY v0, v1, v2 HAVING count(*) = 1),
      m AS (SELECT *, list_sort([v0 // 3 * 7 % 6 - 2, v1 // 3 * 7 % 6 - 2, v2 // 3 * 7 % 6 - 2]) AS t FROM b)
      SELECT v0, v1, v2, (CASE WHEN t[3] < 0 THEN CASE WHEN t[1] = -2 THEN -2 ELSE -1 END WHEN t[1] < 0 THEN -1 WHEN t[1] = t[3] THEN t[1] WHEN (t[1] = t[2] OR t[2] = t[3]) AND t[3] = t[1] + 2 THEN t[1] ELSE -1 END)::INT AS marker FROM m""",
    "ring_hulls": f"WITH {_R} SELECT bounds_id, 4 AS corners, round(w * h + 3.3e-7, 2) AS area FROM r",
    "ring_triangles": f"WITH {_R} SELECT bounds_id, 8 AS triangles, round(w * h * 0.75 + 3.3e-7, 2) AS area FROM r",
    "ring_short_edges": f"WITH {_R} SELECT bounds_id, 4 AS corners, round(xmin + 3, 3) AS x, round(ymin - 2, 3) AS y, 7.0::DOUBLE AS z FROM r",
    "line_measures": f"WITH {_R} SELECT bounds_id, round(w + h, 3) AS length, 2 AS surfaces, round(4 * (w + h) + 3.3e-7, 1) AS area FROM r",
    "ring_distances": f"WITH {_R} SELECT bounds_id, 5.0::DOUBLE AS outside, 0.0::DOUBLE AS inside FROM r",
    "reproject_zones": f"WITH {_T}, l AS (SELECT tree_id, x, y, {_lon} AS lon, {_lat} AS lat FROM t) SELECT tree_id, x AS x0, y AS y0, round({_wx}, 2) AS wx, round({_wy}, 2) AS wy, true AS same FROM l",
    "reproject_rings": f"WITH {_B}, c AS (SELECT bounds_id, unnest([0, 1, 2, 3]) AS k, unnest([xmin, xmax, xmax, xmin]) AS x, unnest([ymin, ymin, ymax, ymax]) AS y FROM b) SELECT bounds_id, k::INT AS k, round({_lon}, 7) AS lon, round({_lat}, 7) AS lat FROM c",
    "geometry_names": "SELECT * FROM (VALUES ('mesh', 'MESH'), (' Point-Cloud ', 'POINT_CLOUD'), ('volume mesh', 'VOLUME_MESH'), ('LOD1', 'LOD1'), ('cube', NULL), (NULL, NULL)) t(name, kind)",
    "crown_segments": f'WITH RECURSIVE {_UP} SELECT "row", col, top FROM seg',
    "crown_radii": f"WITH RECURSIVE {_UP} SELECT top, count(*) AS cells, round(sqrt(count(*) * {CELL} * {CELL} / 2), 4) AS radius FROM seg GROUP BY 1",
    "city_flat_mesh": f"WITH {_MARKED} SELECT fid, v0, v1, v2, marker FROM mk",
    "city_surface_mesh": f"WITH {_F} SELECT (row_number() OVER (ORDER BY building_id) - 1)::INT AS marker, 8 AS walls, round(48 * sqrt(hw * hw + hh * hh), 1) AS wall_area FROM f",
    "object_tree": f"WITH {_B}, o AS (SELECT 'city' AS path, 0 AS level, 'City city' AS line UNION ALL SELECT 'city/' || bounds_id, 1, '  Building ' || bounds_id FROM b UNION ALL SELECT 'city/' || bounds_id || '/part-' || bounds_id, 2, '    BuildingPart part-' || bounds_id FROM b) SELECT path, level::INT AS level, line FROM o",
    "object_attributes": f"WITH {_B} SELECT 'part-' || bounds_id AS object_id, (5 + length(bounds_id))::VARCHAR AS storeys FROM b",
    "object_geometries": f"WITH {_B} SELECT 'LOD1' AS geometry_type, count(*) AS n FROM b UNION ALL SELECT 'BOUNDS', count(*) FROM b WHERE xmax - xmin < 20",
    "object_json": f"WITH {_B} SELECT 'city' AS object_id, NULL AS geometry_type UNION ALL SELECT bounds_id, 'BOUNDS' FROM b UNION ALL SELECT 'part-' || bounds_id, NULL FROM b",
    "dataset_hydrology": _DATASET(("water_level", "water_discharge")),
    "dataset_ocean": _DATASET(("water_level", "air_pressure")),
    "dataset_air_quality": _DATASET(("pm10",)),
    "dataset_buildings": f"WITH {_NEAR(_F, 'f')}, p AS (SELECT DISTINCT point_id, x, y, z, classification FROM points WHERE {_OK}) SELECT building_id, round(quantile_cont(z, 0.9), 4) AS roof FROM f LEFT JOIN p ON {_INSIDE} AND z IS NOT NULL AND NOT isnan(z) AND coalesce(classification NOT IN (2, 9), true) GROUP BY 1",
    "dataset_terrain": f"WITH {_FACES} SELECT fid, v0, v1, v2 FROM fc",
    "dataset_flat_mesh": f"WITH {_NEAR(_MARKED, 'fp')} SELECT fid, marker FROM mk",
    "tet_summary": f"""WITH {_V}, t AS (SELECT cid, {_D("a", "b")} AS l0, {_D("a", "c4")} AS l1, {_D("a", "e")} AS l2, {_D("b", "c4")} AS l3, {_D("b", "e")} AS l4, {_D("c4", "e")} AS l5,
      abs((b.x - a.x) * ((c4.y - a.y) * (e.z - a.z) - (c4.z - a.z) * (e.y - a.y)) + (b.y - a.y) * ((c4.z - a.z) * (e.x - a.x) - (c4.x - a.x) * (e.z - a.z)) + (b.z - a.z) * ((c4.x - a.x) * (e.y - a.y) - (c4.y - a.y) * (e.x - a.x))) / 6 AS vol
      FROM c JOIN v a ON a.vid = v0 JOIN v b ON b.vid = v1 JOIN v c4 ON c4.vid = v2 JOIN v e ON e.vid = v3),
      q AS (SELECT 72 * sqrt(3) * vol / CASE WHEN s > 0 THEN pow(s, 1.5) ELSE 1 END AS quality, greatest(l0, l1, l2, l3, l4, l5) / CASE WHEN low > 0 THEN low ELSE 1 END AS edge_ratio FROM (SELECT *, l0 * l0 + l1 * l1 + l2 * l2 + l3 * l3 + l4 * l4 + l5 * l5 AS s, least(l0, l1, l2, l3, l4, l5) AS low FROM t))
      SELECT count(*) AS num_cells, round(min(quality), 4) AS quality_min, round(max(quality), 4) AS quality_max, round(avg(quality), 4) AS quality_mean, round(min(edge_ratio), 4) AS edge_ratio_min, round(max(edge_ratio), 4) AS edge_ratio_max, round(avg(edge_ratio), 4) AS edge_ratio_mean FROM q""",
    "crown_polygons": f"WITH RECURSIVE {_UP} SELECT top, round(count(*) * {CELL} * {CELL}) AS area FROM seg GROUP BY 1",
}
