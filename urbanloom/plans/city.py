"""A city as a bundle of tables, with the usual verbs; every verb gives a new bundle and plans nothing until asked."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.functions import geometry as geo
from urbanloom.functions import overlay, planar
from urbanloom.operators import cells, meshes, polygons, rasters, trees
from urbanloom.operators import points as pc
from urbanloom.plans.tables import numbered, written


@dataclass(frozen=True)
class City:
    """points (x, y, z, classification), buildings (building_id, ring), terrain (row, col, value) on grid, trees."""

    points: DataFrame | None = None
    buildings: DataFrame | None = None
    terrain: DataFrame | None = None
    grid: rasters.Grid | None = None
    trees: DataFrame | None = None

    def with_pointcloud(self, points: DataFrame, outliers: float = 3.0) -> City:
        """The cloud without global outliers beyond `outliers` deviations (0 keeps all)."""
        return replace(self, points=pc.global_outliers(points, outliers) if outliers > 0 else points)

    def with_footprints(self, buildings: DataFrame, least_area: float = 0.0) -> City:
        """Footprints of at least `least_area`, made counter-clockwise."""
        ring = geo.counter_clockwise(F.col("ring"))
        return replace(self, buildings=buildings.withColumn("ring", ring).where(geo.area(F.col("ring")) >= least_area))

    def build_terrain(self, cell_size: float = 2.0, fill: bool = True) -> City:
        """The elevation raster of the ground points, holes filled from the nearest cell."""
        grid = rasters.Grid.around(self.points, cell_size)
        cells = rasters.rasterize(self.points, grid).select("row", "col", "value")
        return replace(self, terrain=rasters.fill_holes(cells, grid.rows * grid.cols) if fill else cells, grid=grid)

    def building_heights(self, percentile: float = 0.9, least: float = 2.5, outliers: tuple[int, float] | None = (5, 1.5)) -> City:
        """Buildings with ground_height, roof and height, from roof points over the terrain, without each roof's `outliers` (neighbours, margin; None keeps all)."""
        held = self if self.terrain is not None else self.build_terrain()
        centre = held.buildings.select("building_id", geo.vertex_mean(F.col("ring")).alias("c")).select("building_id", "c.*")
        ground = rasters.sample(centre, held.terrain, held.grid)
        heights = polygons.building_heights(held.buildings, held.points, ground, percentile, least, outliers)
        return replace(held, buildings=held.buildings.join(heights, "building_id"))

    def build_lod1(self, default_ground: float = 0.0) -> City:
        """Buildings with lod1: the surfaces of a block from the ground to the roof."""
        held = self if "height" in self.buildings.columns else self.building_heights()
        ground = F.coalesce(F.col("ground_height"), F.lit(default_ground))
        return replace(held, buildings=held.buildings.withColumn("lod1", geo.extrude(F.col("ring"), ground, ground + F.col("height"))))

    def build_trees(self, kind: str = "urban") -> City:
        """Trees (x, y, z, height, crown_radius) from the vegetation of the cloud over the terrain, outside the footprints."""
        held = self if self.terrain is not None else self.build_terrain()
        heights = written(trees.canopy_model(held.points, held.terrain, held.grid, kind, held.buildings), "canopy")
        return replace(held, trees=trees.trees_of(heights, held.terrain, held.grid, kind))

    def terrain_mesh(self) -> tuple[DataFrame, DataFrame]:
        """vertices (vid, x, y, z at the cell centres) and faces (fid, v0, v1, v2; two a quad) of the terrain."""
        held = self if self.terrain is not None else self.build_terrain()
        g = held.grid
        vertices = held.terrain.select((F.col("row").cast("bigint") * g.cols + F.col("col")).alias("vid"), g.x(F.col("col")).alias("x"), g.y(F.col("row")).alias("y"), F.col("value").alias("z"))
        return vertices, cells.grid_triangles(g.rows, g.cols, held.terrain)

    def flat_mesh(self) -> tuple[DataFrame, DataFrame]:
        """The terrain mesh at z = 0, its faces with marker: the footprint's number (by building_id, from 0; the last of several) that holds the centre, -1 beside one, else -2."""
        vertices, faces = self.terrain_mesh()
        numbers = numbered(self.buildings.select("building_id"), ["building_id"], "number")
        centres = meshes.with_corners(faces, vertices).select("fid", *(((F.col(f"v0_{c}") + F.col(f"v1_{c}") + F.col(f"v2_{c}")) / 3).alias(c) for c in "xy"))
        inside = polygons.points_in_polygons(centres, self.buildings, "building_id").join(numbers, "building_id").groupBy("fid").agg(F.max("number").cast("int").alias("building"))
        return vertices.withColumn("z", F.lit(0.0)), faces.join(meshes.domain_markers(faces, inside), "fid")

    def surface_mesh(self) -> DataFrame:
        """marker, ring (three corners) of the triangles of the city: terrain with the flat mesh's markers, and the walls and roofs of the LoD1 blocks with the building's number."""
        held = self if self.buildings is not None and "lod1" in self.buildings.columns else self.build_lod1()
        _, faces = held.flat_mesh()
        vertices, _ = held.terrain_mesh()
        ground = meshes.to_surfaces(faces, vertices).join(faces.select("fid", "marker"), "fid").select("marker", "ring")
        numbers = numbered(held.buildings.select("building_id"), ["building_id"], "number")
        fan = lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - 2), lambda k: F.array(r[0], F.get(r, k), F.get(r, k + 1)))
        flat = planar.meshed(overlay.as_polygon(F.transform("ring", lambda p: geo.point(p.x, p.y))))
        blocks = held.buildings.join(numbers, "building_id").select(F.col("number").cast("int").alias("marker"), "lod1", flat.alias("_roof"), (F.coalesce("ground_height", F.lit(0.0)) + F.col("height")).alias("_top"))
        walls = blocks.select("marker", F.explode(F.slice("lod1", 3, F.size("lod1"))).alias("w")).select("marker", F.explode(fan(F.col("w"))).alias("ring"))
        roofs = blocks.select("marker", "_top", F.explode("_roof").alias("r")).select("marker", F.transform("r", lambda p: geo.point(p.x, p.y, F.col("_top"))).alias("ring"))
        return ground.unionByName(walls).unionByName(roofs)

    def volume_mesh(self, top: float = 100.0, layers: int = 4) -> tuple[DataFrame, DataFrame]:
        """Vertices and tetrahedra (cid, v0..v3) of the air above the terrain up to `top` above its highest cell, in layers of
        columns; cells whose centre lies in a building below its roof are left out."""
        held = self if self.buildings is not None and "height" in self.buildings.columns else self.building_heights()
        held = replace(held, terrain=written(held.terrain, "terrain"))  # every corner reads it, so it isn't worked out again each time
        vertices, faces = held.terrain_mesh()
        count = held.grid.rows * held.grid.cols
        high = (vertices.agg(F.max("z")).first()[0] or 0.0) + top
        lift = lambda z, k: z + (high - z) * k / layers
        level = vertices.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(layers))))
        lifted = level.select((F.col("vid") + F.col("k").cast("bigint") * count).alias("vid"), "x", "y", lift(F.col("z"), F.col("k")).alias("z"))
        tets = meshes.layers(faces, layers, count)
        roofs = held.buildings.select("building_id", (F.coalesce("ground_height", F.lit(0.0)) + F.col("height")).alias("_top"))
        # the layers of a column share their places in plan, so places meet the buildings, and only what is in one is lifted
        under = polygons.points_in_polygons(meshes.prism_places(faces, vertices), held.buildings, "building_id").join(roofs, "building_id")
        each = under.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))))
        inside = each.where(meshes.prism_height(lift) < F.col("_top")).select(meshes.prism_cell(layers).alias("cid")).distinct()
        return lifted, meshes.trimmed(tets, lifted, written(inside, "inside"))

    def with_terrain(self, terrain: DataFrame, grid: rasters.Grid) -> City:
        """The city with a raster of its own (row, col, value)."""
        return replace(self, terrain=terrain, grid=grid)

    def add_flat_terrain(self, level: float | None = None, margin: float = 0.0) -> City:
        """One cell over the box of the points and a margin, at `level`, the lowest point if None."""
        usable = self.points.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz"))
        b = usable.agg(*(f(c).alias(f"{c}{n}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max")))).first()
        if b.xmin is None:
            raise ValueError("the city has no points to lay a terrain under")
        cells_, grid = rasters.flat(self.points.sparkSession, b.zmin if level is None else level, b.xmin - margin, b.ymin - margin, b.xmax + margin, b.ymax + margin)
        return replace(self, terrain=cells_, grid=grid)

    def remove_outside_terrain(self) -> City:
        """The buildings whose box lies inside the terrain."""
        g, box = self.grid, geo.box_of(F.col("ring"))
        inside = (box.xmin >= g.west) & (box.xmax <= g.west + g.cols * g.size) & (box.ymax <= g.north) & (box.ymin >= g.north - g.rows * g.size)
        return replace(self, buildings=self.buildings.where(inside))


def objects(rows: DataFrame) -> dict[str, DataFrame]:
    """Views of an object table (object_id, parent_id, type, attributes as JSON): roots, and children with their parent's type."""
    parent = rows.select(F.col("object_id").alias("_id"), F.col("type").alias("parent_type"))
    return {"roots": rows.where("parent_id IS NULL"), "children": rows.where("parent_id IS NOT NULL").join(parent, F.col("parent_id") == F.col("_id"), "left").drop("_id")}


def child_attribute(rows: DataFrame, kind: str, name: str, default: str | None = None) -> DataFrame:
    """object_id and an attribute of the objects of a type, `default` where it's missing."""
    return rows.where(F.col("type") == kind).select("object_id", F.coalesce(F.get_json_object("attributes", f"$.{name}"), F.lit(default)).alias(name))


def flatten(rows: DataFrame, geometries: DataFrame, kind: str) -> DataFrame:
    """The geometries of a kind of every object and its direct children, under the parent's id: object_id, owner, geometry."""
    own = geometries.where(F.col("geometry_type") == kind).select(F.col("object_id").alias("owner"), "geometry")
    family = rows.select(F.col("object_id"), F.col("object_id").alias("owner")).union(rows.where("parent_id IS NOT NULL").select("parent_id", "object_id"))
    return family.join(own, "owner").select("object_id", "owner", "geometry")


# the tree of objects: rows of (object_id, parent_id, type, attributes), geometries of (object_id, geometry_type, geometry), fields of (object_id, geometry_type, name, ...)


def add_children(rows: DataFrame, children: DataFrame, parent: Column | str) -> DataFrame:
    """`rows` with more objects under a parent (a column of `children`, or one id)."""
    under = parent if isinstance(parent, Column) else F.lit(parent)
    return rows.unionByName(children.withColumn("parent_id", under).select(*rows.columns))


def children_of(rows: DataFrame, kind: str) -> DataFrame:
    """The objects of a type that have a parent."""
    return rows.where((F.col("type") == kind) & F.col("parent_id").isNotNull())


def set_child_attribute(rows: DataFrame, kind: str, name: str, values: DataFrame) -> DataFrame:
    """`rows` with an attribute of the children of a type set from `values` (object_id, value); the others stay as they are."""
    held = rows.join(values.select("object_id", F.col("value").alias("_value")), "object_id", "left")
    known = F.from_json(F.coalesce("attributes", F.lit("{}")), "map<string,string>")
    changed = F.to_json(F.map_concat(F.map_filter(known, lambda k, v: k != name), F.create_map(F.lit(name), F.col("_value").cast("string"))))
    due = (F.col("type") == kind) & F.col("parent_id").isNotNull() & F.col("_value").isNotNull()
    return held.withColumn("attributes", F.when(due, changed).otherwise(F.col("attributes"))).select(*rows.columns)


def add_geometry(geometries: DataFrame, new: DataFrame) -> DataFrame:
    """Geometries with more of them; a new one of an object replaces its old one of the type."""
    return geometries.join(new.select("object_id", "geometry_type"), ["object_id", "geometry_type"], "left_anti").select(*geometries.columns).unionByName(new.select(*geometries.columns))


def remove_geometry(geometries: DataFrame, kind: str, ids: DataFrame | None = None) -> DataFrame:
    """Geometries without those of a type, of the objects in `ids` only if given."""
    gone = geometries.where(F.col("geometry_type") == kind)
    gone = gone if ids is None else gone.join(ids.select("object_id"), "object_id", "left_semi")
    return geometries.join(gone.select("object_id", "geometry_type"), ["object_id", "geometry_type"], "left_anti").select(*geometries.columns)


def add_fields(fields: DataFrame, new: DataFrame, geometries: DataFrame) -> DataFrame:
    """Fields with more of them, for geometries that exist."""
    return fields.unionByName(new.join(geometries.select("object_id", "geometry_type"), ["object_id", "geometry_type"], "left_semi").select(*fields.columns))


def tree_lines(rows: DataFrame, most_levels: int = 32) -> DataFrame:
    """path (ids from the root), level and line (indented type and id) of every object below a root, to be sorted by path. Deeper trees raise."""
    level = written(rows.where("parent_id IS NULL").select("object_id", F.array("object_id").alias("path"), "type"), "level")
    out = level
    for _ in range(most_levels):
        below = rows.where("parent_id IS NOT NULL").select(F.col("object_id").alias("_id"), F.col("parent_id").alias("_parent"), F.col("type").alias("_type"))
        level = written(level.join(below, F.col("object_id") == F.col("_parent")).select(F.col("_id").alias("object_id"), F.concat("path", F.array("_id")).alias("path"), F.col("_type").alias("type")), "level")
        if level.limit(1).count() == 0:
            return out.select(F.array_join("path", "/").alias("path"), (F.size("path") - 1).alias("level"), F.concat(F.repeat(F.lit("  "), F.size("path") - 1), "type", F.lit(" "), "object_id").alias("line"))
        out = out.unionByName(level)
    raise RuntimeError(f"more than {most_levels} levels")


def to_json(rows: DataFrame, geometries: DataFrame) -> DataFrame:
    """object_id and one JSON text of every object: id, parent, type, attributes, geometry by type (as JSON)."""
    held = geometries.select("object_id", F.struct("geometry_type", F.col("geometry")).alias("g")).groupBy("object_id").agg(F.map_from_entries(F.array_sort(F.collect_list("g"))).alias("geometry"))  # as many as there are kinds
    whole = rows.join(held, "object_id", "left")
    return whole.select("object_id", F.to_json(F.struct(F.col("object_id").alias("id"), F.col("parent_id").alias("parent"), "type", "attributes", "geometry")).alias("json"))


def from_json(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The objects and geometries (as JSON text) of `to_json`."""
    held = texts.select(F.from_json("json", "id string, parent string, type string, attributes string, geometry map<string,string>").alias("o")).select("o.*")
    rows = held.select(F.col("id").alias("object_id"), F.col("parent").alias("parent_id"), "type", "attributes")
    return rows, held.select(F.col("id").alias("object_id"), F.explode("geometry").alias("geometry_type", "geometry"))
