"""Formats as tables, registered by suffix for load() and save() of sources.files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanloom.operators.points import Box
from urbanloom.operators.rasters import Grid
from urbanloom.sources import codecs, grids, lidar, packages, vectors
from urbanloom.sources.files import READERS, WRITERS, read_files, write_files

#: Cells along a side of a written raster file, points of a written point file.
BLOCK, POINTS_A_FILE = 512, 1_000_000

# rasters

_CELLS = pa.schema([("row", pa.int32()), ("col", pa.int32()), ("band", pa.int32()), ("value", pa.float64()), ("west", pa.float64()), ("north", pa.float64()), ("size", pa.float64())])
_CELL_SHAPE = "row int, col int, band int, value double, west double, north double, size double"


def _cells(values: np.ndarray, west: float, north: float, size: float, nodata: float | None) -> pa.Table:
    row, col, band = np.indices(values.shape)
    flat = values.ravel().astype(float)
    gone = np.isnan(flat) | (flat == nodata if nodata is not None else False)
    same = lambda v: pa.array(np.full(len(flat), v))
    return pa.Table.from_arrays([pa.array(row.ravel(), pa.int32()), pa.array(col.ravel(), pa.int32()), pa.array(band.ravel(), pa.int32()), pa.array(flat, mask=gone), same(float(west)), same(float(north)), same(float(size))], schema=_CELLS)


def _from_tiff(data: bytes) -> pa.Table:
    t = codecs.decode_tiff(data)
    return _cells(t["values"], t["west"], t["north"], t["size"], t["nodata"])


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """file, row, col, band, value (nodata is NULL), and the file's corner and cell size, of one or many GeoTIFF files."""
    return read_files(spark, path, "*.{tif,tiff,geotif}", _from_tiff, _CELLS, _CELL_SHAPE)


def read_png(spark: SparkSession, path: str) -> DataFrame:
    """The same of PNG images, whose corner is (0, 0) and whose cells are 1 wide."""
    return read_files(spark, path, "*.png", lambda data: _cells(codecs.decode_png(data), 0.0, 0.0, 1.0, None), _CELLS, _CELL_SHAPE)


def read_matrix(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """file, row, col, value of matrices as text, without a georeference."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("file"), F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("row", "line"))
    return lines.select("file", "row", F.posexplode(F.split("line", f"\\Q{delimiter}\\E")).alias("col", "v")).select("file", "row", "col", F.trim("v").try_cast("double").alias("value"))


def on_grid(cells: DataFrame, grid: Grid) -> DataFrame:
    """file, row, col (of `grid`), band, value of the cells of georeferenced files: what lies outside is left out."""
    x = F.col("west") + (F.col("col") + 0.5) * F.col("size")
    y = F.col("north") - (F.col("row") + 0.5) * F.col("size")
    held = cells.select("file", grid.row(y).alias("row"), grid.col(x).alias("col"), "band", "value")
    return held.where(F.col("row").between(0, grid.rows - 1) & F.col("col").between(0, grid.cols - 1))


def _blocks(cells: DataFrame, grid: Grid) -> DataFrame:
    number = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    return cells.select(number("row").alias("down"), number("col").alias("across"), "row", "col", "value")


def _matrix(t: pa.Table, nodata: float) -> tuple[np.ndarray, int, int]:
    row, col = t.column("row").to_numpy(), t.column("col").to_numpy()
    out = np.full((row.max() - row.min() + 1, col.max() - col.min() + 1), nodata)
    out[row - row.min(), col - col.min()] = np.nan_to_num(t.column("value").to_numpy(zero_copy_only=False).astype(float), nan=nodata)
    return out, int(row.min()), int(col.min())


def write_tiff(cells: DataFrame, folder: str, grid: Grid, epsg: int | None = None, nodata: float = -9999.0) -> DataFrame:
    """One GeoTIFF per block of cells (row, col, value): path, n when acted on."""

    def encode(t: pa.Table) -> bytes:
        values, row, col = _matrix(t, nodata)
        return codecs.encode_tiff(values, grid.west + col * grid.size, grid.north - row * grid.size, grid.size, epsg, nodata)

    return write_files(_blocks(cells, grid), ["down", "across"], folder, "tif", encode)


def write_png(cells: DataFrame, folder: str, grid: Grid) -> DataFrame:
    """One grey PNG per block; values are cut to whole numbers from 0, NULL is 0."""
    return write_files(_blocks(cells, grid), ["down", "across"], folder, "png", lambda t: codecs.encode_png(np.maximum(_matrix(t, 0.0)[0], 0).astype(np.int64)))


def world_file(grid: Grid, row: int = 0, col: int = 0) -> str:
    """The six lines beside an image whose first cell is (row, col) of the grid."""
    return "\n".join(repr(float(v)) for v in (grid.size, 0.0, 0.0, -grid.size, grid.west + (col + 0.5) * grid.size, grid.north - (row + 0.5) * grid.size)) + "\n"


# meshes

_MESH = pa.schema([("part", pa.string()), ("id", pa.int64()), *((c, pa.float64()) for c in "xyz"), *((f"v{k}", pa.int64()) for k in range(4))])
_MESH_SHAPE = "part string, id bigint, x double, y double, z double, v0 bigint, v1 bigint, v2 bigint, v3 bigint"


def _mesh_table(vertices: np.ndarray, cells: np.ndarray) -> pa.Table:
    n, m = len(vertices), len(cells)
    none = lambda size, kind: pa.nulls(size, kind)
    corner = lambda k: pa.concat_arrays([none(n, pa.int64()), pa.array(cells[:, k], pa.int64()) if k < cells.shape[1] else none(m, pa.int64())])
    return pa.Table.from_arrays([pa.array(["v"] * n + ["c"] * m, pa.string()), pa.array([*range(n), *range(m)], pa.int64()), *(pa.concat_arrays([pa.array(vertices[:, k], pa.float64()), none(m, pa.float64())]) for k in range(3)), *(corner(k) for k in range(4))], schema=_MESH)


def _mesh_reader(glob: str, decode, corners: int = 3):  # noqa: ANN001, ANN202
    def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
        held = read_files(spark, path, glob, lambda data: _mesh_table(*decode(data)[:2]), _MESH, _MESH_SHAPE)
        names = [f"v{k}" for k in range(corners)]
        return held.where("part = 'v'").select("file", F.col("id").alias("vid"), "x", "y", "z"), held.where("part = 'c'").select("file", F.col("id").alias("fid" if corners == 3 else "cid"), *names)

    return read


def _from_stl(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    corners = grids.decode_stl(data).reshape(-1, 3)
    return corners, np.arange(len(corners)).reshape(-1, 3)


def _from_obj(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    vertices, faces = [], []
    for line in data.decode(errors="replace").splitlines():
        w = line.split()
        if w[:1] == ["v"]:
            vertices.append([float(v) for v in w[1:4]])
        elif w[:1] == ["f"]:
            own = [int(c.split("/")[0]) for c in w[1:]]
            own = [c - 1 if c > 0 else len(vertices) + c for c in own]
            faces += [[own[0], own[k], own[k + 1]] for k in range(1, len(own) - 1)]
    return np.array(vertices, float).reshape(-1, 3), np.array(faces, np.int64).reshape(-1, 3)


def _to_obj(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    return "".join([*(f"v {x!r} {y!r} {z!r}\n" for x, y, z in vertices.tolist()), *(f"f {a + 1} {b + 1} {c + 1}\n" for a, b, c in faces.tolist())]).encode()


def write_meshes(mesh: tuple[DataFrame, DataFrame], folder: str, encode, suffix: str) -> DataFrame:  # noqa: ANN001
    """One file per `file` of vertices (file, vid, x, y, z) and cells (file, fid or cid, v0 to v2 or v3), numbered by vid: path, n when acted on."""
    vertices, cells = mesh
    corners = [c for c in ("v0", "v1", "v2", "v3") if c in cells.columns]
    v = vertices.select("file", F.lit(0).alias("part"), F.col("vid").alias("id"), "x", "y", "z", *(F.lit(None).cast("bigint").alias(c) for c in corners))
    f = cells.select("file", F.lit(1).alias("part"), F.col("cid" if "v3" in corners else "fid").alias("id"), *(F.lit(None).cast("double").alias(c) for c in "xyz"), *corners)

    def one(t: pa.Table) -> bytes:
        t = t.sort_by([("part", "ascending"), ("id", "ascending")])
        first = t.filter(pa.compute.equal(t.column("part"), 0))
        rest = t.filter(pa.compute.equal(t.column("part"), 1))
        ids = first.column("id").to_numpy()
        at = np.column_stack([first.column(c).to_numpy() for c in "xyz"]) if len(ids) else np.zeros((0, 3))
        own = np.column_stack([np.searchsorted(ids, rest.column(c).to_numpy()) for c in corners]) if rest.num_rows else np.zeros((0, len(corners)), np.int64)
        return encode(at, own)

    return write_files(v.unionByName(f), ["file"], folder, suffix, one)


def mesh_as_buildings(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """component (its least vertex), fid, ring of every face: connected parts of a mesh are buildings, their faces its surfaces."""
    from urbanloom.operators.graphs import connected_components
    from urbanloom.operators.meshes import to_surfaces

    edges = faces.select(F.inline(F.array(*(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("v0", "v1"), ("v1", "v2"))))))
    parts = connected_components(edges)
    owner = faces.select("fid", F.col("v0").alias("node")).join(parts, "node").select("component", "fid")
    return owner.join(to_surfaces(faces, vertices), "fid").select("component", "fid", "ring")


# points


def write_las_files(points: DataFrame, folder: str, points_a_file: int = POINTS_A_FILE) -> DataFrame:
    """LAS files of about `points_a_file` points of every cloud, with class, intensity and returns (NULL: class 1, else 0): path, n when acted on."""
    usable = points.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz"))
    size = usable.groupBy("cloud_id").agg(F.greatest(F.ceil(F.count("*") / points_a_file), F.lit(1)).alias("_parts"))
    held = usable.join(size, "cloud_id").withColumn("part", F.pmod(F.xxhash64("point_id"), F.col("_parts")).cast("int"))
    columns = ["x", "y", "z", "classification", "intensity", "return_number", "num_returns"]

    def encode(t: pa.Table) -> bytes:
        c = {n: np.nan_to_num(t.column(n).to_numpy(zero_copy_only=False).astype(float), nan=1.0 if n == "classification" else 0.0) for n in columns}
        return lidar.encode(c["x"], c["y"], c["z"], c["classification"], c["intensity"], (c["return_number"], c["num_returns"]))

    return write_files(held.select("cloud_id", "part", *columns), ["cloud_id", "part"], folder, "las", encode)


_MESSAGE = pa.schema([*((c, pa.float64()) for c in "xyz"), *((c, pa.int32()) for c in ("classification", "intensity", "return_number", "num_returns"))])


def _from_message(data: bytes) -> pa.Table:
    at, attributes = codecs.decode_message(data)
    own = lambda n: pa.array(attributes[n], pa.int32()) if len(attributes.get(n, ())) == len(at) else pa.nulls(len(at), pa.int32())
    return pa.Table.from_arrays([*(pa.array(at[:, k]) for k in range(3)), *(own(n) for n in _MESSAGE.names[3:])], schema=_MESSAGE)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """file, x, y, z and attributes (NULL where absent) of point-cloud messages; positions have single precision."""
    return read_files(spark, path, "*.pb", _from_message, _MESSAGE, "x double, y double, z double, classification int, intensity int, return_number int, num_returns int")


def write_messages(points: DataFrame, folder: str) -> DataFrame:
    """One message per cloud; an attribute is written where all points have it."""
    def encode(t: pa.Table) -> bytes:
        whole = {n: t.column(n).to_numpy() for n in _MESSAGE.names[3:] if t.column(n).null_count == 0}
        return codecs.encode_message(np.column_stack([t.column(c).to_numpy() for c in "xyz"]), whole)

    return write_files(points.select("cloud_id", *_MESSAGE.names), ["cloud_id"], folder, "pb", encode)


def read_points_las(spark: SparkSession, path: str | list[str], box: Box | None = None, points_only: bool = False, classification_only: bool = False) -> DataFrame:
    """Points of LAS files: positions only, or with the class only, or with all attributes."""
    held = lidar.read_las(spark, path, box)
    kept = ["cloud_id", "point_id", "x", "y", "z", *([] if points_only else ["classification"])]
    return held.select(*kept) if points_only or classification_only else held


def read_points_text(spark: SparkSession, path: str | list[str], delimiter: str = ",", box: Box | None = None, points_only: bool = False) -> DataFrame:
    """x, y, z, class (1 where missing) of delimited text; a line with fewer than three numbers fails the job."""
    raw = spark.read.text(path).where("trim(value) != ''").select(F.split("value", f"\\Q{delimiter}\\E").alias("f"), "value")
    number = lambda k: F.trim(F.get("f", F.lit(k))).try_cast("double")
    known = number(0).isNotNull() & number(1).isNotNull() & number(2).isNotNull()
    x = F.when(known, number(0)).otherwise(F.raise_error(F.concat(F.lit("not a point: "), F.substring("value", 1, 80))).cast("double"))
    held = raw.select(x.alias("x"), number(1).alias("y"), number(2).alias("z"), F.coalesce(F.trim(F.get("f", F.lit(3))).try_cast("smallint"), F.lit(1).cast("smallint")).alias("classification"))
    held = held if box is None else held.where(box.holds(F.col("x"), F.col("y")))
    return held.drop("classification") if points_only else held


def write_points_text(points: DataFrame, path: str) -> None:
    """x,y,z,class lines."""
    points.select(F.concat_ws(",", *(F.col(c).cast("string") for c in ("x", "y", "z")), F.coalesce(F.col("classification"), F.lit(1)).cast("string")).alias("value")).write.text(path)


# CityJSON


def surfaces_of(chosen: DataFrame, vertices: DataFrame) -> DataFrame:
    """object_id, surface (from 0), ring (x, y, z; shells only) of the geometries of vectors.preferred_geometry; of a solid the first shell counts, other kinds than surfaces and solids have none."""
    deep = F.get(F.from_json("boundaries", "array<array<array<array<int>>>>"), F.lit(0))
    flat = F.from_json("boundaries", "array<array<array<int>>>")
    held = chosen.withColumn("_s", F.when(F.col("kind") == "Solid", deep).when(F.col("kind").endswith("Surface"), flat))
    rings = held.select("object_id", F.posexplode("_s").alias("surface", "_r")).select("object_id", "surface", F.posexplode(F.get("_r", F.lit(0))).alias("pos", "vid"))
    placed = rings.join(vertices, "vid").groupBy("object_id", "surface").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))).alias("_p"))  # one ring
    return placed.select("object_id", "surface", F.transform("_p", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), p.z.alias("z"))).alias("ring"))


def tin_mesh(chosen: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vertices (object_id, vid from 0 by old number, x, y, z) and faces (object_id, fid, v0, v1, v2) of triangulated reliefs."""
    faces = chosen.select("object_id", F.posexplode(F.from_json("boundaries", "array<array<array<int>>>")).alias("fid", "_t")).select("object_id", "fid", *(F.col("_t")[0][k].alias(f"_v{k}") for k in range(3)))
    used = faces.select("object_id", F.explode(F.array("_v0", "_v1", "_v2")).alias("old")).distinct()
    place = F.row_number().over(Window.partitionBy("object_id").orderBy("old")) - 1
    numbered = used.withColumn("vid", place)
    for k in range(3):
        faces = faces.join(numbered.select("object_id", F.col("old").alias(f"_v{k}"), F.col("vid").alias(f"v{k}")), ["object_id", f"_v{k}"])
    return numbered.join(vertices.withColumnRenamed("vid", "old"), "old").select("object_id", "vid", "x", "y", "z"), faces.select("object_id", "fid", "v0", "v1", "v2")


def cityjson(surfaces: DataFrame, scale: float = 0.001, kind: str = "Building", lod: str = "1") -> DataFrame:
    """One row, one CityJSON 2.0 text of surfaces (object_id, surface, ring): vertices are quantised by `scale` and shared, in
    the order of first use. A file is one text; for a whole country write one per tile."""
    whole = lambda c: F.rint(c / scale).cast("bigint")
    corners = surfaces.select("object_id", "surface", F.posexplode("ring").alias("pos", "p")).select("object_id", "surface", "pos", F.struct(whole(F.col("p.x")).alias("x"), whole(F.col("p.y")).alias("y"), whole(F.col("p.z")).alias("z")).alias("q"))
    seen = corners.groupBy("q").agg(F.min(F.struct("object_id", "surface", "pos")).alias("first"))
    from urbanloom.plans.tables import numbered

    index = numbered(seen.select("q", "first.*"), ["object_id", "surface", "pos"], "vid").select("q", "vid")
    rings = corners.join(index, "q").groupBy("object_id", "surface").agg(F.array(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vid"))), lambda p: p.vid)).alias("shell"))
    bodies = rings.groupBy("object_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("surface", "shell"))), lambda s: s.shell).alias("boundaries"))
    one = F.struct(F.lit(kind).alias("type"), F.array(F.struct(F.lit("MultiSurface").alias("type"), F.lit(lod).alias("lod"), "boundaries")).alias("geometry"))
    objects = bodies.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("object_id", one.alias("o"))))).alias("CityObjects"))
    points = index.agg(F.transform(F.array_sort(F.collect_list(F.struct("vid", "q"))), lambda v: F.array(v.q.x, v.q.y, v.q.z)).alias("vertices"))
    head = F.struct(F.array(*(F.lit(scale),) * 3).alias("scale"), F.array(*(F.lit(0.0),) * 3).alias("translate"))
    return objects.join(points, F.lit(True)).select(F.to_json(F.struct(F.lit("CityJSON").alias("type"), F.lit("2.0").alias("version"), head.alias("transform"), "CityObjects", "vertices")).alias("value"))


# stations


def _rows_of(decode, fields: list[tuple[str, str]]):  # noqa: ANN001, ANN202
    shape = ", ".join(f"{n} {k}" for n, k in fields)

    def rows(text: Column) -> Column:
        @F.udf(f"array<struct<{', '.join(f'{n}:{k}' for n, k in fields)}>>", useArrow=True)
        def run(value):  # noqa: ANN001, ANN202
            return [tuple(r[n] for n, _ in fields) for r in decode(value)] if value else []

        return run(text)

    return rows, shape


_HOUR = [("station_id", "string"), ("name", "string"), ("lat", "double"), ("lon", "double"), ("height", "double"), ("value", "double"), ("quality", "string"), ("timestamp", "string")]
_DAY = [("key", "string"), ("name", "string"), ("lat", "double"), ("lon", "double"), ("date", "bigint"), ("value", "double")]
_SERIES = [("id", "string"), ("timestamp", "bigint"), ("value", "double"), ("unit", "string")]


def latest_hour(texts: DataFrame, height: bool = True) -> DataFrame:
    """parameter and the stations of every latest-hour CSV (parameter, value)."""
    return texts.select("parameter", F.inline(_rows_of(lambda t: codecs.decode_latest_hour(t, height), _HOUR)[0](F.col("value"))))


def day_series(texts: DataFrame, active_only: bool = True) -> DataFrame:
    """The stations and last values of hydrology answers (value)."""
    return texts.select(F.inline(_rows_of(lambda t: codecs.decode_day_series(t, active_only), _DAY)[0](F.col("value"))))


def series(texts: DataFrame, phenomenon: str | None = None) -> DataFrame:
    """The last values of air-quality answers (value)."""
    return texts.select(F.inline(_rows_of(lambda t: codecs.decode_series(t, phenomenon), _SERIES)[0](F.col("value"))))


READERS.add("point_cloud", "las", read_points_las)
READERS.add("point_cloud", "csv xyz txt", read_points_text)
READERS.add("point_cloud", "pb", read_messages)
READERS.add("raster", "tif tiff geotif", read_tiff)
READERS.add("raster", "png", read_png)
READERS.add("raster", "asc", grids.read_asc)
READERS.add("raster", "csv txt", read_matrix)
READERS.add("footprints", "geojson json", vectors.read_geojson_polygons)
READERS.add("footprints", "shp", vectors.read_shp)
READERS.add("footprints", "gpkg", packages.read_gpkg_polygons)
READERS.add("landuse", "geojson json", vectors.read_geojson_polygons)
READERS.add("landuse", "shp", vectors.read_shp)
READERS.add("roads", "geojson json", vectors.read_geojson_lines)
READERS.add("city", "json", vectors.read_cityjson)
for _suffix, _decode in (("obj", _from_obj), ("stl", _from_stl), ("ply", codecs.decode_ply), ("vtk", lambda data: codecs.decode_vtk(data, 3)), ("gltf", codecs.decode_gltf), ("xdmf", codecs.decode_xdmf)):
    READERS.add("mesh", _suffix, _mesh_reader(f"*.{_suffix}", _decode))
for _suffix, _decode in (("vtk", lambda data: codecs.decode_vtk(data, 4)), ("xdmf", codecs.decode_xdmf)):
    READERS.add("volume_mesh", _suffix, _mesh_reader(f"*.{_suffix}", _decode, 4))
WRITERS.add("point_cloud", "las", write_las_files)
WRITERS.add("point_cloud", "csv xyz txt", write_points_text)
WRITERS.add("point_cloud", "pb", write_messages)
WRITERS.add("raster", "tif tiff geotif", write_tiff)
WRITERS.add("raster", "png", write_png)
for _kind, _suffix, _encode in (("mesh", "obj", _to_obj), ("mesh", "ply", codecs.encode_ply), ("mesh", "vtk", codecs.encode_vtk), ("mesh", "gltf", codecs.encode_gltf), ("mesh", "xdmf", codecs.encode_xdmf), ("volume_mesh", "vtk", codecs.encode_vtk), ("volume_mesh", "xdmf", codecs.encode_xdmf), ("mesh", "stl", lambda v, f: grids.encode_stl(v[f]))):
    WRITERS.add(_kind, _suffix, lambda mesh, folder, e=_encode, s=_suffix: write_meshes(mesh, folder, e, s))
