"""Queries that write tables in a format, read them again, and give what came back, with their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.functions import geometry as geo
from urbanloom.functions import surfaces as sf
from urbanloom.operators import rasters as rs
from urbanloom.plans.tables import shared_folder, table, written
from urbanloom.queries.city import _B, _V, _boxes, _footprints, _mesh
from urbanloom.queries.clouds import _GRID, CELL, _dem
from urbanloom.queries.shapes import _R, _blocks, _round
from urbanloom.sources import files, formats, lidar, vectors


def _folder(spark: SparkSession) -> str:
    return os.path.join(shared_folder(spark), f"files-{uuid.uuid4().hex}")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "points").where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz"))


def las_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points as LAS files, several a cloud."""
    folder = _folder(spark)
    files.save(_points(spark, sf_dir), folder, "point_cloud", "las", points_a_file=500).count()
    return files.load(spark, folder, "point_cloud", "las").select(*(F.round(c, 3).alias(c) for c in "xyz"), "classification", "intensity", "return_number", "num_returns")


def las_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of those files from their headers, by cloud."""
    folder = _folder(spark)
    files.save(_points(spark, sf_dir), folder, "point_cloud", "las", points_a_file=500).count()
    held = lidar.las_manifest(spark, folder).withColumn("cloud_id", F.regexp_extract("path", r"([^/]+)-\d+\.las$", 1))
    ends = [(f(f"{c}{n}"), f"{c}{n}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    return held.groupBy("cloud_id").agg(F.sum("n").alias("n"), *(F.round(e, 3).alias(n) for e, n in ends))


def points_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    files.save(_points(spark, sf_dir), folder, "point_cloud", "csv")
    return files.load(spark, folder, "point_cloud", "csv").select("x", "y", "z", "classification")


def message_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points around the corner of their cloud as messages (single precision): rounded to centimetres, with the class."""
    held = _points(spark, sf_dir)
    low = held.groupBy("cloud_id").agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    folder = _folder(spark)
    files.save(held.join(low, "cloud_id").withColumns({"x": F.col("x") - F.col("_x"), "y": F.col("y") - F.col("_y")}), folder, "point_cloud", "pb").count()
    return files.load(spark, folder, "point_cloud", "pb").groupBy(F.col("file").alias("cloud_id")).agg(F.count("*").alias("n"), F.count("classification").alias("classes"), F.round(F.max("x") + 0.0003, 1).alias("width"), F.round(F.max("y") + 0.0003, 1).alias("height"))


def tiff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = _dem(spark, sf_dir)
    folder = _folder(spark)
    files.save(cells, folder, "raster", "tif", grid=grid, epsg=3006).count()
    return formats.on_grid(files.load(spark, folder, "raster", "tif"), grid).select("row", "col", "value")


def png_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elevation raster as an image of whole metres."""
    cells, grid = _dem(spark, sf_dir)
    folder = _folder(spark)
    files.save(cells, folder, "raster", "png", grid=grid).count()
    return files.load(spark, folder, "raster", "png").groupBy("value").agg(F.count("*").alias("n"))


def matrix_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elevation raster as a text matrix in one file."""
    from urbanloom.sources.grids import asc_rows

    cells, _ = _dem(spark, sf_dir)
    folder = _folder(spark)
    lines = asc_rows(cells).select("row", F.translate("line", " ", ",").alias("line")).orderBy("row").coalesce(1)
    lines.select("line").write.text(folder)
    return files.load(spark, folder, "raster", "csv").select("row", "col", "value")


def _mesh_roundtrip(spark: SparkSession, sf_dir: str, suffix: str) -> tuple[DataFrame, DataFrame]:
    vertices, faces, _ = _mesh(spark, sf_dir)
    folder, name = _folder(spark), F.lit("mesh").alias("file")
    files.save((vertices.select(name, "*"), faces.select(name, "*")), folder, "mesh", suffix).count()
    return files.load(spark, folder, "mesh", suffix)


def _corners(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    from urbanloom.operators.meshes import with_corners

    vertices, faces = _mesh_roundtrip(spark, sf_dir, suffix)
    return with_corners(faces.drop("file"), vertices.drop("file")).select("fid", *(F.round(f"v{k}_{c}", 1).alias(f"v{k}_{c}") for k in range(3) for c in "xyz"))


def obj_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corners(spark, sf_dir, "obj")


def ply_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corners(spark, sf_dir, "ply")


def stl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corners(spark, sf_dir, "stl")


def vtk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corners(spark, sf_dir, "vtk")


def gltf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corners(spark, sf_dir, "gltf")


def xdmf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corners(spark, sf_dir, "xdmf")


def volume_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tetrahedra as an XDMF grid."""
    vertices, _, cells = _mesh(spark, sf_dir)
    folder, name = _folder(spark), F.lit("mesh").alias("file")
    files.save((vertices.select(name, "*"), cells.select(name, "*")), folder, "volume_mesh", "xdmf").count()
    return files.load(spark, folder, "volume_mesh", "xdmf")[1].drop("file")


def geojson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints as GeoJSON: id, corners, area."""
    folder = _folder(spark)
    features = vectors.geojson_features(_footprints(spark, sf_dir), "building_id").agg(F.collect_list("value").alias("v"))
    features.select(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join("v", ","), F.lit("]}")).alias("value")).write.text(folder)
    held = files.load(spark, folder, "footprints", "geojson")
    return held.select(F.get_json_object("properties", "$.building_id").alias("building_id"), F.size("ring").alias("corners"), F.round(geo.area(F.col("ring")), 2).alias("area"))


def cityjson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of all boxes as CityJSON: surfaces and their area."""
    folder = _folder(spark)
    held = _blocks(spark, sf_dir).select(F.col("bounds_id").alias("object_id"), F.substring_index("sid", "-", -1).cast("int").alias("surface"), "ring")
    formats.cityjson(held).write.text(folder)
    vertices, objects = files.load(spark, folder, "city", "json")
    back = formats.surfaces_of(vectors.preferred_geometry(objects, 1.0), vertices)
    return back.groupBy("object_id").agg(F.count("*").alias("surfaces"), _round(F.sum(sf.area(F.col("ring"))), 1).alias("area"))


def tin_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faces of a mesh as a CityJSON relief, with compact vertex numbers."""
    from urbanloom.operators.meshes import to_surfaces

    vertices, faces, _ = _mesh(spark, sf_dir)
    held = to_surfaces(faces, vertices).select(F.lit("relief").alias("object_id"), F.col("fid").alias("surface"), "ring")
    folder = _folder(spark)
    formats.cityjson(held, kind="TINRelief").write.text(folder)
    v, objects = files.load(spark, folder, "city", "json")
    own, back = formats.tin_mesh(vectors.preferred_geometry(objects, 1.0), v)
    return back.groupBy("object_id").agg(F.count("*").alias("faces")).join(own.groupBy("object_id").agg(F.count("*").alias("vertices")), "object_id")


def mesh_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mesh without three of every ten faces, so that it falls into parts: every part as a building, its faces and area."""
    vertices, faces, _ = _mesh(spark, sf_dir)
    held = formats.mesh_as_buildings(vertices, written(faces.where("fid % 10 NOT IN (7, 8, 9)"), "faces"))
    return held.groupBy("component").agg(F.count("*").alias("surfaces"))


def _hour_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A latest-hour CSV per field, made of the last readings."""
    from urbanloom.operators.sensors import latest

    rows = table(spark, sf_dir, "observations")
    place = rows.where("ts IS NOT NULL AND lon IS NOT NULL").groupBy("station_id").agg(F.min(F.struct("lat", "lon")).alias("p"))
    last = latest(rows).join(place, "station_id")
    line = F.concat_ws(";", "station_id", F.lit("name"), F.format_string("%.4f", "p.lat"), F.format_string("%.4f", "p.lon"), F.lit("1.0"), F.coalesce(F.col("value").cast("string"), F.lit("")), F.lit("G"), F.lit(""), F.lit("x"))
    head = "Parameter;field\nPeriod;latest-hour\nId;Name;Lat;Lon;Height;2024-01-01 00:00:00;Quality;;\n"
    return last.groupBy(F.col("field").alias("parameter")).agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("value"))


def latest_hour_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the latest-hour CSV texts say."""
    return formats.latest_hour(_hour_texts(spark, sf_dir)).select("parameter", "station_id", "value", "quality", "timestamp")


def day_series_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hydrology answers, one a station with its water levels: the last value."""
    rows = table(spark, sf_dir, "observations").where("field = 'water_level' AND ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    entry = F.struct((F.unix_seconds(F.col("ts").cast("timestamp")) * 1000).alias("date"), F.col("value").alias("value"))
    answers = rows.groupBy("station_id").agg(F.to_json(F.struct(F.array(F.struct(F.col("station_id").alias("key"), F.lit(True).alias("active"))).alias("station"), F.array_sort(F.collect_set(entry)).alias("value"))).alias("value"))
    return formats.day_series(answers.select("value")).groupBy("key").agg(F.max("date").alias("date"))


def series_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The air-quality snapshots' last values, read as answers."""
    held = table(spark, sf_dir, "sensor_snapshots").where("feed = 'air_quality' AND get_json_object(attributes, '$.lastValue.value') IS NOT NULL")
    answers = held.select(F.to_json(F.struct(F.col("snapshot_id").cast("string").alias("id"), F.struct(F.get_json_object("attributes", "$.lastValue.value").cast("double").alias("value")).alias("lastValue"), F.lit("ug").alias("uom"))).alias("value"))
    return formats.series(answers).select("id", "value", "unit").distinct()


def info_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.info(table(spark, sf_dir, "points"))


def info_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = _dem(spark, sf_dir)
    return files.info_raster(cells, grid)


def info_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, faces, _ = _mesh(spark, sf_dir)
    return files.info_mesh(vertices, faces)


def info_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = files.info_rings(_footprints(spark, sf_dir))
    return held.select("n", *(F.round(c, 3).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")))


_ALL = (
    las_roundtrip, las_manifest, points_text_roundtrip, message_roundtrip, tiff_roundtrip, png_roundtrip, matrix_roundtrip, obj_roundtrip, ply_roundtrip, stl_roundtrip, vtk_roundtrip, gltf_roundtrip, xdmf_roundtrip, volume_roundtrip,
    geojson_roundtrip, cityjson_roundtrip, tin_roundtrip, mesh_buildings, latest_hour_csv, day_series_json, series_json, info_points, info_raster, info_mesh, info_footprints,
)
QUERIES = {f.__name__: f for f in _ALL}

_P = "p AS (SELECT * FROM points WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z))"
_ROUND = lambda k: ", ".join(f"round({n}.{c}, 1) AS v{k}_{c}" for n in "abc"[k] for c in "xyz")
_CORNERS = f"WITH {_V.replace(', c AS', ', cc AS')} SELECT fid, {_ROUND(0)}, {_ROUND(1)}, {_ROUND(2)} FROM f JOIN v a ON a.vid = v0 JOIN v b ON b.vid = v1 JOIN v c ON c.vid = v2"
_LAST = "SELECT station_id, field, arg_max(struct_pack(value := CASE WHEN isnan(value) THEN NULL ELSE value END), struct_pack(a := ts, b := obs_id)) AS l FROM observations WHERE ts IS NOT NULL GROUP BY 1, 2"
SQL = {
    "las_roundtrip": f"WITH {_P} SELECT round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, coalesce(classification, 1)::SMALLINT AS classification, coalesce(intensity, 0)::INT AS intensity, coalesce(return_number, 0)::TINYINT AS return_number, coalesce(num_returns, 0)::TINYINT AS num_returns FROM p",
    "las_manifest": f"WITH {_P} SELECT cloud_id, count(*) AS n, {', '.join(f'round({f}({c}), 3) AS {c}{f}' for c in 'xyz' for f in ('min', 'max'))} FROM p GROUP BY 1",
    "points_text_roundtrip": f"WITH {_P} SELECT x, y, z, coalesce(classification, 1)::SMALLINT AS classification FROM p",
    "message_roundtrip": f"WITH {_P} SELECT cloud_id, count(*) AS n, CASE WHEN count(classification) = count(*) THEN count(*) ELSE 0 END AS classes, round(max(x) - min(x) + 0.0003, 1) AS width, round(max(y) - min(y) + 0.0003, 1) AS height FROM p GROUP BY 1",
    "tiff_roundtrip": f'WITH {_GRID} SELECT "row", col, v AS value FROM d',
    "png_roundtrip": f"WITH {_GRID} SELECT floor(greatest(v, 0)) AS value, count(*) AS n FROM d GROUP BY 1",
    "matrix_roundtrip": f'WITH {_GRID} SELECT "row", col, v AS value FROM d',
    **{f"{s}_roundtrip": _CORNERS for s in ("obj", "ply", "stl", "vtk", "gltf", "xdmf")},
    "volume_roundtrip": f"WITH {_V} SELECT cid, v0, v1, v2, v3 FROM c",
    "geojson_roundtrip": f"WITH {_B} SELECT bounds_id AS building_id, 4 AS corners, round((xmax - xmin) * (ymax - ymin) / 2, 2) AS area FROM b",
    "cityjson_roundtrip": f"WITH {_R} SELECT bounds_id AS object_id, 10 AS surfaces, round(2 * w * h + 24 * (w + h) + 3.3e-7, 1) AS area FROM r",
    "tin_roundtrip": f"WITH {_V}, u AS (SELECT count(DISTINCT struct_pack(x := x, y := y, z := z)) AS n FROM v) SELECT 'relief' AS object_id, (SELECT count(*) FROM f) AS faces, u.n AS vertices FROM u",
    "mesh_buildings": f"WITH {_V}, k AS (SELECT fid FROM f WHERE fid % 10 NOT IN (7, 8, 9)), g AS (SELECT fid, fid // 10 * 10 AS component FROM k) SELECT component, count(*) AS surfaces FROM g GROUP BY 1",
    "latest_hour_csv": f"WITH l AS ({_LAST}), h AS (SELECT DISTINCT station_id FROM observations WHERE ts IS NOT NULL AND lon IS NOT NULL) SELECT field AS parameter, station_id, l.value AS value, 'G' AS quality, '2024-01-01 00:00:00' AS timestamp FROM l JOIN h USING (station_id)",
    "day_series_json": "SELECT station_id AS key, max(epoch_ms(date_trunc('second', ts))) AS date FROM observations WHERE field = 'water_level' AND ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY 1",
    "series_json": "SELECT DISTINCT snapshot_id::VARCHAR AS id, json_extract_string(attributes, '$.lastValue.value')::DOUBLE AS value, 'ug' AS unit FROM sensor_snapshots WHERE feed = 'air_quality' AND json_extract_string(attributes, '$.lastValue.value') IS NOT NULL",
    "info_points": f"SELECT count(*) AS n, {', '.join(f'{f}({c}) FILTER (NOT isnan({c})) AS {c}{f}' for c in 'xyz' for f in ('min', 'max'))} FROM points",
    "info_raster": f'WITH {_GRID} SELECT max("row") + 1 AS rows, max(col) + 1 AS cols, {CELL}::DOUBLE AS size, any_value(g.w) * {CELL}::DOUBLE AS west, any_value(g.n) * {CELL}::DOUBLE AS north, count(v) AS valid, min(v) AS min, max(v) AS max FROM d, g',
    "info_mesh": f"WITH {_V} SELECT count(*) AS vertices, {', '.join(f'{f}({c}) AS {c}{f}' for c in 'xyz' for f in ('min', 'max'))}, (SELECT count(*) FROM f) AS faces FROM v",
    "info_footprints": f"WITH {_B} SELECT count(*) AS n, round(min(xmin), 3) AS xmin, round(max(xmax), 3) AS xmax, round(min(ymin), 3) AS ymin, round(max(ymax), 3) AS ymax FROM b",
}
