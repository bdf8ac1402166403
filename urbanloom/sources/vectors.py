"""Vector formats as DataFrames: GeoJSON, shapefile, CityJSON, OpenStreetMap JSON."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"
_POINTS = "array<array<double>>"


def _ring(coordinates):  # noqa: ANN001, ANN202
    """A closed GeoJSON ring as structs without the closing vertex."""
    return F.transform(F.slice(coordinates, 1, F.size(coordinates) - 1), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def read_geojson_polygons(spark: SparkSession, path: str) -> DataFrame:
    """part, ring, holes, properties (variant) of every polygon; a multipolygon gives a row per part."""
    text = spark.read.text(path, wholetext=True)
    features = text.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f"))
    kind = F.get_json_object("f", "$.geometry.type")
    one = F.when(kind == "Polygon", F.array(F.from_json(F.get_json_object("f", "$.geometry.coordinates"), f"array<{_POINTS}>")))
    many = F.when(kind == "MultiPolygon", F.from_json(F.get_json_object("f", "$.geometry.coordinates"), f"array<array<{_POINTS}>>"))
    held = features.select(F.get_json_object("f", "$.properties").alias("properties"), F.posexplode(F.coalesce(one, many)).alias("part", "rings"))
    return held.select("part", _ring(F.col("rings")[0]).alias("ring"), F.transform(F.slice("rings", 2, F.size("rings")), _ring).alias("holes"), "properties")


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (array of x, y) and properties of every line string."""
    text = spark.read.text(path, wholetext=True)
    features = text.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f")).where(F.get_json_object("f", "$.geometry.type") == "LineString")
    points = F.from_json(F.get_json_object("f", "$.geometry.coordinates"), _POINTS)
    return features.select(F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("line"), F.get_json_object("f", "$.properties").alias("properties"))


def geojson_features(polygons: DataFrame, key: str) -> DataFrame:
    """One GeoJSON feature per row, as text: the closing vertex is added."""
    closed = F.concat(F.col("ring"), F.slice("ring", 1, 1))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed, lambda p: F.array(p.x, p.y))).alias("coordinates"))
    return polygons.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(key).alias("properties"))).alias("value"))


def road_graph(lines: DataFrame, decimals: int = 2) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid by x, then y) and edges (src, dst, length) of lines; ends are rounded half to even, lengths are not."""
    from urbanloom.functions.geometry import line_length
    from urbanloom.plans.tables import numbered

    end = lambda p: F.struct(F.bround(p.x, decimals).alias("x"), F.bround(p.y, decimals).alias("y"))
    held = lines.where(F.size("line") > 1).select(end(F.element_at("line", 1)).alias("a"), end(F.element_at("line", -1)).alias("b"), line_length(F.col("line")).alias("length"))
    ends = held.select(F.col("a").alias("p")).union(held.select("b")).distinct()
    vertices = numbered(ends.select("p", "p.x", "p.y"), ["x", "y"], "vid")
    edges = held.join(vertices.select(F.col("p").alias("a"), F.col("vid").alias("src")), "a").join(vertices.select(F.col("p").alias("b"), F.col("vid").alias("dst")), "b")
    return vertices.select("vid", "p.x", "p.y"), edges.select("src", "dst", "length")


def decode_shp(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """The parts of every polygon or polyline of a .shp file, as lists of (x, y)."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    out, at = [], 100
    while at + 12 <= len(data):
        length = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        kind, = struct.unpack("<i", data[at + 8 : at + 12])
        if kind in (3, 5, 13, 15):
            parts, points = struct.unpack("<2i", data[at + 44 : at + 52])
            starts = [*struct.unpack(f"<{parts}i", data[at + 52 : at + 52 + 4 * parts]), points]
            flat = struct.unpack(f"<{2 * points}d", data[at + 52 + 4 * parts : at + 52 + 4 * parts + 16 * points])
            out.append([[(flat[2 * k], flat[2 * k + 1]) for k in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)])
        else:
            out.append([])
        at += 8 + length
    return out


def read_shp(spark: SparkSession, path: str) -> DataFrame:
    """path, feature, part, ring (closed as stored) of every part of a shapefile's shapes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, f, p, [{"x": x, "y": y} for x, y in ring]) for f, parts in enumerate(decode_shp(bytes(data))) for p, ring in enumerate(parts)]
                yield pd.DataFrame(rows, columns=["path", "feature", "part", "ring"])

    return files.mapInPandas(run, f"path string, feature int, part int, ring {RING}")


def read_cityjson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z; scaled and translated) and objects (object_id, type, parents, attributes, geometry as JSON) of a CityJSON file."""
    text = spark.read.text(path, wholetext=True).where(F.get_json_object("value", "$.type") == "CityJSON")
    held = text.select(F.from_json(F.get_json_object("value", "$.vertices"), _POINTS).alias("v"), F.from_json(F.get_json_object("value", "$.transform"), "scale array<double>, translate array<double>").alias("t"))
    one, zero = F.array(*(F.lit(1.0),) * 3), F.array(*(F.lit(0.0),) * 3)
    scale, move = F.coalesce("t.scale", one), F.coalesce("t.translate", zero)
    vertices = held.select(scale.alias("s"), move.alias("m"), F.posexplode("v").alias("vid", "p")).select("vid", *((F.col("p")[k] * F.col("s")[k] + F.col("m")[k]).alias(c) for k, c in enumerate("xyz")))
    objects = text.select(F.explode(F.from_json(F.get_json_object("value", "$.CityObjects"), "map<string,string>")).alias("object_id", "o"))
    return vertices, objects.select("object_id", F.get_json_object("o", "$.type").alias("type"), F.from_json(F.get_json_object("o", "$.parents"), "array<string>").alias("parents"), F.get_json_object("o", "$.attributes").alias("attributes"), F.get_json_object("o", "$.geometry").alias("geometry"))


def preferred_geometry(objects: DataFrame, lod: float = 2.0) -> DataFrame:
    """One geometry per object: the wanted level of detail, else the next below, else any; surfaces before solids; boundaries as JSON."""
    from pyspark.sql import Window

    held = objects.select("object_id", "type", F.posexplode(F.from_json("geometry", "array<string>")).alias("pos", "g"))
    level = F.get_json_object("g", "$.lod").try_cast("double")
    kind = F.get_json_object("g", "$.type")
    held = held.withColumns({"lod": level, "kind": kind})
    order = [F.when(F.col("lod") <= lod, lod - F.col("lod")).otherwise(1000 + F.coalesce(F.col("lod"), F.lit(0.0))), F.when(F.col("kind").contains("Surface"), 0).otherwise(1), F.col("pos")]
    first = F.row_number().over(Window.partitionBy("object_id").orderBy(*order))
    return held.withColumn("_n", first).where("_n = 1").select("object_id", "type", "lod", "kind", F.get_json_object("g", "$.boundaries").alias("boundaries"))


def read_osm_ways(spark: SparkSession, path: str, closed: bool) -> DataFrame:
    """way_id and line of every OpenStreetMap way; `closed` ways (buildings) are closed and have more than two nodes."""
    text = spark.read.text(path, wholetext=True)
    elements = text.select(F.explode(F.from_json(F.get_json_object("value", "$.elements"), "array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>>>")).alias("e")).select("e.*")
    nodes = elements.where("type = 'node'").select(F.col("id").alias("node"), "lon", "lat")
    ways = elements.where("type = 'way'").select(F.col("id").alias("way_id"), F.posexplode("nodes").alias("pos", "node"))
    lines = ways.join(nodes, "node").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("p"))  # a way has at most 2,000 nodes
    lines = lines.select("way_id", F.transform("p", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("line"))
    if not closed:
        return lines.where(F.size("line") > 1)
    shut = F.when(F.element_at("line", 1) == F.element_at("line", -1), F.col("line")).otherwise(F.concat("line", F.slice("line", 1, 1)))
    return lines.where(F.size("line") > 2).select("way_id", shut.alias("line"))
