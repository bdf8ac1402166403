"""Raster and mesh text formats: ESRI ASCII grids, matrices, world files, OBJ, ASCII PLY, STL."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators.rasters import Grid


def read_asc(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """Cells (row, col, value; nodata is NULL) and grid of an ESRI ASCII raster. Only its six header lines come to the driver."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("n", "line"))
    head = {k.lower(): float(v) for k, v in (r.line.split()[:2] for r in lines.where("n < 6").orderBy("n").collect() if r.line[:1].isalpha())}
    size, rows, cols = head["cellsize"], int(head["nrows"]), int(head["ncols"])
    corner = head.get("xllcorner", head.get("xllcenter", 0) - size / 2), head.get("yllcorner", head.get("yllcenter", 0) - size / 2)
    cells = lines.where(F.col("n") >= len(head)).select((F.col("n") - len(head)).alias("row"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v"))
    value = F.col("v").try_cast("double")
    return cells.select("row", "col", F.when(value != head.get("nodata_value", float("nan")), value).alias("value")), Grid(corner[0], corner[1] + rows * size, size, rows, cols)


def asc_rows(cells: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """One line of text per raster row, with its number; a row is as wide as the raster."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("value", F.lit(nodata)).alias("v")))), lambda s: s.v.cast("string")), " ")
    return cells.groupBy("row").agg(line.alias("line"))


def read_world_file(text: str) -> tuple[float, ...]:
    """a, b, c, d, e, f of the affine map; the file's order is a, d, b, e, c, f."""
    a, d, b, e, c, f = (float(v) for v in text.split()[:6])
    return a, b, c, d, e, f


def mosaic(tiles: DataFrame, how: str = "first") -> DataFrame:
    """Cells (tile, row, col, value) of overlapping tiles on one grid as one raster: first, last, min or max by tile."""
    pick = {"first": F.min_by("value", "tile"), "last": F.max_by("value", "tile"), "min": F.min("value"), "max": F.max("value")}[how]
    return tiles.where("value IS NOT NULL AND NOT isnan(value)").groupBy("row", "col").agg(pick.alias("value"))


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """The lines of an OBJ file in order: n, line."""
    v = vertices.select(F.lit(0).alias("kind"), F.col("vid").alias("n"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("line"))
    f = faces.select(F.lit(1).alias("kind"), F.col("fid").alias("n"), F.concat_ws(" ", F.lit("f"), *(F.col(c) + 1 for c in ("v0", "v1", "v2"))).alias("line"))
    return v.union(f).orderBy("kind", "n").select("kind", "n", "line")


def decode_stl(data: bytes) -> np.ndarray:
    """The corners (n, 3, 3) of a binary STL file."""
    n, = struct.unpack_from("<I", data, 80)
    raw = np.frombuffer(data, np.uint8, n * 50, 84).reshape(n, 50)
    return raw[:, 12:48].copy().view("<f4").reshape(n, 3, 3).astype(float)


def encode_stl(corners: np.ndarray) -> bytes:
    """A binary STL file of triangles (n, 3, 3)."""
    n = len(corners)
    body = np.zeros((n, 50), np.uint8)
    normal = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    size = np.linalg.norm(normal, axis=1, keepdims=True)
    body[:, :12] = (normal / np.where(size > 0, size, 1)).astype("<f4").view(np.uint8).reshape(n, 12)
    body[:, 12:48] = np.ascontiguousarray(corners.reshape(n, 9)).astype("<f4").view(np.uint8).reshape(n, 36)
    return bytes(80) + struct.pack("<I", n) + body.tobytes()
