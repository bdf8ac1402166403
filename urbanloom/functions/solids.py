"""Primitive meshes and rays as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sphere(spark: SparkSession, radius: float, resolution: int) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) on `resolution` + 1 parallels of 2 * `resolution` points, and the triangles between them."""
    around = 2 * resolution
    at = spark.range((resolution + 1) * around).select(F.col("id").alias("vid"), F.floor(F.col("id") / around).alias("i"), (F.col("id") % around).alias("j"))
    polar, turn = F.col("i") * (math.pi / resolution), F.col("j") * (2 * math.pi / around)
    vertices = at.select("vid", (radius * F.sin(polar) * F.cos(turn)).alias("x"), (radius * F.sin(polar) * F.sin(turn)).alias("y"), (radius * F.cos(polar)).alias("z"))
    return vertices, _band(at.where(F.col("i") < resolution), around)


def cylinder(spark: SparkSession, radius: float, height: float, resolution: int, top: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The mantle of a cylinder along z, or of a cone with the radius `top` at its upper end."""
    upper = radius if top is None else top
    at = spark.range(2 * resolution).select(F.col("id").alias("vid"), F.floor(F.col("id") / resolution).alias("i"), (F.col("id") % resolution).alias("j"))
    turn, size = F.col("j") * (2 * math.pi / resolution), F.when(F.col("i") == 0, radius).otherwise(upper)
    vertices = at.select("vid", (size * F.cos(turn)).alias("x"), (size * F.sin(turn)).alias("y"), (F.col("i") * height).cast("double").alias("z"))
    return vertices, _band(at.where("i = 0"), resolution)


def _band(at: DataFrame, around: int) -> DataFrame:
    a, b = F.col("i") * around + F.col("j"), F.col("i") * around + (F.col("j") + 1) % around
    halves = F.array(F.struct((F.col("vid") * 2).alias("fid"), a.alias("v0"), (a + around).alias("v1"), b.alias("v2")), F.struct((F.col("vid") * 2 + 1).alias("fid"), b.alias("v0"), (a + around).alias("v1"), (b + around).alias("v2")))
    return at.select(F.inline(halves))


def ray_triangle(origin: tuple, direction: tuple, a: tuple, b: tuple, c: tuple) -> Column:
    """How far along `direction` a ray meets a triangle, NULL if it doesn't; all are triples of columns. Hits behind the origin don't count."""
    minus = lambda p, q: tuple(x - y for x, y in zip(p, q, strict=True))
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    cross = lambda p, q: (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
    e1, e2 = minus(b, a), minus(c, a)
    h = cross(direction, e2)
    det = dot(e1, h)
    inverse = F.when(F.abs(det) > 1e-12, F.lit(1.0) / F.when(F.abs(det) > 1e-12, det))
    s = minus(origin, a)
    u = dot(s, h) * inverse
    q = cross(s, e1)
    v, t = dot(direction, q) * inverse, dot(e2, q) * inverse
    return F.when((u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0), t)
