"""Queries over point clouds and rasters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators import points as pc
from urbanloom.operators import rasters as rs
from urbanloom.operators.nearest import nearest
from urbanloom.operators.ranked import exact_percentiles
from urbanloom.plans.tables import table, written

BOX = pc.Box(250_100.0, 6_400_100.0, 250_300.0, 6_400_300.0, 30.0, 50.0)
CELL = 10.0
COLUMNS = ["cloud_id", "point_id", "x", "y", "z", "classification"]


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """Every point once."""
    return table(spark, sf, "points").select("cloud_id", "strip_id", "point_id", "x", "y", "z", "classification", "intensity", "return_number", "num_returns").distinct()


def crop_points(spark: SparkSession, sf: str) -> DataFrame:
    return pc.crop(table(spark, sf, "points"), BOX).select(*COLUMNS)


def crop_points_3d(spark: SparkSession, sf: str) -> DataFrame:
    return pc.crop(table(spark, sf, "points"), BOX, xy_only=False).select(*COLUMNS)


def z_range(spark: SparkSession, sf: str) -> DataFrame:
    return pc.z_range(table(spark, sf, "points"), 30.0, 45.0).select(*COLUMNS)


def class_filter_keep(spark: SparkSession, sf: str) -> DataFrame:
    return pc.by_class(table(spark, sf, "points"), [2, 9]).select(*COLUMNS)


def class_filter_drop(spark: SparkSession, sf: str) -> DataFrame:
    return pc.by_class(table(spark, sf, "points"), [2, 9], keep=False).select(*COLUMNS)


def vegetation_points(spark: SparkSession, sf: str) -> DataFrame:
    return pc.vegetation(table(spark, sf, "points")).select(*COLUMNS)


def vegetation_removed(spark: SparkSession, sf: str) -> DataFrame:
    return pc.vegetation(table(spark, sf, "points"), keep=False).select(*COLUMNS)


def global_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return pc.global_outliers(table(spark, sf, "points"), 3.0, keep=True).select("cloud_id", "point_id")


def global_outliers_removed(spark: SparkSession, sf: str) -> DataFrame:
    return pc.global_outliers(table(spark, sf, "points"), 3.0).select("cloud_id", "point_id")


def cloud_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return pc.cloud_bounds(table(spark, sf, "points"))


def used_classes(spark: SparkSession, sf: str) -> DataFrame:
    return pc.used_classes(table(spark, sf, "points"))


def merge_clouds(spark: SparkSession, sf: str) -> DataFrame:
    """Points and trees as one cloud; trees lack the point attributes."""
    points = table(spark, sf, "points").select("x", "y", "z", "classification", "intensity")
    trees = table(spark, sf, "trees").select("x", "y", "z", F.lit(5).cast("smallint").alias("classification"))
    return pc.merge(points, trees).groupBy("classification").agg(F.count("*").alias("n"), F.count("intensity").alias("with_intensity"))


def offset_points(spark: SparkSession, sf: str) -> DataFrame:
    return pc.offset(table(spark, sf, "points"), -250_000.0, -6_400_000.0).select("point_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "z")


def keep_points(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "points")
    return pc.keep_points(points, points.where("return_number = 1").select("point_id")).select("cloud_id", "point_id")


def remove_points(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "points")
    return pc.remove_points(points, points.where("return_number = 1").select("point_id")).select("cloud_id", "point_id")


def manifest_prune(spark: SparkSession, sf: str) -> DataFrame:
    return pc.overlapping(pc.manifest(table(spark, sf, "points")), BOX)


def cloud_info(spark: SparkSession, sf: str) -> DataFrame:
    """Count and extent of all points, as a file's description."""
    return table(spark, sf, "points").agg(F.count("*").alias("n"), F.countDistinct("cloud_id").alias("clouds"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max(F.nanvl("x", F.lit(None))).alias("xmax"), F.max(F.nanvl("y", F.lit(None))).alias("ymax"))


def cloud_z_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return exact_percentiles(_points(spark, sf), ["cloud_id"], "z", {"z_p10": 0.1, "z_median": 0.5, "z_p90": 0.9})


def knn_distance(spark: SparkSession, sf: str) -> DataFrame:
    """The mean distance of every tree position to its five nearest others."""
    trees = table(spark, sf, "trees")
    near = nearest(trees, trees, ["x", "y"], trees.count(), 5, apart=True)
    return near.groupBy("x", "y").agg(F.round(F.avg("distance"), 6).alias("mean_distance"), F.count("*").alias("n"))


def knn_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Tree positions whose mean distance to five neighbours exceeds the mean by 1.5 sample deviations."""
    trees = table(spark, sf, "trees")
    near = nearest(trees, trees, ["x", "y"], trees.count(), 5, apart=True)
    means = written(near.groupBy("x", "y").agg(F.avg("distance").alias("d")), "knn")
    limit = means.agg(F.avg("d") + 1.5 * F.stddev_samp("d")).first()[0]
    return means.where(F.col("d") > F.lit(limit)).select("x", "y")


def _dem(spark: SparkSession, sf: str) -> tuple[DataFrame, rs.Grid]:
    """The elevation raster: cell means of ground points in whole millimetres; empty cells 0."""
    points = _points(spark, sf)
    grid = rs.Grid.around(table(spark, sf, "points"), CELL)
    cells = rs.rasterize(points, grid, per_unit=1000)
    return cells.select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value")), grid


def rasterize_mean(spark: SparkSession, sf: str) -> DataFrame:
    grid = rs.Grid.around(table(spark, sf, "points"), CELL)
    return rs.rasterize(_points(spark, sf), grid, per_unit=1000)


def slope_aspect(spark: SparkSession, sf: str) -> DataFrame:
    cells, grid = _dem(spark, sf)
    return rs.slope_aspect(cells, grid.size).select("row", "col", F.round("slope", 6).alias("slope"), F.round(F.cos("aspect") * F.sin("slope"), 6).alias("west"), F.round(F.sin("aspect") * F.sin("slope"), 6).alias("north"))


def tri(spark: SparkSession, sf: str) -> DataFrame:
    return rs.tri(_dem(spark, sf)[0]).select("row", "col", F.round("tri", 3).alias("tri"))


def tpi(spark: SparkSession, sf: str) -> DataFrame:
    return rs.tpi(_dem(spark, sf)[0], 5).select("row", "col", F.round("tpi", 6).alias("tpi"))


def vrm(spark: SparkSession, sf: str) -> DataFrame:
    cells, grid = _dem(spark, sf)
    return rs.vrm(cells, grid.size).select("row", "col", F.round("vrm", 6).alias("vrm"))


def erode_dilate(spark: SparkSession, sf: str) -> DataFrame:
    cells = rs.rasterize(_points(spark, sf), rs.Grid.around(table(spark, sf, "points"), CELL))
    return rs.erode_dilate(cells).where("kept").select("row", "col")


def raster_to_points(spark: SparkSession, sf: str) -> DataFrame:
    grid = rs.Grid.around(table(spark, sf, "points"), CELL)
    return rs.to_points(rs.rasterize(_points(spark, sf), grid, per_unit=1000), grid)


def dem_sample(spark: SparkSession, sf: str) -> DataFrame:
    cells, grid = _dem(spark, sf)
    return rs.sample(table(spark, sf, "trees").select("tree_id", "x", "y", "seen_at").distinct().where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)"), cells, grid).select("tree_id", "x", "y", "ground")


def bilinear_sample(spark: SparkSession, sf: str) -> DataFrame:
    cells, grid = _dem(spark, sf)
    trees = table(spark, sf, "trees").select("tree_id", "x", "y").distinct().where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    return rs.bilinear(trees, cells, grid).select("tree_id", "x", "y", F.round("ground", 5).alias("ground"))


def resample_nearest(spark: SparkSession, sf: str) -> DataFrame:
    cells, grid = _dem(spark, sf)
    return rs.resample_nearest(cells, grid, 3)[0]


def fill_holes(spark: SparkSession, sf: str) -> DataFrame:
    grid = rs.Grid.around(table(spark, sf, "points"), CELL)
    cells = written(rs.rasterize(_points(spark, sf), grid, per_unit=1000).select("row", "col", "value"), "cells")
    return rs.fill_holes(cells, grid.rows * grid.cols)


def tree_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Local maxima of the vegetation surface (highest vegetation point per 2 m cell)."""
    points = _points(spark, sf).where("classification IN (3, 4, 5) AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)")
    grid = rs.Grid.around(table(spark, sf, "points"), 2.0)
    top = points.groupBy(grid.row(F.col("y")).alias("row"), grid.col(F.col("x")).alias("col")).agg(F.max("z").alias("value"))
    cells = grid.cells(spark).join(top, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))
    return rs.local_maxima(cells, 40.0)


QUERIES = {f.__name__: f for f in (crop_points, crop_points_3d, z_range, class_filter_keep, class_filter_drop, vegetation_points, vegetation_removed, global_outliers, global_outliers_removed, cloud_bounds, used_classes, merge_clouds, offset_points, keep_points, remove_points, manifest_prune, cloud_info, cloud_z_percentiles, knn_distance, knn_outliers, rasterize_mean, slope_aspect, tri, tpi, vrm, erode_dilate, raster_to_points, dem_sample, bilinear_sample, resample_nearest, fill_holes, tree_peaks)}

_C = ", ".join(COLUMNS)
_OK = "x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)"
_IN = f"x BETWEEN {BOX.xmin} AND {BOX.xmax} AND y BETWEEN {BOX.ymin} AND {BOX.ymax}"
_GREEN = "coalesce(CASE WHEN has THEN classification IN (3, 4, 5) ELSE return_number != num_returns AND (classification IS NULL OR classification = 1) END, false)"
_VEG = f"FROM points JOIN (SELECT cloud_id, bool_or(coalesce(classification IN (3, 4, 5), false)) AS has FROM points GROUP BY cloud_id) USING (cloud_id) WHERE"
_OUT = "FROM points JOIN (SELECT cloud_id, avg(z) AS m, stddev_pop(z) AS s FROM points WHERE z IS NOT NULL AND NOT isnan(z) GROUP BY cloud_id) USING (cloud_id) WHERE z IS NOT NULL AND NOT isnan(z) AND"
_GRID = f"""
g AS (SELECT floor(min(x) / {CELL})::INT AS w, floor(min(y) / {CELL})::INT AS s, floor(max(y) / {CELL})::INT + 1 AS n, floor(max(x) / {CELL})::INT + 1 AS e FROM points WHERE {_OK}),
p AS (SELECT DISTINCT cloud_id, strip_id, point_id, x, y, z, classification, intensity, return_number, num_returns FROM points),
m AS (SELECT floor((n * {CELL} - y) / {CELL})::INT AS "row", floor((x - w * {CELL}) / {CELL})::INT AS col, floor(sum(CAST(round_even(z * 1000, 0) AS BIGINT)) / count(*)) / 1000.0::DOUBLE AS value, count(*) AS n FROM p, g WHERE {_OK} AND z IS NOT NULL AND NOT isnan(z) AND classification IN (2, 9) GROUP BY 1, 2),
cells AS (SELECT r."row", c.col, m.value AS value, coalesce(m.n, 0) AS n FROM (SELECT unnest(range(n - s))::INT AS "row" FROM g) r CROSS JOIN (SELECT unnest(range(e - w))::INT AS col FROM g) c LEFT JOIN m ON m."row" = r."row" AND m.col = c.col),
d AS (SELECT "row", col, coalesce(value, 0.0) AS v FROM cells)"""
_CLAMP = """least(greatest("row" + i, 0), (SELECT max("row") FROM d))"""


def _around(inner: str, half: int, mirrored: bool) -> str:
    """Every cell beside its neighbours within `half`, edges mirrored (for half 1 the same as clamped)."""
    fold = lambda e, most: f"CASE WHEN {e} < 0 THEN -({e}) - 1 WHEN {e} > {most} THEN 2 * {most} + 1 - ({e}) ELSE {e} END"
    return f"""(SELECT a."row", a.col, i, j, {inner} FROM d a CROSS JOIN (SELECT unnest(range(-{half}, {half + 1})) AS i) CROSS JOIN (SELECT unnest(range(-{half}, {half + 1})) AS j) CROSS JOIN (SELECT max("row") AS mr, max(col) AS mc FROM d)
      JOIN d b ON b."row" = {fold('a."row" + i', "mr")} AND b.col = {fold("a.col + j", "mc")})"""


_SOBEL = f"""sob AS (SELECT "row", col, sum(CASE WHEN j = -1 THEN 1 WHEN j = 1 THEN -1 ELSE 0 END * (2 - abs(i)) * bv) / (8 * {CELL}) AS dx, sum(CASE WHEN i = -1 THEN 1 WHEN i = 1 THEN -1 ELSE 0 END * (2 - abs(j)) * bv) / (8 * {CELL}) AS dy FROM {_around("b.v AS bv", 1, True)} GROUP BY 1, 2),
sl AS (SELECT "row", col, atan(sqrt(dx * dx + dy * dy)) AS slope, atan2(dy, dx) AS aspect FROM sob)"""
_KNN = f"""
t AS (SELECT DISTINCT x, y FROM trees WHERE {_OK}),
k AS (SELECT a.x, a.y, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dd, row_number() OVER (PARTITION BY a.x, a.y ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.x, b.y) AS rk FROM t a JOIN t b ON a.x != b.x OR a.y != b.y)"""
SQL = {
    "crop_points": f"SELECT {_C} FROM points WHERE {_IN}",
    "crop_points_3d": f"SELECT {_C} FROM points WHERE {_IN} AND z BETWEEN {BOX.zmin} AND {BOX.zmax}",
    "z_range": f"SELECT {_C} FROM points WHERE z BETWEEN 30 AND 45",
    "class_filter_keep": f"SELECT {_C} FROM points WHERE classification IN (2, 9)",
    "class_filter_drop": f"SELECT {_C} FROM points WHERE classification IS NULL OR classification NOT IN (2, 9)",
    "vegetation_points": f"SELECT {_C} {_VEG} {_GREEN}",
    "vegetation_removed": f"SELECT {_C} {_VEG} NOT {_GREEN}",
    "global_outliers": f"SELECT cloud_id, point_id {_OUT} abs(z - m) > 3 * s",
    "global_outliers_removed": f"SELECT cloud_id, point_id {_OUT} NOT abs(z - m) > 3 * s",
    "cloud_bounds": "SELECT cloud_id, count(*) AS n, " + ", ".join(f"{f}({c}) FILTER (NOT isnan({c})) AS {c}{f}" for c in "xyz" for f in ("min", "max")) + " FROM points GROUP BY cloud_id",
    "used_classes": "SELECT DISTINCT cloud_id, classification FROM points WHERE classification IS NOT NULL",
    "merge_clouds": "SELECT classification, count(*) AS n, count(intensity) AS with_intensity FROM (SELECT classification, intensity FROM points UNION ALL SELECT 5, NULL FROM trees) GROUP BY 1",
    "offset_points": "SELECT point_id, round(x - 250000, 3) AS x, round(y - 6400000, 3) AS y, z FROM points",
    "keep_points": "SELECT cloud_id, point_id FROM points WHERE point_id IN (SELECT point_id FROM points WHERE return_number = 1)",
    "remove_points": "SELECT cloud_id, point_id FROM points WHERE point_id NOT IN (SELECT point_id FROM points WHERE return_number = 1)",
    "manifest_prune": f"SELECT * FROM (SELECT strip_id, count(*) AS n, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM points WHERE {_OK} GROUP BY strip_id) WHERE xmin <= {BOX.xmax} AND xmax >= {BOX.xmin} AND ymin <= {BOX.ymax} AND ymax >= {BOX.ymin}",
    "cloud_info": "SELECT count(*) AS n, count(DISTINCT cloud_id) AS clouds, min(x) AS xmin, min(y) AS ymin, max(x) FILTER (NOT isnan(x)) AS xmax, max(y) FILTER (NOT isnan(y)) AS ymax FROM points",
    "cloud_z_percentiles": "SELECT cloud_id, quantile_cont(z, 0.1) AS z_p10, quantile_cont(z, 0.5) AS z_median, quantile_cont(z, 0.9) AS z_p90 FROM (SELECT DISTINCT cloud_id, point_id, z FROM points WHERE z IS NOT NULL AND NOT isnan(z)) GROUP BY cloud_id",
    "knn_distance": f"WITH {_KNN} SELECT x, y, round(avg(dd), 6) AS mean_distance, count(*) AS n FROM k WHERE rk <= 5 GROUP BY x, y",
    "knn_outliers": f"WITH {_KNN}, a AS (SELECT x, y, avg(dd) AS m FROM k WHERE rk <= 5 GROUP BY x, y) SELECT x, y FROM a WHERE m > (SELECT avg(m) + 1.5 * stddev_samp(m) FROM a)",
    "rasterize_mean": f'WITH {_GRID} SELECT "row", col, value, n FROM cells',
    "slope_aspect": f'WITH {_GRID}, {_SOBEL} SELECT "row", col, round(slope, 6) AS slope, round(cos(aspect) * sin(slope), 6) AS west, round(sin(aspect) * sin(slope), 6) AS north FROM sl',
    "tri": f'WITH {_GRID} SELECT "row", col, round(sqrt(sum((bv - av) * (bv - av))), 3) AS tri FROM {_around("a.v AS av, b.v AS bv", 1, True)} GROUP BY 1, 2',
    "tpi": f'WITH {_GRID} SELECT "row", col, round(max(av) - sum(bv) / 25, 6) AS tpi FROM {_around("a.v AS av, b.v AS bv", 2, True)} GROUP BY 1, 2',
    "vrm": f"""WITH {_GRID}, {_SOBEL}, dd AS (SELECT * FROM d), u AS (SELECT "row", col, cos(slope) * cos(aspect) AS a, cos(slope) * sin(aspect) AS b, sin(slope) AS c FROM sl)
      SELECT "row", col, round(sqrt(1 - (pow(sum(ua) / 9, 2) + pow(sum(ub) / 9, 2) + pow(sum(uc) / 9, 2)) / 9), 6) AS vrm FROM (SELECT n."row", n.col, u.a AS ua, u.b AS ub, u.c AS uc FROM {_around('b."row" AS br, b.col AS bc', 1, True)} n JOIN u ON u."row" = n.br AND u.col = n.bc) GROUP BY 1, 2""",
    "erode_dilate": f"""WITH {_GRID}, f AS (SELECT "row", col, (value IS NOT NULL)::INT AS ok FROM cells),
      e AS (SELECT a."row", a.col, min(f.ok) AS ok FROM f a JOIN f ON abs(a."row" - f."row") + abs(a.col - f.col) <= 1 GROUP BY 1, 2),
      o AS (SELECT a."row", a.col, max(e.ok) AS ok FROM f a JOIN e ON abs(a."row" - e."row") + abs(a.col - e.col) <= 1 GROUP BY 1, 2)
      SELECT "row", col FROM o JOIN f USING ("row", col) WHERE o.ok = 1 AND f.ok = 1""",
    "raster_to_points": f'WITH {_GRID} SELECT (w * {CELL} + {CELL} * (col + 0.5))::DOUBLE AS x, (g.n * {CELL} - {CELL} * ("row" + 0.5))::DOUBLE AS y, value AS z, 1::SMALLINT AS classification FROM cells, g WHERE value IS NOT NULL',
    "dem_sample": f'WITH {_GRID}, t AS (SELECT DISTINCT tree_id, x, y, seen_at FROM trees WHERE {_OK}) SELECT tree_id, x, y, v AS ground FROM (SELECT *, floor((n * {CELL} - y) / {CELL})::INT AS r, floor((x - w * {CELL}) / {CELL})::INT AS c FROM t, g) LEFT JOIN d ON d."row" = r AND d.col = c',
    "bilinear_sample": f"""WITH {_GRID}, t AS (SELECT DISTINCT tree_id, x, y FROM trees WHERE {_OK}), q AS (SELECT tree_id, x, y, (x - w * {CELL}) / {CELL} - 0.5 AS fx, (n * {CELL} - y) / {CELL} - 0.5 AS fy, n - s AS rows, e - w AS cols FROM t, g),
      c AS (SELECT q.*, least(greatest(floor(fy)::INT + a, 0), rows - 1) AS r, least(greatest(floor(fx)::INT + b, 0), cols - 1) AS k, (CASE a WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE b WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS part FROM q, (VALUES (0), (1)) aa(a), (VALUES (0), (1)) bb(b))
      SELECT tree_id, x, y, round(sum(part * v), 5) AS ground FROM c JOIN d ON d."row" = r AND d.col = k GROUP BY 1, 2, 3""",
    "resample_nearest": f"""WITH {_GRID}, b AS (SELECT max("row") + 1 AS nr, max(col) + 1 AS nc FROM d), r AS (SELECT unnest(range(ceil(nr / 3.0)::INT))::INT AS "row" FROM b), c AS (SELECT unnest(range(ceil(nc / 3.0)::INT))::INT AS col FROM b)
      SELECT r."row", c.col, d.v AS value FROM r, c, b LEFT JOIN d ON d."row" = least(floor((r."row" + 0.5) * 3)::INT, nr - 1) AND d.col = least(floor((c.col + 0.5) * 3)::INT, nc - 1)""",
    "fill_holes": f"""WITH {_GRID} SELECT a."row", a.col, coalesce(a.value, b.value) AS value FROM cells a LEFT JOIN (
      SELECT h."row", h.col, v.value, row_number() OVER (PARTITION BY h."row", h.col ORDER BY (h."row" - v."row") * (h."row" - v."row") + (h.col - v.col) * (h.col - v.col), v."row", v.col) AS rk FROM (SELECT * FROM cells WHERE value IS NULL) h, (SELECT * FROM cells WHERE value IS NOT NULL) v) b ON a."row" = b."row" AND a.col = b.col AND rk = 1""",
    "tree_peaks": f"""WITH g AS (SELECT floor(min(x) / 2)::INT AS w, floor(min(y) / 2)::INT AS s, floor(max(y) / 2)::INT + 1 AS n, floor(max(x) / 2)::INT + 1 AS e FROM points WHERE {_OK}),
      m AS (SELECT floor((n * 2.0 - y) / 2)::INT AS "row", floor((x - w * 2.0) / 2)::INT AS col, max(z) AS v FROM points, g WHERE {_OK} AND z IS NOT NULL AND NOT isnan(z) AND classification IN (3, 4, 5) GROUP BY 1, 2)
      SELECT "row", col, v AS value FROM m WHERE v > 40 AND NOT EXISTS (SELECT 1 FROM m o WHERE o."row" BETWEEN m."row" - 1 AND m."row" + 1 AND o.col BETWEEN m.col - 1 AND m.col + 1 AND o.v > m.v)""",
}
