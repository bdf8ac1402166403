"""Filters, aggregates and set operations of point clouds.

A cloud is rows of (cloud_id, point_id, x, y, z, classification, intensity,
return_number, num_returns); an absent attribute is NULL. All operators are
plain column expressions, so filters reach the Parquet scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VEGETATION = (3, 4, 5)
GROUND = (2, 9)


@dataclass(frozen=True)
class Box:
    """A closed box; z may be open."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float
    zmin: float = -math.inf
    zmax: float = math.inf

    def holds(self, x: Column, y: Column, z: Column | None = None) -> Column:
        inside = x.between(self.xmin, self.xmax) & y.between(self.ymin, self.ymax)
        return inside if z is None else inside & z.between(self.zmin, self.zmax)


def crop(points: DataFrame, box: Box, xy_only: bool = True) -> DataFrame:
    """The points in a box, edges included."""
    return points.where(box.holds(F.col("x"), F.col("y"), None if xy_only else F.col("z")))


def z_range(points: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """The points with z within the inclusive range; an end that is None is open."""
    kept = points.where("NOT isnan(z)")
    kept = kept if low is None else kept.where(F.col("z") >= low)
    return kept if high is None else kept.where(F.col("z") <= high)


def by_class(points: DataFrame, classes: list[int], keep: bool = True) -> DataFrame:
    """The points of the classes, or all others; a point without a class is of none."""
    listed = F.coalesce(F.col("classification").isin(classes), F.lit(False))
    return points.where(listed if keep else ~listed)


def vegetation(points: DataFrame, keep: bool = True) -> DataFrame:
    """Vegetation per cloud: the points of classes 3 to 5 where the cloud has any, else those that
    are not the last return (and of class 1 where classified). `keep` False gives all others."""
    has = points.groupBy("cloud_id").agg(F.max(F.coalesce(F.col("classification").isin(*VEGETATION), F.lit(False))).alias("_has"))
    by_return = (F.col("return_number") != F.col("num_returns")) & (F.col("classification").isNull() | (F.col("classification") == 1))
    is_green = F.coalesce(F.when(F.col("_has"), F.col("classification").isin(*VEGETATION)).otherwise(by_return), F.lit(False))
    return points.join(has, "cloud_id").where(is_green if keep else ~is_green).drop("_has")


def _z_spread(points: DataFrame) -> DataFrame:
    return points.where("z IS NOT NULL AND NOT isnan(z)").groupBy("cloud_id").agg(F.avg("z").alias("_mean"), F.stddev_pop("z").alias("_std"))


def global_outliers(points: DataFrame, margin: float = 3.0, keep: bool = False) -> DataFrame:
    """The points whose z is more than `margin` population deviations from the mean of their cloud (keep False drops them)."""
    far = F.abs(F.col("z") - F.col("_mean")) > F.col("_std") * margin
    held = points.where("z IS NOT NULL AND NOT isnan(z)").join(_z_spread(points), "cloud_id")
    return held.where(far if keep else ~far).drop("_mean", "_std")


def cloud_bounds(points: DataFrame) -> DataFrame:
    """Per cloud its box and number of points; coordinates that are NULL or NaN don't count."""
    ends = [f(F.nanvl(c, F.lit(None).cast("double"))).alias(f"{c}{n}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    return points.groupBy("cloud_id").agg(F.count("*").alias("n"), *ends)


def used_classes(points: DataFrame) -> DataFrame:
    """The distinct classes of every cloud."""
    return points.where("classification IS NOT NULL").select("cloud_id", "classification").distinct()


def merge(*clouds: DataFrame) -> DataFrame:
    """All points of several clouds; attributes that one lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), clouds)


def offset(points: DataFrame, dx: float = 0.0, dy: float = 0.0, dz: float = 0.0) -> DataFrame:
    return points.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy, "z": F.col("z") + dz})


def keep_points(points: DataFrame, ids: DataFrame) -> DataFrame:
    """The points whose point_id is in `ids`."""
    return points.join(ids.select("point_id"), "point_id", "left_semi")


def remove_points(points: DataFrame, ids: DataFrame) -> DataFrame:
    """The points whose point_id is not in `ids`."""
    return points.join(ids.select("point_id"), "point_id", "left_anti")


def manifest(points: DataFrame, file: str = "strip_id") -> DataFrame:
    """One row per file with its box: what a reader prunes by."""
    return points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").groupBy(file).agg(F.count("*").alias("n"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def overlapping(boxes: DataFrame, box: Box) -> DataFrame:
    """The boxes that meet a box, touching edges included."""
    return boxes.where((F.col("xmin") <= box.xmax) & (F.col("xmax") >= box.xmin) & (F.col("ymin") <= box.ymax) & (F.col("ymax") >= box.ymin))


def nearest_gap(value: Column, others: Column) -> Column:
    """The distance of a value to the nearest element of an array."""
    return F.array_min(F.transform(others, lambda o: F.abs(o - value)))
