"""Cleaning and merging of footprints, and grouping of surfaces.

Changes of one polygon are Arrow-batched functions next to the scan; merging
goes through groups that chained gaps make, in two steps of bounded lists, so no
task holds a whole district however long the chain is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanloom.functions import geometry as geo
from urbanloom.functions import overlay as ov
from urbanloom.functions import surfaces as sf
from urbanloom.operators.graphs import connected_components
from urbanloom.operators.polygons import boxes_within
from urbanloom.plans.tables import written

#: Polygons that are merged at once.
AT_ONCE = 64


def polygons_within(polygons: DataFrame, key: str, distance: float) -> DataFrame:
    """Pairs a, b (a < b) of polygons (column `polygon`) at most `distance` apart, 0 where they meet.

    Boxes are paired through tiles, then the polygons' own distance decides. NULL polygons are in no pair."""
    held = polygons.where("polygon.shell IS NOT NULL")
    boxes = held.select(key, geo.box_of(F.col("polygon.shell")).alias("b")).select(key, "b.*")
    side = lambda p: held.select(F.col(key).alias(p), F.col("polygon").alias(f"_{p}"))
    near = boxes_within(boxes, key, distance).join(side("a"), "a").join(side("b"), "b")
    return near.where(ov.gap_of(F.col("_a"), F.col("_b")) <= distance).select("a", "b")


def merge_groups(polygons: DataFrame, key: str, distance: float, least_area: float = 0.0) -> DataFrame:
    """node (the key) and component of every polygon; those chained by gaps of at most `distance` share one.

    Polygons smaller than `least_area` that touch nothing are left out."""
    pairs = written(polygons_within(polygons, key, distance), "pairs")
    kept = polygons.withColumn("_area", ov.measured(F.col("polygon"), ov.polygon_area)).select(key, "_area")
    touched = pairs.select(F.col("a").alias(key)).union(pairs.select("b")).distinct().withColumn("_near", F.lit(True))
    alone = kept.join(touched, key, "left").where(F.coalesce("_near", F.lit(False)) | (F.col("_area") >= least_area))
    return connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(alone.select(F.col(key).alias("src"), F.col(key).alias("dst"))))


def merged(polygons: DataFrame, key: str, groups: DataFrame, tolerance: float, at_once: int = AT_ONCE) -> DataFrame:
    """component, members, polygon: the polygons of every group as one (functions.overlay.merge)."""
    held = united(polygons, key, groups, at_once)
    return held.select("component", "members", ov.merged_list(F.col("parts"), tolerance).alias("polygon"))


def united(polygons: DataFrame, key: str, groups: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """component, members, parts: the union of every group, as the array of its parts.

    Groups are united `at_once` neighbours at a time, again and again until one row is left of each."""
    held = polygons.select(F.col(key).alias("node"), "polygon").join(groups, "node").select("component", "node", F.array("polygon").alias("parts"), F.lit(1).cast("bigint").alias("members"), geo.box_of(F.col("polygon.shell")).xmin.alias("at"))
    while True:
        place = F.row_number().over(Window.partitionBy("component").orderBy("at", "node")) - 1
        lists = held.withColumn("_batch", F.floor(place / at_once)).groupBy("component", "_batch").agg(F.sum("members").alias("members"), F.min("at").alias("at"), F.min("node").alias("node"), F.flatten(F.collect_list("parts")).alias("parts"))  # `at_once` rows at most
        # neighbours of a batch may be in the next one, so what stays apart is kept apart until the last
        held = written(lists.select("component", "node", ov.united(F.col("parts")).alias("parts"), "members", "at"), "merged")
        if held.groupBy("component").count().where("count > 1").limit(1).count() == 0:
            return held.select("component", "members", "parts")


def simplified(polygon: Column, tolerance: float = 0.5) -> Column:
    return ov.changed(polygon, ov.simplified_polygon, tolerance)


def without_slivers(polygon: Column, tolerance: float) -> Column:
    return ov.changed(polygon, ov.without_slivers, tolerance)


def with_clearance(polygon: Column, target: float = 0.5) -> Column:
    return ov.changed(polygon, ov.cleared, target)


def without_small_holes(polygon: Column, least: float = 1.0) -> Column:
    """The polygon without holes smaller than `least`."""
    return ov.changed(polygon, ov.large_holes, least)


def cleaned(polygon: Column, clearance: float = 0.5, least_hole: float = 1.0) -> Column:
    """Repaired (the largest part counts), small holes filled, corners and gaps brought to the clearance."""
    return ov.changed(polygon, ov.cleaned, clearance, least_hole)


def outline(surfaces: DataFrame, key: str, tolerance: float = 0.01) -> DataFrame:
    """`key`, members, polygon: the surfaces (ring) of every object laid on the ground as one polygon; upright ones have no area and drop out."""
    flat = surfaces.select(key, F.transform("ring", lambda p: geo.point(p.x, p.y)).alias("ring")).where(geo.area(F.col("ring")) > 1e-6)
    held = flat.select(F.monotonically_increasing_id().alias("node"), F.col(key).alias("component"), ov.as_polygon(F.col("ring")).alias("polygon"))
    held = written(held, "flat")
    return merged(held.select("node", "polygon"), "node", held.select("node", "component"), tolerance).withColumnRenamed("component", key)


def coplanar_groups(surfaces: DataFrame, key: str, tolerance: float = 1e-5) -> DataFrame:
    """node and component of every surface (sid, unique; `key`, ring): those of an object that share an edge and a plane are one group."""
    end = lambda p: F.concat_ws(" ", F.bround(p.x, 6), F.bround(p.y, 6), F.bround(p.z, 6))
    edges = surfaces.select(key, "sid", F.explode(geo.per_edge(F.col("ring"), lambda p, q: F.array_sort(F.array(end(p), end(q))))).alias("edge"))
    other = edges.select(key, "edge", F.col("sid").alias("other"))
    pairs = edges.join(other, [key, "edge"]).where("sid < other").select("sid", "other").distinct()
    side = lambda a, b: surfaces.select(F.col("sid").alias(a), F.col("ring").alias(b))
    flat = pairs.join(side("sid", "_a"), "sid").join(side("other", "_b"), "other").where(sf.coplanar(F.col("_a"), F.col("_b"), tolerance))
    return connected_components(flat.select(F.col("sid").alias("src"), F.col("other").alias("dst")).union(surfaces.select("sid", "sid")))


def merge_coplanar(surfaces: DataFrame, key: str, tolerance: float = 1e-5) -> DataFrame:
    """`key`, sid (the least of the group), members, normal, area of the surfaces that coplanar neighbours make together."""
    groups = coplanar_groups(surfaces, key, tolerance)
    held = surfaces.join(groups, F.col("sid") == F.col("node")).select(key, "component", "sid", sf.area(F.col("ring")).alias("area"), sf.normal(F.col("ring")).alias("normal"))
    return held.groupBy(key, F.col("component").alias("sid")).agg(F.count("*").alias("members"), F.min_by("normal", F.col("sid")).alias("normal"), F.sum("area").alias("area"))
