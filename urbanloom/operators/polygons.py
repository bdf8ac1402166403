"""Joins of points, boxes and polygons through shared tiles, and what is built on them.

Both sides are given to square tiles; an equi-join on the tile finds all pairs
that can meet, and the exact test decides. Catalyst broadcasts the polygons
where they are small and shuffles by tile where they aren't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.functions import geometry as geo
from urbanloom.operators.graphs import connected_components
from urbanloom.operators.ranked import exact_percentiles
from urbanloom.operators.roofs import neighbour_outliers
from urbanloom.plans.tables import written

TILE = 32.0


def _tile(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("bigint")


#: Boxes are laid on tiles of the level whose size is next above theirs, so each meets at most four; so many levels at most.
LEVELS, STEP = 12, 4.0


def _level(width: Column, height: Column, tile: float) -> Column:
    """The level of a box: tiles of level k are tile * STEP ** k wide."""
    return F.least(F.greatest(F.ceil(F.log(STEP, F.greatest(width, height, F.lit(tile)) / tile)), F.lit(0)), F.lit(LEVELS)).cast("int")


def _spread(boxes: DataFrame, tile: float) -> tuple[DataFrame, list[int]]:
    """`boxes` once per tile (level, tx, ty) that they meet, and the levels in use (LEVELS + 1 numbers at most)."""
    held = boxes.withColumn("level", _level(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), tile))
    size = F.lit(tile) * F.pow(F.lit(STEP), "level")
    at = lambda c: F.floor(F.col(c) / size).cast("bigint")
    spread = held.withColumn("tx", F.explode(F.sequence(at("xmin"), at("xmax")))).withColumn("ty", F.explode(F.sequence(at("ymin"), at("ymax"))))
    return spread, sorted(r[0] for r in held.select("level").distinct().collect() if r[0] is not None)


def _on_levels(df: DataFrame, x: Column, y: Column, levels: list[int], tile: float) -> DataFrame:
    """`df` once per level with the tile that holds the place."""
    each = [F.struct(F.lit(k).alias("level"), _tile(x, tile * STEP**k).alias("tx"), _tile(y, tile * STEP**k).alias("ty")) for k in levels]
    return df.select("*", F.inline(F.array(*each))) if each else df.select("*", F.lit(0).alias("level"), _tile(x, tile).alias("tx"), _tile(y, tile).alias("ty"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: str, tile: float = TILE) -> DataFrame:
    """Every point with the `key` of each polygon (column `ring`) that holds it. Points with NULL or NaN x or y are in none.

    Only keys and boxes are laid on tiles, on the level of their size; rings join what is left after the box test.
    """
    own = polygons.select(key, "ring").where("ring IS NOT NULL")
    boxes = own.select(key, geo.box_of(F.col("ring")).alias("_b")).select(key, "_b.*")
    spread, levels = _spread(boxes, tile)
    held = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    inside = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    near = _on_levels(held, F.col("x"), F.col("y"), levels, tile).join(spread, ["level", "tx", "ty"]).where(inside).select(*points.columns, key)
    return near.join(own, key).where(geo.contains(F.col("ring"), F.col("x"), F.col("y"))).select(*points.columns, key)


def boxes_within(boxes: DataFrame, key: str, distance: float, tile: float = 4 * TILE) -> DataFrame:
    """Pairs a, b (a < b) of boxes at most `distance` apart (0 where they meet).

    A box is laid on the tiles of its level and asks for boxes of its own and
    every higher level; a pair comes from the least tile that both meet.
    """
    grown = boxes.select(F.col(key).alias("k"), *((F.col(c) + (-distance if c.endswith("min") else distance)).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    spread, levels = _spread(grown, tile)
    ask = grown.withColumn("own", _level(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), tile))
    ask = ask.withColumn("level", F.explode(F.array(*(F.lit(k) for k in levels)) if levels else F.array(F.lit(0)))).where("level >= own")
    size = F.lit(tile) * F.pow(F.lit(STEP), "level")
    at = lambda c: F.floor(F.col(c) / size).cast("bigint")
    ask = ask.withColumn("tx", F.explode(F.sequence(at("xmin"), at("xmax")))).withColumn("ty", F.explode(F.sequence(at("ymin"), at("ymax"))))
    left, right = ask.alias("l"), spread.alias("r")
    first = (F.col("tx") == F.floor(F.greatest("l.xmin", "r.xmin") / size)) & (F.col("ty") == F.floor(F.greatest("l.ymin", "r.ymin") / size))
    once = (F.col("own") < F.col("level")) | (F.col("l.k") < F.col("r.k"))
    joined = left.join(right, ["level", "tx", "ty"]).where((F.col("l.k") != F.col("r.k")) & once & first)
    near = joined.select(F.least("l.k", "r.k").alias("a"), F.greatest("l.k", "r.k").alias("b"))
    side = lambda p: boxes.select(F.col(key).alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("xmin", "ymin", "xmax", "ymax")))
    gap = lambda low, high: F.greatest(F.col(f"b_{low}") - F.col(f"a_{high}"), F.col(f"a_{low}") - F.col(f"b_{high}"), F.lit(0.0))
    dx, dy = gap("xmin", "xmax"), gap("ymin", "ymax")
    return near.join(side("a"), "a").join(side("b"), "b").where(F.sqrt(dx * dx + dy * dy) <= distance).select("a", "b")


def merge_groups(boxes: DataFrame, key: str, distance: float) -> DataFrame:
    """node (the key) and component of every box; boxes chained by gaps of at most `distance` share one."""
    pairs = boxes_within(boxes, key, distance)
    alone = boxes.select(F.col(key).alias("src"), F.col(key).alias("dst"))
    return connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(alone))


def building_heights(buildings: DataFrame, roof_points: DataFrame, ground: DataFrame, percentile: float = 0.9, least: float = 2.5, outliers: tuple[int, float] | None = None) -> DataFrame:
    """building_id, ground_height, roof, height: the percentile of the roof points' z above the ground, at least `least`.

    `ground` has building_id and ground (the terrain at the mean of the
    vertices). A building without roof points gets the least height. With
    `outliers` (neighbours, margin), the roof's points that
    roofs.neighbour_outliers names are left out.
    """
    inside = points_in_polygons(roof_points.where("z IS NOT NULL AND NOT isnan(z) AND coalesce(classification NOT IN (2, 9), true)"), buildings, "building_id")
    inside = written(inside.select("building_id", *(F.col(c).cast("double").alias(c) for c in "xyz")), "roofs")  # read twice
    if outliers is not None:
        inside = inside.join(neighbour_outliers(inside, "building_id", *outliers), ["building_id", "x", "y", "z"], "left_anti")
    roof = exact_percentiles(inside, ["building_id"], "z", {"roof": percentile})
    held = buildings.select("building_id").join(ground.select("building_id", F.col("ground").alias("ground_height")), "building_id", "left").join(roof, "building_id", "left")
    return held.withColumn("height", F.greatest(F.coalesce(F.col("roof") - F.col("ground_height"), F.lit(float(least))), F.lit(float(least))))


def heights_from_attribute(buildings: DataFrame, stated: Column, default: float = 10.0, least: float = 2.5) -> DataFrame:
    """`buildings` with height: what is stated (NULL and NaN: `default`), at least `least`."""
    return buildings.withColumn("height", F.greatest(F.coalesce(F.nanvl(stated, F.lit(None).cast("double")), F.lit(default)), F.lit(least)))


def largest(polygons: DataFrame, key: str) -> DataFrame:
    """key and area of the polygon (column `ring`) with the largest area, of equal ones the last by key. One row."""
    held = polygons.select(key, F.round(geo.area(F.col("ring")), 2).alias("area"))
    return held.agg(F.max_by(key, F.struct("area", key)).alias(key), F.max("area").alias("area"))


def zonal_stats(cells: DataFrame, zones: DataFrame, key: str) -> DataFrame:
    """Per zone over the cells (x, y, value) whose centre it holds: count, min, max, mean, sum, std, var, median, p90, unique, majority, minority."""
    held = points_in_polygons(cells, zones, key)
    basic = held.groupBy(key).agg(F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.sum("value").alias("sum"), F.stddev_pop("value").alias("std"), F.var_pop("value").alias("var"), F.countDistinct("value").alias("unique"))
    often = held.groupBy(key, "value").agg(F.count("*").alias("n")).groupBy(key).agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("majority"), F.min_by("value", F.struct("n", "value")).alias("minority"))
    return basic.join(exact_percentiles(held, [key], "value", {"median": 0.5, "p90": 0.9}), key).join(often, key)


def burn(cells: DataFrame, polygons: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """`cells` (row, col, x, y, value) with the value of the last polygon, by `order`, that holds the cell's centre."""
    hit = points_in_polygons(cells.select("row", "col", "x", "y"), polygons.select(key, "ring"), key).join(polygons.select(key, order, F.col(value).alias("_value")), key)
    last = hit.groupBy("row", "col").agg(F.max_by("_value", F.struct(order, key)).alias("_value"))
    return cells.join(last, ["row", "col"], "left").select("row", "col", F.coalesce("_value", "value").alias("value"))
