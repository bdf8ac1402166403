"""Boxes (xmin, ymin, xmax, ymax, and zmin, zmax where wanted) as rows: measures, set operations, tiles, superset tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.operators.polygons import boxes_within

SIDES = ["xmin", "ymin", "xmax", "ymax"]


def measures(boxes: DataFrame) -> DataFrame:
    """`boxes` with width, height, depth, area, volume, cx, cy and is_point; depth and volume are NULL where z is."""
    w, h, d = (F.col(f"{c}max") - F.col(f"{c}min") for c in "xyz")
    middle = lambda c: (F.col(f"{c}min") + F.col(f"{c}max")) / 2
    return boxes.withColumns({"width": w, "height": h, "depth": d, "area": w * h, "volume": w * h * d, "cx": middle("x"), "cy": middle("y"), "is_point": (w == 0) & (h == 0)})


def buffered(boxes: DataFrame, distance: float) -> DataFrame:
    """Every side moved out by a distance."""
    return boxes.withColumns({c: F.col(c) + (-distance if c.endswith("min") else distance) for c in SIDES})


def union(boxes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The box around all boxes (of every group of `keys`), and their number n."""
    ends = [(F.min if c.endswith("min") else F.max)(c).alias(c) for c in SIDES]
    return boxes.groupBy(*(keys or [])).agg(*ends, F.count("*").alias("n"))


def overlaps(boxes: DataFrame, key: str) -> DataFrame:
    """a, b and the intersection of every two boxes that meet."""
    return _paired(boxes, key).select("a", "b", *((F.greatest if c.endswith("min") else F.least)(f"a_{c}", f"b_{c}").alias(c) for c in SIDES))


def nested(boxes: DataFrame, key: str) -> DataFrame:
    """outer, inner of every two boxes of which one holds the other, edges included; equal boxes hold each other."""
    held = _paired(boxes, key)
    inside = lambda o, i: (F.col(f"{o}_xmin") <= F.col(f"{i}_xmin")) & (F.col(f"{o}_ymin") <= F.col(f"{i}_ymin")) & (F.col(f"{o}_xmax") >= F.col(f"{i}_xmax")) & (F.col(f"{o}_ymax") >= F.col(f"{i}_ymax"))
    either = F.array(*(F.struct(F.col(o).alias("outer"), F.col(i).alias("inner"), inside(o, i).alias("holds")) for o, i in (("a", "b"), ("b", "a"))))
    return held.select(F.inline(either)).where("holds").select("outer", "inner")


def _paired(boxes: DataFrame, key: str) -> DataFrame:
    side = lambda p: boxes.select(F.col(key).alias(p), *(F.col(c).alias(f"{p}_{c}") for c in SIDES))
    return boxes_within(boxes, key, 0.0).join(side("a"), "a").join(side("b"), "b")


def supersets(requests: DataFrame, boxes: DataFrame, request: str, key: str, tile: float = 128.0) -> DataFrame:
    """request and key of every box that holds a requested box whole, edges included: it can serve the request."""
    at = lambda c: F.floor((F.col(f"{c}min") + F.col(f"{c}max")) / 2 / tile).cast("bigint")
    wanted = requests.select(F.col(request).alias("_q"), *(F.col(c).alias(f"_{c}") for c in SIDES), at("x").alias("tx"), at("y").alias("ty"))
    from urbanloom.functions.geometry import tiles_of

    spread = boxes.select(key, *SIDES, F.inline(tiles_of(*(F.col(c) for c in SIDES), tile)))
    held = wanted.join(spread, ["tx", "ty"]).where("xmin <= _xmin AND ymin <= _ymin AND xmax >= _xmax AND ymax >= _ymax")
    return held.select(F.col("_q").alias(request), key)


def tiles(boxes: DataFrame, width: float, height: float | None = None) -> DataFrame:
    """`boxes` once per tile (i, j from the low corner) with the tile's sides, the last ones cut at the box; a box without extent has one tile."""
    high = width if height is None else height
    count = lambda c, s: F.greatest(F.ceil((F.col(f"{c}max") - F.col(f"{c}min")) / s).cast("int"), F.lit(1))
    held = boxes.withColumns({"_m": count("x", width), "_n": count("y", high)})
    held = held.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    low = {"xmin": F.col("xmin") + F.col("i") * width, "ymin": F.col("ymin") + F.col("j") * high}
    top = {"xmax": F.least(F.col("xmin") + (F.col("i") + 1) * width, F.col("xmax")), "ymax": F.least(F.col("ymin") + (F.col("j") + 1) * high, F.col("ymax"))}
    return held.withColumns(low | top).drop("_m", "_n")
