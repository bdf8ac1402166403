"""Tree tops and crowns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.operators.nearby import radius_pairs
from urbanloom.plans.tables import written

RULES_A_TASK = 200_000


def crown_radius(height: Column, a: float = 0.22, b: float = 0.87, low: float = 0.8, high: float = 6.0) -> Column:
    """The usual crown radius at a height, within bounds."""
    return F.least(F.greatest(a * F.pow(height, F.lit(b)), F.lit(low)), F.lit(high))


def suppress_peaks(peaks: DataFrame, radius: float | Column, relative_drop: float | None = 0.3, absolute_drop: float | None = 8.0, least_radius: float = 0.0, rules_a_task: int = RULES_A_TASK) -> DataFrame:
    """The peaks (x, y, height; one per position) that greedy suppression in height order keeps.

    A kept peak suppresses every lower one within its own `radius` (a number, or
    a column of `peaks`) whose height is less than `absolute_drop` and less than
    the share `relative_drop` below its own; None leaves a condition out. Peaks
    whose radius is under `least_radius` are dropped first; those with a NULL or
    NaN radius suppress nothing.
    The order is height, then x, then y. In each round every task decides, in
    that order, the peaks of its strip whose stronger neighbours are decided or
    in the strip too; strips run along x and y by turns. That gives the
    sequential result; a chain of neighbours takes a round for each strip that
    it enters, not for each link. Rounds go on until no peak is open: the
    highest open one is always decided, so they end.
    """
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    held = peaks.select("x", "y", "height", r.cast("double").alias("r")).where("height IS NOT NULL AND NOT isnan(height)").where(F.col("r").isNull() | (F.col("r") >= least_radius))
    probes = held.select("x", "y", "r", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("height").alias("sh"))
    pairs = radius_pairs(held, ["x", "y"], held.count(), probes=probes).select(F.col("i_x").alias("wx"), F.col("i_y").alias("wy"), "sx", "sy", "sh")
    weak = held.select(F.col("x").alias("wx"), F.col("y").alias("wy"), F.col("height").alias("wh"))
    rules = pairs.join(weak, ["wx", "wy"]).where("struct(sh, sx, sy) > struct(wh, wx, wy)").select("sh", "sx", "sy", "wh", "wx", "wy")
    drop = F.col("sh") - F.col("wh")
    if absolute_drop is not None:
        rules = rules.where(drop < absolute_drop)
    if relative_drop is not None:
        rules = rules.where(drop < relative_drop * F.col("sh"))
    rules = written(rules, "rules")
    # a peak that no open rule can suppress is kept, unless it is gone
    open_rules, gone, turn = rules, None, 0
    while count := open_rules.count():
        ruled = open_rules.select(F.col("wx").alias("sx"), F.col("wy").alias("sy"), F.lit(False).alias("kept")).distinct()
        flagged = open_rules.join(ruled, ["sx", "sy"], "left").select("sh", "sx", "sy", "wh", "wx", "wy", F.coalesce("kept", F.lit(True)).alias("kept"))
        strips = flagged.repartitionByRange(-(-count // rules_a_task), *(("wx", "wy") if turn % 2 else ("wy", "wx")))
        decided = written(strips.mapInArrow(_decide, "x double, y double, gone boolean"), "decided")
        out = decided.where("gone").select("x", "y")
        gone = out if gone is None else gone.union(out)
        rest = open_rules.join(decided.select(F.col("x").alias("wx"), F.col("y").alias("wy")), ["wx", "wy"], "left_anti")
        open_rules = written(rest.join(out.select(F.col("x").alias("sx"), F.col("y").alias("sy")), ["sx", "sy"], "left_anti"), "rules")
        turn += 1
    return held.select("x", "y", "height") if gone is None else held.join(gone, ["x", "y"], "left_anti").select("x", "y", "height")


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x, y, gone of the peaks that the rules of one strip decide; it holds all open rules of each of its weak peaks."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rules = pa.Table.from_batches(held)
    sx, sy, wh, wx, wy = (rules.column(c).to_numpy() for c in ("sx", "sy", "wh", "wx", "wy"))
    order = np.lexsort((wy, wx, wh))[::-1]
    sx, sy, wx, wy = sx[order], sy[order], wx[order], wy[order]
    kept = rules.column("kept").to_numpy()[order].tolist()
    new = np.append(True, (wx[1:] != wx[:-1]) | (wy[1:] != wy[:-1]))
    first = np.flatnonzero(new)
    place = {at: k for k, at in enumerate(zip(wx[first].tolist(), wy[first].tolist(), strict=True))}
    strong = [place.get(at, -1) for at in zip(sx.tolist(), sy.tolist(), strict=True)]
    state: list[bool | None] = []  # True: gone, False: kept, None: open
    for low, high in zip(first.tolist(), [*first[1:].tolist(), len(strong)], strict=True):
        above = [False if kept[i] else state[strong[i]] if strong[i] >= 0 else None for i in range(low, high)]
        state.append(True if False in above else None if None in above else False)
    at = np.array([k for k, x in enumerate(state) if x is not None], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(wx[first][at]), pa.array(wy[first][at]), pa.array([state[k] for k in at.tolist()], pa.bool_())], names=["x", "y", "gone"])


def canopy(vegetation_top: DataFrame, ground: DataFrame, least: float = 2.0) -> DataFrame:
    """row, col, value: the height of the vegetation above the ground, 0 below `least`."""
    held = vegetation_top.select("row", "col", F.col("value").alias("_top")).join(ground.select("row", "col", F.col("value").alias("_ground")), ["row", "col"], "right")
    high = F.coalesce(F.col("_top") - F.col("_ground"), F.lit(0.0))
    return held.select("row", "col", F.when(high >= least, high).otherwise(0.0).alias("value"))


#: Least height of a tree, width of the blur in cells, width of the window of tops, and least crown radius, by kind of wood.
KINDS = {"urban": (2.5, 0.9, 3, 0.6), "mixed": (3.0, 0.7, 3, 0.8), "dense": (3.5, 0.6, 3, 1.0), "arid": (2.0, 0.2, 3, 0.4)}
#: The least radius that suppression works with, whatever the kind.
LEAST_RADIUS = 0.6


def segments(heights: DataFrame, width: int, tops: DataFrame, least: float) -> DataFrame:
    """row, col, top (row * width + col of a top) of every cell of at least `least` that the watershed gives to a top.

    `heights` (row, col, value) is dense. Cells flow to the highest of the nine
    around them (ties: the later row, then column) and so form one basin a peak;
    a basin without a top joins, whole, the neighbour over its highest pass, again
    and again. With a top on every peak that is what flooding from the tops gives;
    beside basins without a top flooding may draw the border elsewhere. Basins that touch no
    other stay out if they have no top. Of several tops in a basin the highest counts, of equal ones the last.
    """
    from pyspark.sql import Window

    from urbanloom.operators.graphs import connected_components
    from urbanloom.operators.rasters import ALONG_COLUMN, ALONG_ROW, _along

    number = lambda r, c: F.col(r).cast("bigint") * width + F.col(c)
    high = F.when(F.col("value") >= least, F.struct("value", "row", "col"))
    held = heights.withColumn("_up", high)
    for line in (ALONG_ROW, ALONG_COLUMN):
        held = held.withColumn("_up", F.max("_up").over(_along(line).rowsBetween(-1, 1)))
    valid = written(held.where(F.col("value") >= least).select("row", "col", "value", number("row", "col").alias("node"), (F.col("_up.row").cast("bigint") * width + F.col("_up.col")).alias("up")), "valid")
    basin = connected_components(valid.select(F.col("node").alias("src"), F.col("up").alias("dst"))).withColumnRenamed("component", "basin")
    cells = written(valid.join(basin, "node").select("row", "col", "value", "node", "basin"), "basins")
    marks = cells.join(tops.select("row", "col"), ["row", "col"]).groupBy("basin").agg(F.max_by("node", F.struct("value", "row", "col")).alias("top"))
    # the highest pass between every two basins that touch
    beside = cells.select("value", "basin", F.inline(F.array(*(F.struct((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col")) for a, b in ((0, 1), (1, 0), (1, 1), (1, -1))))))
    other = cells.select("row", "col", F.col("value").alias("_v"), F.col("basin").alias("_b"))
    passes = beside.join(other, ["row", "col"]).where("basin != _b").groupBy(F.least("basin", "_b").alias("a"), F.greatest("basin", "_b").alias("b")).agg(F.max(F.least("value", "_v")).alias("height"))
    passes = written(passes, "passes")
    label = written(cells.select("basin").distinct().join(marks, "basin", "left").select("basin", F.col("basin").alias("part"), "top"), "labels")
    while True:
        ends = lambda c: label.select(F.col("basin").alias(c), F.col("part").alias(f"_{c}"), F.col("top").alias(f"_top_{c}"))  # noqa: E731, B023
        links = passes.join(ends("a"), "a").join(ends("b"), "b").where("_a != _b")
        both = links.select("_a", "_b", "_top_a", "height").union(links.select("_b", "_a", "_top_b", "height"))
        first = F.row_number().over(Window.partitionBy("_a").orderBy(F.desc("height"), "_b"))
        chosen = both.where("_top_a IS NULL").withColumn("_n", first).where("_n = 1").select(F.col("_a").alias("src"), F.col("_b").alias("dst"))
        chosen = written(chosen, "joined")
        if chosen.limit(1).count() == 0:
            break
        parts = connected_components(chosen).select(F.col("node").alias("part"), "component")
        moved = label.join(parts, "part", "left").select("basin", F.coalesce("component", "part").alias("part"), "top")
        tops_of = moved.groupBy("part").agg(F.min("top").alias("_top"))
        label = written(moved.join(tops_of, "part").select("basin", "part", F.col("_top").alias("top")), "labels")
    return cells.join(label.where("top IS NOT NULL").select("basin", "top"), "basin").select("row", "col", "top")


def segment_radius(segmented: DataFrame, size: float) -> DataFrame:
    """top, cells, radius: the root of half the area of every segment."""
    return segmented.groupBy("top").agg(F.count("*").alias("cells")).withColumn("radius", F.sqrt(F.col("cells") * (size * size) / 2))


def crown_polygons(segmented: DataFrame, grid, least_area: float = 1.0, tolerance: float | None = None) -> DataFrame:  # noqa: ANN001
    """top, part, polygon (georeferenced, simplified by `tolerance`, two cells if None) of every part of a segment of at least `least_area`.

    Cells that touch at a corner only are different parts, the largest first.
    Runs of cells along rows are rectangles, which are united in bounded lists."""
    from pyspark.sql import Window

    from urbanloom.functions import overlay as ov
    from urbanloom.operators import footprints as fp

    run = F.col("col") - F.row_number().over(Window.partitionBy("top", "row").orderBy("col"))
    runs = segmented.withColumn("_run", run).groupBy("top", "row", "_run").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    x = lambda c: grid.west + c * grid.size
    y = lambda r: F.lit(grid.north) - r * grid.size
    left, right, low, high = x(F.col("a")), x(F.col("b") + 1), y(F.col("row") + 1), y(F.col("row"))
    corner = lambda cx, cy: F.struct(cx.cast("double").alias("x"), cy.cast("double").alias("y"))
    ring = F.array(corner(left, low), corner(right, low), corner(right, high), corner(left, high))
    held = written(runs.select(F.concat_ws("-", "top", "row", "a").alias("node"), "top", ov.as_polygon(ring).alias("polygon")), "runs")
    whole = fp.united(held, "node", held.select("node", F.col("top").alias("component"))).select(F.col("component").alias("top"), F.posexplode("parts").alias("part", "polygon"))
    large = whole.where(ov.measured(F.col("polygon"), ov.polygon_area) >= least_area)
    slim = 2 * grid.size if tolerance is None else tolerance
    return large.select("top", "part", fp.simplified(F.col("polygon"), slim).alias("polygon")) if slim > 0 else large


def canopy_model(points: DataFrame, ground: DataFrame, grid, kind: str = "urban", buildings: DataFrame | None = None, smallest: int = 4, largest_hole: int = 2) -> DataFrame:  # noqa: ANN001
    """row, col, value: the height of the vegetation above the ground raster, on its grid.

    The mean z of vegetation points outside `buildings` (building_id, ring) per
    cell, without thin lines and regions of fewer than `smallest` cells, small
    holes filled, less the ground, 0 below the kind's least height, blurred."""
    from urbanloom.operators import cells as cl
    from urbanloom.operators import points as pc
    from urbanloom.operators import polygons, rasters

    least, sigma, _, _ = _kind(kind)
    green = pc.vegetation(points)
    if buildings is not None:
        green = pc.remove_points(green, polygons.points_in_polygons(green, buildings, "building_id"))
    held = written(rasters.rasterize(green, grid, ground_only=False).select("row", "col", "value"), "green")
    held = rasters.erode_dilate(held).select("row", "col", F.when(F.col("kept"), F.col("value")).alias("value"))
    held = written(cl.remove_small_regions(held, grid.cols, smallest - 1) if smallest > 1 else held, "green")
    if largest_hole > 0:
        filled = cl.fill_small_holes(held, grid.cols, largest_hole, grid.rows * grid.cols)
        held = filled.select("row", "col", F.when(F.col("value") != 0, F.col("value")).alias("value"))
    high = held.join(ground.select("row", "col", F.col("value").alias("_ground")), ["row", "col"]).select("row", "col", F.coalesce(F.col("value") - F.col("_ground"), F.lit(0.0)).alias("value"))
    high = high.withColumn("value", F.when(F.col("value") >= least, F.col("value")).otherwise(0.0))
    return rasters.gaussian(high, sigma)


def _kind(kind: str) -> tuple[float, float, int, float]:
    if kind not in KINDS:
        raise ValueError(f"no kind of wood {kind}; there are {', '.join(KINDS)}")
    return KINDS[kind]


def trees_of(heights: DataFrame, ground: DataFrame, grid, kind: str = "urban") -> DataFrame:  # noqa: ANN001
    """x, y, z, height, crown_radius of every tree of a canopy raster (row, col, value): the tops that greedy suppression
    within their segments' radius keeps, at the cell's corner, z from the ground raster."""
    from urbanloom.operators import rasters

    least, _, window, _ = _kind(kind)
    found = written(rasters.tops(heights, window, least), "tops")
    radius = segment_radius(segments(heights, grid.cols, found, 0.001), grid.size)
    number = F.col("row").cast("bigint") * grid.cols + F.col("col")
    peaks = found.withColumn("top", number).join(radius, "top").select(F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), F.col("value").alias("height"), (F.col("radius") / grid.size).alias("r"))
    peaks = written(peaks, "peaks")
    kept = suppress_peaks(peaks, F.col("r"), least_radius=LEAST_RADIUS / grid.size).select("x", "y").join(peaks, ["x", "y"])
    at = kept.select(F.col("y").cast("int").alias("row"), F.col("x").cast("int").alias("col"), "height", (F.col("r") * grid.size).alias("crown_radius"))
    held = at.join(ground.select("row", "col", F.col("value").alias("z")), ["row", "col"], "left")
    return held.select((grid.west + F.col("col") * grid.size).alias("x"), (F.lit(grid.north) - F.col("row") * grid.size).alias("y"), "z", "height", "crown_radius")
