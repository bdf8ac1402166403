"""Rasters as tables of cells (row, col, value), row 0 in the north.

Stencils are two passes of windows, along rows and then along columns, so every
cell moves twice whatever the size of the stencil. Edges are symmetric.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from urbanloom.operators.points import GROUND

#: Cells of a raster, at most: a country at half a metre.
MOST_CELLS = 10**13
#: The lines that windows run along: the column that is fixed.
ALONG_ROW, ALONG_COLUMN = "row", "col"


def _along(line: str, back: bool = False) -> WindowSpec:
    at = "col" if line == "row" else "row"
    return Window.partitionBy(line).orderBy(F.desc(at) if back else at)


@dataclass(frozen=True)
class Grid:
    """A georeference: north-west corner, cell size, and numbers of rows and columns."""

    west: float
    north: float
    size: float
    rows: int
    cols: int

    @staticmethod
    def around(points: DataFrame, size: float) -> Grid:
        """The grid of whole multiples of `size` that covers the points. One row comes to the driver."""
        r = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).first()
        if r.a is None:
            return Grid(0.0, 0.0, size, 0, 0)
        west, south = math.floor(r.a / size), math.floor(r.c / size)
        return Grid(west * size, (math.floor(r.d / size) + 1) * size, size, math.floor(r.d / size) + 1 - south, math.floor(r.b / size) + 1 - west)

    def row(self, y: Column) -> Column:
        return F.floor((F.lit(self.north) - y) / self.size).cast("int")

    def col(self, x: Column) -> Column:
        return F.floor((x - self.west) / self.size).cast("int")

    def x(self, col: Column) -> Column:
        return self.west + self.size * (col + 0.5)

    def y(self, row: Column) -> Column:
        return self.north - self.size * (row + 0.5)

    def cells(self, spark: SparkSession) -> DataFrame:
        """All cells, generated where they are used. A stray coordinate makes a raster vast: more than MOST_CELLS raise."""
        if self.rows * self.cols > MOST_CELLS:
            raise ValueError(f"a raster of {self.rows} x {self.cols} cells; crop the points or use larger cells")
        at = spark.range(self.rows * self.cols)
        return at.select(F.floor(F.col("id") / self.cols).cast("int").alias("row"), (F.col("id") % self.cols).cast("int").alias("col"))


def rasterize(points: DataFrame, grid: Grid, ground_only: bool = True, per_unit: int = 0) -> DataFrame:
    """row, col, value, n: the mean z of every cell; cells without points have NULL. Ground only: classes 2 and 9.

    With `per_unit` (1000: millimetres) heights are summed as whole numbers and the
    mean is cut to a whole number, so the result doesn't depend on the order of sums.
    """
    held = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)")
    if ground_only:
        held = held.where(F.col("classification").isin(*GROUND))
    mean = F.floor(F.sum(F.rint(F.col("z") * per_unit).cast("bigint")) / F.count("*")) / float(per_unit) if per_unit else F.avg("z")
    mean = held.groupBy(grid.row(F.col("y")).alias("row"), grid.col(F.col("x")).alias("col")).agg(mean.alias("value"), F.count("*").alias("n"))
    return grid.cells(points.sparkSession).join(mean, ["row", "col"], "left").select("row", "col", "value", F.coalesce("n", F.lit(0)).alias("n"))


def _beside(value: Column, line: str, step: int) -> Column:
    """The value `step` cells on, the edge cell's own beyond the edge (symmetric for one step)."""
    return F.coalesce((F.lead if step > 0 else F.lag)(value, abs(step)).over(_along(line)), value)


def _sum3(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Sums over 3 x 3 cells of each column, as s_<column>."""
    along = {f"_r_{c}": F.col(c) + _beside(F.col(c), ALONG_ROW, -1) + _beside(F.col(c), ALONG_ROW, 1) for c in columns}
    cells = cells.withColumns(along)
    across = {f"s_{c}": F.col(f"_r_{c}") + _beside(F.col(f"_r_{c}"), ALONG_COLUMN, -1) + _beside(F.col(f"_r_{c}"), ALONG_COLUMN, 1) for c in columns}
    return cells.withColumns(across).drop(*along)


def slope_aspect(cells: DataFrame, size: float) -> DataFrame:
    """row, col, value, slope, aspect in radians, by Sobel weights; aspect is atan2(northward, -eastward gradient)."""
    v = F.col("value")
    west, east = _beside(v, ALONG_ROW, -1), _beside(v, ALONG_ROW, 1)
    held = cells.select("row", "col", "value", (west - east).alias("_d"), (west + 2 * v + east).alias("_w"))
    d, w = F.col("_d"), F.col("_w")
    held = held.select("row", "col", "value", ((_beside(d, ALONG_COLUMN, -1) + 2 * d + _beside(d, ALONG_COLUMN, 1)) / (8 * size)).alias("_x"), ((_beside(w, ALONG_COLUMN, -1) - _beside(w, ALONG_COLUMN, 1)) / (8 * size)).alias("_y"))
    return held.select("row", "col", "value", F.atan(F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))).alias("slope"), F.atan2("_y", "_x").alias("aspect"))


def tri(cells: DataFrame) -> DataFrame:
    """Terrain roughness: root of the summed squared differences to the 3 x 3 neighbours."""
    held = _sum3(cells.withColumn("_q", F.col("value") * F.col("value")), ["value", "_q"])
    return held.select("row", "col", F.sqrt(F.greatest(F.col("s__q") - 2 * F.col("s_value") * F.col("value") + 9 * F.col("_q"), F.lit(0.0))).alias("tri"))


def box_mean(cells: DataFrame, column: str, width: int) -> DataFrame:
    """mean_<column> over width x width cells with symmetric edges (the edge cell is mirrored with the rest)."""
    if width % 2 == 0 or width < 3:
        raise ValueError("the width must be odd and at least 3")
    half = width // 2
    for line, at in (("row", "col"), ("col", "row")):
        value = F.col("_m" if line == "col" else column)
        inner = F.sum(value).over(_along(line).rowsBetween(-half, half))
        # mirrored cells: those within half of an edge count again, by how far the frame sticks out
        last = F.max(at).over(Window.partitionBy(line))
        low, high = half - F.col(at), F.col(at) + half - last
        mirror = F.lit(0.0)
        for k in range(half):
            first, end = _edge(value, line, k, False), _edge(value, line, k, True)
            mirror = mirror + F.when(low > k, first).otherwise(0.0) + F.when(high > k, end).otherwise(0.0)
        cells = cells.withColumn("_m", inner + mirror)
    return cells.withColumn(f"mean_{column}", F.col("_m") / (width * width)).drop("_m")


def _edge(value: Column, line: str, k: int, back: bool) -> Column:
    """The k-th value of the line from its start, or from its end."""
    whole = _along(line, back).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.nth_value(value, k + 1).over(whole)


def tpi(cells: DataFrame, width: int = 3) -> DataFrame:
    """Position: the value less the mean of the width x width box."""
    return box_mean(cells, "value", width).select("row", "col", (F.col("value") - F.col("mean_value")).alias("tpi"))


def vrm(cells: DataFrame, size: float, width: int = 3) -> DataFrame:
    """Ruggedness of the unit vectors of slope and aspect, their box mean divided by the width once more."""
    held = slope_aspect(cells, size)
    held = held.select("row", "col", (F.cos("slope") * F.cos("aspect")).alias("a"), (F.cos("slope") * F.sin("aspect")).alias("b"), F.sin("slope").alias("c"))
    for c in "abc":
        held = box_mean(held, c, width)
    size2 = F.col("mean_a") * F.col("mean_a") + F.col("mean_b") * F.col("mean_b") + F.col("mean_c") * F.col("mean_c")
    return held.select("row", "col", F.sqrt(1 - size2 / (width * width)).alias("vrm"))


def erode_dilate(cells: DataFrame) -> DataFrame:
    """row, col, value, kept: the valid cells (value not NULL) after erosion and dilation by a 3 x 3 cross. Beyond the edge nothing is eroded."""
    def cross(column: str, out: str, pick) -> DataFrame:  # noqa: ANN001
        c = F.col(column)
        return lambda df: df.withColumn(out, pick(c, *(_beside(c, w, s) for w in (ALONG_ROW, ALONG_COLUMN) for s in (-1, 1))))

    held = cells.withColumn("_valid", F.col("value").isNotNull().cast("int"))
    held = held.transform(cross("_valid", "_thin", F.least)).transform(cross("_thin", "_open", F.greatest))
    return held.select("row", "col", "value", ((F.col("_open") == 1) & (F.col("_valid") == 1)).alias("kept"))


def to_points(cells: DataFrame, grid: Grid, classification: int = 1) -> DataFrame:
    """A point at the centre of every valid cell."""
    held = cells.where("value IS NOT NULL AND NOT isnan(value)")
    return held.select(grid.x(F.col("col")).alias("x"), grid.y(F.col("row")).alias("y"), F.col("value").alias("z"), F.lit(classification).cast("smallint").alias("classification"))


def sample(points: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """`points` with `ground`: the value of the cell that holds them, NULL outside."""
    at = points.withColumns({"row": grid.row(F.col("y")), "col": grid.col(F.col("x"))})
    return at.join(cells.select("row", "col", F.col("value").alias("ground")), ["row", "col"], "left").drop("row", "col")


def bilinear(points: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """`points` with `ground` interpolated between the four nearest cell centres; beyond the outer centres the edge cell counts."""
    clamp = lambda c, most: F.least(F.greatest(c, F.lit(0)), F.lit(most))
    fx, fy = (F.col("x") - grid.west) / grid.size - 0.5, (F.lit(grid.north) - F.col("y")) / grid.size - 0.5
    held = points.withColumns({"_i": F.floor(fy), "_j": F.floor(fx), "_u": fx - F.floor(fx), "_v": fy - F.floor(fy)})
    corners = F.array(*(F.struct(clamp(F.col("_i") + a, grid.rows - 1).cast("int").alias("row"), clamp(F.col("_j") + b, grid.cols - 1).cast("int").alias("col"), ((F.col("_v") if a else 1 - F.col("_v")) * (F.col("_u") if b else 1 - F.col("_u"))).alias("_part")) for a in (0, 1) for b in (0, 1)))
    keys = [c for c in points.columns]
    spread = held.select(*keys, F.inline(corners))
    return spread.join(cells.select("row", "col", "value"), ["row", "col"]).groupBy(*keys).agg(F.sum(F.col("_part") * F.col("value")).alias("ground"))


def resample_nearest(cells: DataFrame, grid: Grid, scale: int) -> tuple[DataFrame, Grid]:
    """The raster with cells `scale` times as wide: each takes the value of the cell at its centre."""
    new = Grid(grid.west, grid.north, grid.size * scale, math.ceil(grid.rows / scale), math.ceil(grid.cols / scale))
    at = lambda c, most: F.least(F.floor((F.col(c) + 0.5) * scale).cast("int"), F.lit(most - 1))
    wanted = new.cells(cells.sparkSession).select("row", "col", at("row", grid.rows).alias("_r"), at("col", grid.cols).alias("_c"))
    got = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    return wanted.join(got, ["_r", "_c"], "left").select("row", "col", "value"), new


def local_maxima(cells: DataFrame, least: float) -> DataFrame:
    """The cells that equal the maximum of their 3 x 3 neighbourhood and exceed `least`."""
    v = F.col("value")
    row = cells.withColumn("_m", F.greatest(v, _beside(v, ALONG_ROW, -1), _beside(v, ALONG_ROW, 1)))
    m = F.col("_m")
    both = row.withColumn("_t", F.greatest(m, _beside(m, ALONG_COLUMN, -1), _beside(m, ALONG_COLUMN, 1)))
    return both.where((v == F.col("_t")) & (v > least)).select("row", "col", "value")


def fill_holes(cells: DataFrame, rows_hint: int) -> DataFrame:
    """Every NULL cell takes the value of the nearest valid cell (ties: lowest row, then column)."""
    from urbanloom.operators.nearest import nearest

    at = cells.select(F.col("row").cast("double").alias("r0"), F.col("col").cast("double").alias("c0"), "value")
    near = nearest(at.where("value IS NULL").select("r0", "c0"), at.where("value IS NOT NULL").select("r0", "c0"), ["r0", "c0"], rows_hint)
    best = near.groupBy("r0", "c0").agg(F.min(F.struct("distance", F.col("i_r0"), F.col("i_c0"))).alias("b"))
    got = best.select(F.col("r0").cast("int").alias("row"), F.col("c0").cast("int").alias("col"), F.col("b.i_r0").cast("int").alias("_r"), F.col("b.i_c0").cast("int").alias("_c"))
    values = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias("_value"))
    filled = got.join(values, ["_r", "_c"]).select("row", "col", "_value")
    return cells.join(filled, ["row", "col"], "left").select("row", "col", F.coalesce("value", "_value").alias("value"))


def vertex_neighbours(width: int, height: int, index: Column, corners: bool = False) -> Column:
    """The neighbours of a vertex (index = x + y * width) of a lattice of width x height vertices, ascending: over sides, and over corners if asked."""
    x, y = index % width, F.floor(index / width).cast("bigint")
    steps = [(a, b) for b in (-1, 0, 1) for a in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    each = F.array(*(F.when((x + a).between(0, width - 1) & (y + b).between(0, height - 1), index + a + b * width) for a, b in steps))
    return F.array_sort(F.array_compact(each))


def volume_vertices(spark: SparkSession, low: tuple[float, float, float], step: tuple[float, float, float], counts: tuple[int, int, int]) -> DataFrame:
    """vid, x, y, z of a lattice of counts + 1 vertices a side, x running fastest."""
    nx, ny, nz = (c + 1 for c in counts)
    at = spark.range(nx * ny * nz)
    i, j, k = F.col("id") % nx, F.floor(F.col("id") / nx) % ny, F.floor(F.col("id") / (nx * ny))
    return at.select(F.col("id").alias("vid"), *((low[n] + step[n] * v).cast("double").alias(c) for n, (c, v) in enumerate(zip("xyz", (i, j, k), strict=True))))


def bottom_up(cells: DataFrame, grid: Grid) -> DataFrame:
    """index (x + y * columns, y from the south) and value of every cell: the order of a field over a lattice."""
    return cells.select(((F.lit(grid.rows - 1) - F.col("row")).cast("bigint") * grid.cols + F.col("col")).alias("index"), "value")


def from_mesh(vertices: DataFrame, faces: DataFrame, grid: Grid) -> DataFrame:
    """The raster of the mean z of the vertices that a face uses; cells without any have NULL."""
    used = faces.select(F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return rasterize(vertices.join(used, "vid", "left_semi"), grid, ground_only=False).select("row", "col", "value")


def flat(spark: SparkSession, value: float, xmin: float, ymin: float, xmax: float, ymax: float) -> tuple[DataFrame, Grid]:
    """A raster of one cell (as wide as the longer side) over a box."""
    size = max(xmax - xmin, ymax - ymin)
    return spark.range(1).select(F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(float(value)).alias("value")), Grid(xmin, ymax, size, 1, 1)


def tops(cells: DataFrame, width: int, least: float) -> DataFrame:
    """The cells that equal the maximum of the width x width cells around them and are at least `least`; every cell of a flat top is one."""
    if width % 2 == 0:
        raise ValueError("the width must be odd")
    half, held = width // 2, cells.select("row", "col", "value", F.col("value").alias("_m"))
    for line in (ALONG_ROW, ALONG_COLUMN):
        held = held.withColumn("_m", F.max("_m").over(_along(line).rowsBetween(-half, half)))
    return held.where((F.col("value") == F.col("_m")) & (F.col("value") >= least)).select("row", "col", "value")


def touched(polygons: DataFrame, key: str, grid: Grid) -> DataFrame:
    """key, row, col of every cell that a polygon (column `ring`) touches: it holds the centre or an edge crosses the cell."""
    from urbanloom.functions import geometry as geo
    from urbanloom.functions.planar import clipped_area

    box = geo.box_of(F.col("ring"))
    held = polygons.select(key, "ring", box.alias("_b"))
    clamp = lambda c, most: F.least(F.greatest(c, F.lit(0)), F.lit(most - 1))
    held = held.where((F.col("_b.xmax") >= grid.west) & (F.col("_b.xmin") <= grid.west + grid.cols * grid.size) & (F.col("_b.ymin") <= grid.north) & (F.col("_b.ymax") >= grid.north - grid.rows * grid.size))
    rows = F.sequence(clamp(grid.row(F.col("_b.ymax")), grid.rows), clamp(grid.row(F.col("_b.ymin")), grid.rows))
    cols = F.sequence(clamp(grid.col(F.col("_b.xmin")), grid.cols), clamp(grid.col(F.col("_b.xmax")), grid.cols))
    spread = held.withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols))
    low = (grid.west + F.col("col") * grid.size, F.lit(grid.north) - (F.col("row") + 1) * grid.size)
    moved = F.transform("ring", lambda p: F.struct((p.x - low[0]).alias("x"), (p.y - low[1]).alias("y")))
    return spread.where(clipped_area(moved, grid.size) > 1e-9).select(key, "row", "col")


def gaussian(cells: DataFrame, sigma: float) -> DataFrame:
    """Blurred by a normal curve of `sigma` cells, cut off at four of them; beyond the edge the raster is mirrored."""
    reach = int(4 * sigma + 0.5)
    if sigma <= 0 or reach < 1:
        return cells.select("row", "col", "value")
    weight = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(reach + 1)]
    whole = weight[0] + 2 * sum(weight[1:])
    held, v = cells.select("row", "col", "value"), F.col("value")
    for line, at in ((ALONG_ROW, "col"), (ALONG_COLUMN, "row")):
        last = F.max(at).over(Window.partitionBy(line))
        held = held.withColumns({"_last": last} | {f"_l{k}": _edge(v, line, k, False) for k in range(reach)} | {f"_h{k}": _edge(v, line, k, True) for k in range(reach)})
        total = v * (weight[0] / whole)
        for k in range(1, reach + 1):
            for back in (True, False):
                out = (k - 1 - F.col(at)) if back else (F.col(at) + k - 1 - F.col("_last"))
                mirrored = F.coalesce(*(F.when(out == m, F.col(f"_{'l' if back else 'h'}{m}")) for m in range(k)))
                total = total + F.coalesce(mirrored, (F.lag if back else F.lead)(v, k).over(_along(line))) * (weight[k] / whole)
        held = held.select("row", "col", total.alias("value"))
    return held
