"""Raster operators on connected regions, smoothing, triangulation and mosaics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.operators.graphs import connected_components
from urbanloom.operators.rasters import ALONG_COLUMN, ALONG_ROW, _beside, fill_holes


def regions(cells: DataFrame, width: int, corners: bool = True) -> DataFrame:
    """row, col, region of every cell of `cells`: connected over sides, and over corners if `corners`. region is the least row * width + col."""
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if corners else [])]
    here = cells.select("row", "col")
    at = here.select("row", "col", F.inline(F.array(*(F.struct((F.col("row") + a).alias("_r"), (F.col("col") + b).alias("_c")) for a, b in steps))))
    there = here.select(F.col("row").alias("_r"), F.col("col").alias("_c"))
    number = lambda r, c: (F.col(r).cast("bigint") * width + F.col(c))
    edges = at.join(there, ["_r", "_c"]).select(number("row", "col").alias("src"), number("_r", "_c").alias("dst")).union(here.select(number("row", "col"), number("row", "col")))
    found = connected_components(edges)
    return found.select(F.floor(F.col("node") / width).cast("int").alias("row"), (F.col("node") % width).cast("int").alias("col"), F.col("component").alias("region"))


def remove_small_regions(cells: DataFrame, width: int, most: int) -> DataFrame:
    """`cells` (row, col, value) with the valid regions of at most `most` cells made NULL."""
    found = regions(cells.where("value IS NOT NULL"), width)
    small = found.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    dropped = found.join(small, "region").select("row", "col", F.lit(True).alias("_drop"))
    return cells.join(dropped, ["row", "col"], "left").select("row", "col", F.when(F.col("_drop").isNull(), F.col("value")).alias("value"))


def small_holes(cells: DataFrame, width: int, most: int) -> DataFrame:
    """row, col of the invalid cells in holes (connected over sides) of at most `most` cells."""
    found = regions(cells.where("value IS NULL"), width, corners=False)
    small = found.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    return found.join(small, "region", "left_semi").select("row", "col")


def fill_small_holes(cells: DataFrame, width: int, most: int, rows_hint: int) -> DataFrame:
    """`cells` (row, col, value) with the holes of at most `most` cells filled from the nearest valid cell, and larger holes made 0."""
    small = small_holes(cells, width, most).withColumn("_small", F.lit(True))
    filled = fill_holes(cells, rows_hint).withColumnRenamed("value", "_filled")
    held = cells.join(filled, ["row", "col"]).join(small, ["row", "col"], "left")
    return held.select("row", "col", F.when(F.col("value").isNotNull() | F.col("_small").isNotNull(), F.col("_filled")).otherwise(0.0).alias("value"))


def smooth(cells: DataFrame, sweeps: int = 1) -> DataFrame:
    """Each cell becomes the mean of its four neighbours, all at once per sweep; beyond the edge the cell itself counts."""
    v = F.col("value")
    for _ in range(sweeps):
        cells = cells.select("row", "col", ((_beside(v, ALONG_ROW, -1) + _beside(v, ALONG_ROW, 1) + _beside(v, ALONG_COLUMN, -1) + _beside(v, ALONG_COLUMN, 1)) / 4).alias("value"))
    return cells


def binomial(cells: DataFrame) -> DataFrame:
    """A Gaussian-like blur: weights 1, 2, 1 along rows, then along columns."""
    v = F.col("value")
    row = cells.select("row", "col", ((_beside(v, ALONG_ROW, -1) + 2 * v + _beside(v, ALONG_ROW, 1)) / 4).alias("value"))
    return row.select("row", "col", ((_beside(v, ALONG_COLUMN, -1) + 2 * v + _beside(v, ALONG_COLUMN, 1)) / 4).alias("value"))


def grid_triangles(rows: Column | int, cols: int, cells: DataFrame) -> DataFrame:
    """Two triangles per quad of neighbouring cell centres: fid, v0, v1, v2 with vertex row * cols + col."""
    quad = cells.where((F.col("row") < rows - 1) & (F.col("col") < cols - 1)).select((F.col("row").cast("bigint") * cols + F.col("col")).alias("q"))
    halves = F.array(F.struct((F.col("q") * 2).alias("fid"), F.col("q").alias("v0"), (F.col("q") + cols).alias("v1"), (F.col("q") + 1).alias("v2")), F.struct((F.col("q") * 2 + 1).alias("fid"), (F.col("q") + 1).alias("v0"), (F.col("q") + cols).alias("v1"), (F.col("q") + cols + 1).alias("v2")))
    return quad.select(F.inline(halves))
