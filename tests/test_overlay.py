import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.functions import geometry as geo
from urbanloom.functions import overlay as ov
from urbanloom.functions import planar
from urbanloom.operators import footprints as fp
from urbanloom.operators import rasters, trees
from urbanloom.queries import shapes


def _square(x, y, size):
    return np.array([(x, y), (x + size, y), (x + size, y + size), (x, y + size)], float)


def _area(polygons):
    return sum(ov.polygon_area(p) for p in polygons)


@pytest.mark.parametrize("seed", range(5))
def test_union_and_difference_by_sampling(seed):
    rng = np.random.default_rng(seed)
    parts = [[planar.hull(rng.uniform(0, 10, 2) + rng.normal(0, 1.5, (8, 2)))] for _ in range(6)]
    at = rng.uniform(-5, 15, (5000, 2))
    inside = np.array([ov.holds(p, at) for p in parts])
    got = np.zeros(len(at), bool)
    for p in ov.union(parts):
        got ^= ov.holds(p, at)
    assert (got != inside.any(axis=0)).sum() <= 2
    got = np.zeros(len(at), bool)
    for p in ov.difference(parts[0], parts[1]):
        got ^= ov.holds(p, at)
    assert (got != (inside[0] & ~inside[1])).sum() <= 2


def test_known_areas():
    a, b = [_square(0, 0, 2)], [_square(1, 1, 2)]
    assert _area(ov.union([a, b])) == pytest.approx(7) and _area(ov.intersection(a, b)) == pytest.approx(1)
    assert [len(p[0]) for p in ov.union([a, [_square(2, 0, 2)]])] == [4]
    assert [len(p) for p in ov.difference([_square(0, 0, 4)], [_square(1, 1, 1)])] == [2]
    far = [_square(250_000, 6_400_000, 4)]
    assert _area(ov.buffered(far, 1)) == pytest.approx(36) and _area(ov.buffered(far, -1)) == pytest.approx(4) and ov.buffered(far, -3) == []
    assert ov.union([]) == [] and ov.union([[np.zeros((2, 2))]]) == []
    assert ov.polygon_area(ov.merge([a, [_square(2.05, 0, 2)]], 0.1)) == pytest.approx(8.1)
    assert ov.polygon_area(ov.merge([a, [_square(20, 20, 2)]], 0.1)) == pytest.approx(84)  # too far: the hull


def test_merging_in_batches_and_broken_rows(spark):
    rows = [(k, [{"x": float(x), "y": float(y)} for x, y in _square(k, 0, 1.5)]) for k in range(30)] + [(40, None), (41, [{"x": 0.0, "y": 0.0}])]
    df = spark.createDataFrame(rows, f"id bigint, ring {planar.RING}").select("id", ov.as_polygon(F.col("ring")).alias("polygon"))
    held = df.where("id < 40")
    groups = fp.merge_groups(held, "id", 0.0)
    got = fp.merged(held, "id", groups, 0.0, at_once=4).select("members", ov.measured(F.col("polygon"), ov.polygon_area).alias("a")).collect()
    assert [(r.members, round(r.a, 6)) for r in got] == [(30, 45.75)]
    odd = df.where("id >= 40").select("id", fp.cleaned(F.col("polygon")).alias("p"), ov.measured(F.col("polygon"), ov.clearance).alias("c")).collect()
    assert all(r.p.shell is None and r.c is None for r in odd)
    assert fp.polygons_within(df.limit(0), "id", 1.0).count() == 0


def test_crowns_with_holes_of_different_shapes(spark):
    holes = {(1, 1), (1, 4), (2, 4), (2, 5)}  # one of 4 corners, one of 6
    cells = [(r, c, 7) for r in range(5) for c in range(8) if (r, c) not in holes]
    segmented = spark.createDataFrame(cells, "row int, col int, top bigint")
    held = trees.crown_polygons(segmented, rasters.Grid(100.0, 200.0, 10.0, 5, 8), tolerance=0.0)
    got = held.select("top", "part", F.transform("polygon.holes", F.size).alias("corners"), ov.measured(F.col("polygon"), ov.polygon_area).alias("area")).collect()
    assert [(r.top, r.part, sorted(r.corners), round(r.area, 6)) for r in got] == [(7, 0, [4, 6], 100.0 * len(cells))]
    assert held.select(F.size(planar.meshed(F.col("polygon")))).first()[0] > 0


def test_merged_boxes_around_holes_of_different_shapes(spark):
    frame = [(0, 0, 80, 10), (0, 40, 80, 50), (0, 0, 10, 50), (70, 0, 80, 50), (30, 0, 40, 50), (55, 5, 75, 20)]  # holes of 4 and 6 corners
    held = spark.createDataFrame([(k, *map(float, b)) for k, b in enumerate(frame)], "id bigint, xmin double, ymin double, xmax double, ymax double")
    held = held.select("id", ov.as_polygon(geo.ring_of((F.col("xmin"), F.col("ymin")), (F.col("xmax"), F.col("ymin")), (F.col("xmax"), F.col("ymax")), (F.col("xmin"), F.col("ymax")))).alias("polygon"))
    got = fp.merged(held, "id", fp.merge_groups(held, "id", 0.0), 0.0).select("component", "members", F.transform("polygon.holes", F.size).alias("corners"), ov.measured(F.col("polygon"), ov.polygon_area).alias("area")).collect()
    assert [(r.component, r.members, sorted(r.corners), round(r.area, 6)) for r in got] == [(0, 6, [4, 6], 80 * 50 - 20 * 30 - 30 * 30 + 15 * 10)]


def test_query_merges_boxes_around_holes_and_those_that_touch(spark, tmp_path):
    frame = [(0, 0, 80, 10), (0, 40, 80, 50), (0, 0, 10, 50), (70, 0, 80, 50), (30, 0, 40, 50), (55, 5, 75, 20)]  # holes of 4 and 6 corners
    side = [(250854.75, 6402179.93, 250919.17, 6402187.44), (250919.17, 6402173.38, 250981.32, 6402208.42)]  # corners within a side, whose place along it is rounded
    a, b = ([np.array([(x, y), (u, y), (u, v), (x, v)])] for x, y, u, v in side)
    assert ov.gap(a, b) == ov.gap(b, a) == 0 and ov.gap(a, [a[0] + (0, 7.52)]) > 0.009
    assert ov.gap([_square(0, 0, 2)], [_square(2, 2, 2)]) == 0 and ov.gap([_square(0, 0, 2)], [_square(5, 0, 2)]) == 3  # a corner; edges on one line
    rows = [(f"{name}{k}", *map(float, box), None, None) for name, boxes in (("f", frame), ("s", side)) for k, box in enumerate(boxes)]
    spark.createDataFrame(rows, "bounds_id string, xmin double, ymin double, xmax double, ymax double, zmin double, zmax double").write.parquet(str(tmp_path / "survey_bounds.parquet"))
    got = shapes.QUERIES["polygon_merged"](spark, str(tmp_path)).orderBy("component").collect()
    assert [tuple(r) for r in got] == [("f0", 6, 2650.0), ("s0", 2, 2661.5)]
