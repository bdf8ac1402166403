import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.functions import geometry as geo
from urbanloom.functions import surfaces as sf
from urbanloom.operators import footprints as fp
from urbanloom.operators import cells, meshes, polygons, rasters, trees
from urbanloom.plans.city import City

XYZ = "array<struct<x:double,y:double,z:double>>"


def _flooded(height, tops, least):
    """Flooding from the tops, the highest cell first: the label of the cell that reached a cell first."""
    label, heap = {}, []
    for r, c in tops:
        label[r, c] = (r, c)
        heapq.heappush(heap, (-height[r, c], r, c))
    while heap:
        _, r, c = heapq.heappop(heap)
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                at = (r + a, c + b)
                if 0 <= at[0] < height.shape[0] and 0 <= at[1] < height.shape[1] and at not in label and height[at] >= least:
                    label[at] = label[r, c]
                    heapq.heappush(heap, (-height[at], *at))
    return label


@pytest.mark.parametrize("seed", [0, 1])
def test_segments_against_flooding(spark, seed):
    rng = np.random.default_rng(seed)
    height = rng.permutation(14 * 17).reshape(14, 17).astype(float)  # no ties
    least = 40.0
    cells = spark.createDataFrame([(r, c, float(height[r, c])) for r in range(14) for c in range(17)], "row int, col int, value double")
    peaks = [tuple(p) for p in np.argwhere(height == np.array([[height[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2].max() for c in range(17)] for r in range(14)])) if height[tuple(p)] >= least]
    frame = lambda tops: spark.createDataFrame([(int(r), int(c)) for r, c in tops], "row int, col int")
    found = lambda tops: {(r.row, r.col): divmod(r.top, 17) for r in trees.segments(cells, 17, frame(tops), least).collect()}
    basins = found(peaks)
    assert basins == {tuple(map(int, k)): tuple(map(int, v)) for k, v in _flooded(height, peaks, least).items()}
    # with fewer tops whole basins join others, and a basin that has one keeps it
    some = [tuple(map(int, p)) for p in peaks[::3]]
    joined = found(some)
    assert set(joined.values()) == set(some) and all(joined[k] == v for k, v in basins.items() if v in some)
    assert all(joined[k] == joined[v] for k, v in basins.items() if v in joined)


def test_windows_and_blur(spark):
    rng = np.random.default_rng(3)
    value = rng.normal(size=(9, 11))
    cells = spark.createDataFrame([(r, c, float(value[r, c])) for r in range(9) for c in range(11)], "row int, col int, value double")
    got = {(r.row, r.col) for r in rasters.tops(cells, 5, -10.0).collect()}
    assert got == {(r, c) for r in range(9) for c in range(11) if value[r, c] == value[max(0, r - 2) : r + 3, max(0, c - 2) : c + 3].max()}
    weight = np.exp(-0.5 * (np.arange(-3, 4) / 0.8) ** 2)
    wide = np.pad(value, 3, mode="symmetric")
    want = sum(weight[i] * weight[j] * wide[i : i + 9, j : j + 11] for i in range(7) for j in range(7)) / weight.sum() ** 2
    assert all(r.value == pytest.approx(want[r.row, r.col]) for r in rasters.gaussian(cells, 0.8).collect())
    with pytest.raises(ValueError, match="crop"):
        rasters.Grid(0.0, 0.0, 1.0, 10**8, 10**8).cells(spark)


def test_boxes_of_all_sizes_pair_once(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(120):
        x, y = rng.uniform(-2000, 2000, 2)
        w, h = 10 ** rng.uniform(-1, 3.5, 2)
        rows.append((k, float(x), float(y), float(x + w), float(y + h)))
    rows += [(200, 0.0, 0.0, 0.0, 0.0), (201, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, xmin double, ymin double, xmax double, ymax double")
    for d in (0.0, 30.0):
        gap = lambda p, q: np.hypot(max(q[1] - p[3], p[1] - q[3], 0), max(q[2] - p[4], p[2] - q[4], 0))
        want = sorted((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and gap(p, q) <= d)
        assert sorted(tuple(r) for r in polygons.boxes_within(df, "id", d).collect()) == want
    at = spark.createDataFrame([(k, *map(float, rng.uniform(-2500, 2500, 2))) for k in range(500)] + [(900, None, 1.0)], "pid int, x double, y double")
    ring = geo.ring_of((F.col("xmax"), F.col("ymin")), (F.col("xmax"), F.col("ymax")), (F.col("xmin"), F.col("ymax")), (F.col("xmin"), F.col("ymin")))
    got = sorted((r.pid, r.id) for r in polygons.points_in_polygons(at, df.select("id", ring.alias("ring")), "id").collect())
    assert got == sorted((p.pid, b[0]) for p in at.collect() for b in rows if p.x is not None and b[1] <= p.x < b[3] and b[2] <= p.y < b[4])
    assert polygons.boxes_within(df.limit(0), "id", 1.0).count() == 0
    assert polygons.points_in_polygons(at, df.limit(0).select("id", ring.alias("ring")), "id").count() == 0


def test_edges_count_on_the_left_and_below(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    places = {(0.0, 1.0): True, (1.0, 0.0): True, (2.0, 1.0): False, (1.0, 2.0): False, (0.0, 0.0): True, (2.0, 2.0): False, (1.0, 1.0): True, (3.0, 1.0): False}
    for ring in (square, square[::-1]):
        df = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring], *p) for p in places], "ring array<struct<x:double,y:double>>, px double, py double")
        got = {(r.px, r.py): r.inside for r in df.select("px", "py", geo.contains(F.col("ring"), F.col("px"), F.col("py")).alias("inside")).collect()}
        assert got == places


def test_surfaces(spark):
    rows = [(0, [(0, 0, 0), (1, 0, 0), (1, 1, 0)]), (1, [(0, 0, 0), (1, 1, 0), (0, 1, 0)]), (2, [(0, 0, 1), (1, 0, 1), (1, 1, 1)]), (3, [(0, 0, 0), (1, 0, 0), (1, 1, 0.5), (0, 1, 0)]), (4, [(0, 0, 0), (1, 1, 1), (2, 2, 2)])]
    df = spark.createDataFrame([(k, [{"x": float(x), "y": float(y), "z": float(z)} for x, y, z in r]) for k, r in rows], f"sid int, ring {XYZ}").withColumn("o", F.lit("o"))
    got = {r.sid: (r.n, r.p) for r in df.select("sid", sf.normal(F.col("ring")).alias("n"), sf.is_planar(F.col("ring")).alias("p")).collect()}
    assert tuple(got[0][0]) == (0, 0, 1) and got[0][1] and not got[3][1] and got[4] == (None, False)
    merged = {r.sid: (r.members, r.area) for r in fp.merge_coplanar(df.where("sid < 3"), "o").collect()}
    assert merged == {0: (2, pytest.approx(1.0)), 2: (1, pytest.approx(0.5))}


def test_facets_and_smoothing(spark):
    marks = {0: -2, 1: -1, 2: -1, 3: 0, 4: 0, 5: 2, 6: 1, 7: 0, 8: 2, 9: 2}
    cases = {(0, 1, 2): -2, (1, 2, 1): -1, (1, 3, 4): -1, (3, 4, 7): 0, (3, 4, 5): 0, (3, 5, 8): 0, (3, 4, 6): -1, (3, 6, 5): -1, (5, 8, 9): 2}
    facets = spark.createDataFrame([tuple(c) for c in cases], "v0 bigint, v1 bigint, v2 bigint")
    got = {(r.v0, r.v1, r.v2): r.marker for r in meshes.facet_markers(facets, spark.createDataFrame(list(marks.items()), "vid bigint, marker int"), 2).collect()}
    assert got == cases
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 3.0), (2, 0.0, 1.0, 6.0), (9, 5.0, 5.0, 5.0)], "vid bigint, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2)], "fid bigint, v0 bigint, v1 bigint, v2 bigint")
    smooth = {r.vid: (r.x, r.y, r.z) for r in meshes.smooth_mesh(vertices, faces, z_only=True).collect()}
    assert smooth == {0: (0, 0, 4.5), 1: (1, 0, 3), 2: (0, 1, 1.5), 9: (5, 5, 5)}


def test_volume_mesh_works_out_the_terrain_once(spark):
    rng = np.random.default_rng(6)
    grid = rasters.Grid(0.0, 60.0, 10.0, 6, 7)
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def read(z):
        reads.add(1)
        return z

    flat = spark.createDataFrame([(r, c, float(rng.uniform(0, 5))) for r in range(6) for c in range(7)], "row int, col int, value double")
    boxes = {"a": (8.0, 8.0, 37.0, 26.0, 30.0), "b": (40.0, 30.0, 70.0, 60.0, 4.0)}
    corner = lambda x, y: {"x": x, "y": y}
    blocks = spark.createDataFrame([(k, [corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)], 0.0, h) for k, (x0, y0, x1, y1, h) in boxes.items()], "building_id string, ring array<struct<x:double,y:double>>, ground_height double, height double")
    held = City(buildings=blocks).with_terrain(flat.select("row", "col", read("value").alias("value")), grid)
    lifted, tets = held.volume_mesh(20.0, 3)
    got = {r.cid: (r.v0, r.v1, r.v2, r.v3) for r in tets.collect()}
    at = {r.vid: np.array([r.x, r.y, r.z]) for r in lifted.collect()}
    assert reads.value == 42
    every = {r.cid: (r.v0, r.v1, r.v2, r.v3) for r in meshes.layers(cells.grid_triangles(6, 7, flat), 3, 42).collect()}
    centre = {k: sum(at[v] for v in t) / 4 for k, t in every.items()}
    within = {k for k, (x, y, z) in centre.items() if any(x0 <= x < x1 and y0 <= y < y1 and z < h for x0, y0, x1, y1, h in boxes.values())}
    assert len(every) == 540 and 0 < len(within) < 270 and got == {k: t for k, t in every.items() if k not in within}
