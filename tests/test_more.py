import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.functions import names, solids
from urbanloom.operators import cells as cl
from urbanloom.operators import trees
from urbanloom.queries.more import tree_nms


def test_suppression_is_the_greedy_one(spark):
    rng = np.random.default_rng(8)
    at = {(float(x), float(y)): float(h) for x, y, h in zip(rng.integers(0, 60, 250), rng.integers(0, 60, 250), rng.integers(5, 40, 250), strict=True)}
    order = sorted(((h, x, y) for (x, y), h in at.items()), reverse=True)
    kept, gone = [], set()
    for h, x, y in order:
        if (x, y) in gone:
            continue
        kept.append((x, y))
        gone |= {(a, b) for g, a, b in order if (g, a, b) < (h, x, y) and np.hypot(a - x, b - y) <= 5 and h - g < 8 and h - g < 0.3 * h}
    df = spark.createDataFrame([(x, y, h) for (x, y), h in at.items()], "x double, y double, height double")
    assert {(r.x, r.y) for r in trees.suppress_peaks(df, 5.0).collect()} == set(kept)
    assert trees.suppress_peaks(df.limit(0), 5.0).count() == 0


def test_long_chains_are_settled(spark):
    row = spark.range(1000).selectExpr("id * 5.0D AS x", "0.0D AS y", "20.0D AS height")
    assert sorted(r.x for r in trees.suppress_peaks(row, 6.0).collect()) == [5.0 * k for k in range(1, 1000, 2)]


def test_chains_across_strips_are_settled(spark):
    bend = [(5.0 * k, 0.0, 20.0) for k in range(20)] + [(0.0, 5.0 * k, 20.0) for k in range(1, 20)]
    df = spark.createDataFrame(bend, "x double, y double, height double")
    whole, cut = ({(r.x, r.y) for r in trees.suppress_peaks(df, 6.0, rules_a_task=n).collect()} for n in (10**6, 10))
    assert whole == cut and len(whole) == 20


def test_every_peak_has_its_own_radius(spark):
    rng = np.random.default_rng(9)
    at = {(float(x), float(y)): (float(h), float(r)) for x, y, h, r in zip(rng.integers(0, 60, 250), rng.integers(0, 60, 250), rng.integers(5, 40, 250), rng.uniform(0, 9, 250), strict=True)}
    df = spark.createDataFrame([(x, y, h, r) for (x, y), (h, r) in at.items()], "x double, y double, height double, r double")

    def greedy(least, ruled):
        order = sorted(((h, x, y, r) for (x, y), (h, r) in at.items() if r >= least), reverse=True)
        kept, gone = set(), set()
        for h, x, y, r in order:
            if (x, y) not in gone:
                kept.add((x, y))
                gone |= {(a, b) for g, a, b, _ in order if (g, a, b) < (h, x, y) and np.hypot(a - x, b - y) <= r and (not ruled or h - g < min(8, 0.3 * h))}
        return kept

    own = trees.suppress_peaks(df, F.col("r"), least_radius=1.0)
    assert {(r.x, r.y) for r in own.collect()} == greedy(1.0, True)
    bare = trees.suppress_peaks(df, F.col("r"), relative_drop=None, absolute_drop=None)
    assert {(r.x, r.y) for r in bare.collect()} == greedy(0.0, False)


def test_tree_nms_takes_the_crown_of_each_tree(spark, tmp_path):
    rows = [(0.0, 0.0, 20.0, 2.0), (3.0, 0.0, 19.0, 2.0), (50.0, 0.0, 20.0, None), (52.5, 0.0, 19.0, 2.0), (54.5, 0.0, 19.0, 2.0), (90.0, 0.0, 20.0, 0.3)]
    spark.createDataFrame(rows, "x double, y double, height double, crown_radius double").write.parquet(f"{tmp_path}/trees.parquet")
    # 0.22 * 20 ** 0.87 is 2.98
    assert {r.x for r in tree_nms(spark, str(tmp_path)).collect()} == {0.0, 3.0, 50.0, 54.5}


def test_regions(spark):
    picture = ["##..#", "#...#", "..#..", ".#..#"]
    cells = spark.createDataFrame([(r, c, 1.0 if x == "#" else None) for r, line in enumerate(picture) for c, x in enumerate(line)], "row int, col int, value double")
    left = {(r.row, r.col) for r in cl.remove_small_regions(cells, 5, 2).where("value IS NOT NULL").collect()}
    assert left == {(0, 0), (0, 1), (1, 0)}
    sides = cl.regions(cells.where("value IS NOT NULL"), 5, corners=False)
    assert sides.select("region").distinct().count() == 5
    assert cl.small_holes(cells, 5, 1).count() == 0 and cl.small_holes(cells, 5, 20).count() == 12
    ring = spark.createDataFrame([(r, c, None if (r, c) == (1, 1) else 1.0) for r in range(3) for c in range(3)], "row int, col int, value double")
    assert {(r.row, r.col) for r in cl.small_holes(ring, 3, 1).collect()} == {(1, 1)}


def test_small_holes_are_filled_and_large_ones_zero(spark):
    picture = ["11111", "1.1..", "111..", "22222"]
    cells = spark.createDataFrame([(r, c, None if x == "." else float(x)) for r, line in enumerate(picture) for c, x in enumerate(line)], "row int, col int, value double")
    got = {(r.row, r.col): r.value for r in cl.fill_small_holes(cells, 5, 1, 20).collect()}
    assert got == {(r, c): 1.0 if (r, c) == (1, 1) else 0.0 if x == "." else float(x) for r, line in enumerate(picture) for c, x in enumerate(line)}


def test_rays(spark):
    one = lambda *p: tuple(F.lit(float(v)) for v in p)
    square = (one(0, 0, 1), one(1, 0, 1), one(1, 1, 1))
    hit = lambda o, d: spark.range(1).select(solids.ray_triangle(one(*o), one(*d), *square)).first()[0]
    assert hit((0.7, 0.5, 2), (0, 0, -1)) == pytest.approx(1.0)
    assert hit((0.7, 0.5, 2), (0, 0, 1)) is None and hit((0.2, 0.8, 2), (0, 0, -1)) is None and hit((0.7, 0.5, 2), (1, 0, 0)) is None


def test_names():
    assert names.resolve_parameter("weather", "Wind-Speed") == names.resolve_parameter("weather", " 4 ") == names.resolve_parameter("weather", 4) == 4
    with pytest.raises(ValueError, match="no ocean"):
        names.resolve_parameter("ocean", "tide of war")
    assert names.classes_of("vegetation") == (3, 4, 5, 7)
    with pytest.raises(ValueError, match="class group"):
        names.classes_of("cars")


def test_closed_solids(spark):
    from urbanloom.operators.graphs import naked_edges

    vertices, faces = solids.sphere(spark, 1.0, 6)
    assert vertices.count() == 84 and faces.count() == 144
    assert vertices.where("abs(x * x + y * y + z * z - 1) > 1e-9").count() == 0
    assert naked_edges(solids.cylinder(spark, 1.0, 2.0, 10)[1]).count() == 20


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{k}_found" for k in (2, 3, 4, 5)} <= set(entry.queries())


def test_roofs(spark):
    from urbanloom.operators import roofs

    rng = np.random.default_rng(9)
    flat = np.column_stack([rng.random(60) * 10, rng.random(60) * 10, np.zeros(60)])
    rows = [("a", *map(float, p)) for p in flat] + [("a", 5.0, 5.0, 40.0)] + [("b", float(k), 0.0, 0.0) for k in range(4)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    assert (5.0, 5.0, 40.0) in {(r.x, r.y, r.z) for r in roofs.neighbour_outliers(df, "g").where("g = 'a'").collect()}
    assert roofs.neighbour_outliers(df, "g").where("g = 'b'").count() == 0
    n = roofs.normals(df.where("g = 'a' AND z = 0")).collect()
    assert len(n) == 60 and all(r.nz == pytest.approx(1.0) for r in n)
    off = roofs.best_plane(np.vstack([flat, [[1, 1, 9], [2, 2, -9]]]))
    assert off.sum() == 2 and not roofs.best_plane(flat[:8]).any()


def test_city_bundle(spark):
    from urbanloom.plans import city

    rng = np.random.default_rng(10)
    at = rng.random((4000, 2)) * 40
    inside = (np.abs(at[:, 0] - 20) < 5) & (np.abs(at[:, 1] - 20) < 5)
    rows = [("c", k, float(x), float(y), 12.0 if i else 2.0, 6 if i else 2) for k, ((x, y), i) in enumerate(zip(at, inside, strict=True))]
    cloud = spark.createDataFrame(rows, "cloud_id string, point_id bigint, x double, y double, z double, classification smallint")
    square = [{"x": float(x), "y": float(y)} for x, y in ((15, 15), (15, 25), (25, 25), (25, 15))]
    far = [{"x": p["x"] + 500, "y": p["y"]} for p in square]
    prints = spark.createDataFrame([("b", square), ("far", far)], "building_id string, ring array<struct<x:double,y:double>>")
    held = city.City().with_pointcloud(cloud, 0).with_footprints(prints, 10).build_terrain(5.0).remove_outside_terrain().build_lod1()
    r = held.buildings.first()
    assert held.buildings.count() == 1 and r.ground_height == pytest.approx(2) and r.height == pytest.approx(10) and len(r.lod1) == 6
    rows = spark.createDataFrame([("c", None, "City", "{}"), ("b1", "c", "Building", '{"h": 3}'), ("b2", "c", "Building", None)], "object_id string, parent_id string, type string, attributes string")
    assert city.objects(rows)["roots"].count() == 1 and city.objects(rows)["children"].where("parent_type = 'City'").count() == 2
    assert {tuple(x) for x in city.child_attribute(rows, "Building", "h", "0").collect()} == {("b1", "3"), ("b2", "0")}
    geometries = spark.createDataFrame([("b1", "MESH", "m1"), ("b2", "MESH", "m2"), ("c", "POINT", "p")], "object_id string, geometry_type string, geometry string")
    assert city.flatten(rows, geometries, "MESH").where("object_id = 'c'").count() == 2


def test_packages(spark, tmp_path):
    import sqlite3
    import struct

    from urbanloom.sources import files, packages

    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]
    body = struct.pack("<BIII", 1, 3, 1, 4) + b"".join(struct.pack("<2d", *p) for p in ring)
    many = struct.pack("<BII", 1, 6, 2) + body + body
    assert packages.decode_wkb(many) == [[ring], [ring]]
    with sqlite3.connect(tmp_path / "a.gpkg") as db:
        db.execute("CREATE TABLE prints (fid INTEGER PRIMARY KEY, geom BLOB)")
        db.executemany("INSERT INTO prints VALUES (?, ?)", [(1, b"GP\x00\x01" + struct.pack("<i", 3006) + body), (2, b"GP\x00\x03" + struct.pack("<i4d", 3006, 0, 4, 0, 3) + many), (3, None)])
    got = packages.read_gpkg_polygons(spark, str(tmp_path), "prints").collect()
    assert sorted((r.fid, r.part, len(r.ring)) for r in got) == [(1, 0, 4), (2, 0, 4), (2, 1, 4)]
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n0 1 0.5\n3 0 1 2\n")
    v, f = files.load(spark, str(tmp_path / "a.ply"), "mesh")
    assert v.count() == 3 and tuple(f.first()) == ("a", 0, 0, 1, 2)
    with pytest.raises(ValueError, match="suffix"):
        files.load(spark, "a.xyz", "mesh")


def test_solids_close(spark):
    from urbanloom.functions import geometry as geo
    from urbanloom.operators import meshes
    from urbanloom.operators.graphs import naked_edges

    vertices = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 1.0), (2, 0.0, 1.0, 1.0), (3, 1.0, 1.0, 2.0)], "vid bigint, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 3, 2)], "fid bigint, v0 bigint, v1 bigint, v2 bigint")
    v, f = meshes.solid(vertices, faces, 0.0, 4)
    assert v.count() == 8 and f.count() == 12 and naked_edges(f).count() == 0
    assert meshes.open_boundary(f, v, "z", 0.0).count() == 10
    line = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 4.0}, {"x": 3.0, "y": 4.0}, {"x": 3.0, "y": 9.0}],)], "line array<struct<x:double,y:double>>")
    got = line.select(F.transform(geo.road_surfaces(F.col("line"), 2.0), geo.area).alias("a")).first().a
    assert got == pytest.approx([10.0, 10.0])


def test_city_heights_leave_roof_outliers_out(spark):
    from urbanloom.operators import rasters
    from urbanloom.plans import city

    roof = [(2.0 + k % 5, 2.0 + k // 5, 10.0, 6) for k in range(17)] + [(3.0, 3.0, 60.0, 6), (5.0, 4.0, 90.0, 6), (4.0, 5.0, 120.0, 6)]
    points = spark.createDataFrame(roof, "x double, y double, z double, classification int")
    prints = spark.createDataFrame([("b", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])], "building_id string, ring array<struct<x: double, y: double>>")
    terrain = spark.createDataFrame([(r, c, 0.0) for r in range(10) for c in range(10)], "row int, col int, value double")
    held = city.City(points=points, terrain=terrain, grid=rasters.Grid(0.0, 10.0, 1.0, 10, 10)).with_footprints(prints)
    assert held.building_heights().buildings.first().height == 10.0
    assert held.building_heights(outliers=None).buildings.first().height > 50.0
