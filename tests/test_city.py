import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.functions import crs, planar
from urbanloom.functions import geometry as geo
from urbanloom.operators import graphs, meshes, points, polygons, rasters, sensors
from urbanloom.operators.ranked import exact_percentiles
from urbanloom.plans import registry
from urbanloom.sources import files, grids, lidar, vectors


def _ring(spark, corners):
    return spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in corners],)], f"ring {planar.RING}")


def test_ring_expressions(spark):
    r = F.col("ring")
    df = _ring(spark, [(0, 0), (4, 0), (4, 3), (0, 3)])
    got = df.select(geo.area(r), geo.perimeter(r), geo.is_convex(r), geo.contains(r, F.lit(1.0), F.lit(1.0)), geo.contains(r, F.lit(5.0), F.lit(1.0)), geo.ring_distance(r, F.lit(7.0), F.lit(7.0)), F.size(geo.split_sides(r, 2.0)), F.size(geo.extrude(r, F.lit(0.0), F.lit(2.0))), geo.vertex_mean(r).x).first()
    assert tuple(got) == (12.0, 14.0, True, True, False, 5.0, 8, 6, 2.0)
    dent = _ring(spark, [(0, 0), (4, 0), (2, 1), (4, 3), (0, 3)])
    assert tuple(dent.select(geo.is_convex(r), geo.contains(r, F.lit(3.5), F.lit(1.2)), F.size(geo.without_short_edges(r, 2.5))).first()) == (False, False, 4)


def test_planar():
    rng = np.random.default_rng(0)
    h = planar.hull(np.vstack([rng.random((50, 2)), [[0, 0], [1, 0], [1, 1], [0, 1]]]))
    assert {tuple(p) for p in h} == {(0, 0), (1, 0), (1, 1), (0, 1)}
    line = np.array([(0, 0), (1, 0.01), (2, 0), (3, 2), (4, 0)], float)
    assert planar.simplify(line, 0.1).tolist() == [[0, 0], [2, 0], [3, 2], [4, 0]]
    square = planar.clip(np.array([(-1, -1), (3, -1), (3, 3), (-1, 3)], float), 0, 0, 2, 2)
    assert sorted(map(tuple, square.tolist())) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    dent = np.array([(0, 0), (4, 0), (2, 1), (4, 3), (0, 3)], float)
    area = lambda t: abs(np.cross(np.append(dent[t[1]] - dent[t[0]], 0), np.append(dent[t[2]] - dent[t[0]], 0))[2]) / 2
    assert sum(area(t) for t in planar.ears(dent)) == pytest.approx(9.0)
    assert planar.hull(np.zeros((0, 2))).shape[0] == 0 and planar.ears(dent[:2]) == []


def test_planar_columns(spark):
    df = _ring(spark, [(0, 0), (4, 0), (2, 1), (4, 3), (0, 3)])
    r = F.col("ring")
    got = df.select(geo.area(planar.convex_hull(r)), F.size(planar.triangulated(r)), geo.area(planar.clipped(r, 0.0, 0.0, 1.0, 1.0)), F.size(planar.simplified(r, 100.0))).first()
    assert tuple(got) == (12.0, 3, 1.0, 2)


def test_crs_round_trip(spark):
    # the meridian itself, and a control point of the national grid
    x, y = crs.to_plane("lon", "lat")
    lon, lat = crs.to_sphere("x", "y")
    df = spark.createDataFrame([(15.0, 60.0), (11.0, 57.5), (24.1, 65.8)], "lon double, lat double")
    plane = df.select("lon", "lat", F.expr(x).alias("x"), F.expr(y).alias("y"))
    back = plane.select("lon", "lat", "x", "y", F.expr(lon).alias("lo"), F.expr(lat).alias("la")).collect()
    for r in back:
        assert r.lo == pytest.approx(r.lon, abs=1e-9) and r.la == pytest.approx(r.lat, abs=1e-9)
    assert back[0].x == pytest.approx(500_000) and back[0].y == pytest.approx(6_651_411.19, abs=0.01)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, 5000), (None, 3)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graphs.connected_components(df).collect()}
    assert got == {a: find(a) for a in list(parent)}


def test_mesh_quality(spark):
    s = math.sqrt(3) / 2
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.5, s, 0.0), (3, 0.5, s / 3, math.sqrt(2 / 3)), (4, 3.0, 0.0, 0.0)], "vid bigint, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 1, 4)], "fid bigint, v0 bigint, v1 bigint, v2 bigint")
    got = {r.fid: r for r in meshes.triangle_quality(f, v).collect()}
    assert (got[0].quality, got[0].aspect_ratio, got[0].edge_ratio) == pytest.approx((1, 1, 1)) and got[0].skewness == pytest.approx(0, abs=1e-9)
    assert got[1].quality == 0
    c = spark.createDataFrame([(0, 0, 1, 2, 3)], "cid bigint, v0 bigint, v1 bigint, v2 bigint, v3 bigint")
    t = meshes.tetrahedron_quality(c, v).first()
    assert (t.quality, t.aspect_ratio, t.edge_ratio) == pytest.approx((1, 1, 1)) and t.skewness == pytest.approx(0, abs=1e-6)
    assert graphs.tet_boundary(c).count() == 4 and graphs.naked_edges(f).count() == 4
    assert meshes.layers(f.where("fid = 0"), 2, 5).count() == 6


def test_box_mean_has_symmetric_edges(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 50, (6, 7)).astype(float)
    cells = spark.createDataFrame([(r, c, float(a[r, c])) for r in range(6) for c in range(7)], "row int, col int, value double")
    padded = np.pad(a, 2, mode="symmetric")
    want = np.array([[padded[r : r + 5, c : c + 5].mean() for c in range(7)] for r in range(6)])
    for x in rasters.box_mean(cells, "value", 5).collect():
        assert x.mean_value == pytest.approx(want[x.row, x.col])
    with pytest.raises(ValueError, match="odd"):
        rasters.box_mean(cells, "value", 4)


def test_exact_percentiles(spark):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 30, 200).astype(float)
    df = spark.createDataFrame([(None if k % 2 else 1, float(v)) for k, v in enumerate(values)] + [(1, None), (1, float("nan"))], "g int, v double")
    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", {"m": 0.5, "q": 0.9}).collect()}
    assert got[1].m == pytest.approx(np.quantile(values[::2], 0.5)) and got[None].q == pytest.approx(np.quantile(values[1::2], 0.9))


def test_tiles_do_not_change_polygon_joins(spark):
    rng = np.random.default_rng(5)
    at = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(rng.random((300, 2)) * 100)] + [(900, None, 1.0)], "point_id bigint, x double, y double")
    rings = [[(x, y), (x + 20, y + 5), (x + 8, y + 9), (x + 3, y + 25)] for x, y in rng.random((15, 2)) * 90]
    polys = spark.createDataFrame([(f"b{k}", [{"x": float(a), "y": float(b)} for a, b in r]) for k, r in enumerate(rings)], f"building_id string, ring {planar.RING}")
    runs = [{(r.point_id, r.building_id) for r in polygons.points_in_polygons(at, polys, "building_id", t).collect()} for t in (3.0, 16.0, 500.0)]
    assert runs[0] == runs[1] == runs[2] and runs[0]


def test_cloud_filters(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 0.0, 1.0, 2, 1, 1), ("a", 2, 1.0, 1.0, 2.0, None, 1, 2), ("b", 3, 2.0, 2.0, float("nan"), 4, 1, 1), ("b", 4, None, 2.0, 3.0, 1, 1, 2)], "cloud_id string, point_id bigint, x double, y double, z double, classification smallint, return_number tinyint, num_returns tinyint")
    ids = lambda d: sorted(r.point_id for r in d.collect())
    assert ids(points.by_class(df, [2])) == [1] and ids(points.by_class(df, [2], False)) == [2, 3, 4]
    assert ids(points.vegetation(df)) == [2, 3] and ids(points.vegetation(df, False)) == [1, 4]
    assert ids(points.z_range(df, 2.0)) == [2, 4] and ids(points.crop(df, points.Box(0, 0, 1, 1))) == [1, 2]
    assert ids(points.global_outliers(df)) == [1, 2, 4]


def test_registry(spark):
    from dataclasses import dataclass

    @dataclass(frozen=True)
    class Arguments:
        bounds: tuple
        n: int = 3

    held = registry.register(registry.Dataset("numbers", Arguments, lambda s, a: s.range(a.n)))
    assert registry.get("numbers")(spark, bounds=(0, 0, 1, 1), n=5).count() == 5
    assert held.options()["n"]["default"] == 3 and "numbers" in registry.datasets()
    registry.as_view(spark, "numbers", bounds=(0, 0, 1, 1))
    assert spark.sql("SELECT * FROM numbers").count() == 3
    for bad in ((0, 0, 0, 1), (0, 0, 1), (0, 0, 0, 1, 1, 0)):
        with pytest.raises(ValueError, match="bounds"):
            held(spark, bounds=bad)
    registry.unregister("numbers")
    with pytest.raises(KeyError):
        registry.get("numbers")


def test_las_round_trip(spark, tmp_path):
    rng = np.random.default_rng(6)
    at = rng.random((500, 3)) * 100 + [250_000, 6_400_000, 30]
    df = spark.createDataFrame([(f"c{k % 2}", k, *map(float, p), k % 30, k, 1 + k % 3, 3) for k, p in enumerate(at)], lidar.POINTS)
    written = files.save(df, str(tmp_path), "point_cloud", "las", points_a_file=100)
    assert written.agg(F.sum("n"), F.count("*")).first()[0] == 500
    back = lidar.read_las(spark, str(tmp_path))
    got = sorted((round(r.x, 3), round(r.y, 3), round(r.z, 3), r.classification, r.intensity, r.return_number, r.num_returns) for r in back.collect())
    assert got == sorted((round(x, 3), round(y, 3), round(z, 3), k % 30, k, 1 + k % 3, 3) for k, (x, y, z) in enumerate(at))
    ends = lidar.las_manifest(spark, str(tmp_path)).agg(F.sum("n"), F.min("xmin"), F.max("zmax")).first()
    assert ends[0] == 500 and ends[1] == pytest.approx(at[:, 0].min()) and ends[2] == pytest.approx(at[:, 2].max())
    with pytest.raises(ValueError, match="LAS"):
        lidar.header(b"x" * 300)


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("1,2,3,5\n4,5,6\nx,1,1\n\n")
    assert {tuple(r) for r in lidar.read_xyz(spark, str(tmp_path / "a.xyz")).collect()} == {(1, 2, 3, 5), (4, 5, 6, 1)}
    (tmp_path / "a.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    cells, grid = grids.read_asc(spark, str(tmp_path / "a.asc"))
    assert (grid.west, grid.north, grid.rows, grid.cols) == (10, 30, 2, 3)
    assert {(r.row, r.col): r.value for r in cells.collect()}[(1, 1)] is None
    assert sorted(tuple(r) for r in grids.asc_rows(cells).collect()) == [(0, "1.0 2.0 3.0"), (1, "4.0 -9999.0 6.0")]
    assert grids.read_world_file("0.5\n0\n0\n-0.5\n10\n20\n") == (0.5, 0, 10, 0, -0.5, 20)
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1 2 3 4\nf 1/1 2/2 3/3\n")
    (tmp_path / "b.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nf -3 -2 -1\n")
    v, f = files.load(spark, str(tmp_path), "mesh", "obj")
    assert {(r.file, r.v0, r.v1, r.v2) for r in f.collect()} == {("a", 0, 1, 2), ("a", 0, 2, 3), ("b", 0, 1, 2)} and f.count() == 4
    v, f = v.where("file = 'a'"), f.where("file = 'a'")
    assert v.count() == 4 and f.count() == 3
    assert [r.line.split()[0] for r in grids.obj_lines(v, f).collect()] == ["v"] * 4 + ["f"] * 3
    corners = np.arange(18, dtype=float).reshape(2, 3, 3)
    assert np.array_equal(grids.decode_stl(grids.encode_stl(corners)), corners)


def test_vector_formats(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 3], [0, 0]]
    text = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": 7}, "geometry": {"type": "Polygon", "coordinates": [ring, ring]}}, {"type": "Feature", "properties": {"id": 8}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4], [3, 5.005]]}}]}
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps(text))
    polys = vectors.read_geojson_polygons(spark, str(path)).collect()
    assert len(polys) == 3 and all(len(p.ring) == 3 for p in polys) and [len(p.holes) for p in polys] == [1, 0, 0]
    lines = vectors.read_geojson_lines(spark, str(path))
    v, e = vectors.road_graph(lines)
    assert v.count() == 2 and e.first().length == pytest.approx(6.005)
    out = vectors.geojson_features(spark.createDataFrame(polys).select("ring", F.lit("k").alias("id")), "id").first().value
    assert json.loads(out)["geometry"]["coordinates"][0] == ring
    city = {"type": "CityJSON", "transform": {"scale": [0.5, 0.5, 1], "translate": [10, 20, 0]}, "vertices": [[0, 0, 0], [2, 4, 6]], "CityObjects": {"b1": {"type": "Building", "attributes": {"h": 3}, "geometry": [{"type": "Solid", "lod": "2", "boundaries": [1]}, {"type": "MultiSurface", "lod": "2", "boundaries": [2]}, {"type": "MultiSurface", "lod": "3", "boundaries": [3]}]}, "p1": {"type": "BuildingPart", "parents": ["b1"], "geometry": []}}}
    (tmp_path / "c.json").write_text(json.dumps(city))
    vertices, objects = vectors.read_cityjson(spark, str(tmp_path / "c.json"))
    assert {tuple(r) for r in vertices.collect()} == {(0, 10, 20, 0), (1, 11, 22, 6)}
    assert {r.object_id: r.parents for r in objects.collect()} == {"b1": None, "p1": ["b1"]}
    assert vectors.preferred_geometry(objects).first().boundaries == "[2]"
    osm = {"elements": [*({"type": "node", "id": k, "lat": k, "lon": 2 * k} for k in range(4)), {"type": "way", "id": 9, "nodes": [0, 1, 2]}, {"type": "way", "id": 10, "nodes": [3, 1]}]}
    (tmp_path / "o.json").write_text(json.dumps(osm))
    assert {r.way_id: len(r.line) for r in vectors.read_osm_ways(spark, str(tmp_path / "o.json"), True).collect()} == {9: 4}
    assert vectors.read_osm_ways(spark, str(tmp_path / "o.json"), False).count() == 2


def test_sensors_and_stream(spark, tmp_path):
    import datetime as dt

    from urbanloom.streaming.latest import latest_stream

    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, "s", "t", 1.0, "C", "G", at(1)), (2, "s", "t", float("nan"), "C", "G", at(3)), (3, "s", "w", 5.0, "m", "G", at(2)), (4, "r", "t", None, "C", "G", None)]
    df = spark.createDataFrame(rows, "obs_id bigint, station_id string, field string, value double, unit string, quality string, ts timestamp_ntz")
    got = {(r.station_id, r.field): r.value for r in sensors.latest(df).collect()}
    assert got == {("s", "t"): None, ("s", "w"): 5.0}
    assert sensors.drop_all_missing(sensors.latest(df)).count() == 2
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = latest_stream(stream).writeStream.outputMode("complete").format("memory").queryName("latest_readings").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.station_id, r.field): r.value for r in spark.sql("SELECT * FROM latest_readings").collect()} == got
