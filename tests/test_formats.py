import json

import numpy as np
import pytest

from urbanloom.functions import crs
from urbanloom.plans import city
from urbanloom.plans.tables import drop_written, written
from urbanloom.sources import codecs, files, formats


def test_codecs_round_trip():
    rng = np.random.default_rng(0)
    values = rng.normal(0, 100, (130, 70))
    t = codecs.decode_tiff(codecs.encode_tiff(values, 1000, 2000, 2.0, 3006, -9999.0))
    assert np.array_equal(t["values"][..., 0], values) and (t["west"], t["north"], t["size"], t["epsg"], t["nodata"]) == (1000, 2000, 2, 3006, -9999)
    for most in (255, 65_535):
        grey = rng.integers(0, most + 1, (20, 31))
        assert np.array_equal(codecs.decode_png(codecs.encode_png(grey))[..., 0], grey)
    v, f, c = rng.normal(0, 9, (30, 3)), rng.integers(0, 30, (12, 3)), rng.integers(0, 30, (9, 4))
    for encode, decode in ((codecs.encode_vtk, lambda d: codecs.decode_vtk(d, 3)), (codecs.encode_ply, codecs.decode_ply)):
        assert all(np.array_equal(a, b) for a, b in zip(decode(encode(v, f)), (v, f), strict=True))
    assert np.array_equal(codecs.decode_vtk(codecs.encode_vtk(v, c), 4)[1], c)
    assert np.allclose(codecs.decode_gltf(codecs.encode_gltf(v, f))[0], v, atol=1e-5)
    assert np.array_equal(codecs.decode_xdmf(codecs.encode_xdmf(v, c, np.arange(9)))[2], np.arange(9))
    at, attributes = codecs.decode_message(codecs.encode_message(v, {"intensity": np.array([0, 127, 128, 70_000])}))
    assert np.allclose(at, v, atol=1e-5) and attributes["intensity"].tolist() == [0, 127, 128, 70_000]
    for bad in (codecs.decode_tiff, codecs.decode_png):
        with pytest.raises(ValueError, match="not a"):
            bad(b"nonsense" * 20)


def test_station_texts():
    text = "m;a\nb;c\nId;Name;Lat;Lon;H;2023-05-01 12:00:00;Q\n1;A;57.1;12.0;3;4.5;G;;x\nsub;title\n2;B;58;13;5;;Y;;\n3;C\n"
    got = codecs.decode_latest_hour(text)
    assert [(r["station_id"], r["value"], r["quality"], r["timestamp"]) for r in got] == [("1", 4.5, "G", "2023-05-01 12:00:00"), ("2", None, "Y", "2023-05-01 12:00:00")]
    assert codecs.decode_latest_hour("") == []
    day = {"station": [{"key": 7, "active": True}, {"key": 8, "active": False}], "value": [{"date": 2, "value": 1.5}, {"date": 3, "value": None}, {"date": 1, "value": 9.0}]}
    assert [(r["key"], r["date"], r["value"]) for r in codecs.decode_day_series(json.dumps(day))] == [("7", 2, 1.5)]
    assert len(codecs.decode_day_series(json.dumps(day), active_only=False)) == 2
    series = [{"id": 1, "lastValue": {"timestamp": 5, "value": 2.0}, "uom": "u", "parameters": {"phenomenon": {"id": "8"}}}, {"id": 2}]
    assert [r["id"] for r in codecs.decode_series(json.dumps(series), "8")] == ["1"] and len(codecs.decode_series(json.dumps(series))) == 2


def test_points_text_refuses_short_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2,3,5\n\n4,5,6\n")
    assert files.load(spark, str(tmp_path / "a.csv"), "point_cloud").count() == 2
    (tmp_path / "b.csv").write_text("1,2\n")
    with pytest.raises(Exception, match="not a point"):
        formats.read_points_text(spark, str(tmp_path / "b.csv")).collect()


def test_reference_systems(spark):
    df = spark.createDataFrame([(12.0, 57.7), (18.0, 59.3)], "x double, y double")
    for code in (3006, 3007, 32633, 3857, 25832):
        back = crs.reprojected(crs.reprojected(df, 4326, code), code, "EPSG:4326").collect()
        assert [(r.x, r.y) for r in back] == [pytest.approx(p, abs=1e-8) for p in ((12.0, 57.7), (18.0, 59.3))]
    r = crs.reprojected(df, 4326, 3857).first()
    assert (r.x, r.y) == pytest.approx((1335833.8895, 7904559.1871), abs=1e-2)
    assert crs.chosen("EPSG:3007", None) == (3007, 3007) and crs.chosen("3007", 4326, 3006) == (3006, 4326) and crs.chosen(None, None) == (3006, 3006)
    with pytest.raises(ValueError, match="EPSG"):
        crs.zone(1234)


def test_objects(spark):
    shape = "object_id string, parent_id string, type string, attributes string"
    root = spark.createDataFrame([("r", None, "City", None)], shape)
    child = spark.createDataFrame([("a", "r", "Building", '{"h": 1}'), ("b", "r", "Building", None)], shape)
    rows = city.add_children(root, child, "r")
    values = spark.createDataFrame([("a", "7"), ("r", "9")], "object_id string, value string")
    held = {r.object_id: r.attributes for r in city.set_child_attribute(rows, "Building", "storeys", values).collect()}
    assert json.loads(held["a"]) == {"h": "1", "storeys": "7"} and held["b"] is None and held["r"] is None
    shapes = spark.createDataFrame([("a", "LOD0", "x"), ("b", "LOD0", "y")], "object_id string, geometry_type string, geometry string")
    more = city.add_geometry(shapes, spark.createDataFrame([("a", "LOD0", "z")], shapes.schema))
    assert {(r.object_id, r.geometry) for r in more.collect()} == {("a", "z"), ("b", "y")}
    assert city.remove_geometry(more, "LOD0", child.where("object_id = 'a'")).count() == 1
    fields = spark.createDataFrame([], "object_id string, geometry_type string, name string")
    assert city.add_fields(fields, spark.createDataFrame([("a", "LOD0", "f"), ("a", "MESH", "g")], fields.schema), more).count() == 1
    back, again = city.from_json(city.to_json(rows, more))
    assert back.exceptAll(rows).count() == 0 and again.exceptAll(more).count() == 0


def test_written_tables_are_dropped(spark):
    df = written(spark.range(5).toDF("id"), "kept")
    assert df.count() == 5 and drop_written(spark) >= 1
    with pytest.raises(Exception):  # noqa: B017, PT011
        df.count()
    assert drop_written(spark) == 0
