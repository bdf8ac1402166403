import numpy as np
import pytest

from urbanloom.operators import nearby as N
from urbanloom.operators.nearest import nearest


def _brute(rows, radius, metric="euclidean"):
    out = set()
    for i, (a, *p) in enumerate(rows):
        for b, *q in rows[:i]:
            if a is None or b is None or a == b or any(v is None or v != v for v in [*p, *q]):
                continue
            if N.METRICS[metric](np.array(p, float), np.array(q, float)) <= radius:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize(("seed", "cells"), [(0, 12_000), (1, 20), (2, 5)])
def test_pairs_against_brute_force(spark, monkeypatch, seed, cells):
    monkeypatch.setattr(N._choose_pivots, "__defaults__", (cells,))
    rng = np.random.default_rng(seed)
    spots = rng.integers(0, 40, (300, 2)).astype(float)
    rows = [(f"t{k % 280}", *map(float, p)) for k, p in enumerate(spots)] + [("n", None, 1.0), ("m", float("nan"), 1.0), (None, 1.0, 1.0)]
    rows += rows[:20]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id string, x double, y double, a_id string")
    got = {tuple(r) for r in N.neighbours(df, "id", ["x", "y"], 1.5).collect()}
    assert got == _brute(rows, 1.5)


def test_great_circle(spark):
    rng = np.random.default_rng(3)
    rows = [(str(k), float(rng.uniform(178, 180) if k % 2 else rng.uniform(-180, -178)), float(rng.uniform(60, 62))) for k in range(150)]
    df = spark.createDataFrame(rows, "id string, lon double, lat double")
    got = {tuple(r) for r in N.neighbours(df, "id", ["lon", "lat"], 20_000.0, metric="great_circle").collect()}
    assert got == _brute(rows, 20_000.0, "great_circle") and got


def test_one_position_with_many_rows_and_groups(spark):
    rows = [(k, "a" if k % 2 else "b", 5.0, 5.0) for k in range(40)]
    df = spark.createDataFrame(rows, "id bigint, cloud string, x double, y double")
    got = N.neighbours(df, "id", ["x", "y"], 0.1, apart="cloud")
    assert got.count() == 400
    assert N.neighbours(df.limit(0), "id", ["x", "y"], 0.1).count() == 0


def test_boxes(spark):
    rng = np.random.default_rng(4)
    trees = [(f"t{k}", float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 60, (200, 2)))] + [("n", None, 3.0)]
    boxes = [(f"b{k}", float(x), float(y), float(x + w), float(y + h)) for k, (x, y, w, h) in enumerate(rng.integers(0, 25, (40, 4)))]
    boxes += [("r", 30.0, 0.0, 10.0, 60.0), ("u", None, 0.0, 60.0, 60.0), ("v", float("nan"), 0.0, 60.0, 60.0), boxes[0]]
    t = spark.createDataFrame(trees, "tree_id string, x double, y double")
    b = spark.createDataFrame([(*x, 1.0) for x in boxes], "bounds_id string, xmin double, ymin double, xmax double, ymax double, x double")
    got = {tuple(r) for r in N.containing_boxes(t, "tree_id", b, "bounds_id").collect()}
    want = {(i, k) for i, x, y in trees for k, a, c, d, e in boxes if x is not None and a is not None and a <= x <= d and c <= y <= e}
    assert got == want
    assert N.containing_boxes(t, "tree_id", b.limit(0), "bounds_id").count() == 0
    assert N.containing_boxes(t.limit(0), "tree_id", b, "bounds_id").count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(6)
    at = np.unique(rng.integers(0, 50, (200, 2)).astype(float), axis=0)
    df = spark.createDataFrame([tuple(map(float, p)) for p in at], "x double, y double")
    near = nearest(df, df, ["x", "y"], 20_000, 3, apart=True).collect()
    by = {}
    for r in near:
        by.setdefault((r.x, r.y), []).append(r.distance)
    for p in at:
        d = np.sort(np.hypot(*(at - p).T))[1:4]
        assert sorted(by[tuple(p)]) == pytest.approx(list(d))
    assert nearest(df, df.limit(0), ["x", "y"], 10).count() == 0
    assert nearest(df.limit(2), df.limit(2), ["x", "y"], 10, 5, apart=True).count() == 2
