import itertools

import numpy as np
import pytest

from urbanloom.operators import units as U

UNITS = [("t", "c", 1.0, 0.0, True), ("t", "k", 1.0, -273.15, False), ("t", "tenth", 0.1, 0.0, False), ("p", "x", 1.0, 0.0, True)]
SHAPE = "obs_id bigint, station_id string, field string, value double, unit string, description string, ts timestamp_ntz, received_at timestamp_ntz, factor double"


def _real_units(spark):
    return spark.createDataFrame([("air_temperature", "degC", 1.0, 0.0, True), ("air_temperature", "kelvin", 1.0, -273.15, False), ("air_temperature", "degF", 5 / 9, -160 / 9, False), ("air_temperature", "tenth_degC", 0.1, 0.0, False)], "field string, unit_code string, factor double, shift double, is_common boolean")


def test_names(spark):
    names = {("air_temperature", "°C x 0.1"): "tenth_degC", ("air_temperature", "K"): "kelvin", ("air_temperature", "deg. F"): "degF", ("air_pressure", "in. Hg"): "inHg", ("air_pressure", "mm(Hg)"): "mmHg", ("wind_speed", "m·s⁻¹"): "m_s", ("wind_speed", "KM/H"): "km_h", ("precipitation", '"'): "inch", ("precipitation", "mm/10"): "tenth_mm", ("water_level", "cm."): "cm", ("water_discharge", "cu ft/s"): "ft3_s", ("pm10", "µg m-3"): "ug_m3", ("pm10", "see description"): None, ("other", "m"): None}
    df = spark.createDataFrame([(*k,) for k in names], "field string, name string")
    from pyspark.sql import functions as F

    got = {(r.field, r.name): r.code for r in df.withColumn("code", U.unit_codes(F.col("field"), F.array("name"))[0]).collect()}
    assert got == names


def test_stated_and_decoded(spark):
    rows = []
    for k in range(60):
        level = float(10 + 3 * np.sin(k / 5))
        kelvin = 20 <= k < 40
        said = None if 25 <= k < 35 else ("K" if kelvin else "°C")
        rows.append((k, "s", "air_temperature", level + 273.15 if kelvin else level, said, None, None, None, 9.0))
    rows = [(*r[:6], None, __import__("datetime").datetime(2024, 1, 1, r[0] // 24, 0) + __import__("datetime").timedelta(hours=r[0]), r[8]) for r in rows]
    rows += [(100, "s", "air_temperature", 50.0, "n/a", "Enhet: deg. F. hourly mean, sensor 2 m above ground", None, None, 1.0), (101, None, "air_temperature", None, "K", None, None, None, 1.0), (102, "s", "air_temperature", float("nan"), "K", None, None, None, 1.0), (103, "s", "unheard", 5.0, "m", None, None, None, 1.0)]
    df = spark.createDataFrame(rows + rows[:5], SHAPE)
    got = {r.obs_id: r for r in U.normalise_units(df, _real_units(spark), rows_a_partition=20).collect()}
    assert len(got) == 62 and 101 not in got and 102 not in got
    assert got[103].unit_code is None and got[103].common is None
    assert all(got[k].unit_code == ("kelvin" if 20 <= k < 40 else "degC") for k in range(60))
    assert all(got[k].basis == ("decoded" if 25 <= k < 35 else "unit") for k in range(60))
    assert got[100].basis == "description" and got[100].common == pytest.approx(10.0)
    found = {r.obs_id: r.milli for r in U.converted(U.normalise_units(df, _real_units(spark))).collect()}
    assert set(found) == {*range(20, 25), *range(35, 40), 100} and found[100] == 10000
    assert U.normalise_units(df.limit(0), _real_units(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_scan_is_viterbi(seed):
    rng = np.random.default_rng(seed)
    n, k = 7, 3
    level, score = rng.normal(size=(n, k)), rng.normal(size=(n, k))
    series = np.array([0, 0, 0, 0, 1, 1, 1])
    matrix, new = U._steps(series, level, score, None)
    forward = U._segmented(matrix, new)
    for t in range(n):
        start = 0 if series[t] == 0 else 4
        best = {}
        for path in itertools.product(range(k), repeat=t - start + 1):
            s = score[start, path[0]]
            for i in range(start + 1, t + 1):
                a, b = path[i - 1 - start], path[i - start]
                s += score[i, b] - U.JUMP * abs(level[i, b] - level[i - 1, a]) - (U.SWITCH if a != b else 0)
            best[path[-1]] = max(best.get(path[-1], -1e18), s)
        want = np.array([best[s] for s in range(k)])
        assert np.allclose(forward[t], want - want.max())


def test_cuts_do_not_matter(spark):
    rng = np.random.default_rng(1)
    rows = [(k, f"s{k % 3 == 0}", "air_temperature", float(rng.choice([8.0, 281.0, 46.0, 81.0])), [None, "K", "°C"][int(rng.integers(0, 3))] if k % 7 == 0 else None, None, None, None, 0.0) for k in range(400)]
    df = spark.createDataFrame(rows, SHAPE)
    one = {(r.obs_id, r.unit_code) for r in U.normalise_units(df, _real_units(spark), 10**9).collect()}
    many = {(r.obs_id, r.unit_code) for r in U.normalise_units(df, _real_units(spark), 25).collect()}
    assert one == many


def test_codes_of_the_table_are_names(spark):
    units = spark.createDataFrame([("humidity", "rel_pct", 1.0, 0.0, True), ("humidity", "frac", 100.0, 0.0, False), ("wind_speed", "m_s", 1.0, 0.0, True), ("wind_speed", "dm_s", 0.1, 0.0, False)], "field string, unit_code string, factor double, shift double, is_common boolean")
    rows = [(1, "s", "humidity", 0.5, " frac", None), (2, "s", "humidity", 50.0, "Rel Pct", None), (3, "s", "humidity", 0.4, None, "relative humidity; values in FRAC"), (4, "s", "wind_speed", 30.0, "dm_s", None), (5, "s", "wind_speed", 3.0, "metres per second", None), (6, "s", "wind_speed", 3.0, "frac", None), (7, "s", None, 3.0, "frac", None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "obs_id bigint, station_id string, field string, value double, unit string, description string, ts timestamp_ntz, received_at timestamp_ntz")
    got = {r.obs_id: (r.basis, r.unit_code) for r in U.normalise_units(df, units).collect()}
    assert {k: got[k] for k in range(1, 6)} == {1: ("unit", "frac"), 2: ("unit", "rel_pct"), 3: ("description", "frac"), 4: ("unit", "dm_s"), 5: ("unit", "m_s")}
    assert got[6][0] == "decoded" and got[7][1] is None
    assert {r.obs_id for r in U.converted(U.normalise_units(df, units)).collect()} == {1, 3, 4}
