import numpy as np
import pytest

from urbanloom.functions.buckets import Buckets
from urbanloom.operators.graphs import connected_components, contracted
from urbanloom.operators.ranked import exact_percentiles

AT = {"a": 0.0, "b": 0.1, "m": 0.5, "z": 0.9, "e": 1.0}


@pytest.mark.parametrize("sort_rows", [10**6, 5])
def test_exact_percentiles(spark, sort_rows):
    rng = np.random.default_rng(0)
    values = [*rng.normal(50, 1e-3, 1500), *rng.lognormal(0, 9, 200), *-rng.lognormal(0, 9, 200), 0.0, 0.0, 0.0]
    rows = [("a" if k % 3 else None, float(v)) for k, v in enumerate(values)]
    df = spark.createDataFrame([*rows, ("a", None), ("a", float("nan"))], "g string, v double")
    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", AT, sort_rows).collect()}
    for g in ("a", None):
        own = np.array([v for k, v in rows if k == g])
        for name, q in AT.items():
            assert got[g][name] == pytest.approx(np.quantile(own, q), rel=1e-14)
    assert exact_percentiles(df.limit(0), ["g"], "v", AT).count() == 0


def test_infinite_values_and_bad_alpha(spark):
    df = spark.createDataFrame([(1, float("inf")), (1, 2.0), (1, float("-inf"))], "g int, v double")
    r = exact_percentiles(df, ["g"], "v", AT).first()
    assert r.a == float("-inf") and r.m == 2.0 and r.e == float("inf")
    with pytest.raises(ValueError, match="alpha"):
        Buckets(1e-9)


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(1)
    edges = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 300, (220, 2))] + [("x", None), ("lone", "lone")] + [(f"c{k:04}", f"c{k + 1:04}") for k in range(600)]
    owner = {}
    for a, b in edges:
        if a and b:
            whole = owner.get(a, {a}) | owner.get(b, {b})
            owner |= dict.fromkeys(whole, whole)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {n: min(w) for n, w in owner.items()}
    node, least = contracted(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(node.tolist(), least.tolist(), strict=True)) == {5: 1, 3: 1, 9: 8}
