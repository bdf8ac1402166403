"""Point operators per building: outliers by neighbours, normals, planes, coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.operators.nearest import nearest
from urbanloom.plans.tables import written

#: Groups are laid this far apart on an axis of their own, so that neighbours never cross them.
APART = 1e7


def neighbour_outliers(points: DataFrame, group: str, neighbours: int = 5, margin: float = 1.5) -> DataFrame:
    """The distinct positions (group, x, y, z, mean_distance) whose mean distance to `neighbours` others of
    their group exceeds the group's mean by `margin` sample deviations. A group with no more positions than that has none."""
    held = points.select(group, *(F.col(c).cast("double").alias(c) for c in "xyz")).where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz")).distinct()
    # numbers are fixed by writing them, so that a lost task can't change them
    lanes = written(held.select(group).distinct().select(group, (F.monotonically_increasing_id() * F.lit(APART)).alias("w")), "lanes")
    laid = held.join(lanes, group)
    near = nearest(laid.select("x", "y", "z", "w"), laid.select("x", "y", "z", "w"), ["x", "y", "z", "w"], laid.count(), neighbours, apart=True)
    means = near.where(F.col("w") == F.col("i_w")).groupBy("x", "y", "z", "w").agg(F.avg("distance").alias("mean_distance"), F.count("*").alias("n")).where(F.col("n") == neighbours)
    whole = means.join(lanes, "w")
    limits = whole.groupBy(group).agg((F.avg("mean_distance") + margin * F.stddev_samp("mean_distance")).alias("_limit"))
    return whole.join(limits, group).where(F.col("mean_distance") > F.col("_limit")).select(group, "x", "y", "z", "mean_distance")


def normal_of(neighbours: Column) -> Column:
    """The unit normal (nx, ny, nz; nz not negative) of an array of (x, y, z) by principal components; NULL below three points."""

    @F.pandas_udf("nx double, ny double, nz double")
    def run(groups: pd.Series) -> pd.DataFrame:
        out = []
        for g in groups:
            at = np.array([(p["x"], p["y"], p["z"]) for p in g], float)
            if len(at) < 3:
                out.append((None, None, None))
                continue
            n = np.linalg.svd(at - at.mean(axis=0))[2][2]
            out.append(tuple(float(v) for v in (n if n[2] >= 0 else -n)))
        return pd.DataFrame(out, columns=["nx", "ny", "nz"])

    return run(neighbours)


def normals(points: DataFrame, neighbours: int = 8) -> DataFrame:
    """x, y, z and the normal of every distinct position by its nearest positions and itself."""
    near = nearest(points, points, ["x", "y", "z"], points.count(), neighbours)
    spots = near.groupBy("x", "y", "z").agg(F.collect_list(F.struct(F.col("i_x").alias("x"), F.col("i_y").alias("y"), F.col("i_z").alias("z"))).alias("g"))  # `neighbours` at most
    return spots.withColumn("n", normal_of(F.col("g"))).select("x", "y", "z", "n.*")


def coverage(points: DataFrame, group: str, area: DataFrame, size: float = 1.0) -> DataFrame:
    """Per group, the share of its tiles (area: group, tx, ty) of `size` that hold a point."""
    hit = points.select(group, F.floor(F.col("x") / size).cast("bigint").alias("tx"), F.floor(F.col("y") / size).cast("bigint").alias("ty")).distinct().withColumn("_hit", F.lit(1))
    return area.join(hit, [group, "tx", "ty"], "left").groupBy(group).agg((F.count("_hit") / F.count("*")).alias("coverage"))


def best_plane(at: np.ndarray, margin: float = 0.2, rounds: int = 150, seed: int = 7) -> np.ndarray:
    """Which points lie off the plane through three of them that most points lie within `margin` of; none of fewer than nine."""
    off = np.zeros(len(at), bool)
    if len(at) < 9:
        return off
    pick, least = np.random.default_rng(seed), len(at) + 1
    for _ in range(rounds):
        a, b, c = at[pick.choice(len(at), 3, replace=False)]
        n = np.cross(b - a, c - a)
        size = np.linalg.norm(n)
        if size < 1e-12:
            continue
        far = np.abs((at - a) @ (n / size)) > margin
        if far.sum() < least:
            off, least = far, int(far.sum())
    return off
