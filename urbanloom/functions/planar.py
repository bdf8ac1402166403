"""Ring operations that need more than expressions, as Arrow-batched functions: hull, simplify, clip, triangulate."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"
TRIANGLES = "array<struct<a:int,b:int,c:int>>"


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, counter-clockwise from the least point; collinear points are left out."""
    at = np.unique(points, axis=0)
    if len(at) < 3:
        return at
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    out: list = []
    for chain in (at, at[::-1]):
        side: list = []
        for p in chain:
            while len(side) > 1 and turn(side[-2], side[-1], p) <= 0:
                side.pop()
            side.append(p)
        out += side[:-1]
    return np.array(out)


def simplify(line: np.ndarray, tolerance: float) -> np.ndarray:
    """The line with vertices left out that lie within `tolerance` of what stays; the ends stay."""
    keep = np.zeros(len(line), bool)
    if len(line):
        keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = line[a], line[b] - line[a]
        size = float(np.hypot(*d))
        off = line[a + 1 : b] - p
        far = np.abs(d[0] * off[:, 1] - d[1] * off[:, 0]) / size if size > 0 else np.hypot(off[:, 0], off[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def clip(ring: np.ndarray, xmin: float, ymin: float, xmax: float, ymax: float) -> np.ndarray:
    """The part of a convex-clipped ring inside a box, edge after edge."""
    for axis, bound, sign in ((0, xmin, 1), (0, xmax, -1), (1, ymin, 1), (1, ymax, -1)):
        if not len(ring):
            break
        inside = sign * (ring[:, axis] - bound) >= 0
        out = []
        for k in range(len(ring)):
            p, q, a, b = ring[k - 1], ring[k], inside[k - 1], inside[k]
            if a != b:
                t = (bound - p[axis]) / (q[axis] - p[axis])
                out.append(p + t * (q - p))
            if b:
                out.append(q)
        ring = np.array(out).reshape(-1, 2)
    return ring


def ears(ring: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles (vertex places) of a simple ring, which may touch itself along bridges, by cutting ears.

    The corners at reflex vertices are the only ones that can lie in an ear, so
    only they are tested, all at once. A degenerate rest is cut at its flattest
    corner, whose triangle has no area to speak of.
    """
    n = len(ring)
    if n < 3:
        return []
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    order = list(range(n)) if float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) > 0 else list(range(n))[::-1]
    turn = lambda o, a, b: (x[a] - x[o]) * (y[b] - y[o]) - (y[a] - y[o]) * (x[b] - x[o])
    out, start = [], 0
    while len(order) > 3:
        size = len(order)
        around = np.array(order)
        corner = turn(np.roll(around, 1), around, np.roll(around, -1))
        reflex = around[corner <= 0]
        for step in range(size):
            k = (start + step) % size
            if corner[k] <= 0:
                continue
            a, b, c = order[k - 1], order[k], order[(k + 1) % size]
            rest = reflex[~(((x[reflex] == x[a]) & (y[reflex] == y[a])) | ((x[reflex] == x[b]) & (y[reflex] == y[b])) | ((x[reflex] == x[c]) & (y[reflex] == y[c])))]
            if not ((turn(a, b, rest) >= 0) & (turn(b, c, rest) >= 0) & (turn(c, a, rest) >= 0)).any():
                break
        else:
            k = int(np.abs(corner).argmin())
            a, b, c = order[k - 1], order[k], order[(k + 1) % size]
        out.append((a, b, c))
        del order[k]
        start = k
    return [*out, tuple(order)]


def _array(ring) -> np.ndarray:  # noqa: ANN001
    return np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)


def _structs(ring: np.ndarray) -> list[dict]:
    return [{"x": float(p[0]), "y": float(p[1])} for p in ring]


def ring_function(change, *given: float):  # noqa: ANN001, ANN201
    """A column function of rings from a function of arrays; NULL stays NULL."""

    @F.pandas_udf(RING)
    def run(rings: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else _structs(change(_array(r), *given)) for r in rings])

    return run


def convex_hull(ring: Column) -> Column:
    return ring_function(hull)(ring)


def simplified(ring: Column, tolerance: float) -> Column:
    return ring_function(simplify, tolerance)(ring)


def clipped(ring: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    return ring_function(clip, xmin, ymin, xmax, ymax)(ring)


def triangulated(ring: Column) -> Column:
    """The triangles of a ring as places of its vertices."""

    @F.pandas_udf(TRIANGLES)
    def run(rings: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else [{"a": a, "b": b, "c": c} for a, b, c in ears(_array(r))] for r in rings])

    return run(ring)


def clipped_area(ring: Column, size: float) -> Column:
    """The area of a ring inside the square from the origin to `size`."""

    @F.pandas_udf("double")
    def run(rings: pd.Series) -> pd.Series:
        out = []
        for r in rings:
            part = clip(_array(r), 0.0, 0.0, size, size) if r is not None else np.zeros((0, 2))
            x, y = (part[:, 0], part[:, 1]) if len(part) else (np.zeros(0), np.zeros(0))
            out.append(abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2)
        return pd.Series(out, dtype="float64")

    return run(ring)


def bridged(shell: np.ndarray, holes: list[np.ndarray]) -> np.ndarray:
    """A ring that runs along the shell and, over bridges of no width, along every hole."""
    area = lambda r: float((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum())
    ring = shell if area(shell) > 0 else shell[::-1]
    turned = [h if area(h) < 0 else h[::-1] for h in holes if len(h) > 2]
    for hole in sorted(turned, key=lambda h: -h[:, 0].max()):
        start = int(hole[:, 0].argmax())
        m = hole[start]
        # the nearest vertex of the ring that sees the hole's rightmost vertex
        order = np.argsort(np.hypot(*(ring - m).T), kind="stable")
        walls = [(r, np.roll(r, -1, axis=0)) for r in (ring, *turned)]
        for k in order:
            if not any(_cross(m, ring[k], p, q).any() for p, q in walls):
                break
        ring = np.vstack([ring[: k + 1], hole[start:], hole[: start + 1], ring[k:]])
    return ring


def _cross(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which edges p q the segment a b properly crosses."""
    side = lambda o, e, at: np.sign((e[..., 0] - o[..., 0]) * (at[..., 1] - o[..., 1]) - (e[..., 1] - o[..., 1]) * (at[..., 0] - o[..., 0]))
    return (side(a, b, p) * side(a, b, q) < 0) & (side(p, q, a) * side(p, q, b) < 0)


def meshed(polygon: Column) -> Column:
    """The triangles (arrays of three x, y) of a polygon (shell and holes)."""

    @F.arrow_udf(f"array<{RING}>")
    def run(polygons: pa.Array) -> pa.Array:  # pandas fails on holes with different numbers of corners
        out = []
        for p in polygons.to_pylist():
            if p is None or p["shell"] is None:
                out.append(None)
                continue
            ring = bridged(_array(p["shell"]), [_array(h) for h in p["holes"]])
            out.append([_structs(ring[[a, b, c]]) for a, b, c in ears(ring)])
        return pa.array(out, pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))

    return run(polygon)
