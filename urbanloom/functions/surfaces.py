"""Planar surfaces in space: rings of (x, y, z), as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urbanloom.functions.geometry import per_edge, total


def normal(ring: Column) -> Column:
    """The unit normal (x, y, z) by Newell's sum over the edges, right-handed; NULL where the ring has no area."""
    part = lambda a, b: total(per_edge(ring, lambda p, q: (p[a] - q[a]) * (p[b] + q[b])))
    x, y, z = part("y", "z"), part("z", "x"), part("x", "y")
    size = F.sqrt(x * x + y * y + z * z)
    return F.when(size > 0, F.struct(*((c / F.when(size > 0, size)).alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z")))))


def area(ring: Column) -> Column:
    """The area of a planar ring in space."""
    part = lambda a, b: total(per_edge(ring, lambda p, q: (p[a] - q[a]) * (p[b] + q[b])))
    x, y, z = part("y", "z"), part("z", "x"), part("x", "y")
    return F.sqrt(x * x + y * y + z * z) / 2


def mean(ring: Column) -> Column:
    """The mean of the vertices."""
    return F.struct(*((total(F.transform(ring, lambda p: p[c])) / F.size(ring)).alias(c) for c in "xyz"))  # noqa: B023


def along(n: Column, p: Column) -> Column:
    return n.x * p.x + n.y * p.y + n.z * p.z


def is_planar(ring: Column, tolerance: float = 1e-5) -> Column:
    """Whether all vertices lie within `tolerance` of the plane through their mean; a ring without area is not."""
    n, c = normal(ring), mean(ring)
    return F.coalesce(F.forall(ring, lambda p: F.abs(along(n, p) - along(n, c)) <= tolerance), F.lit(False))


def coplanar(a: Column, b: Column, tolerance: float = 1e-5) -> Column:
    """Whether all vertices of b lie within `tolerance` of a's plane, and the other way round."""
    def within(one: Column, other: Column) -> Column:
        n, c = normal(one), mean(one)
        return F.forall(other, lambda p: F.abs(along(n, p) - along(n, c)) <= tolerance)

    return F.coalesce(within(a, b) & within(b, a), F.lit(False))


def lattice(ring: Column, spacing: float) -> Column:
    """Points (x, y) on a lattice over the box of a ring, along its axes, both ends included, at most `spacing` apart."""
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    low, high = (F.array_min(xs), F.array_min(ys)), (F.array_max(xs), F.array_max(ys))
    n = [F.greatest(F.ceil((h - l) / spacing), F.lit(1)).cast("int") for l, h in zip(low, high, strict=True)]  # noqa: E741
    at = lambda k, i: low[k] + (high[k] - low[k]) * i / n[k]
    return F.flatten(F.transform(F.sequence(F.lit(0), n[0]), lambda i: F.transform(F.sequence(F.lit(0), n[1]), lambda j: F.struct(at(0, i).alias("x"), at(1, j).alias("y")))))


def subdivided(ring: Column, longest: float) -> Column:
    """The box of a ring as equal rectangles (rings of x, y) of sides of at most `longest`."""
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    low, high = (F.array_min(xs), F.array_min(ys)), (F.array_max(xs), F.array_max(ys))
    n = [F.greatest(F.ceil((h - l) / longest), F.lit(1)).cast("int") for l, h in zip(low, high, strict=True)]  # noqa: E741
    at = lambda k, i: low[k] + (high[k] - low[k]) * i / n[k]
    corner = lambda i, j: F.struct(at(0, i).alias("x"), at(1, j).alias("y"))
    return F.flatten(F.transform(F.sequence(F.lit(0), n[0] - 1), lambda i: F.transform(F.sequence(F.lit(0), n[1] - 1), lambda j: F.array(corner(i, j), corner(i + 1, j), corner(i + 1, j + 1), corner(i, j + 1)))))
