"""Column expressions over rings, boxes, segments and affine maps.

A ring is an array of (x, y) or (x, y, z) structs, not closed. Everything is
built from higher-order functions, so it runs in the JVM next to the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column, z: Column | None = None) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), *([] if z is None else [z.cast("double").alias("z")]))


def ring_of(*corners: tuple[Column, Column]) -> Column:
    return F.array(*(point(x, y) for x, y in corners))


def per_edge(ring: Column, measure: Callable[[Column, Column], Column]) -> Column:
    """An array with `measure` of every edge (start, end), the closing edge last."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), measure)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def signed_area(ring: Column) -> Column:
    """Shoelace area around the first vertex (so that large coordinates lose nothing), positive for counter-clockwise rings."""
    first = F.array_repeat(F.get(ring, F.lit(0)), F.size(ring))
    moved = F.zip_with(ring, first, lambda p, o: F.struct((p.x - o.x).alias("x"), (p.y - o.y).alias("y")))
    return total(per_edge(moved, lambda p, q: p.x * q.y - q.x * p.y)) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return total(per_edge(ring, lambda p, q: F.sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y))))


def vertex_mean(ring: Column) -> Column:
    """The mean of the vertices (not the centroid of the area)."""
    n = F.size(ring)
    return F.struct((total(F.transform(ring, lambda p: p.x)) / n).alias("x"), (total(F.transform(ring, lambda p: p.y)) / n).alias("y"))


def box_of(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def counter_clockwise(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def is_convex(ring: Column) -> Column:
    """All turns have one sign (straight corners allowed)."""
    turn = F.zip_with(
        per_edge(ring, lambda p, q: F.struct((q.x - p.x).alias("x"), (q.y - p.y).alias("y"))),
        F.concat(F.slice(per_edge(ring, lambda p, q: F.struct((q.x - p.x).alias("x"), (q.y - p.y).alias("y"))), 2, F.size(ring)), F.slice(per_edge(ring, lambda p, q: F.struct((q.x - p.x).alias("x"), (q.y - p.y).alias("y"))), 1, 1)),
        lambda a, b: a.x * b.y - a.y * b.x,
    )
    return F.forall(turn, lambda t: t >= 0) | F.forall(turn, lambda t: t <= 0)


def crossings(ring: Column, x: Column, y: Column) -> Column:
    """How many edges of the ring lie strictly right of a point, on its level.

    An edge counts on the levels from its lower end (included) to its upper end
    (left out), so a shared vertex counts once; the sign of one cross product
    says on which side of the edge the point is.
    """

    def right_of_point(p: Column, q: Column) -> Column:
        low, high = F.when(p.y <= q.y, p).otherwise(q), F.when(p.y <= q.y, q).otherwise(p)
        side = (high.x - low.x) * (y - low.y) - (high.y - low.y) * (x - low.x)
        return (low.y <= y) & (y < high.y) & (side > 0)

    return F.size(F.filter(per_edge(ring, right_of_point), lambda hit: hit))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether an odd number of edges lies right of the point. Of points on the ring, those on left and lower edges are inside, those on right and upper edges outside."""
    return crossings(ring, x, y) % 2 == 1


def translate(ring: Column, dx: float | Column, dy: float | Column) -> Column:
    return F.transform(ring, lambda p: point(p.x + dx, p.y + dy))


def with_z(ring: Column, z: Column) -> Column:
    return F.transform(ring, lambda p: point(p.x, p.y, z))


def without_short_edges(ring: Column, least: float) -> Column:
    """The ring without the vertices that end an edge of at most `least`, unless fewer than three would stay."""
    ended = F.zip_with(F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.size(ring) - 1)), ring, lambda p, q: F.struct(q.alias("q"), F.sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)).alias("d")))
    kept = F.transform(F.filter(ended, lambda e: e.d > least), lambda e: e.q)
    return F.when(F.size(kept) >= 3, kept).otherwise(ring)


def split_sides(ring: Column, longest: float) -> Column:
    """The ring with every edge in equal parts of at most `longest`."""
    def parts(p: Column, q: Column) -> Column:
        n = F.greatest(F.ceil(F.sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) / longest), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: point(p.x + (q.x - p.x) * i / n, p.y + (q.y - p.y) * i / n))

    return F.flatten(per_edge(ring, parts))


def segment_distance(x: Column, y: Column, p: Column, q: Column) -> Column:
    """The distance of a point to a segment."""
    dx, dy = q.x - p.x, q.y - p.y
    along = F.coalesce(((x - p.x) * dx + (y - p.y) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    ex, ey = x - (p.x + t * dx), y - (p.y + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def ring_distance(ring: Column, x: Column, y: Column) -> Column:
    """The distance of a point to a ring's area; 0 inside."""
    return F.when(contains(ring, x, y), 0.0).otherwise(F.array_min(per_edge(ring, lambda p, q: segment_distance(x, y, p, q))))


def line_length(line: Column) -> Column:
    """The length of a line of (x, y) structs."""
    steps = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda p, q: F.sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)))
    return total(steps)


def affine(x: Column, y: Column, z: Column, matrix: list[list[float]]) -> tuple[Column, Column, Column]:
    """A point under the upper three rows of a 4 x 4 matrix."""
    return tuple(x * row[0] + y * row[1] + z * row[2] + row[3] for row in matrix[:3])


def extrude(ring: Column, ground: Column, roof: Column) -> Column:
    """The surfaces of a block as rings of (x, y, z): roof, floor, and a quad per edge."""
    lower, upper = with_z(ring, ground), with_z(ring, roof)
    walls = per_edge(ring, lambda p, q: F.array(point(p.x, p.y, ground), point(q.x, q.y, ground), point(q.x, q.y, roof), point(p.x, p.y, roof)))
    return F.concat(F.array(upper, lower), walls)


def tiles_of(xmin: Column, ymin: Column, xmax: Column, ymax: Column, size: float) -> Column:
    """The square tiles (tx, ty) that a box meets."""
    at = lambda c: F.floor(c / size).cast("bigint")
    across = F.sequence(at(xmin), at(xmax))
    return F.flatten(F.transform(across, lambda tx: F.transform(F.sequence(at(ymin), at(ymax)), lambda ty: F.struct(tx.alias("tx"), ty.alias("ty")))))


def road_surfaces(line: Column, width: float) -> Column:
    """A quad of `width` along every segment of a line (flat ends), as rings; segments without length have none."""
    steps = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q"), F.sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)).alias("d")))

    def quad(s: Column) -> Column:
        nx, ny = (s.p.y - s.q.y) / s.d * (width / 2), (s.q.x - s.p.x) / s.d * (width / 2)
        return F.array(point(s.p.x - nx, s.p.y - ny), point(s.q.x - nx, s.q.y - ny), point(s.q.x + nx, s.q.y + ny), point(s.p.x + nx, s.p.y + ny))

    return F.transform(F.filter(steps, lambda s: s.d > 0), quad)
