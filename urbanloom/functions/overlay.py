"""Boolean operations, buffers and repairs of planar polygons, and their column functions.

A polygon is a list of rings (arrays of x, y, not closed); a point is inside if
an odd number of rings hold it, so holes are rings like any other. Everything
rests on one arrangement: all edges are cut where they meet, a cut edge stays if
the result lies on exactly one of its sides, and what stays is walked into rings.
Positions are snapped to a grid of a micrometre around the polygons' middle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from urbanloom.functions.planar import RING, hull, simplify

POLYGON = f"struct<shell:{RING},holes:array<{RING}>>"
GRID = 1e-6
#: A mitre longer than so many distances is cut to a bevel.
MITRE_LIMIT = 5.0

Rings = list[np.ndarray]


def holds(rings: Rings, at: np.ndarray) -> np.ndarray:
    """Which points lie inside, by the parity of the edges right of them."""
    odd = np.zeros(len(at), bool)
    for ring in rings:
        p, q = ring, np.roll(ring, -1, axis=0)
        up = np.where((p[:, 1] <= q[:, 1])[:, None], p, q)
        down = np.where((p[:, 1] <= q[:, 1])[:, None], q, p)
        for k in range(0, len(at), max(1, 500_000 // max(1, len(ring)))):
            own = slice(k, k + max(1, 500_000 // max(1, len(ring))))
            x, y = at[own, 0][:, None], at[own, 1][:, None]
            level = (up[:, 1] <= y) & (y < down[:, 1])
            right = (down[:, 0] - up[:, 0]) * (y - up[:, 1]) - (down[:, 1] - up[:, 1]) * (x - up[:, 0]) > 0
            odd[own] ^= (level & right).sum(axis=1) % 2 == 1
    return odd


def ring_area(ring: np.ndarray) -> float:
    """Signed; positive for counter-clockwise rings."""
    if len(ring) < 3:
        return 0.0
    own = ring - ring[0]
    return float((own[:, 0] * np.roll(own[:, 1], -1) - np.roll(own[:, 0], -1) * own[:, 1]).sum()) / 2


def polygon_area(rings: Rings) -> float:
    """Of a shell and its holes, however they are oriented."""
    return abs(ring_area(rings[0])) - sum(abs(ring_area(h)) for h in rings[1:]) if rings else 0.0


def _cut(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct pieces (n, 2, 2; grid units) of segments, cut wherever they meet or a vertex lies on them."""
    n = len(a)
    d, size = b - a, np.maximum(np.hypot(*(b - a).T), 1e-300)
    cuts: list[list[np.ndarray]] = [[np.zeros(1), np.ones(1)] for _ in range(n)]
    vertices = np.unique(np.vstack([a, b]), axis=0)
    low, high = np.minimum(a, b) - 1.0, np.maximum(a, b) + 1.0
    step = max(1, 1_000_000 // max(1, len(vertices), n))
    for k in range(0, n, step):
        own = slice(k, min(n, k + step))
        # vertices within half a grid unit of the segment
        r = vertices[None] - a[own][:, None]
        along = (r * d[own][:, None]).sum(axis=2) / size[own][:, None] ** 2
        off = np.abs(r[..., 0] * d[own][:, None, 1] - r[..., 1] * d[own][:, None, 0]) / size[own][:, None]
        for i, j in zip(*np.nonzero((off <= 0.75) & (along > 0) & (along < 1)), strict=True):
            cuts[k + i].append(along[i, j : j + 1])
        # proper crossings
        meet = (low[own][:, None] <= high[None]).all(axis=2) & (low[None] <= high[own][:, None]).all(axis=2)
        i, j = np.nonzero(meet)
        i = i + k
        i, j = i[i < j], j[i < j]
        cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        solid = np.abs(cross) > 1e-12 * size[i] * size[j]
        i, j, cross = i[solid], j[solid], cross[solid]
        w = a[j] - a[i]
        t, u = (w[:, 0] * d[j, 1] - w[:, 1] * d[j, 0]) / cross, (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / cross
        hit = (t > 0) & (t < 1) & (u > 0) & (u < 1)
        for x, y, s, v in zip(i[hit], j[hit], t[hit], u[hit], strict=True):
            cuts[x].append(np.array([s]))
            cuts[y].append(np.array([v]))
    out = []
    for k in range(n):
        t = np.unique(np.concatenate(cuts[k]))
        at = np.rint(a[k] + t[:, None] * d[k])
        out.append(np.stack([at[:-1], at[1:]], axis=1))
    pieces = np.concatenate(out) if out else np.zeros((0, 2, 2))
    pieces = pieces[(pieces[:, 0] != pieces[:, 1]).any(axis=1)]
    flip = (pieces[:, 0, 0] > pieces[:, 1, 0]) | ((pieces[:, 0, 0] == pieces[:, 1, 0]) & (pieces[:, 0, 1] > pieces[:, 1, 1]))
    pieces[flip] = pieces[flip][:, ::-1]
    return np.unique(pieces.reshape(-1, 4), axis=0).reshape(-1, 2, 2)


def overlay(parts: list[Rings], rule: Callable[[list[np.ndarray]], np.ndarray]) -> list[Rings]:
    """The polygons (shell first, counter-clockwise, then holes) where `rule` of being inside each part holds, the largest first."""
    every = [r for rings in parts for r in rings if len(r) > 2]
    if not every:
        return []
    middle = np.rint(np.vstack(every).mean(axis=0))
    snapped = [[np.rint((r - middle) / GRID) for r in rings if len(r) > 2] for rings in parts]
    a = np.vstack([r for rings in snapped for r in rings])
    b = np.vstack([np.roll(r, -1, axis=0) for rings in snapped for r in rings])
    solid = (a != b).any(axis=1)
    pieces = _cut(a[solid], b[solid])
    if not len(pieces):
        return []
    d = pieces[:, 1] - pieces[:, 0]
    normal = np.stack([-d[:, 1], d[:, 0]], axis=1) / np.hypot(*d.T)[:, None]
    centre = pieces.mean(axis=1)
    left, right = (rule([holds(rings, centre + side * normal) for rings in snapped]) for side in (2.0, -2.0))
    edges = np.concatenate([pieces[left & ~right], pieces[right & ~left][:, ::-1]])
    rings = [r * GRID + middle for r in _walk(edges)]
    shells = sorted((r for r in rings if ring_area(r) > GRID), key=lambda r: -ring_area(r))
    out = [[s] for s in shells]
    for hole in (r for r in rings if ring_area(r) < -GRID):
        p, q = hole[0], hole[1]
        n = np.array([q[1] - p[1], p[0] - q[0]]) / np.hypot(*(q - p))  # towards the hole's own inside
        around = [k for k, s in enumerate(shells) if holds([s], ((p + q) / 2 + 2 * GRID * n)[None])[0]]
        if around:
            out[around[-1]].append(hole)
    return out


def _walk(edges: np.ndarray) -> Rings:
    """Directed edges, the inside on their left, as simple rings without straight corners."""
    leaving: dict[tuple, list[int]] = {}
    starts, ends = [tuple(e[0]) for e in edges], [tuple(e[1]) for e in edges]
    for k, s in enumerate(starts):
        leaving.setdefault(s, []).append(k)
    angle = np.arctan2(edges[:, 1, 1] - edges[:, 0, 1], edges[:, 1, 0] - edges[:, 0, 0]) if len(edges) else []
    used, rings = np.zeros(len(edges), bool), []
    for first in range(len(edges)):
        if used[first]:
            continue
        ring, k = [], first
        while not used[k]:
            used[k] = True
            ring.append(starts[k])
            onward = [j for j in leaving.get(ends[k], []) if not used[j]]
            if not onward:
                break
            back = angle[k] + np.pi
            k = min(onward, key=lambda j: (back - angle[j]) % (2 * np.pi) or 2 * np.pi)
        if ends[k] == starts[first]:
            rings.append(_bent(np.array(ring, float)))
    return [r for r in rings if len(r) > 2]


def _bent(ring: np.ndarray) -> np.ndarray:
    """The ring without corners that lie within a grid unit of the line between their neighbours."""
    keep = np.ones(len(ring), bool)
    for k in range(len(ring)):
        others = np.flatnonzero(keep)
        if len(others) <= 3:
            break
        i = int(np.searchsorted(others, k))
        p, q = ring[others[i - 1]], ring[others[(i + 1) % len(others)]]
        size = np.hypot(*(q - p))
        off = abs((q[0] - p[0]) * (ring[k][1] - p[1]) - (q[1] - p[1]) * (ring[k][0] - p[0]))
        if size > 0 and off <= 1.5 * size:
            keep[k] = False
    return ring[keep]


def union(parts: list[Rings]) -> list[Rings]:
    return overlay(parts, lambda inside: np.any(inside, axis=0))


def intersection(a: Rings, b: Rings) -> list[Rings]:
    return overlay([a, b], lambda inside: inside[0] & inside[1])


def difference(a: Rings, b: Rings) -> list[Rings]:
    return overlay([a, b], lambda inside: inside[0] & ~inside[1])


def repaired(rings: Rings) -> list[Rings]:
    """The polygons of any rings, crossing or not."""
    return overlay([rings], lambda inside: inside[0])


def buffered(rings: Rings, distance: float) -> list[Rings]:
    """Grown by a distance (shrunk by a negative one), with mitred corners: strips along the edges and kites at the corners."""
    strips: list[Rings] = []
    valid = repaired(rings)
    for ring in (r for polygon in valid for r in polygon):
        d = np.roll(ring, -1, axis=0) - ring
        out = np.stack([d[:, 1], -d[:, 0]], axis=1) / np.hypot(*d.T)[:, None]  # outward, as the inside is on the left
        for k in range(len(ring)):
            p, q, n, before = ring[k], ring[(k + 1) % len(ring)], out[k] * distance, out[k - 1] * distance
            strips.append([np.array([p, q, q + n, p + n])])
            turn = (out[k - 1][0] * out[k][1] - out[k - 1][1] * out[k][0]) * distance
            if turn > 0:
                share = 1 + float(out[k - 1] @ out[k])
                tip = [p + (before + n) / share] if share > 2 / MITRE_LIMIT**2 else []
                strips.append([np.array([p, p + before, *tip, p + n])])
    whole = [[r for polygon in valid for r in polygon]]
    if distance >= 0:
        return union(whole + strips)
    return overlay(whole + strips, lambda inside: inside[0] & ~np.any(inside[1:], axis=0))


def closed(rings: Rings, distance: float) -> list[Rings]:
    """Grown, then shrunk: gaps and notches narrower than twice the distance are filled."""
    return union([q for p in buffered(rings, distance) for q in buffered(p, -distance)])


def merge(parts: list[Rings], tolerance: float) -> Rings:
    """One polygon of several: their union, else with gaps of the tolerance closed, else the hull; then simplified by a quarter of the tolerance."""
    whole = union(parts)
    if len(whole) > 1:
        whole = union([q for p in union([b for part in parts for b in buffered(part, tolerance)]) for q in buffered(p, -tolerance)])
    if len(whole) != 1:
        points = np.vstack([p[0] for p in parts if p]) if any(parts) else np.zeros((0, 2))
        return [hull(points)] if len(points) else []
    return simplified_polygon(whole[0], tolerance / 4)


def simplified_polygon(rings: Rings, tolerance: float) -> Rings:
    """Each ring simplified between its two farthest corners; a polygon that would cross itself stays as it is."""
    out = []
    for ring in rings:
        far = int(np.hypot(*(ring - ring[0]).T).argmax())
        turned = np.vstack([ring[far:], ring[:far]])
        other = int(np.hypot(*(turned - turned[0]).T).argmax())
        slim = np.vstack([simplify(turned[: other + 1], tolerance)[:-1], simplify(np.vstack([turned[other:], turned[:1]]), tolerance)[:-1]])
        out.append(slim if len(slim) > 2 else ring)
    return rings if any(crosses_itself(r) for r in out) else out


def without_slivers(rings: Rings, tolerance: float) -> Rings:
    """Closed by the tolerance, parts merged to one polygon."""
    parts = closed(rings, tolerance)
    return parts[0] if len(parts) == 1 else merge(parts, tolerance) if parts else rings


def crosses_itself(ring: np.ndarray) -> bool:
    """Whether two edges meet other than at the corner they share."""
    p, q = ring, np.roll(ring, -1, axis=0)
    i, j = np.triu_indices(len(ring), 1)
    apart = (j - i > 1) & ~((i == 0) & (j == len(ring) - 1))
    i, j = i[apart], j[apart]
    side = lambda o, a, b: np.sign((a[:, 0] - o[:, 0]) * (b[:, 1] - o[:, 1]) - (a[:, 1] - o[:, 1]) * (b[:, 0] - o[:, 0]))
    proper = (side(p[i], q[i], p[j]) * side(p[i], q[i], q[j]) < 0) & (side(p[j], q[j], p[i]) * side(p[j], q[j], q[i]) < 0)
    return bool(proper.any())


def clearance(rings: Rings) -> float:
    """How far a vertex may move before the polygon breaks: the least distance of a vertex to another vertex or to an edge that isn't its own."""
    best = np.inf
    vertices = np.vstack(rings)
    for ring in rings:
        p, q = ring, np.roll(ring, -1, axis=0)
        d = q - p
        r = vertices[None] - p[:, None]
        t = np.clip((r * d[:, None]).sum(axis=2) / np.maximum((d * d).sum(axis=1), 1e-300)[:, None], 0, 1)
        gap = np.hypot(*np.moveaxis(r - t[..., None] * d[:, None], 2, 0))
        own = (vertices[None] == p[:, None]).all(axis=2) | (vertices[None] == q[:, None]).all(axis=2)
        best = min(best, float(np.where(own, np.inf, gap).min(initial=np.inf)), float(np.hypot(*d.T).min()))
    return best


def long_edged(rings: Rings, least: float) -> Rings:
    """Without the corners that end an edge of at most `least`, unless fewer than three would stay."""
    out = []
    for ring in rings:
        kept = ring[np.hypot(*(ring - np.roll(ring, 1, axis=0)).T) > least]
        out.append(kept if len(kept) > 2 else ring)
    return out


def gaps_filled(rings: Rings, tolerance: float) -> Rings:
    """Gaps narrower than the tolerance filled, nothing added outside the hull."""
    parts = [q for p in closed(rings, tolerance / 2) for q in intersection(p, [hull(rings[0])])]
    return parts[0] if parts else rings


def edges_apart(rings: Rings, tolerance: float) -> Rings:
    """Edges of the shell closer than the tolerance, but not touching, pushed apart to it; of several moves of a corner the smallest counts."""
    ring = rings[0]
    n = len(ring)
    moves: dict[int, np.ndarray] = {}
    for i in range(n):
        for j in range(i + 2, n - (i == 0)):
            p, q, gap = _nearest(ring[i], ring[(i + 1) % n], ring[j], ring[(j + 1) % n])
            if 0 < gap < tolerance:
                push = (q - p) / gap * (tolerance - gap) / 2
                for k, by in ((i, -push), ((i + 1) % n, -push), (j, push), ((j + 1) % n, push)):
                    if k not in moves or np.hypot(*by) < np.hypot(*moves[k]):
                        moves[k] = by
    moved = ring.copy()
    for k, by in moves.items():
        moved[k] += by
    return rings if crosses_itself(moved) else [moved, *rings[1:]]


def _nearest(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The nearest points of two segments that don't cross, and their distance."""
    def foot(p, s, e):  # noqa: ANN001, ANN202
        size = float((e - s) @ (e - s))
        return s + min(1.0, max(0.0, float((p - s) @ (e - s)) / size if size else 0.0)) * (e - s)

    pairs = [(a, foot(a, c, d)), (b, foot(b, c, d)), (foot(c, a, b), c), (foot(d, a, b), d)]
    return min(((p, q, float(np.hypot(*(q - p)))) for p, q in pairs), key=lambda x: x[2])


def blunted(rings: Rings, degrees: float, tolerance: float) -> Rings:
    """Corners of the shell sharper than `degrees` get a second corner, `tolerance` beside them, away from the edge that follows."""
    ring, out = rings[0], []
    for k in range(len(ring)):
        p, q, r = ring[k - 1], ring[k], ring[(k + 1) % len(ring)]
        u, v = p - q, r - q
        out.append(q)
        cos = float(u @ v) / max(np.hypot(*u) * np.hypot(*v), 1e-300)
        if np.degrees(np.arccos(np.clip(cos, -1, 1))) < degrees:
            side = np.array([-u[1], u[0]]) / np.hypot(*u)
            out[-1] = q + side * tolerance * (-1.0 if float(side @ v) > 0 else 1.0)
            out.append(q)
    return [np.array(out), *rings[1:]]


def cleared(rings: Rings, target: float, accepted: float = 0.9, rounds: int = 4) -> Rings:
    """A polygon whose clearance reaches `target`, or the best found: slivers closed, gaps filled, short edges dropped, edges pushed apart, in rounds."""
    best, now = rings, rings
    if clearance(now) > target:
        return rings
    for _ in range(rounds):
        for change in (lambda r: without_slivers(r, clearance(r) / 2), lambda r: gaps_filled(r, target), lambda r: long_edged(r, target), lambda r: edges_apart(r, target)):
            tried = change(now)
            if clearance(tried) > clearance(now):
                now = tried
            if clearance(now) > target * accepted:
                return now
        best = now if clearance(now) > clearance(best) else best
    return best


def large_holes(rings: Rings, least: float) -> Rings:
    """Without holes smaller than `least`."""
    return [rings[0], *(h for h in rings[1:] if abs(ring_area(h)) >= least)]


def cleaned(rings: Rings, target: float, least_hole: float) -> Rings:
    """The largest part of the repaired polygon, without small holes, with the clearance."""
    parts = repaired(rings)
    return cleared(large_holes(parts[0], least_hole), target) if parts else rings


# column functions


#: Polygons go in and out as Arrow arrays: pandas would make one rectangular array of a polygon's holes, which fails where their numbers of corners differ.
_RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_POLYGON = pa.struct([("shell", _RING), ("holes", pa.list_(_RING))])


def _rings(polygon: dict) -> Rings:
    one = lambda ring: np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)
    return [r for r in (one(polygon["shell"]), *(one(h) for h in polygon["holes"] if h is not None)) if len(r) > 2]


def _struct(rings: Rings) -> dict | None:
    one = lambda ring: [{"x": x, "y": y} for x, y in ring.tolist()]
    return {"shell": one(rings[0]), "holes": [one(h) for h in rings[1:]]} if rings else None


def _each(polygons: pa.Array) -> list[Rings | None]:
    """The rings of every row, None for NULL."""
    return [None if p is None or p["shell"] is None else _rings(p) for p in polygons.to_pylist()]


def _lists(lists: pa.Array) -> list[list[Rings] | None]:
    """The polygons of every row's array, without NULLs in it."""
    return [None if some is None else [_rings(p) for p in some if p is not None] for some in lists.to_pylist()]


def _column(rows: list[Rings | None]) -> pa.Array:
    return pa.array([(_struct(r) if r else None) or {"shell": None, "holes": None} for r in rows], _POLYGON)


def _list_column(rows: list[list[Rings] | None]) -> pa.Array:
    return pa.array([None if some is None else [_struct(p) for p in some] for some in rows], pa.list_(_POLYGON))


def as_polygon(ring: Column, holes: Column | None = None) -> Column:
    """A ring, and holes if any, as a polygon."""
    return F.struct(ring.alias("shell"), (F.array().cast(f"array<{RING}>") if holes is None else holes).alias("holes"))


def without_holes(polygon: Column) -> Column:
    return as_polygon(polygon["shell"])


def changed(polygon: Column, change: Callable[..., Rings], *given: float) -> Column:
    """A function from rings to rings (one polygon) of a column; NULL, and polygons without three corners, give NULL."""

    @F.arrow_udf(POLYGON)
    def run(polygons: pa.Array) -> pa.Array:
        return _column([change(r, *given) if r else None for r in _each(polygons)])

    return run(polygon)


def parts_of(polygon: Column, change: Callable[..., list[Rings]], *given: float) -> Column:
    """The same for functions that give several polygons: an array of them, the largest first."""

    @F.arrow_udf(f"array<{POLYGON}>")
    def run(polygons: pa.Array) -> pa.Array:
        return _list_column([change(r, *given) if r else [] for r in _each(polygons)])

    return run(polygon)


def measured(polygon: Column, measure: Callable[[Rings], float]) -> Column:
    """A number of every polygon."""

    @F.arrow_udf("double")
    def run(polygons: pa.Array) -> pa.Array:
        return pa.array([measure(r) if r else None for r in _each(polygons)], pa.float64(), from_pandas=True)

    return run(polygon)


def united(polygons: Column) -> Column:
    """The union of an array of polygons, as an array."""

    @F.arrow_udf(f"array<{POLYGON}>")
    def run(lists: pa.Array) -> pa.Array:
        return _list_column([None if some is None else union(some) for some in _lists(lists)])

    return run(polygons)


def merged_list(polygons: Column, tolerance: float) -> Column:
    """One polygon of an array of them."""

    @F.arrow_udf(POLYGON)
    def run(lists: pa.Array) -> pa.Array:
        return _column([None if some is None else merge(some, tolerance) for some in _lists(lists)])

    return run(polygons)


def gap(a: Rings, b: Rings) -> float:
    """The distance of two polygons, 0 where they meet."""
    if holds(a, b[0][:1])[0] or holds(b, a[0][:1])[0]:
        return 0.0
    best = np.inf
    for left, right in ((a, b), (b, a)):
        at = np.vstack(left)
        for ring in right:
            p, d = ring, np.roll(ring, -1, axis=0) - ring
            t = np.clip(((at[None] - p[:, None]) * d[:, None]).sum(axis=2) / np.maximum((d * d).sum(axis=1), 1e-300)[:, None], 0, 1)
            best = min(best, float(np.hypot(*np.moveaxis(at[None] - p[:, None] - t[..., None] * d[:, None], 2, 0)).min()))
    for r in a:
        for s in b:  # edges that meet, also in a corner only: its place along an edge is rounded, so `best` may stay a little above 0
            u, v = (r, np.roll(r, -1, axis=0)), (s, np.roll(s, -1, axis=0))
            side = lambda o, e, at: np.sign((e[0] - o[0])[:, None] * (at[None, :, 1] - o[1][:, None]) - (e[1] - o[1])[:, None] * (at[None, :, 0] - o[0][:, None]))
            across = side(u[0].T, u[1].T, v[0]) * side(u[0].T, u[1].T, v[1]) <= 0
            along = side(v[0].T, v[1].T, u[0]) * side(v[0].T, v[1].T, u[1]) <= 0
            boxes = ((np.minimum(*u)[:, None] <= np.maximum(*v)[None]) & (np.minimum(*v)[None] <= np.maximum(*u)[:, None])).all(axis=2)  # of edges on one line
            if (across & along.T & boxes).any():
                return 0.0
    return best


def gap_of(a: Column, b: Column) -> Column:
    """The distance of two polygons of a row."""

    @F.arrow_udf("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([gap(x, y) for x, y in zip(_each(left), _each(right), strict=True)], pa.float64(), from_pandas=True)

    return run(a, b)


def common_of(a: Column, b: Column) -> Column:
    """What two polygons of a row have in common, as an array of polygons."""

    @F.arrow_udf(f"array<{POLYGON}>")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return _list_column([intersection(x, y) for x, y in zip(_each(left), _each(right), strict=True)])

    return run(a, b)
