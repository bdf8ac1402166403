"""Radius joins: for every probe, all index rows within its radius, exactly.

Space is cut into Voronoi cells around pivots, in two levels. An index row goes
to its one cell. A probe goes to every cell that can hold a row within its
radius: if q is nearest to pivot b among its siblings and d(p, q) <= r, then
d(p, b) <= d(p, b') + 2r for every sibling b' (triangle inequality), so cells
beyond that bound can be left out and no pair is lost. Inside a cell a
vantage-point tree, built and searched for all probes of the cell at once,
gives the candidates, which the exact metric decides.

Only distinct positions take part, so rows that share a position, however many,
cost one; pivots are drawn from distinct positions, so dense areas get more
cells. Pivots are bounded in number and are the only thing sent to all tasks;
where they don't suffice, cells are sliced by a hash of the position and probes
go to every slice, so a task holds no more however many rows there are.

On the sphere all bounds are taken on chords through it, a true metric that is
well conditioned everywhere; arcs only decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.plans.tables import written

#: Metres; the mean radius that great-circle distances are taken on.
EARTH_RADIUS = 6_371_008.8
#: Distinct positions that a cell should hold, and the most pivots (96 bytes each at most go to every task).
CELL_ROWS, MAX_PIVOTS = 12_000, 65_536
LEAF = 48
#: Slack of all pruning (units of the coordinates; metres on the sphere, where chords are exact to 1e-8), so that rounding of a bound never loses a pair; the exact test has none.
SLACK = 1e-6
#: Rows of a result that a task holds before it hands them on.
OUT_ROWS = 100_000
#: A box is asked for in at most so many pieces along its longer side.
PIECES = 64


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of two stacks of positions, broadcast over all but the last axis."""
    total = np.square(a[..., 0] - b[..., 0])
    for k in range(1, a.shape[-1]):
        total += np.square(a[..., k] - b[..., k])
    return np.sqrt(total)


def _half_chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The squared half chord of the unit sphere between stacks of (lon, lat) in degrees (the haversine)."""
    lat1, lat2 = np.radians(a[..., 1]), np.radians(b[..., 1])
    return np.square(np.sin((lat2 - lat1) / 2)) + np.cos(lat1) * np.cos(lat2) * np.square(np.sin(np.radians(b[..., 0] - a[..., 0]) / 2))


def great_circle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances in metres along the sphere of (lon, lat) in degrees, by both half chords (to the point and to its antipode), so exact near either."""
    lat1, lat2 = np.radians(a[..., 1]), np.radians(b[..., 1])
    far = np.square(np.sin((lat2 + lat1) / 2)) + np.cos(lat1) * np.cos(lat2) * np.square(np.cos(np.radians(b[..., 0] - a[..., 0]) / 2))
    return 2 * EARTH_RADIUS * np.arctan2(np.sqrt(_half_chord(a, b)), np.sqrt(far))


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances in metres through the sphere of (lon, lat) in degrees."""
    return 2 * EARTH_RADIUS * np.sqrt(np.minimum(_half_chord(a, b), 1.0))


METRICS = {"euclidean": euclidean, "great_circle": great_circle}
#: The metric that bounds are taken in, and a radius of each metric in it.
BOUNDS = {
    "euclidean": (euclidean, lambda r: r),
    "great_circle": (chord, lambda r: 2 * EARTH_RADIUS * np.sin(np.minimum(r / (2 * EARTH_RADIUS), math.pi / 2))),
}


class Pivots:
    """Two levels of Voronoi cells. The first pivots are the coarse ones; every other goes to its nearest coarse one."""

    def __init__(self, positions: np.ndarray, metric: str) -> None:
        self.metric = metric
        coarse = max(1, round(math.sqrt(len(positions))))
        self.coarse = positions[:coarse]
        step = max(1, 2_000_000 // coarse)
        near = np.concatenate([BOUNDS[metric][0](positions[k : k + step][:, None, :], self.coarse[None, :, :]).argmin(axis=1) for k in range(0, len(positions), step)])
        self.fine = [positions[near == a] for a in range(coarse)]
        self.fine = [f if len(f) else self.coarse[a : a + 1] for a, f in enumerate(self.fine)]
        self.offset = np.cumsum([0, *(len(f) for f in self.fine)])

    def place(self, at: np.ndarray, radius: np.ndarray, home: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, cell and whether it is the row's own cell, for the own cell (`home`) and all that its ball may reach."""
        distance, as_bound = BOUNDS[self.metric]
        radius = as_bound(radius)
        first = distance(at[:, None, :], self.coarse[None, :, :])
        own, reach = first.argmin(axis=1), first.min(axis=1) + 2 * radius + SLACK
        rows, cells, mine = [], [], []
        for a, children in enumerate(self.fine):
            near = np.flatnonzero(first[:, a] <= reach)
            if not len(near):
                continue
            second = distance(at[near][:, None, :], children[None, :, :])
            best = second.argmin(axis=1)
            within = second <= (second.min(axis=1) + 2 * radius[near] + SLACK)[:, None]
            if home:
                is_own = own[near] == a
                rows.append(near[is_own])
                cells.append(self.offset[a] + best[is_own])
                mine.append(np.ones(int(is_own.sum()), bool))
                within[np.flatnonzero(is_own), best[is_own]] = False
            r, c = np.nonzero(within)
            rows.append(near[r])
            cells.append(self.offset[a] + c)
            mine.append(np.zeros(len(r), bool))
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(mine)


def tree_join(index: np.ndarray, probe: np.ndarray, radius: np.ndarray, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (probe, index) places with distance <= radius, in blocks, by a vantage-point tree that is built as it is searched."""
    exact, (distance, as_bound) = METRICS[metric], BOUNDS[metric]
    bound = as_bound(radius) + SLACK
    stack = [(np.arange(len(index)), np.arange(len(probe)))]
    while stack:
        inside, asking = stack.pop()
        if not len(inside) or not len(asking):
            continue
        if len(inside) > LEAF:
            vantage = index[inside[0]]
            to_index = distance(index[inside], vantage[None, :])
            middle = np.partition(to_index, len(inside) // 2)[len(inside) // 2]
            near = to_index < middle
            if near.any():
                to_probe, reach = distance(probe[asking], vantage[None, :]), bound[asking]
                stack.append((inside[near], asking[to_probe - reach < middle]))
                stack.append((inside[~near], asking[to_probe + reach >= middle]))
                continue
        for begin in range(0, len(asking), max(1, 2_000_000 // len(inside))):
            part = asking[begin : begin + max(1, 2_000_000 // len(inside))]
            hit_p, hit_i = np.nonzero(exact(probe[part][:, None, :], index[inside][None, :, :]) <= radius[part][:, None])
            if len(hit_p):
                yield part[hit_p], inside[hit_i]


def _choose_pivots(positions: DataFrame, names: list[str], rows: int, metric: str, cell_rows: int = CELL_ROWS) -> Pivots | None:
    """Pivots from the distinct positions with the smallest hashes; a bounded sample that is the same in every run."""
    wanted = min(MAX_PIVOTS, max(1, math.ceil(rows / cell_rows)))
    hashed = positions.select(*names, F.xxhash64(*names).alias("_h"))
    # about four times as many as wanted pass the filter, whatever the size
    share = min(1.0, 4.0 * wanted / max(rows, 1))
    if share < 1.0:
        hashed = hashed.where(F.col("_h") < int(-(2**63) + share * 2**64))
    got = hashed.distinct().orderBy("_h", *names).limit(wanted).drop("_h").collect()
    if not got:
        got = positions.select(*names).limit(1).collect()
    return Pivots(np.array([tuple(r) for r in got], float), metric) if got else None


def _matrix(batch: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    columns = [batch.column(n) for n in names]
    return np.column_stack([(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).to_numpy(zero_copy_only=False) for c in columns]).astype(float)


def _batch(blocks: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    whole = np.vstack(blocks)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(whole[:, k])) for k in range(whole.shape[1])], names=names)


def radius_pairs(index: DataFrame, coordinates: list[str], rows: int, probes: DataFrame | None = None, radius: float | None = None, metric: str = "euclidean", boxes: list[str] | None = None, distinct: bool = False, slice_rows: int = MAX_PIVOTS * CELL_ROWS) -> DataFrame:
    """Pairs of distinct positions at most a radius apart.

    `index` holds positions in the columns `coordinates`; `rows` is about how
    many (it sets the number of cells only). Without `probes` it is joined with
    itself at `radius`: the result has a_<c> and b_<c> per coordinate c, the
    smaller position first, no position with itself. With `probes` (columns
    `coordinates`, `r`, and any others, all double), the result has i_<c> for
    index positions and all probe columns; with `boxes` (the probe columns of the
    low sides, then of the high sides) only positions inside the closed box come
    out. `distinct` says that index positions are usable and distinct already.

    Defined results: positions with a NULL or NaN coordinate are in no pair, nor
    are probes with a NULL, NaN or negative radius; repeated positions count
    once; an empty side gives an empty result.
    """
    usable = lambda df, names: df.where(" AND ".join(f"{n} IS NOT NULL AND NOT isnan({n})" for n in names))
    d = len(coordinates)
    index = index.select(*(F.col(c).cast("double").alias(c) for c in coordinates))
    index = index if distinct else usable(index, coordinates)
    pivots = _choose_pivots(index, coordinates, rows, metric)
    carried = [*coordinates, "r"] if probes is None else [c for c in probes.columns]
    extra = [c for c in carried if c not in coordinates and c != "r"]
    order = [*coordinates, "r", *extra]
    ours = index if distinct else index.distinct()
    slices = max(1, math.ceil(rows / slice_rows))
    if probes is None:
        ours = ours.withColumn("r", F.lit(float(radius)))
    else:
        ours = ours.withColumns({c: F.lit(0.0) for c in ["r", *extra]})
    sides = ours.select(F.lit(True).alias("indexed"), *order)
    if probes is not None:
        asked = usable(probes.select(*(F.col(c).cast("double").alias(c) for c in order)), [*coordinates, "r"]).where("r >= 0").distinct()
        sides = sides.unionByName(asked.select(F.lit(False).alias("indexed"), *order))
    fields = ", ".join(f"{c} double" for c in order)
    alone = probes is None
    placed_schema = pa.schema([("cell", pa.int32()), ("indexed", pa.bool_()), ("own", pa.bool_()), *((c, pa.float64()) for c in order)])
    names_out = [f"{side}_{c}" for side in "ab" for c in coordinates] if alone else [*(f"i_{c}" for c in coordinates), *order]
    spark = index.sparkSession
    result = ", ".join(f"{c} double" for c in names_out)
    if pivots is None:
        return spark.createDataFrame([], result)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _matrix(batch, order)
            indexed = batch.column("indexed").to_numpy(zero_copy_only=False)
            for side in (True, False):
                own_rows = np.flatnonzero(indexed == side)
                if not len(own_rows):
                    continue
                at = values[own_rows]
                reach = at[:, d] if alone or not side else np.zeros(len(at))
                row, cell, mine = pivots.place(at[:, :d], reach, side)
                if slices > 1:  # an index row has one slice of its cell, a probe has all
                    home = (np.ascontiguousarray(at[:, :d]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).sum(axis=1) % np.uint64(slices)
                    every = np.tile(np.arange(slices), len(row))
                    row, cell, mine = (np.repeat(v, slices) for v in (row, cell, mine))
                    cell, mine = cell * slices + every, mine & (home[row] == every)
                if side and not alone:
                    row, cell, mine = row[mine], cell[mine], mine[mine]
                out = at[row]
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(np.full(len(row), side)), pa.array(mine), *(pa.array(out[:, k]) for k in range(len(order)))], schema=placed_schema)

    places = [order.index(c) for c in boxes or []]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(batches))
        values = _matrix(cell, order)
        own = cell.column("own").to_numpy(zero_copy_only=False)
        at = values[own][:, :d]
        asking = values if alone else values[~own]
        held, count = [], 0
        for p, i in tree_join(at, np.ascontiguousarray(asking[:, :d]), asking[:, d], metric):
            if alone:
                a, b = asking[p][:, :d], at[i]
                smaller = np.zeros(len(a), bool)
                tied = np.ones(len(a), bool)
                for k in range(d):
                    smaller |= tied & (a[:, k] < b[:, k])
                    tied &= a[:, k] == b[:, k]
                out = np.hstack([a[smaller], b[smaller]])
            else:
                for k, c in enumerate(places[: len(places) // 2]):
                    inside = (at[i, k] >= asking[p, c]) & (at[i, k] <= asking[p, places[k + len(places) // 2]])
                    p, i = p[inside], i[inside]
                out = np.hstack([at[i], asking[p]])
            held.append(out)
            count += len(out)
            if count >= OUT_ROWS:
                yield _batch(held, names_out)
                held, count = [], 0
        if count:
            yield _batch(held, names_out)

    placed = sides.mapInArrow(place, f"cell int, indexed boolean, own boolean, {fields}")
    return placed.groupBy("cell").applyInArrow(join, result)


def neighbours(rows: DataFrame, key: str, coordinates: list[str], radius: float, metric: str = "euclidean", apart: str | None = None) -> DataFrame:
    """All pairs of rows of different `key` (and different `apart`, if given) at most `radius` apart.

    Columns a_id, b_id (the keys as strings, a_id < b_id), each pair once.

    Defined results: rows with a NULL key or a NULL or NaN coordinate are in no
    pair; rows of one key that occur at several positions pair at any of them;
    repeated rows count once; extra columns are left out; an empty table gives
    an empty result.
    """
    group = F.col(apart) if apart else F.col(key)
    held = rows.select(F.col(key).cast("string").alias("id"), group.cast("string").alias("apart"), *(F.col(c).cast("double").alias(c) for c in coordinates))
    held = held.where(" AND ".join(["id IS NOT NULL", "apart IS NOT NULL", *(f"{c} IS NOT NULL AND NOT isnan({c})" for c in coordinates)]))
    # every position once, and whether several groups share it
    mark = F.xxhash64("apart")
    spots = written(held.groupBy(*coordinates).agg((F.min(mark) != F.max(mark)).alias("several")), "positions")
    pairs = radius_pairs(spots, coordinates, spots.count(), radius=radius, metric=metric, distinct=True)
    # positions that hold several rows pair with themselves
    shared = spots.where("several").select(*(F.col(c).alias(f"a_{c}") for c in coordinates), *(F.col(c).alias(f"b_{c}") for c in coordinates))
    pairs = written(pairs.unionByName(shared), "pairs")
    side = lambda p: pairs.select(*(F.col(f"{p}_{c}").alias(c) for c in coordinates))
    # the rows at the positions of any pair, read in one pass
    touched = written(held.join(side("a").union(side("b")).distinct(), coordinates).distinct(), "touched")
    out = pairs
    for p in "ab":
        out = out.join(touched.select(F.col("id").alias(f"{p}_id"), F.col("apart").alias(f"{p}_apart"), *(F.col(c).alias(f"{p}_{c}") for c in coordinates)), [f"{p}_{c}" for c in coordinates])
    out = out.where("a_id != b_id AND a_apart != b_apart")
    return out.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()


def _hypotenuse(*sides: Column) -> Column:
    total = sides[0] * sides[0]
    for s in sides[1:]:
        total = total + s * s
    return F.sqrt(total)


def containing_boxes(rows: DataFrame, key: str, boxes: DataFrame, box_key: str) -> DataFrame:
    """a_id and b_id of every row (columns x, y) and box (xmin, ymin, xmax, ymax) that holds it, edges included.

    A box is asked for as the balls around its pieces, about as long as wide (at
    most PIECES); positions in a ball are tested against the box before they
    come out. Defined results: rows with a NULL or NaN x or y, and boxes with a
    NULL or NaN side or reversed sides, are in no pair; each pair comes once;
    extra columns are left out; an empty side gives an empty result.
    """
    sides = ["xmin", "ymin", "xmax", "ymax"]
    whole = boxes.select(F.col(box_key).cast("string").alias("b_id"), *(F.col(c).cast("double").alias(c) for c in sides)).where(" AND ".join(["b_id IS NOT NULL", "xmin <= xmax", "ymin <= ymax", *(f"{c} IS NOT NULL AND NOT isnan({c})" for c in sides)]))
    held = rows.select(F.col(key).cast("string").alias("a_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("a_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    wide, high = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    pieces = F.least(F.greatest(F.floor(F.greatest(wide, high) / F.greatest(F.least(wide, high), F.lit(1e-300))), F.lit(1)), F.lit(PIECES)).cast("int")
    cut = whole.select(*sides).distinct().withColumn("_n", pieces).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    low, size = (F.struct("xmin", "ymin"), F.struct((wide / F.when(wide >= high, F.col("_n")).otherwise(1)).alias("x"), (high / F.when(wide >= high, 1).otherwise(F.col("_n"))).alias("y")))
    cut = cut.select(*sides, "_k", low.alias("_low"), size.alias("_size"), (wide >= high).alias("_flat"))
    along = lambda c, flat: F.col(f"_low.{c}min") + F.col(f"_size.{c}") * (F.when(F.col("_flat") == flat, F.col("_k")).otherwise(0) + 0.5)
    radius = _hypotenuse(F.col("_size.x"), F.col("_size.y")) / 2 * (1 + 1e-9) + SLACK + (F.abs("xmin") + F.abs("xmax") + F.abs("ymin") + F.abs("ymax")) * 1e-15
    balls = cut.select(along("x", True).alias("x"), along("y", False).alias("y"), radius.alias("r"), *sides)
    near = radius_pairs(held.select("x", "y"), ["x", "y"], rows.count(), probes=balls, boxes=sides)
    inside = near.select(F.col("i_x").alias("x"), F.col("i_y").alias("y"), *sides).distinct()
    return inside.join(held, ["x", "y"]).join(whole, sides).select("a_id", "b_id").distinct()
