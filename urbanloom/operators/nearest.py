"""Nearest positions, exactly, in two radius joins.

A first pass gives every probe an upper bound: the distance to the k-th nearest
index position among those of its own cell. The second pass is a radius join
with that bound as the probe's own radius, which can lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanloom.operators.nearby import METRICS, _choose_pivots, _matrix, radius_pairs
from urbanloom.plans.tables import written

#: Distinct positions in a cell; small, as all pairs of a cell are looked at.
CELL_ROWS = 1_000


def nearest(probes: DataFrame, index: DataFrame, coordinates: list[str], rows: int, k: int = 1, apart: bool = False) -> DataFrame:
    """For every distinct probe position its k nearest distinct index positions, ties broken by position.

    Columns: the probe's coordinates, i_<coordinate>, distance, rank. `apart` leaves out the probe's own position. Fewer than k
    index positions give all of them. NULL and NaN coordinates are left out; an
    empty side gives an empty result.
    """
    metric = "euclidean"
    usable = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in coordinates)
    own = written(index.select(*(F.col(c).cast("double").alias(c) for c in coordinates)).where(usable).distinct(), "positions")
    asked = probes.select(*(F.col(c).cast("double").alias(c) for c in coordinates)).where(usable).distinct()
    pivots = _choose_pivots(own, coordinates, rows, metric, CELL_ROWS)
    fields = ", ".join(f"{c} double" for c in coordinates)
    result = f"{fields}, {', '.join(f'i_{c} double' for c in coordinates)}, distance double, rank int"
    if pivots is None:
        return probes.sparkSession.createDataFrame([], result)
    some, want = np.vstack(pivots.fine), k + apart

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = _matrix(batch, coordinates)
                row, cell, mine = pivots.place(at, np.zeros(len(at)), True)
                row, cell = row[mine], cell[mine]
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("indexed").take(pa.array(row)), *(pa.array(at[row, j]) for j in range(at.shape[1]))], names=["cell", "indexed", *coordinates])

    def bound(cell: pa.Table) -> pa.Table:
        values, indexed = _matrix(cell, coordinates), cell.column("indexed").to_numpy(zero_copy_only=False)
        at, ours = values[~indexed], values[indexed]
        # a cell with too few index positions borrows the pivots, which are index positions too
        ours = ours if len(ours) >= want else np.unique(np.vstack([ours, some]), axis=0)
        reach = np.full(len(at), np.inf)
        step = max(1, 2_000_000 // max(1, len(ours)))
        for begin in range(0, len(at) if len(ours) >= want else 0, step):
            d = METRICS[metric](at[begin : begin + step][:, None, :], ours[None, :, :])
            reach[begin : begin + step] = np.partition(d, want - 1, axis=1)[:, want - 1]
        return pa.Table.from_arrays([*(pa.array(np.ascontiguousarray(at[:, j])) for j in range(at.shape[1])), pa.array(reach)], names=[*coordinates, "r"])

    sides = own.withColumn("indexed", F.lit(True)).unionByName(asked.withColumn("indexed", F.lit(False))).select("indexed", *coordinates)
    bounded = sides.mapInArrow(place, f"cell int, indexed boolean, {fields}").groupBy("cell").applyInArrow(bound, f"{fields}, r double")
    pairs = radius_pairs(own, coordinates, rows, probes=bounded, metric=metric, distinct=True)
    total = F.lit(0.0)
    for c in coordinates:
        total = total + (F.col(c) - F.col(f"i_{c}")) * (F.col(c) - F.col(f"i_{c}"))
    pairs = pairs.withColumn("distance", F.sqrt(total))
    if apart:
        pairs = pairs.where(" OR ".join(f"{c} != i_{c}" for c in coordinates))
    rank = F.row_number().over(Window.partitionBy(*coordinates).orderBy("distance", *(f"i_{c}" for c in coordinates)))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(*coordinates, *(f"i_{c}" for c in coordinates), "distance", "rank")
