"""Connected components and edge operators of graphs of any size and shape."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.plans.tables import written

MOST_ROUNDS = 60
#: Edges that a task contracts at once.
EDGES_AT_ONCE = 1_000_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of some edges that isn't the least of its component, and that least one."""
    nodes, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = codes[: len(u)], codes[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, least)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        text = pa.types.is_string(t.schema.types[0])
        u, v = (np.array(t.column(k).to_pylist(), dtype=object) if text else t.column(k).to_numpy() for k in range(2))
        node, least = contracted(u, v)
        return pa.RecordBatch.from_arrays([pa.array(node, t.schema.types[0]), pa.array(least, t.schema.types[0])], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= EDGES_AT_ONCE:
            yield done()
            held = []
    if held and sum(x.num_rows for x in held):
        yield done()


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """node, component (its least node) of every node that an edge names.

    Edges are laid in ranges of their greater node, and every task contracts its
    own to stars, which shortens paths; alternating large and small stars do the
    rest in rounds that grow with the logarithm of the longest path left. Each
    round is written to the shared folder. Self-loops name their node; edges
    with a NULL end are left out.
    """
    held = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL"), "edges")
    nodes = held.select(F.col("u").alias("node")).union(held.select("v")).distinct()
    kind = held.schema["u"].dataType.simpleString()
    laid = held.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).repartitionByRange("u")
    now = written(laid.mapInArrow(_contract, f"u {kind}, v {kind}").distinct(), "stars")
    mark = None
    for _ in range(MOST_ROUNDS):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.join(least, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v")))
        now = written(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def adjacency(edges: DataFrame, both_ways: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Entries (src, dst, length) of the adjacency matrix: lengths of equal entries add up, a self-loop is entered once."""
    held = edges.select(*keys, "src", "dst", "length")
    if both_ways:
        held = held.union(held.where("src != dst").select(*keys, F.col("dst"), F.col("src"), "length"))
    return held.groupBy(*keys, "src", "dst").agg(F.sum("length").alias("length"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: how many edge ends meet at each node (a self-loop has two)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def naked_edges(faces: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The edges (lesser vertex first) that exactly one face uses."""
    sides = F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    return faces.select(*keys, F.inline(sides)).groupBy(*keys, "a", "b").agg(F.count("*").alias("n")).where("n = 1").drop("n")


def tet_boundary(cells: DataFrame) -> DataFrame:
    """The triangles (sorted vertices) that exactly one tetrahedron has, with that cell."""
    faces = F.array(*(F.sort_array(F.array(*t)) for t in (("v0", "v1", "v2"), ("v0", "v1", "v3"), ("v0", "v2", "v3"), ("v1", "v2", "v3"))))
    held = cells.select("cid", F.explode(faces).alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.min("cid").alias("cid")).where("n = 1")
    return held.select("cid", *(F.col("f")[k].alias(f"v{k}") for k in range(3)))
