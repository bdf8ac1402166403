"""Files as rows: readers that decode whole files, writers of one file per group, and the choice of a format by suffix.

A file is read by one task and a group is written by one, so what is written is
cut into groups of bounded size first. Paths may have any scheme that pyarrow
knows; all tasks must reach them.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def filesystem(path: str) -> tuple[Any, str]:
    """The file system of a path and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def put(path: str, data: bytes) -> None:
    """Write a file under another name and rename it, so a lost task leaves no half of one."""
    system, inner = filesystem(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{os.getpid()}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, inner)


def get(path: str, size: int | None = None) -> bytes:
    """A file, or its first `size` bytes."""
    system, inner = filesystem(path)
    with system.open_input_file(inner) as file:
        return file.read(size) if size is not None else file.read()


def read_files(spark: SparkSession, path: str | list[str], glob: str, decode: Callable[[bytes], pa.Table], schema: pa.Schema, shape: str) -> DataFrame:
    """file (the name without suffix) and what `decode` gives of every file, as columns of `schema` (DDL `shape`)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    whole = pa.schema([("file", pa.string()), *schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = decode(data.as_buffer().to_pybytes()).cast(schema)
                own = pa.array([name.rsplit("/", 1)[-1].rsplit(".", 1)[0]] * table.num_rows, pa.string())
                yield from pa.Table.from_arrays([own, *table.columns], schema=whole).to_batches(max_chunksize=100_000)

    return files.mapInArrow(run, f"file string, {shape}")


def write_files(rows: DataFrame, keys: list[str], folder: str, suffix: str, encode: Callable[[pa.Table], bytes]) -> DataFrame:
    """path and n of one file per group of `keys` (whose values make its name), written when acted on; a repeated task writes the same file again."""

    def run(group: pa.Table) -> pa.Table:
        name = "-".join(str(group.column(k)[0].as_py()) for k in keys)
        path = f"{folder.rstrip('/')}/{name.replace('/', '_')}.{suffix}"
        put(path, encode(group.drop_columns(keys)))
        return pa.table({"path": [path], "n": pa.array([group.num_rows], pa.int64())})

    return rows.groupBy(*keys).applyInArrow(run, "path string, n bigint")


class Formats:
    """Functions by kind of data and suffix; of two suffixes (.json.zip) the longer one counts."""

    def __init__(self) -> None:
        self.known: dict[str, dict[str, Callable]] = {}

    def add(self, kind: str, suffixes: str, function: Callable) -> None:
        for s in suffixes.split():
            self.known.setdefault(kind, {})[s] = function

    def of(self, kind: str, path: str, given: str | None = None) -> Callable:
        """The function for a path, or for the suffix `given`; ValueError if there is none."""
        if kind not in self.known:
            raise ValueError(f"no formats of {kind}; there are {', '.join(sorted(self.known))}")
        name = path.rstrip("/").rsplit("/", 1)[-1].lower()
        parts = name.split(".")
        for tried in ([given.lstrip(".").lower()] if given else [".".join(parts[-2:]), parts[-1]]):
            if tried in self.known[kind]:
                return self.known[kind][tried]
        raise ValueError(f"{path}: no format of {kind} has this suffix; there are {', '.join(sorted(self.known[kind]))}")


READERS, WRITERS = Formats(), Formats()


def load(spark: SparkSession, path: str, kind: str, suffix: str | None = None, **given: Any) -> Any:
    """Read a path as a kind of data (point_cloud, raster, mesh, footprints, roads, city) by its suffix."""
    from urbanloom.sources import formats  # noqa: F401  registers all

    return READERS.of(kind, path, suffix)(spark, path, **given)


def save(what: Any, path: str, kind: str, suffix: str | None = None, **given: Any) -> Any:
    """Write data of a kind to a path by its suffix."""
    from urbanloom.sources import formats  # noqa: F401

    return WRITERS.of(kind, path, suffix)(what, path, **given)


def info(rows: DataFrame) -> DataFrame:
    """One row about points, vertices or any x, y (z): n and the box of what is neither NULL nor NaN."""
    there = [c for c in "xyz" if c in rows.columns]
    ends = [f(F.nanvl(c, F.lit(None).cast("double"))).alias(f"{c}{n}") for c in there for f, n in ((F.min, "min"), (F.max, "max"))]
    return rows.agg(F.count("*").alias("n"), *ends)


def info_rings(rows: DataFrame, column: str = "ring") -> DataFrame:
    """One row about rings or lines: n and the box of all vertices."""
    held = rows.select(F.explode(column).alias("p")).select("p.x", "p.y")
    return rows.agg(F.count("*").alias("n")).join(info(held).drop("n"), F.lit(True))


def info_raster(cells: DataFrame, grid: Any) -> DataFrame:
    """One row about a raster: rows, cols, cell size, corner, valid cells, least and greatest value."""
    return cells.agg(F.lit(grid.rows).alias("rows"), F.lit(grid.cols).alias("cols"), F.lit(grid.size).alias("size"), F.lit(grid.west).alias("west"), F.lit(grid.north).alias("north"), F.count("value").alias("valid"), F.min("value").alias("min"), F.max("value").alias("max"))


def info_mesh(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row about a mesh: vertices, faces and box."""
    return info(vertices).withColumnRenamed("n", "vertices").join(faces.agg(F.count("*").alias("faces")), F.lit(True))
