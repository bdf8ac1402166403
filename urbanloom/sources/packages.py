"""GeoPackage layers."""

from __future__ import annotations

import os
import sqlite3
import struct
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from urbanloom.sources.vectors import RING

_ENVELOPE = (0, 32, 48, 48, 64)


def decode_wkb(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """The polygons (lists of rings) of a WKB polygon or multipolygon, x and y only."""
    def read(at: int) -> tuple[list, int]:
        order = "<" if data[at] else ">"
        kind, = struct.unpack_from(f"{order}I", data, at + 1)
        at += 5
        if kind & 0x20000000:
            at += 4
        flat = kind & 0xFFFF
        size = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}[flat // 1000]
        count, = struct.unpack_from(f"{order}I", data, at)
        at += 4
        if flat % 1000 == 6:
            polygons = []
            for _ in range(count):
                inner, at = read(at)
                polygons += inner
            return polygons, at
        if flat % 1000 != 3:
            raise ValueError(f"WKB type {kind} isn't a polygon")
        rings = []
        for _ in range(count):
            n, = struct.unpack_from(f"{order}I", data, at)
            values = struct.unpack_from(f"{order}{n * size}d", data, at + 4)
            rings.append([(values[k * size], values[k * size + 1]) for k in range(n)])
            at += 4 + 8 * n * size
        return [rings], at

    return read(0)[0]


def read_gpkg_polygons(spark: SparkSession, path: str, layer: str, geometry: str = "geom") -> DataFrame:
    """path, fid, part, ring (closed as stored) of the polygons of a GeoPackage layer; each file is read whole by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gpkg").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                with tempfile.TemporaryDirectory() as folder:  # sqlite reads files only; the copy lives as long as the task
                    copy = os.path.join(folder, "a.gpkg")
                    with open(copy, "wb") as f:
                        f.write(data)
                    with sqlite3.connect(copy) as db:
                        rows = db.execute(f'SELECT rowid, "{geometry}" FROM "{layer}" WHERE "{geometry}" IS NOT NULL').fetchall()
                out = []
                for fid, blob in rows:
                    body = blob[8 + _ENVELOPE[(blob[3] >> 1) & 7] :]
                    out += [(name, fid, part, [{"x": x, "y": y} for x, y in rings[0]]) for part, rings in enumerate(decode_wkb(body)) if rings]
                yield pd.DataFrame(out, columns=["path", "fid", "part", "ring"])

    return files.mapInPandas(run, f"path string, fid bigint, part int, ring {RING}")
