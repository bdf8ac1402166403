"""LAS point files (1.2 to 1.4, uncompressed) as DataFrames, and back.

Files are read as binary rows, so each file is one task's work and decoded
there; the header alone gives a manifest for pruning.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators.points import Box

POINTS = "cloud_id string, point_id bigint, x double, y double, z double, classification smallint, intensity int, return_number tinyint, num_returns tinyint"
HEADER = "path string, n bigint, xmin double, ymin double, xmax double, ymax double, zmin double, zmax double"
#: Fixed values of the format: most bytes of a header, header size, offsets of the header's fields.
HEADER_READ = 375
HEADER_BYTES, _OFFSET_AT, _FORMAT_AT, _COUNT_AT, _SCALE_AT = 227, 96, 104, 107, 131


def header(data: bytes) -> dict:
    """The fields of a LAS header; ValueError if it is none."""
    if len(data) < HEADER_BYTES or data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    start, = struct.unpack_from("<I", data, _OFFSET_AT)
    kind, length, count = struct.unpack_from("<BHI", data, _FORMAT_AT)
    scale = struct.unpack_from("<12d", data, _SCALE_AT)
    if data[25] >= 4 and len(data) >= 255 and not count:
        count, = struct.unpack_from("<Q", data, 247)
    if kind & 0x80:
        raise ValueError("compressed LAS isn't supported")
    return {"start": start, "kind": kind & 0x3F, "length": length, "n": count, "scale": scale[:3], "offset": scale[3:6], "xmax": scale[6], "xmin": scale[7], "ymax": scale[8], "ymin": scale[9], "zmax": scale[10], "zmin": scale[11]}


def decode(data: bytes) -> dict[str, np.ndarray]:
    """The columns of a LAS file."""
    h = header(data)
    raw = np.frombuffer(data, np.uint8, h["n"] * h["length"], h["start"]).reshape(h["n"], h["length"])
    ints = raw[:, :12].copy().view("<i4")
    out = {c: ints[:, k] * h["scale"][k] + h["offset"][k] for k, c in enumerate("xyz")}
    out["intensity"] = raw[:, 12:14].copy().view("<u2")[:, 0].astype(np.int32)
    if h["kind"] < 6:
        out["return_number"], out["num_returns"], out["classification"] = raw[:, 14] & 7, (raw[:, 14] >> 3) & 7, raw[:, 15] & 31
    else:
        out["return_number"], out["num_returns"], out["classification"] = raw[:, 14] & 15, raw[:, 14] >> 4, raw[:, 16]
    return out


def encode(x: np.ndarray, y: np.ndarray, z: np.ndarray, classification: np.ndarray, intensity: np.ndarray | None = None, returns: tuple | None = None, scale: float = 0.001) -> bytes:
    """A LAS 1.2 file of point format 0."""
    n = len(x)
    low = [float(np.floor(c.min())) if n else 0.0 for c in (x, y, z)]
    body = np.zeros((n, 20), np.uint8)
    for k, c in enumerate((x, y, z)):
        body[:, 4 * k : 4 * k + 4] = np.rint((c - low[k]) / scale).astype("<i4").view(np.uint8).reshape(n, 4)
    body[:, 12:14] = (np.zeros(n) if intensity is None else intensity).astype("<u2").view(np.uint8).reshape(n, 2)
    number, of = returns if returns is not None else (np.ones(n, np.uint8), np.ones(n, np.uint8))
    body[:, 14] = (np.asarray(number, np.uint8) & 7) | ((np.asarray(of, np.uint8) & 7) << 3)
    body[:, 15] = classification.astype(np.uint8) & 31
    head = bytearray(HEADER_BYTES)
    head[:4], head[24:26] = b"LASF", b"\x01\x02"
    struct.pack_into("<HI", head, 94, HEADER_BYTES, HEADER_BYTES)
    struct.pack_into("<BHI", head, _FORMAT_AT, 0, 20, n)
    ends = [e for c in (x, y, z) for e in ((float(c.max()), float(c.min())) if n else (0.0, 0.0))]
    struct.pack_into("<12d", head, _SCALE_AT, scale, scale, scale, *low, *ends)
    return bytes(head) + body.tobytes()


def read_las(spark: SparkSession, path: str | list[str], box: Box | None = None) -> DataFrame:
    """All points of one or many LAS files (or folders of them); `box` keeps those inside."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = decode(data.as_buffer().to_pybytes())
                n = len(c["x"])
                yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1].removesuffix(".las")] * n, pa.string()), pa.array(np.arange(n)), pa.array(c["x"]), pa.array(c["y"]), pa.array(c["z"]), pa.array(c["classification"].astype(np.int16)), pa.array(c["intensity"]), pa.array(c["return_number"].astype(np.int8)), pa.array(c["num_returns"].astype(np.int8))], names=[f.split()[0] for f in POINTS.split(", ")])

    points = files.mapInArrow(run, POINTS)
    return points if box is None else points.where(box.holds(F.col("x"), F.col("y")))


def las_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, n and box of every LAS file. Only the first bytes of a file are read."""
    from urbanloom.sources.files import get

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": p} | {k: v for k, v in header(get(p, HEADER_READ)).items() if k in HEADER} for p in batch["path"]]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in HEADER.split(", ")])

    return files.mapInPandas(run, HEADER)


def read_xyz(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Delimited x, y, z and an optional class, 1 where missing."""
    raw = spark.read.text(path).where("trim(value) != ''").select(F.split("value", f"\\Q{delimiter}\\E").alias("f"))
    return raw.select(*(F.col("f")[k].try_cast("double").alias(c) for k, c in enumerate("xyz")), F.coalesce(F.get("f", F.lit(3)).try_cast("smallint"), F.lit(1).cast("smallint")).alias("classification")).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
