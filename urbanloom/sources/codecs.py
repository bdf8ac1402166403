"""Bytes of raster, mesh and message formats to arrays and back: GeoTIFF, PNG, VTK, PLY, glTF, XDMF with inline data, point-cloud messages."""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib

import numpy as np

# GeoTIFF: fixed values of the format

_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
WIDTH, HEIGHT, BITS, PACKING, STRIPS, BANDS, ROWS_A_STRIP, SIZES, PREDICTOR, TILE_W, TILE_H, TILES, TILE_SIZES, KIND = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339
SCALE, TIE, GEO, NODATA = 33550, 33922, 34735, 42113


def decode_tiff(data: bytes) -> dict:
    """values (rows, cols, bands) as floats, west, north, size, epsg and nodata (None where absent) of a GeoTIFF: strips or tiles, plain or deflated, one sample kind."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, = struct.unpack_from(f"{order}I", data, 4)
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack_from(f"{order}H", data, at)[0]):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        if kind not in _TYPES:
            continue
        code, size = _TYPES[kind]
        where = at + 10 + 12 * k if size * count <= 4 else struct.unpack_from(f"{order}I", data, at + 10 + 12 * k)[0]
        tags[tag] = struct.unpack_from(f"{order}{count}s" if code == "s" else f"{order}{count * len(code)}{code[0]}", data, where)
    width, height, bands = tags[WIDTH][0], tags[HEIGHT][0], tags.get(BANDS, (1,))[0]
    packing, predictor = tags.get(PACKING, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    if packing not in (1, 8, 32946) or predictor not in (1, 2):
        raise ValueError(f"TIFF compression {packing} with predictor {predictor} isn't supported")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[tags.get(KIND, (1,))[0]]}{tags[BITS][0] // 8}")
    tiled = TILES in tags
    high, wide = (tags[TILE_H][0], tags[TILE_W][0]) if tiled else (tags.get(ROWS_A_STRIP, (height,))[0], width)
    out = np.zeros((height, width, bands))
    across = -(-width // wide)
    for k, (start, size) in enumerate(zip(tags[TILES if tiled else STRIPS], tags[TILE_SIZES if tiled else SIZES], strict=True)):
        raw = data[start : start + size] if packing == 1 else zlib.decompress(data[start : start + size])
        row, col = k // across * high, k % across * wide
        rows = high if tiled else min(high, height - row)
        block = np.frombuffer(raw, kind, rows * wide * bands).reshape(rows, wide, bands)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind)
        out[row : row + rows, col : col + wide] = block[: height - row, : width - col]
    nodata = tags.get(NODATA)
    scale, tie = tags.get(SCALE, (1.0, 1.0, 0.0)), tags.get(TIE, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    keys = tags.get(GEO, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    return {"values": out, "west": tie[3] - tie[0] * scale[0], "north": tie[4] + tie[1] * scale[1], "size": scale[0], "epsg": codes.get(3072) or codes.get(2048), "nodata": float(nodata[0].split(b"\0")[0]) if nodata else None}


def encode_tiff(values: np.ndarray, west: float, north: float, size: float, epsg: int | None = None, nodata: float | None = None, rows_a_strip: int = 64) -> bytes:
    """A GeoTIFF of doubles (rows, cols[, bands]) in deflated strips."""
    values = values.reshape(*values.shape[:2], -1).astype("<f8")
    height, width, bands = values.shape
    strips = [zlib.compress(values[r : r + rows_a_strip].tobytes()) for r in range(0, max(height, 1), rows_a_strip)]
    starts = np.cumsum([8, *(len(s) for s in strips)])
    geo = [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg] if epsg else [1, 1, 0, 1, 1024, 0, 1, 1]
    entries = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [64] * bands), (PACKING, 3, [8]), (262, 3, [1]), (STRIPS, 4, starts[:-1].tolist()), (BANDS, 3, [bands]), (ROWS_A_STRIP, 4, [rows_a_strip]),
        (SIZES, 4, [len(s) for s in strips]), (284, 3, [1]), (KIND, 3, [3] * bands), (SCALE, 12, [size, size, 0.0]), (TIE, 12, [0.0, 0.0, 0.0, west, north, 0.0]), (GEO, 3, geo),
        *([(NODATA, 2, f"{nodata!r}\0".encode())] if nodata is not None else []),
    ]
    directory, extra, base = b"", b"", int(starts[-1]) + 2 + 12 * len(entries) + 4
    for tag, kind, given in entries:
        body = given if kind == 2 else struct.pack(f"<{len(given)}{_TYPES[kind][0]}", *given)
        place = body.ljust(4, b"\0") if len(body) <= 4 else struct.pack("<I", base + len(extra))
        extra += b"" if len(body) <= 4 else body
        directory += struct.pack("<HHI", tag, kind, len(given)) + place
    return b"II" + struct.pack("<HI", 42, int(starts[-1])) + b"".join(strips) + struct.pack("<H", len(entries)) + directory + b"\0\0\0\0" + extra


# PNG


def encode_png(values: np.ndarray) -> bytes:
    """A grey PNG of whole numbers 0..255 or, if any is larger, 0..65535."""
    deep = bool(values.size and values.max() > 255)
    rows = values.astype(">u2" if deep else "u1")
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", values.shape[1], values.shape[0], 16 if deep else 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The values (rows, cols, channels) of a PNG without palette or interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, head = 8, b"", ()
    while at < len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        if name == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif name == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += 12 + size
    width, height, bits, colour, _, _, laced = head
    if laced or colour == 3 or bits not in (8, 16):
        raise ValueError("a PNG of this kind isn't supported")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    step = channels * bits // 8
    raw, out = zlib.decompress(packed), np.zeros((height, width * step), np.uint8)
    for r in range(height):
        begin = r * (width * step + 1)
        rule, line = raw[begin], np.frombuffer(raw, np.uint8, width * step, begin + 1).astype(np.int64)
        above = out[r - 1].astype(np.int64) if r else np.zeros(width * step, np.int64)
        if rule == 2:
            line = line + above
        elif rule in (1, 3, 4):
            for k in range(len(line)):
                left, corner = (int(line[k - step]), int(above[k - step])) if k >= step else (0, 0)
                if rule == 4:
                    guess = left + int(above[k]) - corner
                    line[k] += min((left, int(above[k]), corner), key=lambda v: abs(guess - v))
                else:
                    line[k] += left if rule == 1 else (left + int(above[k])) // 2
                line[k] &= 255
        out[r] = line & 255
    return out.reshape(height, width, channels) if bits == 8 else out.view(">u2").reshape(height, width, channels)


# meshes


def encode_vtk(vertices: np.ndarray, cells: np.ndarray) -> bytes:
    """A text VTK grid of triangles or tetrahedra."""
    n, corners = cells.shape
    lines = ["# vtk DataFile Version 3.0", "mesh", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {len(vertices)} double", *(" ".join(map(repr, v)) for v in vertices.tolist()), f"CELLS {n} {n * (corners + 1)}", *(" ".join(map(str, [corners, *c])) for c in cells.tolist()), f"CELL_TYPES {n}", *[str({3: 5, 4: 10}[corners])] * n]
    return ("\n".join(lines) + "\n").encode()


def decode_vtk(data: bytes, corners: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the cells of 3 corners (quads as two) or of 4 (tetrahedra) of a text VTK grid or surface."""
    words = data.decode().split()
    upper = [w.upper() for w in words]
    at = upper.index("POINTS")
    n = int(words[at + 1])
    vertices = np.array(words[at + 3 : at + 3 + 3 * n], float).reshape(n, 3)
    place = next(k for k, w in enumerate(upper) if w in ("CELLS", "POLYGONS"))
    count, flat, out = int(words[place + 1]), [int(w) for w in words[place + 3 : place + 3 + int(words[place + 2])]], []
    kinds = [int(w) for w in words[upper.index("CELL_TYPES") + 2 :][:count]] if "CELL_TYPES" in upper else [{3: 5, 4: 9}[flat[0]]] * count
    k = 0
    for kind in kinds:
        own = flat[k + 1 : k + 1 + flat[k]]
        k += 1 + flat[k]
        if corners == 4 and kind == 10:
            out.append(own)
        elif corners == 3 and kind in (5, 9):
            out += [own[:3]] if kind == 5 else [own[:3], [own[0], own[2], own[3]]]
    return vertices, np.array(out, np.int64).reshape(-1, corners)


def encode_ply(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    """A binary PLY mesh."""
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(vertices)}\nproperty double x\nproperty double y\nproperty double z\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    body = np.zeros(len(faces), np.dtype([("n", "u1"), ("v", "<i4", 3)]))
    body["n"], body["v"] = 3, faces
    return head.encode() + vertices.astype("<f8").tobytes() + body.tobytes()


_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def decode_ply(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (x, y, z) and triangles (larger faces as fans) of a PLY mesh, text or binary."""
    end = data.index(b"end_header") + len(b"end_header")
    end = data.index(b"\n", end) + 1
    elements: list[list] = []
    order = ""
    for line in data[:end].decode().splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            order = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[w[1]]
        elif w[:1] == ["element"]:
            elements.append([w[1], int(w[2]), []])
        elif w[:1] == ["property"]:
            elements[-1][2].append(w[1:])
    words, at = (iter(data[end:].split()) if not order else None), end
    vertices, faces = np.zeros((0, 3)), []
    for name, count, properties in elements:
        if order and all(p[0] != "list" for p in properties):
            kind = np.dtype([(p[1], order + _PLY[p[0]]) for p in properties])
            rows = np.frombuffer(data, kind, count, at)
            at += count * kind.itemsize
            if name == "vertex":
                vertices = np.stack([rows[c].astype(float) for c in "xyz"], axis=1)
            continue
        held = []
        for _ in range(count):
            row: dict = {}
            for p in properties:
                if words is not None:
                    row[p[-1]] = [float(next(words)) for _ in range(int(next(words)))] if p[0] == "list" else float(next(words))
                elif p[0] == "list":
                    n = int(np.frombuffer(data, order + _PLY[p[1]], 1, at)[0])
                    at += np.dtype(_PLY[p[1]]).itemsize
                    row[p[-1]] = np.frombuffer(data, order + _PLY[p[2]], n, at).tolist()
                    at += n * np.dtype(_PLY[p[2]]).itemsize
                else:
                    row[p[-1]] = float(np.frombuffer(data, order + _PLY[p[0]], 1, at)[0])
                    at += np.dtype(_PLY[p[0]]).itemsize
            held.append(row)
        if name == "vertex":
            vertices = np.array([[r[c] for c in "xyz"] for r in held], float).reshape(-1, 3)
        elif name == "face":
            for r in held:
                own = [int(v) for v in next(v for v in r.values() if isinstance(v, list))]
                faces += [[own[0], own[k], own[k + 1]] for k in range(1, len(own) - 1)]
    return vertices, np.array(faces, np.int64).reshape(-1, 3)


def encode_gltf(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    """A glTF scene of one mesh, its buffer inline."""
    points, corners = vertices.astype("<f4"), faces.astype("<u4").ravel()
    body = points.tobytes() + corners.tobytes()
    ends = (points.min(axis=0).tolist(), points.max(axis=0).tolist()) if len(points) else ([0.0] * 3, [0.0] * 3)
    scene = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1, "mode": 4}]}],
        "buffers": [{"byteLength": len(body), "uri": "data:application/octet-stream;base64," + base64.b64encode(body).decode()}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": points.nbytes, "target": 34962}, {"buffer": 0, "byteOffset": points.nbytes, "byteLength": corners.nbytes, "target": 34963}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": len(points), "type": "VEC3", "min": ends[0], "max": ends[1]}, {"bufferView": 1, "componentType": 5125, "count": len(corners), "type": "SCALAR"}],
    }
    return json.dumps(scene).encode()


def decode_gltf(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of the first mesh of a glTF scene with an inline buffer."""
    scene = json.loads(data)
    body = base64.b64decode(scene["buffers"][0]["uri"].split(",", 1)[1])
    first = scene["meshes"][0]["primitives"][0]

    def values(k: int) -> np.ndarray:
        a = scene["accessors"][k]
        kind, width = {5126: "<f4", 5125: "<u4", 5123: "<u2"}[a["componentType"]], {"VEC3": 3, "SCALAR": 1}[a["type"]]
        return np.frombuffer(body, kind, a["count"] * width, scene["bufferViews"][a["bufferView"]].get("byteOffset", 0) + a.get("byteOffset", 0))

    return values(first["attributes"]["POSITION"]).astype(float).reshape(-1, 3), values(first["indices"]).astype(np.int64).reshape(-1, 3)


def encode_xdmf(vertices: np.ndarray, cells: np.ndarray, markers: np.ndarray | None = None) -> bytes:
    """An XDMF grid of triangles or tetrahedra with its data inline, and a marker per cell if given."""
    n, corners = cells.shape
    rows = lambda a: "\n".join(" ".join(map(repr, r)) for r in a.tolist())
    item = lambda shape, kind, text: f'<DataItem Dimensions="{shape}" NumberType="{kind}" Format="XML">\n{text}\n</DataItem>'
    marked = "" if markers is None else f'<Attribute Name="marker" AttributeType="Scalar" Center="Cell">{item(n, "Int", " ".join(map(str, markers.tolist())))}</Attribute>\n'
    return f"""<?xml version="1.0"?>
<Xdmf Version="3.0"><Domain><Grid Name="mesh" GridType="Uniform">
<Topology TopologyType="{ {3: "Triangle", 4: "Tetrahedron"}[corners]}" NumberOfElements="{n}">{item(f"{n} {corners}", "Int", rows(cells))}</Topology>
<Geometry GeometryType="XYZ">{item(f"{len(vertices)} 3", "Float", rows(vertices))}</Geometry>
{marked}</Grid></Domain></Xdmf>
""".encode()


def decode_xdmf(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Vertices, cells and markers (None if there are none) of such a grid; data in other files are refused."""
    import xml.etree.ElementTree as tree

    grid = tree.fromstring(data).find(".//Grid")

    def values(element) -> np.ndarray:  # noqa: ANN001
        item = element.find("DataItem")
        if item.get("Format", "XML") != "XML":
            raise ValueError("XDMF data in another file aren't supported")
        return np.array((item.text or "").split(), float)

    corners = {"Triangle": 3, "Tetrahedron": 4}[grid.find("Topology").get("TopologyType")]
    marks = grid.find("Attribute")
    return values(grid.find("Geometry")).reshape(-1, 3), values(grid.find("Topology")).astype(np.int64).reshape(-1, corners), None if marks is None else values(marks).astype(np.int64)


# messages: a point cloud as packed fields, points in single precision

_FIELDS = ("classification", "intensity", "return_number", "num_returns")


def encode_message(points: np.ndarray, attributes: dict[str, np.ndarray]) -> bytes:
    """A point-cloud message: points (field 1, packed floats) and whole-number attributes (fields 2 to 5, packed varints)."""
    out = _field(1, points.astype("<f4").tobytes()) if len(points) else b""
    for k, name in enumerate(_FIELDS, 2):
        if name in attributes and len(attributes[name]):
            out += _field(k, b"".join(_varint(int(v)) for v in attributes[name]))
    return out


def decode_message(data: bytes) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The points and attributes of such a message."""
    points, attributes, at = b"", {}, 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        if tag & 7 != 2:
            raise ValueError("a point-cloud message has packed fields only")
        size, at = _read_varint(data, at)
        body, at = data[at : at + size], at + size
        if tag >> 3 == 1:
            points += body
        elif 2 <= tag >> 3 <= 5:
            values, k = [], 0
            while k < len(body):
                v, k = _read_varint(body, k)
                values.append(v)
            attributes[_FIELDS[(tag >> 3) - 2]] = np.array(values, np.int64)
    return np.frombuffer(points, "<f4").astype(float).reshape(-1, 3), attributes


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


# station texts


def decode_latest_hour(text: str, height: bool = True) -> list[dict]:
    """station_id, name, lat, lon, height, value (None where it is no number), quality, timestamp of a latest-hour CSV.

    Two lines of metadata and a header that names the time come before the
    stations; lines whose first field is no number are titles. Without `height`
    there is no such column and it is 0."""
    lines = [x.split(";") for x in text.replace("\r", "").split("\n")]
    stamp = next((c.strip() for x in lines[:4] for c in x if re.match(r"\s*\d{4}-\d\d-\d\d", c)), None)
    number = lambda t: float(t) if re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", t) else None
    out, shift = [], 1 if height else 0
    for x in lines[2:]:
        if len(x) < 6 + shift or not x[0].strip().isdigit() or number(x[2]) is None or number(x[3]) is None:
            continue
        out.append({"station_id": x[0].strip(), "name": x[1].strip(), "lat": number(x[2]), "lon": number(x[3]), "height": (number(x[4]) or 0.0) if height else 0.0, "value": number(x[4 + shift]), "quality": x[5 + shift].strip(), "timestamp": stamp})
    return out


def decode_day_series(text: str, active_only: bool = True) -> list[dict]:
    """key, name, lat, lon, date (milliseconds) and value of the last entry with a value of every station of a hydrology answer {station: [...], value: [...]}."""
    whole = json.loads(text)
    series = [v for v in whole.get("value") or [] if v.get("value") is not None]
    last = max(series, key=lambda v: v["date"], default={})
    own = [s for s in whole.get("station") or [] if s.get("active", True) or not active_only]
    return [{"key": str(s["key"]), "name": s.get("name"), "lat": s.get("latitude"), "lon": s.get("longitude"), "date": last.get("date"), "value": last.get("value")} for s in own]


def decode_series(text: str, phenomenon: str | None = None) -> list[dict]:
    """id, timestamp (milliseconds), value and unit of the last values of an air-quality answer; only series of a phenomenon if given."""
    whole = json.loads(text)
    rows = whole if isinstance(whole, list) else [whole]
    named = [r for r in rows if phenomenon is None or str((r.get("parameters") or {}).get("phenomenon", {}).get("id")) == phenomenon]
    return [{"id": str(r.get("id")), "timestamp": (r.get("lastValue") or {}).get("timestamp"), "value": (r.get("lastValue") or {}).get("value"), "unit": r.get("uom")} for r in named]
