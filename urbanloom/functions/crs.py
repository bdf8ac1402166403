"""Coordinate reference systems as expressions: transverse Mercator zones (SWEREF 99, UTM) by the Kruger series on GRS 80, Web Mercator, and degrees.

The text of an expression is valid in Spark and in DuckDB alike. The datums
(SWEREF 99, ETRS 89, WGS 84) count as one, as they do to within a metre.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: GRS 80.
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257222101
_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)
_N = FLATTENING / (2 - FLATTENING)
_A = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)


#: Central meridian, scale, false easting and northing of the local zones, by code.
LOCAL = {3006: (15.0, 0.9996, 500_000.0, 0.0)} | {3007 + k: (m, 1.0, 150_000.0, 0.0) for k, m in enumerate((12.0, 13.5, 15.0, 16.5, 18.0, 14.25, 15.75, 17.25, 18.75, 20.25, 21.75, 23.25))}
DEGREES, WEB, SPHERE = (4326, 4258, 4619), 3857, 6_378_137.0


def zone(code: int) -> tuple[float, float, float, float]:
    """Central meridian, scale, false easting and northing of a transverse Mercator code; ValueError if it is none."""
    if code in LOCAL:
        return LOCAL[code]
    for first, north in ((32600, 0.0), (32700, 10_000_000.0), (25800, 0.0)):
        if 1 <= code - first <= 60:
            return 6.0 * (code - first) - 183.0, 0.9996, 500_000.0, north
    raise ValueError(f"EPSG:{code} isn't known here")


def to_plane(lon: str, lat: str, at: tuple[float, float, float, float] = LOCAL[3006]) -> tuple[str, str]:
    """SQL of easting and northing of longitude and latitude in degrees."""
    meridian, scale, easting, northing = at
    phi, dl = f"radians({lat})", f"radians({lon} - {meridian!r})"
    t = f"sinh(atanh(sin({phi})) - {_E!r} * atanh({_E!r} * sin({phi})))"
    xi, eta = f"atan2({t}, cos({dl}))", f"atanh(sin({dl}) / sqrt(1 + {t} * {t}))"
    north = " + ".join([xi, *(f"{b!r} * sin({2 * k} * {xi}) * cosh({2 * k} * {eta})" for k, b in enumerate(_FORWARD, 1))])
    east = " + ".join([eta, *(f"{b!r} * cos({2 * k} * {xi}) * sinh({2 * k} * {eta})" for k, b in enumerate(_FORWARD, 1))])
    return f"({easting!r} + {scale * _A!r} * ({east}))", f"({northing!r} + {scale * _A!r} * ({north}))"


def to_sphere(x: str, y: str, at: tuple[float, float, float, float] = LOCAL[3006]) -> tuple[str, str]:
    """SQL of longitude and latitude in degrees of easting and northing."""
    meridian, scale, easting, northing = at
    xi, eta = f"(({y} - {northing!r}) / {scale * _A!r})", f"(({x} - {easting!r}) / {scale * _A!r})"
    xi1 = "(" + " - ".join([xi, *(f"{b!r} * sin({2 * k} * {xi}) * cosh({2 * k} * {eta})" for k, b in enumerate(_BACK, 1))]) + ")"
    eta1 = "(" + " - ".join([eta, *(f"{b!r} * cos({2 * k} * {xi}) * sinh({2 * k} * {eta})" for k, b in enumerate(_BACK, 1))]) + ")"
    chi = f"asin(sin({xi1}) / cosh({eta1}))"
    lon = f"({meridian!r} + degrees(atan2(sinh({eta1}), cos({xi1}))))"
    a = (_E2 + _E2**2 + _E2**3 + _E2**4, -(7 * _E2**2 + 17 * _E2**3 + 30 * _E2**4) / 6, (224 * _E2**3 + 889 * _E2**4) / 120, -(4279 * _E2**4) / 1260)
    s, c = f"sin({chi})", f"cos({chi})"
    s2 = f"({s} * {s})"
    lat = f"degrees({chi} + {s} * {c} * ({a[0]!r} + {a[1]!r} * {s2} + {a[2]!r} * {s2} * {s2} + {a[3]!r} * {s2} * {s2} * {s2}))"
    return lon, lat


def epsg(name: str | int | None) -> int | None:
    """The number of a code as it is written: 3006, "3006", "EPSG:3006", "urn:ogc:def:crs:EPSG::3006"; None for none."""
    if name is None or isinstance(name, int):
        return name
    digits = re.search(r"(\d+)\s*$", name.strip())
    if not digits:
        raise ValueError(f"no EPSG code in {name!r}")
    return int(digits.group(1))


def chosen(source: str | int | None, target: str | int | None, of_geometry: str | int | None = None, default: int = 3006) -> tuple[int, int]:
    """The codes to convert from and to: the geometry's own wins over what the caller says, the default comes last; no target means no change."""
    own = epsg(of_geometry) or epsg(source) or default
    return own, epsg(target) or own


def reproject(x: str, y: str, source: int, target: int) -> tuple[str, str]:
    """SQL of the coordinates of one code in another; degrees are longitude, latitude."""
    if source == target or (source in DEGREES and target in DEGREES):
        return x, y
    if source == WEB:
        lon, lat = f"degrees({x} / {SPHERE!r})", f"degrees(2 * atan(exp({y} / {SPHERE!r})) - {math.pi / 2!r})"
    else:
        lon, lat = (x, y) if source in DEGREES else to_sphere(x, y, zone(source))
    if target in DEGREES:
        return lon, lat
    if target == WEB:
        return f"({SPHERE!r} * radians({lon}))", f"({SPHERE!r} * ln(tan({math.pi / 4!r} + radians({lat}) / 2)))"
    return to_plane(lon, lat, zone(target))


def reprojected(rows: DataFrame, source: str | int, target: str | int, x: str = "x", y: str = "y") -> DataFrame:
    """`rows` with the columns x and y in another reference system; all other columns, z among them, stay."""
    new_x, new_y = reproject(f"`{x}`", f"`{y}`", epsg(source), epsg(target))
    held = rows
    if epsg(source) not in DEGREES and epsg(target) not in DEGREES:  # two steps, so that the inner expressions are computed once
        lon, lat = reproject(f"`{x}`", f"`{y}`", epsg(source), DEGREES[0])
        held = rows.select("*", F.inline(F.array(F.struct(F.expr(lon).alias("_lon"), F.expr(lat).alias("_lat")))))
        new_x, new_y = reproject("_lon", "_lat", DEGREES[0], epsg(target))
    return held.withColumns({x: F.expr(new_x), y: F.expr(new_y)}).drop("_lon", "_lat")


def reprojected_ring(ring: Column, source: str | int, target: str | int) -> Column:
    """A ring or line in another reference system; x and y change, further fields stay."""
    new_x, new_y = reproject("p.x", "p.y", epsg(source), epsg(target))
    return F.transform(ring, lambda p: p.withField("x", _compiled(new_x, p)).withField("y", _compiled(new_y, p)))


def _compiled(text: str, q: Column) -> Column:
    """A small reader of the expressions made here: numbers, p.x, p.y, functions and the four operations."""
    tokens = re.findall(r"\d+\.?\d*(?:e[+-]?\d+)?|p\.[xy]|[a-z_0-9]+(?=\()|[()+\-*/,]", text)
    place = 0

    def peek() -> str:
        return tokens[place] if place < len(tokens) else ""

    def take() -> str:
        nonlocal place
        place += 1
        return tokens[place - 1]

    def factor() -> Column:
        t = take()
        if t == "-":
            return -factor()
        if t == "(":
            inner = added()
            take()
            return inner
        if t in ("p.x", "p.y"):
            return q[t[2]]
        if re.fullmatch(r"[a-z_][a-z_0-9]*", t):
            take()
            arguments = [added()]
            while take() == ",":
                arguments.append(added())
            return getattr(F, {"ln": "log"}.get(t, t))(*arguments)
        return F.lit(float(t))

    def multiplied() -> Column:
        left = factor()
        while peek() in ("*", "/"):
            left = left * factor() if take() == "*" else left / factor()
        return left

    def added() -> Column:
        left = multiplied()
        while peek() in ("+", "-"):
            left = left + multiplied() if take() == "+" else left - multiplied()
        return left

    return added()


def degree_box(box: tuple[float, float, float, float], code: int = 3006) -> tuple[float, float, float, float]:
    """A box (xmin, ymin, xmax, ymax) in degrees, by its low and its high corner."""
    from pyspark.sql import SparkSession

    lon, lat = reproject("x", "y", code, DEGREES[0])
    rows = SparkSession.active().createDataFrame([tuple(map(float, box[:2])), tuple(map(float, box[2:4]))], "x double, y double").select(F.expr(lon), F.expr(lat)).collect()
    return (*rows[0], *rows[1])
