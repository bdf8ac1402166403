"""Queries over polygon repair, merging and surfaces, with their SQL: shapes with known results are made of every survey box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.functions import geometry as geo
from urbanloom.functions import overlay as ov
from urbanloom.functions import surfaces as sf
from urbanloom.operators import footprints as fp
from urbanloom.queries.city import _B, _boxes, _components

#: The shapes need some room.
_ROOMY = "xmax - xmin > 2 AND ymax - ymin > 2"


def _at(x: float, y: float) -> tuple[Column, Column]:
    """A place in the box, from 0 to 1 along its sides."""
    return F.col("xmin") + (F.col("xmax") - F.col("xmin")) * x, F.col("ymin") + (F.col("ymax") - F.col("ymin")) * y


def _shaped(spark: SparkSession, sf_dir: str, ring: Column, holes: Column | None = None) -> DataFrame:
    return _boxes(spark, sf_dir).where(_ROOMY).select("bounds_id", "xmin", "ymin", "xmax", "ymax", ov.as_polygon(ring, holes).alias("polygon"))


def _box_ring() -> Column:
    return geo.ring_of(_at(0, 0), _at(1, 0), _at(1, 1), _at(0, 1))


def _notched(width: float) -> Column:
    """The box with a slot of `width` from the middle of its upper side to its centre."""
    (cx, cy), half = _at(0.5, 0.5), width / 2
    top = F.col("ymax")
    return geo.ring_of(_at(0, 0), _at(1, 0), _at(1, 1), (cx + half, top), (cx + half, cy), (cx - half, cy), (cx - half, top), _at(0, 1))


def _area(polygon: Column) -> Column:
    return _round(F.coalesce(ov.measured(polygon, ov.polygon_area), F.lit(0.0)))


def _round(area: Column, digits: int = 2) -> Column:
    """Rounded a third of a square millimetre up, so that areas of whole square centimetres never lie on the edge of two roundings."""
    return F.round(area + 3.3e-7, digits)


def polygon_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes grown by 3 m and shrunk by 2 m, with mitred corners."""
    held = _shaped(spark, sf_dir, _box_ring())
    first = lambda d: F.get(ov.parts_of(F.col("polygon"), ov.buffered, d), F.lit(0))
    held = held.select("bounds_id", first(3.0).alias("more"), first(-2.0).alias("less"))
    return held.select("bounds_id", _area(F.col("more")).alias("grown"), _area(F.col("less")).alias("shrunk"))


def polygon_notches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot of 40 cm: the clearance it leaves, and the area once it is closed as a sliver, as a gap, and by the repair of the clearance."""
    held = _shaped(spark, sf_dir, _notched(0.4))
    held = held.select("bounds_id", "polygon", fp.without_slivers(F.col("polygon"), 0.5).alias("a"), ov.changed(F.col("polygon"), ov.gaps_filled, 0.5).alias("b"), fp.with_clearance(F.col("polygon"), 0.5).alias("c"))
    return held.select("bounds_id", F.round(ov.measured(F.col("polygon"), ov.clearance), 3).alias("clearance"), _area(F.col("a")).alias("slivers"), _area(F.col("b")).alias("gaps"), _area(F.col("c")).alias("cleared"))


def polygon_edges_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot of 30 cm whose sides are pushed apart to 50 cm."""
    held = _shaped(spark, sf_dir, _notched(0.3)).select("bounds_id", ov.changed(F.col("polygon"), ov.edges_apart, 0.5).alias("polygon"))
    return held.select("bounds_id", F.round(ov.measured(F.col("polygon"), ov.clearance), 3).alias("clearance"))


def polygon_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with a corner 5 cm off the middle of every side, simplified by 10 cm."""
    (cx, _), (_, cy), d = _at(0.5, 0), _at(0, 0.5), 0.05
    ring = geo.ring_of(_at(0, 0), (cx, F.col("ymin") - d), _at(1, 0), (F.col("xmax") + d, cy), _at(1, 1), (cx, F.col("ymax") - d), _at(0, 1), (F.col("xmin") + d, cy))
    held = _shaped(spark, sf_dir, ring).select("bounds_id", fp.simplified(F.col("polygon"), 0.1).alias("polygon"))
    return held.select("bounds_id", F.size("polygon.shell").alias("corners"), _area(F.col("polygon")).alias("area"))


def polygon_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with a hole of a quarter of their area and one of 0.25 square metres: as they are, without the small one, without any, and cleaned."""
    small = geo.ring_of(*((F.col("xmin") + x, F.col("ymin") + y) for x, y in ((0.25, 0.25), (0.25, 0.75), (0.75, 0.75), (0.75, 0.25))))
    large = geo.ring_of(_at(0.45, 0.45), _at(0.45, 0.95), _at(0.95, 0.95), _at(0.95, 0.45))
    held = _shaped(spark, sf_dir, _box_ring(), F.array(small, large)).where("xmax - xmin > 8 AND ymax - ymin > 8")
    held = held.select("bounds_id", "polygon", fp.without_small_holes(F.col("polygon")).alias("a"), ov.without_holes(F.col("polygon")).alias("b"), fp.cleaned(F.col("polygon"), 0.2).alias("c"))
    return held.select("bounds_id", *(_area(F.col(c)).alias(n) for c, n in (("polygon", "area"), ("a", "large_only"), ("b", "filled"), ("c", "cleaned"))))


def polygon_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bow ties over the boxes: whether they cross themselves, and the parts and area of the repair."""
    held = _shaped(spark, sf_dir, geo.ring_of(_at(0, 0), _at(1, 1), _at(1, 0), _at(0, 1))).select("bounds_id", "polygon", ov.parts_of(F.col("polygon"), ov.repaired).alias("parts"))
    area = F.aggregate(F.transform("parts", lambda p: geo.area(p.shell)), F.lit(0.0), lambda a, b: a + b)
    return held.select("bounds_id", (ov.measured(F.col("polygon"), lambda r: float(ov.crosses_itself(r[0]))) == 1).alias("crosses"), F.size("parts").alias("parts"), _round(area).alias("area"))


def polygon_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wedges of 2.9 degrees, whose sharp corner gets a second one 20 cm beside it."""
    wedge = geo.ring_of(_at(0, 0), _at(1, 0), (F.col("xmax"), F.col("ymin") + (F.col("xmax") - F.col("xmin")) / 20))
    held = _shaped(spark, sf_dir, wedge).select("bounds_id", ov.changed(F.col("polygon"), ov.blunted, 5.0, 0.2).alias("polygon"))
    return held.select("bounds_id", F.size("polygon.shell").alias("corners"), _area(F.col("polygon")).alias("area"))


def polygon_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area that every two boxes have in common."""
    held = _shaped(spark, sf_dir, _box_ring())
    side = lambda p: held.select(F.col("bounds_id").alias(p), F.col("polygon").alias(f"_{p}"))
    pairs = fp.polygons_within(held, "bounds_id", 0.0).join(side("a"), "a").join(side("b"), "b")
    common = F.aggregate(F.transform(ov.common_of(F.col("_a"), F.col("_b")), lambda p: geo.area(p.shell)), F.lit(0.0), lambda a, b: a + b)
    return pairs.select("a", "b", _round(common).alias("area")).where("area > 0.01")


def polygon_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes at most 15 m apart, by the distance of their outlines."""
    return fp.polygons_within(_shaped(spark, sf_dir, _box_ring()), "bounds_id", 15.0)


def polygon_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that meet, as one outline: members and area."""
    held = _shaped(spark, sf_dir, _box_ring())
    out = fp.merged(held, "bounds_id", fp.merge_groups(held, "bounds_id", 0.0), 0.0)
    return out.select("component", "members", _round(ov.measured(F.col("polygon"), ov.polygon_area), 1).alias("area"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surfaces of blocks of 12 m over the boxes, every wall in two halves: bounds_id, sid, ring."""
    (cx, cy), low, high = _at(0.5, 0.5), F.lit(0.0), F.lit(12.0)
    ring = geo.ring_of(_at(0, 0), (cx, F.col("ymin")), _at(1, 0), (F.col("xmax"), cy), _at(1, 1), (cx, F.col("ymax")), _at(0, 1), (F.col("xmin"), cy))
    held = _boxes(spark, sf_dir).where(_ROOMY).select("bounds_id", F.posexplode(geo.extrude(ring, low, high)).alias("k", "ring"))
    return held.select("bounds_id", F.concat_ws("-", "bounds_id", F.lpad(F.col("k").cast("string"), 2, "0")).alias("sid"), "ring")


def surface_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal, area and planarity of every surface of the blocks."""
    n = sf.normal(F.col("ring"))
    return _blocks(spark, sf_dir).select("sid", *((F.round(n[c], 6) + 0.0).alias(f"n{c}") for c in "xyz"), _round(sf.area(F.col("ring"))).alias("area"), sf.is_planar(F.col("ring")).alias("planar"))


def coplanar_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks' surfaces with coplanar neighbours merged."""
    held = fp.merge_coplanar(_blocks(spark, sf_dir), "bounds_id")
    return held.groupBy("bounds_id").agg(F.count("*").alias("surfaces"), F.sum("members").alias("members"), _round(F.sum("area"), 1).alias("area"))


def block_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground outline of every block, from all its surfaces."""
    return fp.outline(_blocks(spark, sf_dir), "bounds_id").select("bounds_id", "members", _area(F.col("polygon")).alias("area"))


def surface_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice points and pieces of every box at a spacing of 10 m, and the area of the pieces."""
    held = _boxes(spark, sf_dir).where(_ROOMY).withColumn("ring", _box_ring())
    parts = sf.subdivided(F.col("ring"), 10.0)
    return held.select("bounds_id", F.size(sf.lattice(F.col("ring"), 10.0)).alias("points"), F.size(parts).alias("parts"), _round(F.aggregate(F.transform(parts, geo.area), F.lit(0.0), lambda a, b: a + b)).alias("area"))


_ALL = (polygon_buffer, polygon_notches, polygon_edges_apart, polygon_simplify, polygon_holes, polygon_repair, polygon_angles, polygon_common, polygon_near, polygon_merged, surface_normals, coplanar_merged, block_outlines, surface_samples)
QUERIES = {f.__name__: f for f in _ALL}

_R = f"{_B}, r AS (SELECT *, xmax - xmin AS w, ymax - ymin AS h FROM b WHERE {_ROOMY})"
_DIST = "sqrt(pow(greatest(p.xmin - q.xmax, q.xmin - p.xmax, 0), 2) + pow(greatest(p.ymin - q.ymax, q.ymin - p.ymax, 0), 2))"
_PARTS = "greatest(ceil(w / 10), 1) AS m, greatest(ceil(h / 10), 1) AS n"
SQL = {
    "polygon_buffer": f"WITH {_R} SELECT bounds_id, round((w + 6) * (h + 6) + 3.3e-7, 2) AS grown, round(CASE WHEN w > 4 AND h > 4 THEN (w - 4) * (h - 4) ELSE 0 END + 3.3e-7, 2) AS shrunk FROM r",
    "polygon_notches": f"WITH {_R} SELECT bounds_id, 0.4::DOUBLE AS clearance, round(w * h + 3.3e-7, 2) AS slivers, round(w * h + 3.3e-7, 2) AS gaps, round(w * h + 3.3e-7, 2) AS cleared FROM r",
    "polygon_edges_apart": f"WITH {_R} SELECT bounds_id, 0.5::DOUBLE AS clearance FROM r",
    "polygon_simplify": f"WITH {_R} SELECT bounds_id, 4 AS corners, round(w * h + 3.3e-7, 2) AS area FROM r",
    "polygon_holes": f"WITH {_R} SELECT bounds_id, round(w * h * 0.75 - 0.25 + 3.3e-7, 2) AS area, round(w * h * 0.75 + 3.3e-7, 2) AS large_only, round(w * h + 3.3e-7, 2) AS filled, round(w * h * 0.75 + 3.3e-7, 2) AS cleaned FROM r WHERE w > 8 AND h > 8",
    "polygon_repair": f"WITH {_R} SELECT bounds_id, true AS crosses, 2 AS parts, round(w * h / 2 + 3.3e-7, 2) AS area FROM r",
    "polygon_angles": f"WITH {_R} SELECT bounds_id, 4 AS corners, round(w * w / 40 + 0.1 * w * sqrt(1 + 1 / 400.0) + 3.3e-7, 2) AS area FROM r",
    "polygon_common": f"WITH {_R} SELECT p.bounds_id AS a, q.bounds_id AS b, round((least(p.xmax, q.xmax) - greatest(p.xmin, q.xmin)) * (least(p.ymax, q.ymax) - greatest(p.ymin, q.ymin)) + 3.3e-7, 2) AS area FROM r p JOIN r q ON p.bounds_id < q.bounds_id AND p.xmin < q.xmax AND q.xmin < p.xmax AND p.ymin < q.ymax AND q.ymin < p.ymax WHERE area > 0.01",
    "polygon_near": f"WITH {_R} SELECT p.bounds_id AS a, q.bounds_id AS b FROM r p JOIN r q ON p.bounds_id < q.bounds_id WHERE {_DIST} <= 15",
    "polygon_merged": f"""WITH RECURSIVE {_R}, e AS (SELECT p.bounds_id AS src, q.bounds_id AS dst FROM r p JOIN r q ON p.bounds_id <= q.bounds_id AND {_DIST} <= 0), {_components("e")},
      k AS (SELECT component, r.* FROM cc JOIN r ON bounds_id = node), x AS (SELECT component, x, lead(x) OVER (PARTITION BY component ORDER BY x) AS x1 FROM (SELECT component, xmin AS x FROM k UNION SELECT component, xmax FROM k)),
      y AS (SELECT component, y, lead(y) OVER (PARTITION BY component ORDER BY y) AS y1 FROM (SELECT component, ymin AS y FROM k UNION SELECT component, ymax FROM k)),
      cell AS (SELECT component, (x1 - x) * (y1 - y) AS s FROM x JOIN y USING (component) WHERE x1 IS NOT NULL AND y1 IS NOT NULL AND EXISTS (SELECT 1 FROM k WHERE k.component = x.component AND k.xmin <= x AND k.xmax >= x1 AND k.ymin <= y AND k.ymax >= y1)),
      n AS (SELECT component, count(*) AS members FROM k GROUP BY 1)
      SELECT component, any_value(members) AS members, round(sum(s) + 3.3e-7, 1) AS area FROM cell JOIN n USING (component) GROUP BY component""",
    "surface_normals": f"""WITH {_R}, s AS (SELECT bounds_id, unnest(['00', '01', '02', '03', '04', '05', '06', '07', '08', '09']) AS k, unnest([0, 0, 0, 0, 1, 1, 0, 0, -1, -1])::DOUBLE AS nx, unnest([0, 0, -1, -1, 0, 0, 1, 1, 0, 0])::DOUBLE AS ny, unnest([1, 1, 0, 0, 0, 0, 0, 0, 0, 0])::DOUBLE AS nz, unnest([w * h, w * h, 6 * w, 6 * w, 6 * h, 6 * h, 6 * w, 6 * w, 6 * h, 6 * h]) AS a FROM r)
      SELECT bounds_id || '-' || k AS sid, nx, ny, nz, round(a + 3.3e-7, 2) AS area, true AS planar FROM s""",
    "coplanar_merged": f"WITH {_R} SELECT bounds_id, 6 AS surfaces, 10 AS members, round(2 * w * h + 24 * (w + h) + 3.3e-7, 1) AS area FROM r",
    "block_outlines": f"WITH {_R} SELECT bounds_id, 2 AS members, round(w * h + 3.3e-7, 2) AS area FROM r",
    "surface_samples": f"WITH {_R}, c AS (SELECT *, {_PARTS} FROM r) SELECT bounds_id, ((m + 1) * (n + 1))::INT AS points, (m * n)::INT AS parts, round(w * h + 3.3e-7, 2) AS area FROM c",
}
