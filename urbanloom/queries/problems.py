"""Queries of the data-quality and spatial problems of the core: p2 to p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.functions import timeparse, unitnames
from urbanloom.operators import instants, nearby, records, units
from urbanloom.plans.tables import table

TREE_RADIUS, POINT_RADIUS, STATION_RADIUS = 1.505, 0.0505, 25_000.0


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return records.parse_records(table(spark, sf, "raw_records"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return records.rejected(_parsed(spark, sf))


def p2_points(spark: SparkSession, sf: str) -> DataFrame:
    return records.valid(_parsed(spark, sf), "points")


def p2_fields(spark: SparkSession, sf: str) -> DataFrame:
    return records.valid(_parsed(spark, sf), "fields")


def p2_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).groupBy("layout", F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def _instants(spark: SparkSession, sf: str) -> DataFrame:
    return instants.normalise_instants(table(spark, sf, "sensor_snapshots"), table(spark, sf, "station_zones"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return instants.normalised(_instants(spark, sf))


def p3_estimated(spark: SparkSession, sf: str) -> DataFrame:
    """Times that name no zone, of stations without one, by the estimated zone."""
    found = instants.with_estimates(_instants(spark, sf), table(spark, sf, "station_zones"))
    return found.select("snapshot_id", "station_id", "zone_estimate", "violations", "estimated_utc")


def p3_heldout(spark: SparkSession, sf: str) -> DataFrame:
    """How many local times of stations with a zone on record the estimate places right when every zone is hidden from it, in all and by station's rows."""
    snapshots, zones = table(spark, sf, "sensor_snapshots"), table(spark, sf, "station_zones")
    known = instants.normalise_instants(snapshots, zones).where("status = 'ok'").select("snapshot_id", "utc_us")
    hidden = instants.normalise_instants(snapshots, zones.withColumn("tz_name", F.lit(None).cast("string")))
    guessed = instants.with_estimates(hidden, zones).join(known, "snapshot_id")
    size = guessed.groupBy("station_id").agg(F.count("*").alias("rows"), F.sum((F.col("estimated_us") == F.col("utc_us")).cast("int")).alias("right"))
    band = F.when(F.col("rows") < 5, "under 5").when(F.col("rows") < 50, "5 to 49").otherwise("50 and more")
    return size.groupBy(band.alias("rows_a_station")).agg(F.count("*").alias("stations"), F.sum("rows").alias("rows"), F.coalesce(F.sum("right"), F.lit(0)).alias("right"))


def _normal(spark: SparkSession, sf: str) -> DataFrame:
    return units.normalise_units(table(spark, sf, "observations"), table(spark, sf, "units"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return units.converted(_normal(spark, sf))


def p4_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Values whose unit nothing names, in the unit that the model decodes."""
    return _normal(spark, sf).where("basis = 'decoded'").select("obs_id", "station_id", "field", "unit_code", F.round("common", 6).alias("common"))


def p4_heldout(spark: SparkSession, sf: str) -> DataFrame:
    """Of every field, the stated units that the model decodes right when it isn't told: a tenth of them, drawn by hash, is hidden."""
    observations, known = table(spark, sf, "observations"), table(spark, sf, "units")
    truth = units.stated_units(observations.where("value IS NOT NULL AND NOT isnan(value)"), known).where("stated_unit IS NOT NULL").select("obs_id", "stated_unit").distinct()
    hide = F.pmod(F.xxhash64(F.lit("held out"), "obs_id"), F.lit(10)) == 0
    untold = observations.withColumns({c: F.when(~hide, F.col(c)) for c in ("unit", "description")})
    decoded = units.normalise_units(untold, known).where("basis = 'decoded'").join(truth, "obs_id").where(hide)
    return decoded.groupBy("field").agg(F.count("*").alias("rows"), F.sum((F.col("unit_code") == F.col("stated_unit")).cast("int")).alias("right"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    trees, points, boxes = (table(spark, sf, n) for n in ("trees", "points", "survey_bounds"))
    parts = {
        "tree_tree": nearby.neighbours(trees, "tree_id", ["x", "y"], TREE_RADIUS),
        "tree_bounds": nearby.containing_boxes(trees, "tree_id", boxes, "bounds_id"),
        "point_point": nearby.neighbours(points, "point_id", ["x", "y", "z"], POINT_RADIUS, apart="cloud_id"),
    }
    out = None
    for kind, pairs in parts.items():
        one = pairs.select(F.lit(kind).alias("kind"), "a_id", "b_id")
        out = one if out is None else out.unionByName(one)
    return out


def p5_station_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Stations within 25 km of each other, on the sphere."""
    seen = table(spark, sf, "observations").select("station_id", "lon", "lat").distinct()
    return nearby.neighbours(seen, "station_id", ["lon", "lat"], STATION_RADIUS, metric="great_circle")


QUERIES = {f.__name__: f for f in (p2_found, p2_points, p2_fields, p2_reasons, p3_found, p3_estimated, p3_heldout, p4_found, p4_decoded, p4_heldout, p5_found, p5_station_pairs)}

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _one_layout(layout: str, d: str, names: list[str], bad: str) -> str:
    """SQL that judges the lines of a layout. Quoted delimiters become char 1 before the split."""
    field = rf"""([ \t\r]*"([^"\n]|"")*"[ \t\r]*|[^"{d}]*)"""
    whole = rf"^{field}({d}{field})*$"
    trims = ", ".join(f"""trim(CASE WHEN trim(f[{k + 1}], ' ' || chr(9) || chr(13)) LIKE '"%' THEN replace(replace(regexp_replace(trim(f[{k + 1}], ' ' || chr(9) || chr(13)), '^"|"$', '', 'g'), '""', '"'), chr(1), '{d}') ELSE f[{k + 1}] END, ' ' || chr(9) || chr(13)) AS {n}""" for k, n in enumerate(names))
    return rf"""
    SELECT record_id, '{layout}' AS layout, CASE WHEN NOT well THEN 'quoting' WHEN n != {len(names)} THEN 'column_count' WHEN {bad} THEN 'invalid_value' END AS reason, {", ".join(names)} FROM (
      SELECT record_id, well, len(f) AS n, {trims} FROM (
        SELECT record_id, well, CASE WHEN well THEN string_split(array_to_string(list_transform(regexp_extract_all(line, '"([^"]|"")*"|[^"]+'), lambda t: CASE WHEN t LIKE '"%' THEN replace(t, '{d}', chr(1)) ELSE t END), ''), '{d}') END AS f FROM (
          SELECT record_id, line, regexp_full_match(line, '{whole}', 's') AS well FROM raw_records WHERE layout = '{layout}')))"""


_IS = lambda c: f"(regexp_full_match({c}, '{_NUMBER}') AND abs(coalesce(TRY_CAST({c} AS DOUBLE), 'inf'::DOUBLE)) < 'inf'::DOUBLE)"
_IN = lambda c, a, b: f"({c} = '' OR (regexp_full_match({c}, '[0-9]+') AND TRY_CAST({c} AS DOUBLE) BETWEEN {a} AND {b}))"
_POINT_NAMES, _FIELD_NAMES = [p.name for p in records.POINTS.parts], [p.name for p in records.FIELDS.parts]
_BAD_POINT = f"NOT (cloud_id != '' AND regexp_full_match(point_id, '[0-9]+') AND {_IS('x')} AND {_IS('y')} AND {_IS('z')} AND {_IN('classification', 0, 255)} AND {_IN('intensity', 0, 65535)} AND {_IN('return_number', 1, 15)} AND {_IN('num_returns', 1, 15)})"
_BAD_FIELD = f"NOT (station_name != '' AND regexp_full_match(station_id, '[0-9]+') AND {_IS('lat')} AND abs(TRY_CAST(lat AS DOUBLE)) <= 90 AND {_IS('lon')} AND abs(TRY_CAST(lon AS DOUBLE)) <= 180 AND (height = '' OR {_IS('height')}) AND (value = '' OR {_IS('value')}) AND quality IN ('', 'G', 'Y', 'O', 'R'))"
_POINT_SQL = _one_layout("points", ",", _POINT_NAMES, _BAD_POINT)
_FIELD_SQL = _one_layout("fields", ";", _FIELD_NAMES, _BAD_FIELD)


def _typed(parts: tuple[records.Part, ...]) -> str:
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "smallint": "SMALLINT", "int": "INTEGER", "tinyint": "TINYINT"}
    return ", ".join(f"CAST(nullif({p.name}, '') AS {kinds[p.spark]}) AS {p.name}" for p in parts)


_QUOTED = lambda t: "'" + t.replace("'", "''") + "'"
_FOLDED = lambda c: f"regexp_replace(replace(replace(translate(lower(trim({c})), {_QUOTED(unitnames._FROM)}, {_QUOTED(unitnames._TO)}), '℃', '°c'), '℉', '°f'), '[\\s._()^]+', '', 'g')"


def _named_unit(text: str) -> str:
    """SQL of the unit code that a text names for the field `o.field`: a code of the unit table as it is, folded, or a spelling."""
    spelt = " ".join(f"WHEN '{f}' THEN CASE {' '.join(f'WHEN regexp_full_match({_FOLDED(text)}, {_QUOTED(p)}) THEN {_QUOTED(c)}' for c, p in units_)} END" for f, units_ in unitnames.PATTERNS.items())
    own = lambda match: f"(SELECT min(unit_code) FROM units u WHERE u.field = o.field AND {match} HAVING count(DISTINCT unit_code) = 1)"
    return f"coalesce({own(f'trim(u.unit_code) = trim({text})')}, {own(_FOLDED('u.unit_code') + ' = ' + _FOLDED(text))}, CASE o.field {spelt} END)"


_CASES = lambda values, of: f"CASE {of} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"
_READ = " ".join(f"WHEN regexp_matches(t, {_QUOTED(pattern)}) THEN regexp_replace(t, {_QUOTED(pattern)}, '{order.replace('$', chr(92))}')" for pattern, order in timeparse._FORMS)
_NUM = lambda c: f"TRY_CAST({c} AS INT)"
#: The clock of a zone at a UTC instant, and the instant that a local time means by the offset of a day before or after.
_SHOWN = lambda u: f"timezone(zone, timezone('UTC', {u}))"
_MEANT = lambda sign: f"loc - ({_SHOWN(f'loc {sign} INTERVAL 1 DAY')} - (loc {sign} INTERVAL 1 DAY))"
_INSTANT_SQL = f"""
    WITH kz AS (SELECT name FROM pg_timezone_names() WHERE name LIKE '%/%' OR name = 'UTC'), own AS (SELECT station_id, min(tz_name) AS tz FROM station_zones WHERE tz_name IN (SELECT name FROM kz) GROUP BY 1),
    a AS (SELECT DISTINCT snapshot_id, station_id, received_at, coalesce(nullif(json_extract_string(attributes, '$.timestamp'), ''), nullif(json_extract_string(attributes, '$.lastValue.timestamp'), '')) AS written FROM sensor_snapshots),
    b AS (SELECT *, trim(written) AS t FROM a WHERE written IS NOT NULL),
    c AS (SELECT *, string_split(CASE {_READ} END, '|') AS p, CASE WHEN regexp_matches(t, '^[0-9]{{9,16}}([.][0-9]{{1,6}})?$') AND NOT regexp_matches(t, '^[0-9]{{14}}$') THEN TRY_CAST(t AS DECIMAL(24, 6)) END AS e FROM b),
    d AS (SELECT *, {_NUM("p[1]")} AS y, coalesce({_NUM("p[2]")}, {_CASES(timeparse.MONTHS, "lower(p[2])")}) AS mo, {_NUM("p[3]")} AS dd, lower(p[8]) AS half, {_NUM("p[4]")} AS h12, {_NUM("p[5]")} AS mi,
      CASE WHEN p[6] = '' THEN 0 ELSE {_NUM("p[6]")} END AS se, CASE WHEN p[7] = '' THEN 0 ELSE {_NUM("substring(rpad(p[7], 6, '0'), 1, 6)")} END AS fr, p[9] AS z, regexp_replace(p[9], '[^0-9]', '', 'g') AS dg,
      CASE WHEN e >= 946684800 AND e < 4102444800 THEN floor(e * 1000000) WHEN e >= 946684800000 AND e < 4102444800000 THEN floor(e * 1000) WHEN e >= 946684800000000 AND e < 4102444800000000 THEN floor(e) END::BIGINT AS epoch FROM c),
    f AS (SELECT *, CASE WHEN half = '' THEN h12 WHEN h12 BETWEEN 1 AND 12 THEN h12 % 12 + CASE WHEN half = 'pm' THEN 12 ELSE 0 END END AS h,
      CASE WHEN regexp_matches(z, '^[+-][0-9]') THEN CASE WHEN {_NUM("substring(dg, 1, 2)")} <= 18 AND (length(dg) < 4 OR {_NUM("substring(dg, 3, 2)")} <= 59) THEN (CASE WHEN z LIKE '-%' THEN -1 ELSE 1 END) * ({_NUM("substring(dg, 1, 2)")} * 60 + CASE WHEN length(dg) > 2 THEN {_NUM("substring(dg, 3, 2)")} ELSE 0 END) END
        ELSE {_CASES(timeparse.ABBREVIATIONS, "upper(z)")} END AS off, CASE WHEN z IN (SELECT name FROM kz) THEN z END AS tz1 FROM d),
    g AS (SELECT f.*, CASE WHEN h BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND se BETWEEN 0 AND 59 AND y >= 1 THEN TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, dd, h, mi, se) AS TIMESTAMP) END + to_microseconds(fr) AS loc,
      coalesce(z != '', false) AS zoned, coalesce(tz1, CASE WHEN NOT coalesce(z != '', false) THEN tz END) AS zone FROM f LEFT JOIN own USING (station_id)),
    i AS (SELECT *, CASE WHEN epoch IS NOT NULL THEN make_timestamp(epoch) ELSE loc - to_minutes(off) END AS said, {_MEANT("-")} AS u0, {_MEANT("+")} AS u1 FROM g),
    j AS (SELECT *, CASE WHEN {_SHOWN("u0")} = loc THEN u0 END AS early, CASE WHEN {_SHOWN("u1")} = loc THEN u1 END AS late FROM i),
    k AS (SELECT *, CASE WHEN said IS NOT NULL THEN 'ok' WHEN loc IS NULL OR (zoned AND zone IS NULL) THEN 'unreadable' WHEN zone IS NULL THEN 'no_zone' WHEN early IS NULL AND late IS NULL THEN 'nonexistent' WHEN early != late THEN 'ambiguous' ELSE 'ok' END AS status FROM j)
    SELECT snapshot_id, CASE WHEN status = 'ok' THEN strftime(coalesce(said, early, late), '%Y-%m-%dT%H:%M:%S.%fZ') ELSE status END AS utc FROM k
    WHERE NOT (status = 'ok' AND regexp_matches(written, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}[.][0-9]{{6}}Z$'))"""
_PHRASED = ", ".join(f"nullif(regexp_extract(description, {_QUOTED(p)}, 1), '') AS p{k}" for k, p in enumerate(unitnames.PHRASES))
_XY = "x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)"
SQL = {
    "p2_found": f"SELECT record_id, reason FROM ({_POINT_SQL}) WHERE reason IS NOT NULL UNION ALL SELECT record_id, reason FROM ({_FIELD_SQL}) WHERE reason IS NOT NULL",
    "p2_points": f"SELECT record_id, {_typed(records.POINTS.parts)} FROM ({_POINT_SQL}) WHERE reason IS NULL",
    "p2_fields": f"SELECT record_id, {_typed(records.FIELDS.parts)} FROM ({_FIELD_SQL}) WHERE reason IS NULL",
    "p2_reasons": f"SELECT layout, coalesce(reason, 'valid') AS reason, count(*) AS n FROM (SELECT layout, reason FROM ({_POINT_SQL}) UNION ALL SELECT layout, reason FROM ({_FIELD_SQL})) GROUP BY 1, 2",
    "p3_found": _INSTANT_SQL,
    "p4_found": f"""
    WITH w AS (SELECT DISTINCT field, unit, description FROM observations), o AS (SELECT *, {_PHRASED} FROM w),
    n AS (SELECT o.field, o.unit, o.description, coalesce({_named_unit("o.unit")}, {", ".join(_named_unit(f"o.p{k}") for k in range(len(unitnames.PHRASES)))}) AS code FROM o)
    SELECT DISTINCT obs_id, code AS unit_code, CAST(round_even((value * factor + shift) * 1000, 0) AS BIGINT) AS milli
    FROM observations b JOIN n ON b.field IS NOT DISTINCT FROM n.field AND b.unit IS NOT DISTINCT FROM n.unit AND b.description IS NOT DISTINCT FROM n.description
    JOIN units u ON u.field = b.field AND u.unit_code = code WHERE NOT is_common AND value IS NOT NULL AND NOT isnan(value)""",
    "p5_found": f"""
    WITH t AS (SELECT DISTINCT tree_id, x, y, floor(x / 2)::BIGINT AS gx, floor(y / 2)::BIGINT AS gy FROM trees WHERE tree_id IS NOT NULL AND {_XY}),
    tn AS (SELECT tree_id, x, y, gx + i AS gx, gy + j AS gy FROM t, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)),
    p AS (SELECT DISTINCT cloud_id, point_id, x, y, z, floor(x)::BIGINT AS gx, floor(y)::BIGINT AS gy FROM points WHERE {_XY} AND z IS NOT NULL AND NOT isnan(z)),
    pn AS (SELECT DISTINCT cloud_id, point_id, x, y, z, floor(x + i)::BIGINT AS gx, floor(y + j)::BIGINT AS gy FROM p, (VALUES (-0.06), (0), (0.06)) a(i), (VALUES (-0.06), (0), (0.06)) b(j))
    SELECT DISTINCT 'tree_tree' AS kind, t.tree_id AS a_id, n.tree_id AS b_id FROM t JOIN tn n USING (gx, gy) WHERE t.tree_id < n.tree_id AND sqrt((t.x - n.x) * (t.x - n.x) + (t.y - n.y) * (t.y - n.y)) <= {TREE_RADIUS}
    UNION ALL SELECT DISTINCT 'tree_bounds', tree_id, bounds_id FROM trees JOIN survey_bounds ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax WHERE {_XY}
    UNION ALL SELECT DISTINCT 'point_point', p.point_id::VARCHAR, n.point_id::VARCHAR FROM p JOIN pn n USING (gx, gy) WHERE p.point_id::VARCHAR < n.point_id::VARCHAR AND p.cloud_id != n.cloud_id
      AND sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y) + (p.z - n.z) * (p.z - n.z)) <= {POINT_RADIUS}""",
    "p5_station_pairs": f"""
    WITH s AS (SELECT DISTINCT station_id, lon, lat FROM observations WHERE station_id IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat))
    SELECT DISTINCT a.station_id AS a_id, b.station_id AS b_id FROM s a JOIN s b ON a.station_id < b.station_id
    WHERE 2 * {nearby.EARTH_RADIUS} * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= {STATION_RADIUS}""",
}
