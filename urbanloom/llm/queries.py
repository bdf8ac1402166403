"""Queries of the training-data problems: p1, p6, p7, p8, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.functions.buckets import Buckets
from urbanloom.llm import leak, mixing, quantiles, splitting
from urbanloom.plans.tables import table

SHARES = {"z_p10": 0.1, "z_median": 0.5, "z_p90": 0.9}
LEAST_LENGTH = 1e-8


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    points, edges = table(spark, sf, "points"), table(spark, sf, "road_edges").where(f"length > {LEAST_LENGTH}")
    clouds = quantiles.wrong_statistics(points, "point_id", "z", "cloud_id", "strip_id", ["classification"], table(spark, sf, "cloud_stats"), "stats_id", {"median": ("z_median", 0.5), "p90": ("z_p90", 0.9)}, 0.5, relative=False)
    lengths = quantiles.wrong_statistics(edges, "eid", "length", "network_id", "batch_id", [], table(spark, sf, "length_stats"), "stats_id", {"median": ("median", 0.5), "p90": ("p90", 0.9)}, 0.08, relative=True)
    return lengths.select(F.lit("length_stats").alias("stats_kind"), F.col("_id").alias("stats_id")).unionByName(clouds.select(F.lit("cloud_stats").alias("stats_kind"), F.col("_id").alias("stats_id")))


def p1_cloud_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Elevation percentiles of every whole cloud and class, combined from the sketches of its strips."""
    held = table(spark, sf, "points").select("point_id", "cloud_id", "strip_id", "classification", "z").where("z IS NOT NULL AND NOT isnan(z)").distinct()
    strips = quantiles.sketch(held, ["cloud_id", "strip_id", "classification"], "z")
    keys = ["cloud_id", "classification"]
    return _rounded(quantiles.percentiles(quantiles.merged(strips, keys), keys, SHARES), keys, list(SHARES))


def p1_network_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Length percentiles of every network, combined from the sketches of its batches."""
    held = table(spark, sf, "road_edges").select("eid", "network_id", "batch_id", "length").where(f"length > {LEAST_LENGTH} AND NOT isnan(length)").distinct()
    batches = quantiles.sketch(held, ["network_id", "batch_id"], "length")
    return _rounded(quantiles.percentiles(quantiles.merged(batches, ["network_id"]), ["network_id"], {"median": 0.5, "p90": 0.9}), ["network_id"], ["median", "p90"])


def _rounded(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.select(*keys, "n", *(F.round(f"{n}{end}", 4).alias(f"{n}{end}") for n in names for end in ("", "_min", "_max")))


def p1_bucket_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The sketch of every whole network: buckets and how many lengths each holds, added up over its batches."""
    held = table(spark, sf, "road_edges").select("eid", "network_id", "batch_id", "length").where(f"length > {LEAST_LENGTH} AND NOT isnan(length)").distinct()
    return quantiles.merged(quantiles.sketch(held, ["network_id", "batch_id"], "length"), ["network_id"]).select("network_id", "bucket", "n")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leak.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p6_suites(spark: SparkSession, sf: str) -> DataFrame:
    """Per suite, the items that leaked and the documents that hold them."""
    items = table(spark, sf, "eval_items")
    found = leak.leaks(table(spark, sf, "documents"), items)
    return found.join(items.select("item_id", "suite"), "item_id").groupBy("suite").agg(F.countDistinct("item_id").alias("items"), F.countDistinct("doc_id").alias("documents"))


def _mixture(spark: SparkSession, sf: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).shares().where("falls_short").select("source")


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).chosen()


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).shares()


def p7_margins(spark: SparkSession, sf: str) -> DataFrame:
    """Natural, fitted and taken shares of sources, languages and topics."""
    return _mixture(spark, sf).margins()


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.pieces(table(spark, sf, "documents")).where("piece = 0").select("doc_id")


def p8_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.pieces(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_cloud_percentiles, p1_network_percentiles, p1_bucket_counts, p6_found, p6_suites, p7_found, p7_mixture, p7_shares, p7_margins, p8_found, p8_pieces)}

_SCHEME = Buckets(quantiles.ALPHA)


def _bucket(v: str) -> str:
    """SQL of the bucket of a value."""
    level = f"CAST(ceil(ln(abs({v})) / {_SCHEME.log!r}) AS BIGINT) - {_SCHEME.first} + 1"
    return f"CASE WHEN {v} = 0 THEN 0 WHEN {v} < 0 THEN -({level}) ELSE {level} END"


def _sketched(rows: str, keys: str, value: str, shares: dict[str, float]) -> str:
    """SQL of the percentiles of a sketch: buckets are counted, ranks are looked up by running sums."""
    edge = lambda level: f"exp(({level} + {_SCHEME.first - 1}) * {_SCHEME.log!r})"
    size = "abs(bucket)"
    # per bucket: estimate, least and greatest value
    ends = f"""SELECT *, CASE WHEN bucket = 0 THEN 0.0 ELSE sign(bucket) * {edge(size)} * {2 / (_SCHEME.gamma + 1)!r} END AS e,
      CASE WHEN bucket > 0 THEN {edge(size + " - 1")} * (1 - 1e-9) ELSE -{edge(size)} * (1 + 1e-9) END AS lo, CASE WHEN bucket > 0 THEN {edge(size)} * (1 + 1e-9) ELSE -{edge(size + " - 1")} * (1 - 1e-9) END AS hi,
      sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total FROM s"""
    out = []
    for name, share in shares.items():
        rank = f"({share!r} * (total - 1))"
        at = lambda c, f, rank=rank: f"max({c}) FILTER (upto - n <= {f}({rank}) AND {f}({rank}) < upto)"
        part = f"any_value({rank} - floor({rank}))"
        out += [f"round({at(c, 'floor')} * (1 - {part}) + {at(c, 'ceil')} * {part}, 4) AS {name}{end}" for c, end in (("e", ""), ("lo", "_min"), ("hi", "_max"))]
    return f"WITH s AS (SELECT {keys}, {_bucket(value)} AS bucket, count(*) AS n FROM ({rows}) GROUP BY ALL), b AS ({ends}) SELECT {keys}, any_value(total)::BIGINT AS n, {', '.join(out)} FROM b GROUP BY {keys}"


_LENGTHS = f"SELECT DISTINCT eid, network_id, batch_id, length FROM road_edges WHERE length > {LEAST_LENGTH} AND NOT isnan(length)"
_EXACT = "SELECT {keys}, quantile_cont({v}, 0.5) AS m, quantile_cont({v}, 0.9) AS q FROM {t} GROUP BY {keys}"
SQL = {
    "p1_cloud_percentiles": _sketched("SELECT DISTINCT point_id, cloud_id, strip_id, classification, z FROM points WHERE z IS NOT NULL AND NOT isnan(z)", "cloud_id, classification", "z", SHARES),
    "p1_network_percentiles": _sketched(_LENGTHS, "network_id", "length", {"median": 0.5, "p90": 0.9}),
    "p1_bucket_counts": f"SELECT network_id, ({_bucket('length')})::INT AS bucket, count(*) AS n FROM ({_LENGTHS}) GROUP BY ALL",
    "p1_found": f"""
    WITH e AS (SELECT DISTINCT eid, network_id, batch_id, length FROM road_edges WHERE length > {LEAST_LENGTH} AND NOT isnan(length)),
    eg AS ({_EXACT.format(keys="network_id, batch_id", v="length", t="e")} UNION ALL SELECT network_id, NULL, quantile_cont(length, 0.5), quantile_cont(length, 0.9) FROM e GROUP BY network_id),
    p AS (SELECT DISTINCT point_id, cloud_id, strip_id, classification, z FROM points WHERE z IS NOT NULL AND NOT isnan(z)),
    pg AS ({_EXACT.format(keys="cloud_id, strip_id, classification", v="z", t="p")} UNION ALL SELECT cloud_id, NULL, classification, quantile_cont(z, 0.5), quantile_cont(z, 0.9) FROM p GROUP BY cloud_id, classification)
    SELECT 'length_stats' AS stats_kind, s.stats_id FROM length_stats s JOIN eg ON s.network_id = eg.network_id AND s.batch_id IS NOT DISTINCT FROM eg.batch_id WHERE abs(s.median - m) > 0.08 * m OR abs(s.p90 - q) > 0.08 * q
    UNION ALL SELECT 'cloud_stats', s.stats_id FROM cloud_stats s JOIN pg ON s.cloud_id = pg.cloud_id AND s.strip_id IS NOT DISTINCT FROM pg.strip_id AND s.classification IS NOT DISTINCT FROM pg.classification WHERE abs(s.z_median - m) > 0.5 OR abs(s.z_p90 - q) > 0.5""",
}
