"""Latest readings, summaries and pivots of station observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_to_null(observations: DataFrame) -> DataFrame:
    """NaN is missing, as NULL is."""
    return observations.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def latest(observations: DataFrame) -> DataFrame:
    """Per station and field the last reading by ts, then obs_id: a hash aggregate with partial maxima, no sort."""
    last = F.max_by(F.struct("value", "unit", "quality", "ts"), F.struct("ts", "obs_id"))
    held = missing_to_null(observations).where("ts IS NOT NULL").groupBy("station_id", "field").agg(last.alias("_l"))
    return held.select("station_id", "field", "_l.value", "_l.unit", "_l.quality", "_l.ts")


def stations_within(observations: DataFrame, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    return observations.where(F.col("lon").between(*lon) & F.col("lat").between(*lat))


def drop_all_missing(readings: DataFrame) -> DataFrame:
    """The readings of stations with at least one value."""
    some = readings.where("value IS NOT NULL").select("station_id").distinct()
    return readings.join(some, "station_id", "left_semi")


def first_stations(readings: DataFrame, count: int) -> DataFrame:
    """The readings of the `count` stations with the least ids."""
    kept = readings.select("station_id").distinct().orderBy("station_id").limit(count)
    return readings.join(kept, "station_id", "left_semi")


def merge_stations(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """One row per station: the metadata of its first observation, and a map of its fields' last values."""
    meta = stations.where("ts IS NOT NULL").groupBy("station_id").agg(F.min_by(F.struct("station_name", "lon", "lat", "elevation"), F.struct("ts", "obs_id")).alias("m"))
    fields = readings.groupBy("station_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("values"))  # a station has few fields
    return meta.join(fields, "station_id").select("station_id", "m.*", "values")


def latest_value(snapshots: DataFrame, path: str = "$.lastValue.value") -> DataFrame:
    """station_id, value, n: the number at `path` of the JSON attributes of a station's last snapshot by arrival (then by id), and how many it has.

    Snapshots without an arrival are left out; repeated ones count once; what is no number is NULL."""
    held = snapshots.where("received_at IS NOT NULL").select("station_id", "snapshot_id", "received_at", F.get_json_object("attributes", path).try_cast("double").alias("value")).distinct()
    return held.groupBy("station_id").agg(F.max_by("value", F.struct("received_at", "snapshot_id")).alias("value"), F.count("*").alias("n"))


def summarise(observations: DataFrame) -> DataFrame:
    """Per field: stations, values, least, greatest and mean value that is not missing."""
    return missing_to_null(observations).groupBy("field").agg(F.countDistinct("station_id").alias("stations"), F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def to_wide(readings: DataFrame, fields: list[str]) -> DataFrame:
    """One row per station, one column per field."""
    return readings.groupBy("station_id").pivot("field", fields).agg(F.first("value"))


def stale(readings: DataFrame, days: int) -> DataFrame:
    """The readings more than `days` before the newest one of their field."""
    newest = readings.groupBy(F.col("field").alias("_field")).agg(F.max("ts").alias("_newest"))
    return readings.join(newest, F.col("field").eqNullSafe(F.col("_field"))).where(F.col("ts") < F.col("_newest") - F.expr(f"INTERVAL {days} DAYS")).drop("_field", "_newest")
