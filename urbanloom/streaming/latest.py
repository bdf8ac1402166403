"""The latest reading per station and field, kept up to date over a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.operators.sensors import missing_to_null


def latest_stream(observations: DataFrame, late: str = "7 days") -> DataFrame:
    """The batch expression of operators.sensors.latest as a streaming aggregate, for update or complete output.

    `ts` is the event time; its state is one row per station and field. Repeated
    rows change nothing, as a maximum doesn't.
    """
    held = missing_to_null(observations).where("ts IS NOT NULL").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    last = F.max_by(F.struct("value", "unit", "quality", "at"), F.struct("at", "obs_id"))
    return held.groupBy("station_id", "field").agg(last.alias("_l")).select("station_id", "field", "_l.value", "_l.unit", "_l.quality", F.col("_l.at").alias("ts"))


def windowed_means(observations: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "7 days") -> DataFrame:
    """Mean and count per field and time window; closed windows are given out once, rows later than `late` are left out."""
    held = missing_to_null(observations).where("ts IS NOT NULL AND value IS NOT NULL").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    frame = F.window("at", window, slide) if slide else F.window("at", window)
    return held.groupBy(frame.alias("w"), "field").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "field", "mean", "n")
