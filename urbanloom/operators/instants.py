"""One UTC instant for every measured time, or the reason why there is none.

A time that states a zone or offset is converted by it; a local time by the zone
on record for its station. `with_estimates` goes on with the times that name no
zone, of stations without one: every candidate zone (an offset history with its
daylight saving) is laid against the arrival times month by month, and the
history of zones with the fewest violations, changes of zone being dear, wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.functions.timeparse import CANONICAL, DAY_US, clock_fields, clock_us, epoch_us, fields_of, is_known_zone, utc_text, zone_offset_us
from urbanloom.plans.tables import pinned

MINUTE_US = 60_000_000
#: A change of a station's zone is as bad as so many violations.
CHANGE = 5
#: Candidates besides the zones on record: UTC, and Central and Eastern European winter time all year.
STEADY = ("Etc/GMT-1", "Etc/GMT-2", "UTC")


def measured_text(attributes: Column) -> Column:
    """The key `timestamp` at top level, else inside lastValue; NULL if missing, null or empty."""
    top, inner = F.get_json_object(attributes, "$.timestamp"), F.get_json_object(attributes, "$.lastValue.timestamp")
    return F.coalesce(F.when(top != "", top), F.when(inner != "", inner))


def _with_utc(df: DataFrame, local: str, zone: str) -> DataFrame:
    """`df` with early and late: both UTC instants that a local time may mean, each NULL where the zone doesn't show it."""
    at, where = F.col(local), F.col(zone)
    df = pinned(df, {"_early": at - zone_offset_us(at - DAY_US, where), "_late": at - zone_offset_us(at + DAY_US, where)})
    shown = lambda u: F.when(F.col(u) + zone_offset_us(F.col(u), where) == at, F.col(u))
    return pinned(df, {"early": shown("_early"), "late": shown("_late")}).drop("_early", "_late")


def _candidate_zones(zones: DataFrame) -> list[str]:
    """The distinct known zone names, at most as many as the tz database has, and clocks that are never set."""
    named = zones.where(is_known_zone(F.col("tz_name"))).select("tz_name").distinct().collect()
    return sorted({r[0] for r in named} | set(STEADY))


def normalise_instants(snapshots: DataFrame, zones: DataFrame) -> DataFrame:
    """The measured time of every snapshot as one UTC instant.

    Columns: snapshot_id, station_id, written (the text), form (canonical if it
    already is in the target form, else other), status, utc_us, utc, local_us (the
    clock as written, if it was read), received_us. status is absent (missing,
    null or empty), ok, unreadable, no_zone, nonexistent or ambiguous.

    Defined results: rows repeated in all columns count once; a NULL or unknown
    station has no zone; an unknown tz_name counts as none; NULL received_at
    gives no evidence; JSON that can't be read is absent; extra columns are left
    out; an empty table gives an empty result.
    """
    base = snapshots.select("snapshot_id", "station_id", "received_at", measured_text(F.col("attributes")).alias("written")).distinct()
    text = F.trim(F.col("written"))
    base = pinned(base, {"parts": fields_of(text), "epoch": epoch_us(text)})
    received = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', received_at)")
    base = pinned(base, clock_fields(F.col("parts")) | {"received_us": received}).drop("parts", "received_at")
    base = pinned(base, {"local": clock_us()}).drop("year", "month", "day", "hour", "minute", "second", "fraction")
    own = zones.select(F.col("station_id").alias("_station"), F.col("tz_name").alias("_zone")).where(is_known_zone(F.col("_zone"))).groupBy("_station").agg(F.min("_zone").alias("_zone"))
    base = base.join(own, base.station_id == own._station, "left").drop("_station")
    base = base.withColumn("zone", F.coalesce("text_zone", F.when(~F.coalesce("has_zone", F.lit(False)), F.col("_zone"))))
    base = _with_utc(base, "local", "zone")
    by_text = F.coalesce(F.col("epoch"), F.col("local") - F.col("offset"))
    zoned = F.col("zone").isNotNull()
    status = (
        F.when(F.col("written").isNull(), "absent")
        .when(by_text.isNotNull(), "ok")
        .when(F.col("local").isNull() | (F.col("has_zone") & ~zoned), "unreadable")
        .when(~zoned, "no_zone")
        .when(F.col("early").isNull() & F.col("late").isNull(), "nonexistent")
        .when(F.col("early") != F.col("late"), "ambiguous")
        .otherwise("ok")
    )
    base = pinned(base, {"status": status}).withColumn("utc_us", F.when(F.col("status") == "ok", F.coalesce(by_text, "early", "late")))
    base = base.withColumn("form", F.when(F.col("written").rlike(CANONICAL) & (F.col("status") == "ok"), "canonical").otherwise("other"))

    return base.select("snapshot_id", "station_id", "written", "form", "status", "utc_us", utc_text(F.col("utc_us")).alias("utc"), F.col("local").alias("local_us"), "received_us")


def with_estimates(instants: DataFrame, zones: DataFrame, fresh_minutes: int = 30, ahead_minutes: int = 2) -> DataFrame:
    """normalise_instants' rows of status no_zone with zone_estimate, violations, estimated_utc.

    Defined results: stations without any arrival time, and NULL stations, have
    no estimate; a local time that the estimated zone has twice takes the earlier
    instant, one that it skips has none.
    """
    open_rows = instants.where("status = 'no_zone'").withColumnsRenamed({"local_us": "local"}).withColumn("month", month_of(F.col("local")))
    best = estimate_zones(open_rows, _candidate_zones(zones), fresh_minutes, ahead_minutes)
    best = best.withColumnsRenamed({"station_id": "_station", "month": "_month"})
    out = open_rows.join(best, (F.col("station_id") == F.col("_station")) & (F.col("month") == F.col("_month")), "left")
    out = _with_utc(out, "local", "zone_estimate").withColumn("estimated_us", F.coalesce("early", "late"))
    return out.select("snapshot_id", "station_id", "written", "zone_estimate", "violations", "estimated_us", utc_text(F.col("estimated_us")).alias("estimated_utc"))


def month_of(local: Column) -> Column:
    """Months since January of year 0 of a local time in microseconds."""
    day = F.date_from_unix_date(F.floor(local / DAY_US).cast("int"))
    return F.year(day) * 12 + F.month(day) - 1


def estimate_zones(local_times: DataFrame, candidates: list[str], fresh_minutes: int = 30, ahead_minutes: int = 2, change: float = CHANGE) -> DataFrame:
    """The zone of every station in every month, by its local times (`local`, microseconds) and arrivals (`received_us`).

    Columns station_id, month, zone_estimate, violations. A candidate is violated
    by a row whose instant lies more than `ahead_minutes` after its arrival or
    more than `fresh_minutes` before it, or that the zone skips. Of all
    histories (a zone a month) the one with the fewest violations, a change
    counting as `change` more, is found by dynamic programming; ties go to the
    first name. Months without arrivals have the zone of the month before, else after.
    Violations are counted per station, month and candidate before the shuffle,
    so a station with a third of all rows is no more work than any other.
    """
    kept = local_times.where("local IS NOT NULL AND station_id IS NOT NULL").select("station_id", month_of(F.col("local")).alias("month"), "local", "received_us")
    if not candidates:
        return kept.sparkSession.createDataFrame([], "station_id string, month int, zone_estimate string, violations bigint")
    rows = kept.withColumn("candidate", F.explode(F.array(*(F.lit(k) for k in range(len(candidates))))))
    rows = _with_utc(rows.withColumn("_zone", F.element_at(F.array(*(F.lit(z) for z in candidates)), F.col("candidate") + 1)), "local", "_zone")
    early, late = F.col("early"), F.col("late")
    fits = lambda u: (F.col("received_us") - u).between(-ahead_minutes * MINUTE_US, fresh_minutes * MINUTE_US)
    broken = (F.col("received_us").isNotNull() & ~F.coalesce(fits(early), F.lit(False)) & ~F.coalesce(fits(late), F.lit(False))).cast("bigint")
    counted = rows.groupBy("station_id", "month", "candidate").agg(F.sum(broken).alias("violations"), F.count("received_us").alias("evidence"))

    def history(months: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(months))
        month, at = np.unique(table.column("month").to_numpy(), return_inverse=True)
        cost, seen = np.zeros((len(month), len(candidates))), np.zeros(len(month), np.int64)
        cost[at, table.column("candidate").to_numpy()] = table.column("violations").to_numpy()
        np.maximum.at(seen, at, table.column("evidence").to_numpy())
        if not seen.any():
            return
        best, came = cost[0].copy(), np.zeros(cost.shape, np.int64)
        for t in range(1, len(month)):
            cheapest = int(best.argmin())
            stay = best <= best[cheapest] + change
            came[t] = np.where(stay, np.arange(len(candidates)), cheapest)
            best = np.where(stay, best, best[cheapest] + change) + cost[t]
        path = np.zeros(len(month), np.int64)
        path[-1] = int(best.argmin())
        for t in range(len(month) - 1, 0, -1):
            path[t - 1] = came[t, path[t]]
        zone = pa.array([candidates[k] for k in path])
        yield pa.RecordBatch.from_arrays([table.column("station_id").combine_chunks()[:1].take(pa.array(np.zeros(len(month), np.int64))), pa.array(month, pa.int32()), zone, pa.array(cost[np.arange(len(month)), path].astype(np.int64))], names=["station_id", "month", "zone_estimate", "violations"])

    # a station has one row a month and candidate
    return counted.groupBy("station_id").applyInArrow(history, "station_id string, month int, zone_estimate string, violations bigint")


def normalised(instants: DataFrame) -> DataFrame:
    """snapshot_id and utc (the instant, or the status that prevents one) of all times present in another form."""
    text = F.when(F.col("status") == "ok", F.col("utc")).otherwise(F.col("status"))
    return instants.where("status != 'absent' AND form = 'other'").select("snapshot_id", text.alias("utc"))
