import datetime as dt
import json

from urbanloom.operators.instants import estimate_zones, normalise_instants, normalised

STOCKHOLM, NONE = "1", "2"
CASES = [
    ("2023-05-01 12:00:00", STOCKHOLM, "2023-05-01T10:00:00.000000Z"),
    ("2023-05-01T12:34", STOCKHOLM, "2023-05-01T10:34:00.000000Z"),
    ("2023-05-01 12:00:00", NONE, "no_zone"),
    ("2023-03-26 02:30:00", STOCKHOLM, "nonexistent"),
    ("2023-10-29 02:30:00", STOCKHOLM, "ambiguous"),
    ("2023-10-29 02:30:00 CEST", STOCKHOLM, "2023-10-29T00:30:00.000000Z"),
    ("2023-10-29T02:30:00+01", NONE, "2023-10-29T01:30:00.000000Z"),
    ("2023-10-29 02:30:00,1239 +0530", NONE, "2023-10-28T21:00:00.123900Z"),
    ("12.02.2023 21:41", STOCKHOLM, "2023-02-12T20:41:00.000000Z"),
    ("09/28/2019 12:05:17 AM", STOCKHOLM, "2019-09-27T22:05:17.000000Z"),
    ("09/28/2019 12:05:17 PM", STOCKHOLM, "2019-09-28T10:05:17.000000Z"),
    ("20220126203238", STOCKHOLM, "2022-01-26T19:32:38.000000Z"),
    ("20231021T054452Z", NONE, "2023-10-21T05:44:52.000000Z"),
    ("Fri, 18 Sep 2020 03:07:14 +0000", NONE, "2020-09-18T03:07:14.000000Z"),
    ("3 okt 2020 03:07:14", STOCKHOLM, "2020-10-03T01:07:14.000000Z"),
    (1555500398000, NONE, "2019-04-17T11:26:38.000000Z"),
    ("1645791428", NONE, "2022-02-25T12:17:08.000000Z"),
    ("1577845034000001", NONE, "2020-01-01T02:17:14.000001Z"),
    ("2023-02-29 10:00:00", STOCKHOLM, "unreadable"),
    ("2024-02-29 10:00:00", STOCKHOLM, "2024-02-29T09:00:00.000000Z"),
    ("2023-13-08 10:20:00", STOCKHOLM, "unreadable"),
    ("25:61", STOCKHOLM, "unreadable"),
    ("2023-05-01", STOCKHOLM, "unreadable"),
    ("unknown", NONE, "unreadable"),
    ("2023-05-01 12:00:00 QQQ", STOCKHOLM, "unreadable"),
    ("2023-05-01 12:00:00 Asia/Kolkata", STOCKHOLM, "2023-05-01T06:30:00.000000Z"),
    ("9" * 40, NONE, "unreadable"),
    ("x" * 100_000, NONE, "unreadable"),
    ("2023-05-01T12:34:56.000000Z", NONE, None),
    ("", NONE, None),
    (None, NONE, None),
]


def _frames(spark, rows):
    snapshots = spark.createDataFrame(rows, "snapshot_id bigint, station_id string, attributes string, received_at timestamp_ntz, zone string, local string")
    zones = spark.createDataFrame([(STOCKHOLM, "Europe/Stockholm"), (NONE, None), ("3", "Mars/Base")], "station_id string, tz_name string")
    return snapshots, zones


def test_forms(spark):
    rows = []
    for k, (value, station, _) in enumerate(CASES):
        where = {"timestamp": value} if k % 2 else {"lastValue": {"timestamp": value}}
        rows.append((k, station, json.dumps(where), None, "x", "y"))
    got = {r.snapshot_id: r.utc for r in normalised(normalise_instants(*_frames(spark, rows + rows))).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(CASES) if want}


def test_broken_rows(spark):
    local = json.dumps({"timestamp": "2023-05-01 12:00:00"})
    rows = [(1, None, local, None, "", ""), (2, "3", local, None, "", ""), (3, "9", local, None, "", ""), (4, STOCKHOLM, "{broken", None, "", ""), (5, STOCKHOLM, None, None, "", "")]
    got = {r.snapshot_id: r.status for r in normalise_instants(*_frames(spark, rows)).collect()}
    assert got == {1: "no_zone", 2: "no_zone", 3: "no_zone", 4: "absent", 5: "absent"}
    snapshots, zones = _frames(spark, rows)
    assert normalise_instants(snapshots.limit(0), zones).count() == 0
    assert normalised(normalise_instants(snapshots, zones.limit(0))).count() == 3


def test_the_estimate_finds_the_zone_on_record(spark):
    from zoneinfo import ZoneInfo

    names = ["Europe/Stockholm", "America/New_York", "Asia/Kolkata", "Europe/London", "UTC"]
    rows = []
    for s, name in enumerate(names):
        for k in range(40):
            utc = dt.datetime(2022, 1, 1, tzinfo=dt.UTC) + dt.timedelta(days=9 * k, hours=k)
            local = utc.astimezone(ZoneInfo(name)).replace(tzinfo=dt.UTC)
            late = 86_400 if k % 3 == 0 else 60 * (k % 20)  # a third arrives a day late
            rows.append((str(s), int(local.timestamp() * 1e6), int((utc.timestamp() + late) * 1e6)))
    df = spark.createDataFrame(rows, "station_id string, local bigint, received_us bigint")
    got = {(r.station_id, r.zone_estimate) for r in estimate_zones(df, sorted(names)).collect()}
    assert got == {(str(s), name) for s, name in enumerate(names)}
    assert estimate_zones(df.limit(0), names).count() == 0 and estimate_zones(df, []).count() == 0


def test_a_change_of_zone_is_found(spark):
    rows = []
    for k in range(200):
        utc = dt.datetime(2022, 1, 1, tzinfo=dt.UTC) + dt.timedelta(days=3 * k)
        hours = 1 if k < 100 else -5
        rows.append(("s", int((utc.timestamp() + 3600 * hours) * 1e6), int((utc.timestamp() + 300) * 1e6) if k % 9 else None))
    df = spark.createDataFrame(rows, "station_id string, local bigint, received_us bigint")
    got = {r.month: r.zone_estimate for r in estimate_zones(df, ["Etc/GMT+5", "Etc/GMT-1", "UTC"]).collect()}
    assert got[2022 * 12] == "Etc/GMT-1" and got[2023 * 12 + 5] == "Etc/GMT+5" and list(dict.fromkeys(got[m] for m in sorted(got))) == ["Etc/GMT-1", "Etc/GMT+5"]
