"""Timestamps written in many ways, read with JVM-side column expressions.

Everything is plain arithmetic on the written fields, so neither the session
time zone nor the ANSI setting changes a result.
"""

from __future__ import annotations

import zoneinfo
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: Minutes east of UTC of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "AZOT": -60, "AZOST": 0, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "JST": 540, "AEST": 600, "AEDT": 660,
}
#: The first three letters of month names, English then Swedish where they differ.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "maj": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12}
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"

_ZONE = r"\s*(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}|[A-Za-z_]+/[A-Za-z_/+-]+)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
#: Pattern, and how its groups are put as year|month|day|hour|minute|second|fraction|half of day|zone.
_FORMS = (
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt]|\s+){_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1|$2|$3|$4|$5|$6|||"),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})\s+([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{4}})\s+{_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})\s+{_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})\s+{_CLOCK}(?:\s*([AaPp][Mm]))?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
)


@cache
def known_zones() -> tuple[str, ...]:
    """Region names of the public tz database that this machine knows."""
    return tuple(sorted(z for z in zoneinfo.available_timezones() if "/" in z or z == "UTC"))


def is_known_zone(zone: Column) -> Column:
    return zone.isin(*known_zones())


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date; arithmetic only."""
    y = year - F.when(month <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    of_era = y - era * 400
    of_year = F.floor((153 * (month + F.when(month > 2, -3).otherwise(9)) + 2) / 5) + day - 1
    return (era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468).cast("bigint")


def _month_length(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _lookup(values: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def fields_of(text: Column) -> Column:
    """The written fields of a date and time as an array of nine strings, NULL where no form fits."""
    out = F.lit(None).cast("string")
    for pattern, order in reversed(_FORMS):
        out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, order)).otherwise(out)
    return F.split(out, r"\|")


def epoch_us(text: Column) -> Column:
    """Microseconds since 1970 of a bare number of seconds, milliseconds or microseconds that falls in 2000..2099; else NULL."""
    number = F.when(text.rlike(r"^\d{9,16}(?:\.\d{1,6})?$") & ~text.rlike(r"^\d{14}$"), text.try_cast("decimal(24,6)"))
    low, high = 946_684_800, 4_102_444_800
    return (
        F.when((number >= low) & (number < high), F.floor(number * 1_000_000))
        .when((number >= low * 1000) & (number < high * 1000), F.floor(number * 1000))
        .when((number >= low * 1_000_000) & (number < high * 1_000_000), F.floor(number))
        .cast("bigint")
    )


def clock_fields(parts: Column) -> dict[str, Column]:
    """The written fields as numbers: columns to be computed once, for clock_us."""
    at = lambda k: F.get(parts, F.lit(k))
    word, half, hour12 = F.lower(at(1)), F.lower(at(7)), _int(at(3))
    zone = at(8)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.when(F.length(digits) > 2, _int(F.substring(digits, 3, 2))).otherwise(0)
    return {
        "year": _int(at(0)),
        "month": F.coalesce(_int(word), _lookup(MONTHS, word)),
        "day": _int(at(2)),
        "hour": F.when(half == "", hour12).when((hour12 >= 1) & (hour12 <= 12), hour12 % 12 + F.when(half == "pm", 12).otherwise(0)),
        "minute": _int(at(4)),
        "second": F.when(at(5) == "", 0).otherwise(_int(at(5))),
        "fraction": F.when(at(6) == "", 0).otherwise(_int(F.substring(F.rpad(at(6), 6, "0"), 1, 6))),
        "has_zone": zone != "",
        "offset": F.when(zone.rlike(r"^[+-]\d"), F.when((_int(F.substring(digits, 1, 2)) <= 18) & (minutes <= 59), F.when(zone.startswith("-"), -1).otherwise(1) * (_int(F.substring(digits, 1, 2)) * 60 + minutes))).otherwise(_lookup(ABBREVIATIONS, F.upper(zone))).cast("bigint") * 60_000_000,
        "text_zone": F.when(is_known_zone(zone), zone),
    }


def clock_us() -> Column:
    """Microseconds of the clock_fields columns as if they were UTC; NULL if they name no real date and time."""
    year, month, day, hour, minute, second = (F.col(c) for c in ("year", "month", "day", "hour", "minute", "second"))
    real = (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= _month_length(year, month)) & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    seconds = ((days_from_civil(year, month, day) * 24 + hour) * 60 + minute) * 60 + second
    return F.when(real, seconds.cast("bigint") * 1_000_000 + F.col("fraction"))


def zone_offset_us(utc: Column, zone: Column) -> Column:
    """Microseconds east of UTC of a known zone at a UTC instant (microseconds)."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), zone)) - utc


def utc_text(us: Column) -> Column:
    """`2023-05-01T12:34:56.000000Z` of microseconds since 1970, whatever the session zone."""
    day = F.floor(us / DAY_US).cast("bigint")
    rest = F.pmod(us, F.lit(DAY_US))
    second = (rest / 1_000_000).cast("bigint")
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    clock = F.concat(two(F.floor(second / 3600)), F.lit(":"), two(F.floor(second / 60) % 60), F.lit(":"), two(second % 60))
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), clock, F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("Z"))
