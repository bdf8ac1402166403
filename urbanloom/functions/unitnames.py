"""Units as people write them: a name in a unit column or inside a description, to a unit code.

Names are folded first (case, blanks, dots, signs, raised digits), so that one
short pattern per unit covers its spellings in English and Swedish. Other fields
and units are read by their codes in the table of units (`coded`).

A description is read where one of the templates of PHRASES puts the unit:
"Enhet: U. ..." (U may hold a dot), "Enhet: U", "given in U, ...",
"readings are U; ...", "... (U)", "...; values in U" and "... - unit U".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_METRE, _PER_S = "met(?:er|re)s?", "per(?:second|sekund)"
_CUBIC = "(?:percubicmet(?:er|re)|perkubikmeter|/?m-?3)"
#: Per field, unit code and the pattern that its folded names match as a whole.
PATTERNS: dict[str, tuple[tuple[str, str], ...]] = {
    "air_temperature": (
        ("tenth_degC", r"(?:0?1|1/10|tenths?|tiondels?)(?:ofa?|x)?(?:°|deg(?:rees?)?|grad(?:er)?)?(?:c|celsius)|(?:°|deg)?(?:c|celsius)x0?1|(?:°|deg)?(?:c|celsius)/10"),
        ("degC", r"(?:°|deg(?:rees?)?|grad(?:er)?)?(?:c|celsius)"),
        ("kelvin", r"(?:absolutetemperaturein)?(?:°|deg(?:rees?)?|grad(?:er)?)?(?:k|kelvins?)"),
        ("degF", r"(?:°|deg(?:rees?)?|grad(?:er)?)?(?:f|fahrenheit)"),
    ),
    "air_pressure": (
        ("hPa", r"hpa|mbar|mb|millibars?|hectopascals?|hektopascal"),
        ("kPa", r"kpa|kilopascals?"),
        ("Pa", r"pa|pascals?|n/m2|nm-2"),
        ("mmHg", rf"mmhg|torr|mmkvicksilver|milli{_METRE}ofmercury|millimeterkvicksilver"),
        ("inHg", r'(?:in|"|inch(?:es)?)hg|inch(?:es)?ofmercury|tumkvicksilver'),
    ),
    "wind_speed": (
        ("m_s", rf"m/s|ms-1|mps|{_METRE}{_PER_S}|{_METRE}/s"),
        ("km_h", rf"km/?h|kmh-1|kph|kilo{_METRE}(?:perhour|itimmen|pertimme)"),
        ("knot", r"kn|kts?|knots?|knop"),
        ("mph", r"mph|mi/h|miles?/h(?:our)?|miles?perhour"),
    ),
    "precipitation": (
        ("tenth_mm", rf"0?1mm|1/10mm|mm/10|mmx0?1|(?:tenths?|tiondels?)(?:ofa?)?(?:mm|milli{_METRE})"),
        ("mm", rf"mm|milli{_METRE}|l/m2|lit(?:er|re)s?(?:persquaremet(?:er|re)|perkvadratmeter)"),
        ("cm", rf"cm|centi{_METRE}"),
        ("inch", r'in|inch(?:es)?|tum|"'),
    ),
    "water_level": (("m", rf"m|{_METRE}"), ("cm", rf"cm|centi{_METRE}"), ("mm", rf"mm|milli{_METRE}"), ("ft", r"ft|foot|feet|fot|'")),
    "water_discharge": (
        ("m3_s", rf"m3/s|m3s-1|cumecs?|cubic{_METRE}{_PER_S}|kubikmeter{_PER_S}"),
        ("l_s", rf"l/s|ls-1|lps|dm3/s|lit(?:er|re)s?(?:/s|{_PER_S})"),
        ("ft3_s", rf"ft3/s|cfs|cuft/s|cubic(?:feet|foot){_PER_S}|kubikfot{_PER_S}"),
    ),
    "pm10": (
        ("ug_m3", rf"(?:ug|micrograms?|mikrogram){_CUBIC}"),
        ("mg_m3", rf"(?:mg|milligrams?){_CUBIC}"),
        ("ng_m3", rf"(?:ng|nanograms?){_CUBIC}"),
    ),
}
#: Where a description puts the unit of its value; the second Enhet form allows for a dot inside the unit.
PHRASES = (r"^Enhet: (.+?)\. ", r"^Enhet: (.+?\. .+?)\. ", r"^Enhet: ([^.]+)$", r"^given in (.+?), ", r"^readings are (.+?); ", r" \(([^()]+)\)$", r"; values in (.+)$", r" - unit (.+)$")
_FROM, _TO = "²³¹⁻−·µμ″′”’º", "231--.uu\"'\"'°"


def folded(name: Column) -> Column:
    """A unit name without what spellings differ in."""
    text = F.translate(F.lower(F.trim(name)), _FROM, _TO)
    text = F.replace(F.replace(text, F.lit("℃"), F.lit("°c")), F.lit("℉"), F.lit("°f"))
    return F.regexp_replace(text, r"[\s._()^]+", "")


def unit_code(field: Column, text: Column) -> Column:
    """The code of a folded unit name, NULL if the field has no such unit."""
    out = F.lit(None).cast("string")
    for name_of_field, units in PATTERNS.items():
        mine = F.lit(None).cast("string")
        for code, pattern in reversed(units):
            mine = F.when(text.rlike(f"^(?:{pattern})$"), code).otherwise(mine)
        out = F.when(field == name_of_field, mine).otherwise(out)
    return out


def coded(units: DataFrame) -> DataFrame:
    """Per field of the table of units (field, unit_code): _exact and _folded, maps from a code and from a folded code to the code. What two codes fold to is in neither."""
    held = units.select("field", F.col("unit_code").alias("code")).where("field IS NOT NULL AND code IS NOT NULL").distinct()

    def by(key: Column, name: str) -> DataFrame:
        one = held.groupBy("field", key.alias("key")).agg(F.min("code").alias("code"), F.count("*").alias("n")).where("n = 1 AND key != ''")
        return one.groupBy("field").agg(F.map_from_entries(F.collect_list(F.struct("key", "code"))).alias(name))  # 10,000 entries at most

    return by(F.trim("code"), "_exact").join(by(folded(F.col("code")), "_folded"), "field", "full").withColumnRenamed("field", "_of")


def unit_codes(field: Column, names: Column, exact: Column | None = None, fold: Column | None = None) -> Column:
    """The codes of an array of unit names, by the maps of `coded` if given, else by PATTERNS. Lambdas keep one copy of the pattern chain, and each name is folded once."""
    if exact is None or fold is None:
        return F.transform(F.transform(names, folded), lambda text: unit_code(field, text))
    both = F.transform(names, lambda name: F.struct(F.trim(name).alias("name"), folded(name).alias("text")))
    return F.transform(both, lambda b: F.coalesce(F.try_element_at(exact, b["name"]), F.try_element_at(fold, b["text"]), unit_code(field, b["text"])))


def phrases(description: Column) -> Column:
    """The places of a description where its value's unit may stand, as an array."""
    return F.array(*(F.regexp_extract(description, p, 1) for p in PHRASES))
