"""Names of parameters, geometry types and point classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parameter numbers of the national weather, hydrology and ocean services, by name and alias.
PARAMETERS = {
    "weather": {
        "air_temperature": 1, "wind_direction": 3, "wind_speed": 4, "relative_humidity": 6, "precipitation_1h": 7, "sea_level_pressure": 9,
        "temperature": 1, "temp": 1, "wind_dir": 3, "wind": 4, "humidity": 6, "rh": 6, "precipitation": 7, "precip": 7, "rain": 7, "pressure": 9,
    },
    "hydrology": {
        "discharge_daily": 1, "discharge_15min": 2, "water_level": 3, "water_temperature": 4, "ice_formation": 5, "ice_breakup": 6, "ice_thickness": 7, "snow_density": 8, "water_equivalent": 9, "discharge_monthly": 10,
        "discharge": 1, "flow": 1, "flow_daily": 1, "flow_15min": 2, "level": 3, "water_temp": 4, "temperature": 4, "ice": 7, "snow": 8,
    },
    "ocean": {
        "wave_height_significant": 1, "current_direction": 2, "current_speed": 3, "salinity": 4, "sea_temperature": 5, "sea_level": 6, "wave_direction_mean": 7, "wave_direction_peak": 8, "wave_period_peak": 9, "wave_period_mean": 10, "wave_height_max": 11, "sea_level_rw_hourly": 12, "sea_level_minute": 13, "sea_level_rw_minute": 14, "dissolved_oxygen": 15,
        "temperature": 5, "sea_temp": 5, "water_temperature": 5, "water_temp": 5, "level": 6, "water_level": 6, "salt": 4, "waves": 1, "wave_height": 1, "current": 3, "oxygen": 15,
    },
    "air_quality": {"no2": 8, "o3": 7, "pm10": 5, "pm2.5": 6001, "so2": 1, "co": 2064},
}
#: Land-use codes of the survey and their classes.
LANDUSE = {
    "VATTEN": "WATER", "SKOGLÖV": "FOREST", "SKOGSMARK": "FOREST", "SKOGBARR": "FOREST", "ODLÅKER": "FARMLAND", "ÅKERMARK": "FARMLAND",
    "ODLFRUKT": "FARMLAND", "ÖPMARK": "GRASS", "BEBLÅG": "LIGHT_URBAN", "BEBHÖG": "HEAVY_URBAN", "BEBSLUT": "URBAN", "BEBIND": "INDUSTRIAL",
}
#: The point classes of named groups.
CLASSES = {"terrain": (2, 8), "buildings": (6, 9), "vegetation": (3, 4, 5, 7)}


def resolve_parameter(kind: str, name: str | int) -> int:
    """The number of a parameter: a number as it is, an alias in any case, with blanks or hyphens; ValueError otherwise."""
    if isinstance(name, int):
        return name
    text = name.strip().lower().replace(" ", "_").replace("-", "_")
    if text.isdigit():
        return int(text)
    if text not in PARAMETERS[kind]:
        raise ValueError(f"no {kind} parameter {name}")
    return PARAMETERS[kind][text]


def parameter_column(kind: str, name: Column) -> Column:
    """resolve_parameter of a column, NULL where the name is unknown."""
    text = F.translate(F.lower(F.trim(name)), " -", "__")
    known = F.create_map(*(F.lit(x) for pair in PARAMETERS[kind].items() for x in pair))
    return F.coalesce(text.try_cast("int"), F.try_element_at(known, text))


def geometry_type(class_name: Column) -> Column:
    """`VolumeMesh` to `VOLUME_MESH`."""
    return F.upper(F.regexp_replace(class_name, "(?<!^)(?=[A-Z])", "_"))


#: The kinds of geometry that an object may have.
GEOMETRY_TYPES = ("BOUNDS", "LOD0", "LOD1", "LOD2", "LOD3", "MESH", "VOLUME_MESH", "POINT_CLOUD", "RASTER", "POLYGON", "SURFACE", "MULTISURFACE", "LINESTRING", "MULTILINESTRING")


def geometry_type_of(name: Column) -> Column:
    """The kind of geometry that a text names, in any case, with hyphens or blanks; NULL if it names none."""
    text = F.translate(F.upper(F.trim(name)), " -", "__")
    return F.when(text.isin(*GEOMETRY_TYPES), text)


def classes_of(name: str) -> tuple[int, ...]:
    if name not in CLASSES:
        raise ValueError(f"no class group {name}; there are {', '.join(CLASSES)}")
    return CLASSES[name]


def landuse_class(code: Column) -> Column:
    """The class of a land-use code, UNKNOWN for a missing, empty or unlisted one."""
    known = F.create_map(*(F.lit(x) for pair in LANDUSE.items() for x in pair))
    return F.coalesce(F.try_element_at(known, code), F.lit("UNKNOWN"))
