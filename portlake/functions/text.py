"""String, identifier and JSON-cell expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names of land-cover tiles
TILE_PREFIX = "ESA_WorldCover_10m_2021_v200_"
TILE_SUFFIX = "_Map.tif"
TILE_DEGREES = 3

# fixed values: fields of a Sentinel-1 product name
PRODUCT_NAME = r"^(S1[AB])_(\w+?)_(\w+?)_(\w+?)_(\d{8})T(\d{6})_(\d{8})T(\d{6})_(\d{6})_"

# fixed value: orbits in one repeat cycle
ORBITS_PER_CYCLE = 175


def clean_ws(c: Column) -> Column:
    """Collapse runs of white space to one space and trim."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    """Empty text is the null marker of the source tables."""
    return F.nullif(F.trim(c), F.lit(""))


def port_key(c: Column) -> Column:
    """Spelling of a port name before the alias table is applied."""
    return clean_ws(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" ")))


def valid_mmsi(c: Column) -> Column:
    """Nine digits, not all zero."""
    return c.rlike(r"^\d{9}$") & (c != "000000000")


def object_id(*parts: Column) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def id_part(c: Column, k: int) -> Column:
    return F.split_part(c, F.lit("|"), F.lit(k))


def product_fields(c: Column) -> dict[str, Column]:
    """Platform, mode, polarisation, date, time and absolute orbit from a product name (null when it is none)."""
    part = lambda k: F.nullif(F.regexp_extract(c, PRODUCT_NAME, k), F.lit(""))
    return {
        "platform": part(1), "mode": part(2), "pol": part(4),
        "date": F.to_date(part(5), "yyyyMMdd"),
        "hour": F.substring(part(6), 1, 2).cast("int"), "minute": F.substring(part(6), 3, 2).cast("int"),
        "orbit": part(9).cast("int"),
    }


def relative_orbit(orbit: Column) -> Column:
    return F.pmod(orbit - 1, F.lit(ORBITS_PER_CYCLE)) + 1


def solar_hour(hour: Column, minute: Column, lon: Column) -> Column:
    """Local solar hour in [0, 24)."""
    return F.pmod(hour + minute / F.lit(60.0) + lon / F.lit(15.0), F.lit(24.0))


def pass_direction(solar: Column) -> Column:
    return F.when(solar.between(15, 21), "desc").when(solar.between(2, 9), "asc").otherwise("?")


def tile_name(lon: Column, lat: Column) -> Column:
    """Name of the three-degree tile that holds a point."""
    lon0 = (F.floor(lon / TILE_DEGREES) * TILE_DEGREES).cast("int")
    lat0 = (F.floor(lat / TILE_DEGREES) * TILE_DEGREES).cast("int")
    return F.concat(
        F.lit(TILE_PREFIX),
        F.when(lat0 >= 0, "N").otherwise("S"), F.lpad(F.abs(lat0).cast("string"), 2, "0"),
        F.when(lon0 >= 0, "E").otherwise("W"), F.lpad(F.abs(lon0).cast("string"), 3, "0"),
        F.lit(TILE_SUFFIX),
    )


def tile_corners(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, margin_m: float = 0.0) -> Column:
    """Array of (lon, lat) corners of all tiles that a box, grown by `margin_m`, touches."""
    mlat = F.lit(margin_m / 111320.0)
    mlon = mlat / F.greatest(F.lit(0.2), F.cos(F.radians((min_lat + max_lat) / 2)))
    base = lambda c: (F.floor(c / TILE_DEGREES) * TILE_DEGREES).cast("int")
    lons = F.sequence(base(min_lon - mlon), base(max_lon + mlon), F.lit(TILE_DEGREES))
    lats = F.sequence(base(min_lat - mlat), base(max_lat + mlat), F.lit(TILE_DEGREES))
    return F.flatten(F.transform(lons, lambda lo: F.transform(lats, lambda la: F.struct(lo.alias("lon"), la.alias("lat")))))


def spatial_block(product: Column, x: Column, y: Column, size: float = 1000.0) -> Column:
    return F.concat_ws("|", product.cast("string"), F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))


def missing_names(flags: Mapping[str, Column]) -> Column:
    """`;`-joined names of the flags that are not true."""
    return F.concat_ws(";", *[F.when(~F.coalesce(f, F.lit(False)), F.lit(n)) for n, f in flags.items()])


def count_true(flags: Mapping[str, Column]) -> Column:
    total = F.lit(0)
    for f in flags.values():
        total = total + F.when(F.coalesce(f, F.lit(False)), 1).otherwise(0)
    return total


def hash_key(c: Column, seed: str = "") -> Column:
    """Reproducible pseudo-random ordering key of an id."""
    return F.sha2(F.concat(F.lit(seed), c.cast("string")), 256)


def histogram_json(entries: Column) -> Column:
    """Array of (key, count) structs to a JSON object with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(entries)))


def histogram_top(c: Column) -> Column:
    """Key with the largest count of a JSON histogram, ties to the smallest key."""
    m = F.from_json(c, "map<string,bigint>")
    return F.element_at(
        F.transform(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), lambda s: s["k"]), 1)
