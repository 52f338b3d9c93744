"""Distances, angles, grid cells and 64-bit photo hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basinlens.constants import EARTH_RADIUS_M


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres on a sphere."""
    lat1, lon1, lat2, lon2 = (F.col(c) if isinstance(c, str) else c for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(chord))


def dms_to_degrees(parts, ref, negative_ref: str) -> Column:
    """Signed degrees from ``array<struct<num,den>>`` (deg, min, sec) and a hemisphere letter.

    Null when the tag is missing; a missing hemisphere letter leaves the sign positive.
    """
    parts = F.col(parts) if isinstance(parts, str) else parts
    ref = F.col(ref) if isinstance(ref, str) else ref

    def ratio(i: int) -> Column:
        return F.try_divide(parts[i]["num"].cast("double"), parts[i]["den"].cast("double"))

    degrees = ratio(0) + ratio(1) / F.lit(60.0) + ratio(2) / F.lit(3600.0)
    return F.when(ref.eqNullSafe(F.lit(negative_ref)), -degrees).otherwise(degrees)


def exif_gps(lat_parts, lat_ref, lon_parts, lon_ref) -> Column:
    """``struct<lat,lon>``; null unless both tags are present."""
    lat = dms_to_degrees(lat_parts, lat_ref, "S")
    lon = dms_to_degrees(lon_parts, lon_ref, "W")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def exif_timestamp(*tags) -> Column:
    """First tag that parses as ``yyyy:MM:dd HH:mm:ss``, without a time zone."""
    texts = [F.col(t) if isinstance(t, str) else t for t in tags]
    fmt = F.lit("yyyy:MM:dd HH:mm:ss")
    strict = [F.when(t.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"), t) for t in texts]
    return F.coalesce(*[F.try_to_timestamp(t, fmt).cast("timestamp_ntz") for t in strict])


def cell(value, size: float) -> Column:
    """Index of the grid cell (half-open intervals of ``size``) holding ``value``."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(float(size))).cast("long")


def cell_range(low: Column, high: Column, size: float) -> Column:
    """All cell indexes touched by the closed interval [low, high]."""
    return F.sequence(cell(low, size), cell(high, size))


def is_hash_hex(text) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike("^[0-9a-fA-F]{16}$")


def hash_from_hex(text) -> Column:
    """64-bit value of 16 hex characters as a bigint; null for text that is not a hash."""
    text = F.col(text) if isinstance(text, str) else text
    clean = F.when(is_hash_hex(text), text)
    high = F.conv(F.substring(clean, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(clean, 9, 8), 16, 10).cast("bigint")
    return hash_from_halves(high, low)


def hash_from_halves(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
