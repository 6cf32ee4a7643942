"""Great-circle geometry as Column expressions (no UDFs, all inside codegen)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapaudit.config import EARTH_RADIUS_M


def _c(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Metres between two (lat, lon) points on the mean sphere."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # not least(): that would skip a null and answer half the circumference
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.when(a > 1.0, 1.0).otherwise(F.sqrt(a)))


def unit_vector(lat, lon) -> tuple[Column, Column, Column]:
    """The point on the unit sphere; squared chords between such points order like distances."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon))
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def destination(lat, lon, heading, distance) -> tuple[Column, Column]:
    """(lat, lon) reached from a point along a bearing in degrees clockwise from north."""
    phi, bearing = F.radians(_c(lat)), F.radians(_c(heading))
    delta = _c(distance) / F.lit(EARTH_RADIUS_M)
    phi2 = F.asin(F.sin(phi) * F.cos(delta) + F.cos(phi) * F.sin(delta) * F.cos(bearing))
    dlon = F.atan2(
        F.sin(bearing) * F.sin(delta) * F.cos(phi),
        F.cos(delta) - F.sin(phi) * F.sin(phi2),
    )
    return F.degrees(phi2), F.degrees(F.radians(_c(lon)) + dlon)


def pixel_distance(v, image_height=1440, camera_height=1.4, fov_deg=92.0, horizon=None) -> Column:
    """Ground distance of an image row for a level camera; infinity from the horizon up."""
    half = image_height / 2
    below = _c(v) - F.lit(float(half if horizon is None else horizon))
    scale = half * camera_height / math.tan(math.radians(fov_deg / 2))
    return F.when(below <= 0, F.lit(float("inf"))).otherwise(F.lit(scale) / below)


def wkt_point(lon, lat) -> Column:
    """``POINT(lon lat)``; null when either coordinate is null."""
    return F.concat(F.lit("POINT("), _c(lon).cast("string"), F.lit(" "), _c(lat).cast("string"), F.lit(")"))


def within_box(lat_col: str, lon_col: str, metres: float, lat: float, lon: float) -> Column:
    """Bounds that every position within ``metres`` of (lat, lon) keeps: plain comparisons of columns with numbers, which a
    scan can use to skip row groups. The distance itself is still to be tested."""
    reach = math.degrees(metres / EARTH_RADIUS_M) * (1 + 1e-9) + 1e-9
    box = (F.col(lat_col) >= lat - reach) & (F.col(lat_col) <= lat + reach)
    if abs(lat) + reach >= 90:  # a pole is inside: every meridian is near
        return box
    side = math.degrees(math.asin(math.sin(math.radians(reach)) / math.cos(math.radians(lat)))) + 1e-9
    around = [(lon + turn - side, lon + turn + side) for turn in (-360.0, 0.0, 360.0)]
    near = [(F.col(lon_col) >= max(west, -180.0)) & (F.col(lon_col) <= min(east, 180.0))
            for west, east in around if west <= 180 and east >= -180]
    # longitudes written beyond a full turn are left to the distance
    return box & reduce(lambda a, b: a | b, near, (F.col(lon_col) < -180.0) | (F.col(lon_col) > 180.0))
