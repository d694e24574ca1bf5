"""Column functions: rounding, distances, headings, keys, units."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the calculation contract.
M_PER_MILE, M_PER_KM = 1609.344, 1000.0
MPS_TO_MPH, MPS_TO_KMH = 2.23694, 3.6
EARTH_A, EARTH_F = 6378137.0, 1.0 / 298.257223563
EARTH_R = 6_371_000.0


def js_round(x: Column) -> Column:
    """The nearest whole number, ties upward (2.5 -> 3, -2.5 -> -2)."""
    low = F.floor(x).cast("double")
    return low + F.when(x - low >= 0.5, 1.0).otherwise(0.0)


def round1(x: Column) -> Column:
    return js_round(x * 10.0) / 10.0


def round2(x: Column) -> Column:
    return js_round(x * 100.0) / 100.0


def _rad(x: Column) -> Column:
    return x * F.lit(math.pi) / 180.0


def geodesic_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on the WGS-84 ellipsoid (Andoyer-Lambert); 0 between equal points."""
    b1 = F.atan((1.0 - EARTH_F) * F.tan(_rad(lat1)))
    b2 = F.atan((1.0 - EARTH_F) * F.tan(_rad(lat2)))
    p, q = (b1 + b2) / 2.0, (b2 - b1) / 2.0
    half = F.sin(_rad(lng2 - lng1) / 2.0)
    h = F.sin(q) * F.sin(q) + F.cos(b1) * F.cos(b2) * half * half
    sigma = 2.0 * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1.0 - h, F.lit(0.0))))
    x = (sigma - F.sin(sigma)) * (F.sin(p) * F.sin(p) * F.cos(q) * F.cos(q)) / F.greatest(1.0 - h, F.lit(1e-12))
    y = (sigma + F.sin(sigma)) * (F.cos(p) * F.cos(p) * F.sin(q) * F.sin(q)) / F.greatest(h, F.lit(1e-12))
    same = ((lat1 == lat2) & (lng1 == lng2)) | (sigma == 0.0)
    return F.when(same, 0.0).otherwise(EARTH_A * (sigma - (EARTH_F / 2.0) * (x + y)))


def surely_within(lat1: Column, lng1: Column, lat2: Column, lng2: Column, metres: float) -> Column:
    """True where a bound on the distance (no degree is longer than 112 km) is within ``metres``; cheap, so it goes before geodesic_m in a filter."""
    return (F.abs(lat2 - lat1) + F.abs(lng2 - lng1)) * 112_000.0 <= metres


def surely_beyond(lat1: Column, lat2: Column, metres: float) -> Column:
    """True where the latitudes alone are more than ``metres`` apart (no degree of latitude is shorter than 110 km)."""
    return F.abs(lat2 - lat1) * 110_000.0 > metres


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on a sphere of 6 371 km."""
    dlat, dlng = F.sin(_rad(lat2 - lat1) / 2.0), F.sin(_rad(lng2 - lng1) / 2.0)
    a = dlat * dlat + F.cos(_rad(lat1)) * F.cos(_rad(lat2)) * dlng * dlng
    return EARTH_R * 2.0 * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def heading(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Forward azimuth in degrees, 0 to 360."""
    dl = _rad(lng2 - lng1)
    y = F.sin(dl) * F.cos(_rad(lat2))
    x = F.cos(_rad(lat1)) * F.sin(_rad(lat2)) - F.sin(_rad(lat1)) * F.cos(_rad(lat2)) * F.cos(dl)
    return F.pmod(F.atan2(y, x) * 180.0 / F.lit(math.pi) + 360.0, F.lit(360.0))


def coord_key(lat: Column, lng: Column) -> Column:
    """``lat,lng`` with five decimals."""
    return F.format_string("%.5f,%.5f", lat, lng)


def epoch_seconds(ts: Column) -> Column:
    """Seconds from seconds or milliseconds (above 1e10); negative or missing times give null."""
    return F.when(ts >= 0, F.when(ts > 1e10, ts / 1000.0).otherwise(ts))


def charging_state_key(state: Column) -> Column:
    """Trimmed, lower-cased, letters and digits only."""
    return F.regexp_replace(F.lower(F.trim(state)), "[^a-z0-9]", "")


def percent_of(part: Column, whole: Column) -> Column:
    """Percent to one decimal; 0 of nothing."""
    return F.when(whole > 0, js_round(part / whole * 1000.0) / 10.0).otherwise(0.0)


def c_to_f(c: Column) -> Column:
    return c * 9.0 / 5.0 + 32.0


def psi_to_bar(psi: Column) -> Column:
    return psi * 0.0689476
