"""Distances, bearings and projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0

# WGS-84 ellipsoid, and zone 32 of the UTM grid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM32_MERIDIAN = 9.0


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    half_lat, half_lon = F.sin((lat2 - lat1) / 2.0), F.sin((lon2 - lon1) / 2.0)
    a = half_lat * half_lat + F.cos(lat1) * F.cos(lat2) * half_lon * half_lon
    return 2.0 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def degree_distance(lat1, lon1, lat2, lon2) -> Column:
    dlat, dlon = _c(lat1) - _c(lat2), _c(lon1) - _c(lon2)
    return F.sqrt(dlat * dlat + dlon * dlon)


METRICS = {"haversine": haversine_km, "degrees": degree_distance}


def bearing_sin_cos(lat1, lon1, lat2, lon2) -> tuple[Column, Column]:
    """(sin, cos) of the initial great-circle bearing from point 1 to point 2."""
    lat1, lat2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlon = F.radians(_c(lon2) - _c(lon1))
    east = F.sin(dlon) * F.cos(lat2)
    north = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(dlon)
    angle = F.atan2(east, north)
    return F.sin(angle), F.cos(angle)


def bearing_degrees(lat1, lon1, lat2, lon2) -> Column:
    sin, cos = bearing_sin_cos(lat1, lon1, lat2, lon2)
    return F.pmod(F.degrees(F.atan2(sin, cos)), F.lit(360.0))


def position_encoding(lat, lon) -> list[Column]:
    """sin/cos of latitude and longitude."""
    lat, lon = F.radians(_c(lat)), F.radians(_c(lon))
    return [F.sin(lat), F.cos(lat), F.sin(lon), F.cos(lon)]


def inverse_geodesic(lat1, lon1, lat2, lon2, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Distance in km and bearing in [0, 360) on WGS-84 for arrays of point pairs."""
    b = WGS84_A * (1 - WGS84_F)
    phi1, phi2 = np.radians(lat1), np.radians(lat2)
    dlon = np.radians(np.asarray(lon2) - np.asarray(lon1))
    u1, u2 = np.arctan((1 - WGS84_F) * np.tan(phi1)), np.arctan((1 - WGS84_F) * np.tan(phi2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = dlon.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(rounds):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cos_s = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, cu1 * cu2 * sl / sin_s, 0.0)
            cos2_a = 1 - sin_a**2
            cos_2m = np.where(cos2_a > 0, cos_s - 2 * su1 * su2 / cos2_a, 0.0)
            c = WGS84_F / 16 * cos2_a * (4 + WGS84_F * (4 - 3 * cos2_a))
            step = sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1))
            lam = dlon + (1 - c) * WGS84_F * sin_a * step
        us = cos2_a * (WGS84_A**2 - b**2) / b**2
        big_a = 1 + us / 16384 * (4096 + us * (us * (320 - 175 * us) - 768))
        big_b = us / 1024 * (256 + us * (us * (74 - 47 * us) - 128))
        tail = cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3) * big_b / 6
        delta = big_b * sin_s * (cos_2m + big_b / 4 * (cos_s * (2 * cos_2m**2 - 1) - tail))
        km = b * big_a * (sigma - delta) / 1000.0
        bearing = np.degrees(np.arctan2(cu2 * np.sin(lam), cu1 * su2 - su1 * cu2 * np.cos(lam)))
    return km, np.mod(bearing, 360.0)


def geodesic(lat1, lon1, lat2, lon2) -> Column:
    """Struct ``(km, bearing)`` on WGS-84, computed on Arrow batches."""

    @F.pandas_udf("struct<km double, bearing double>")
    def solve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        km, bearing = inverse_geodesic(*(x.to_numpy(float) for x in (a, b, c, d)))
        return pd.DataFrame({"km": km, "bearing": bearing})

    return solve(lat1, lon1, lat2, lon2)


def utm(lat: Column | str, lon: Column | str, meridian: float = UTM32_MERIDIAN) -> tuple[Column, Column]:
    """(easting, northing) in metres on the northern UTM grid, by the Krueger series."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    ecc = 2 * n**0.5 / (1 + n)
    phi, dlon = F.radians(_c(lat)), F.radians(_c(lon) - meridian)
    t = F.sinh(F.atanh(F.sin(phi)) - ecc * F.atanh(ecc * F.sin(phi)))
    xi = F.atan2(t, F.cos(dlon))
    eta = F.atanh(F.sin(dlon) / F.sqrt(1.0 + t * t))
    east, north = eta, xi
    for j, a in enumerate(series, start=1):
        east = east + a * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        north = north + a * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    return UTM_FALSE_EASTING + UTM_SCALE * radius * east, UTM_SCALE * radius * north


def anisotropic_km(x1, y1, x2, y2, angle_deg: float, ratio: float) -> Column:
    """Planar distance with the axis across ``angle_deg`` (clockwise from north) stretched."""
    theta = F.radians(F.lit(float(angle_deg)))
    dx, dy = _c(x2) - _c(x1), _c(y2) - _c(y1)
    along = dx * F.sin(theta) + dy * F.cos(theta)
    across = (dx * F.cos(theta) - dy * F.sin(theta)) / ratio
    return F.sqrt(along * along + across * across) / 1000.0
