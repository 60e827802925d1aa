"""Angles, distances and one step of a backward trajectory, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres, seconds, hPa, degrees.
EARTH_RADIUS, HOUR = 6_371_000.0, 3600.0
P_START, P_LOW, P_HIGH = 800.0, 100.0, 950.0
POLAR_LIMIT = 89.0


def unit_sphere(lat: Column, lon: Column) -> list[Column]:
    """x, y, z of a point on the unit sphere."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Straight distance between two points of the unit sphere."""
    return F.sqrt(sum((p - q) * (p - q) for p, q in zip(unit_sphere(lat1, lon1), unit_sphere(lat2, lon2), strict=True)))


def chord_degrees(c: Column) -> Column:
    """The central angle of a chord, in degrees."""
    return F.degrees(2 * F.asin(F.least(c / 2, F.lit(1.0))))


def wrap_longitude(lon: Column) -> Column:
    """Into [-180, 180); pmod, since % keeps the sign of its left side."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def step_back(lat: Column, lon: Column, pressure: Column, u: Column, v: Column, omega: Column) -> list[Column]:
    """Latitude, longitude and pressure one hour earlier in the wind (u, v, omega)."""
    metres = EARTH_RADIUS * F.greatest(F.cos(F.radians(lat)), F.cos(F.radians(F.lit(POLAR_LIMIT))))
    return [
        lat - F.degrees(v * HOUR / EARTH_RADIUS),
        wrap_longitude(lon - F.degrees(u * HOUR / metres)),
        pressure - omega * HOUR / 100.0,
    ]


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
