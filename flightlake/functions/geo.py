"""Expressions on positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0

# Commands whose position is a vertex of the planned route.
ROUTE_COMMANDS = (16, 17, 18, 19, 21, 22, 30, 31, 36, 82, 84, 85, 92, 94, 188, 189)


def is_fix(lat: Column, lon: Column) -> Column:
    """A position that was actually known: both present and not exactly (0, 0)."""
    return lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))


def is_route_command(command: Column) -> Column:
    return F.coalesce(command.isin(*ROUTE_COMMANDS), F.lit(False))


def is_route_vertex(command: Column, lat: Column, lon: Column) -> Column:
    return (
        is_route_command(command)
        & is_fix(lat, lon)
        & (F.abs(lat) <= 90)
        & (F.abs(lon) <= 180)
    )


def as_degrees(lat: Column, lon: Column) -> tuple[Column, Column]:
    """A position in degrees, also where either number is too large for one: then both count 1e-7 degrees."""
    scaled = (F.abs(lat) > 1e5) | (F.abs(lon) > 1e5)
    return F.when(scaled, lat * 1e-7).otherwise(lat), F.when(scaled, lon * 1e-7).otherwise(lon)


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres on a sphere."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(h))


def zoom_for(lon_span: Column, lat_span: Column) -> Column:
    span = F.greatest(lon_span, lat_span, F.lit(1e-4))
    return F.least(F.lit(18.0), F.greatest(F.lit(2.0), F.log2(F.lit(360.0) / span) - 0.5))
