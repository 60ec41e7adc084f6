"""Distances on a sphere and the grid that finds near pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.constants import EARTH_METRES, PROXIMITY_METRES


def haversine(lat_1: Column, lon_1: Column, lat_2: Column, lon_2: Column) -> Column:
    """Metres between two points given in degrees."""
    a, b = F.radians(lat_1), F.radians(lat_2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon_2) - F.radians(lon_1)) / 2), 2)
    return 2 * EARTH_METRES * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def proximity(metres: Column, limit: float = PROXIMITY_METRES) -> Column:
    """1 at no distance, falling to 0 at ``limit``; 0 beyond or where unknown."""
    return F.when(metres <= limit, 1 - metres / limit).otherwise(0.0)


def cell_degrees(metres: float, most_latitude: float = 85.0) -> tuple[float, float]:
    """Sides, in degrees, of grid cells at least ``metres`` wide up to a latitude."""
    lat = math.degrees(metres / EARTH_METRES) * 1.0001
    return lat, lat / math.cos(math.radians(most_latitude))


def cell(lat: Column, lon: Column, sides: tuple[float, float]) -> tuple[Column, Column]:
    return F.floor((lat + 90) / sides[0]).cast("long"), F.floor((lon + 180) / sides[1]).cast("long")
