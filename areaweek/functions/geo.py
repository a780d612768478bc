"""Great-circle and border-length expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius and kilometres per degree.
EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE = 111.32


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def degrees_to_km(length: Column, latitude: Column) -> Column:
    """Length in degrees to kilometres, scaled by the square root of cos(latitude)."""
    return length * KM_PER_DEGREE * F.sqrt(F.cos(F.radians(latitude)))
