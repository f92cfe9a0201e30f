"""Geography as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def latitude() -> Column:
    return F.coalesce(F.col("source.geo.location.lat"), F.col("source.geo.latitude"))


def longitude() -> Column:
    return F.coalesce(F.col("source.geo.location.lon"), F.col("source.geo.longitude"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    a = (F.pow(F.sin(half_dlat), 2.0)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2.0))
    # Rounding may push antipodal points just past 1, where asin is NaN.
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def speed_kmh(distance_km: Column, micros: Column) -> Column:
    """Speed over a time gap that is taken as at least one second."""
    seconds = F.greatest(micros / F.lit(1e6), F.lit(1.0))
    return distance_km / seconds * 3600
