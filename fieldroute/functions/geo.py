"""Geographic Column expressions; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Earth radius in km, planning speed in km/h, mercator radius in m.
EARTH_KM, SPEED_KMH, MERCATOR_M = 6371.0, 50.0, 6378137.0


def haversine_km(lat1, lon1, lat2, lon2):
    """Great-circle km; 0 where an end is missing."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.coalesce(2 * EARTH_KM * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)))), F.lit(0.0))


def travel_minutes(km):
    return km / SPEED_KMH * 60


def mercator(lat, lon):
    """x and y in metres."""
    return F.radians(lon) * MERCATOR_M, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * MERCATOR_M


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"2 * 6371.0::DOUBLE * asin(sqrt(least(greatest(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2), 0), 1)))"
