"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Kilometres in a degree of latitude, rounded down: a band this wide has every point in reach.
KM_A_DEGREE = 111.19


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points in degrees; NULL where one is unknown."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.when(a.isNotNull(), F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a))))
