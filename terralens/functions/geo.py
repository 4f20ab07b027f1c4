"""Geometry as column expressions. Angles are degrees, lengths metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
DEGREE_M = 111320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(EARTH_M) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    x = F.sin(d) * F.cos(p2)
    y = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(x, y)), F.lit(360.0))


def lat_degrees(metres: Column | float) -> Column:
    return (F.lit(metres) if not isinstance(metres, Column) else metres) / DEGREE_M


def lon_degrees(metres: Column | float, lat: Column) -> Column:
    return (F.lit(metres) if not isinstance(metres, Column) else metres) / (F.lit(DEGREE_M) * F.cos(F.radians(lat)))


def tile_bbox(lat: Column, lon: Column, metres: Column | float) -> Column:
    """(south, west, north, east) of the square around a point."""
    dy, dx = lat_degrees(metres), lon_degrees(metres, lat)
    return F.struct((lat - dy).alias("south"), (lon - dx).alias("west"), (lat + dy).alias("north"), (lon + dx).alias("east"))


def point_quadrant(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Top-Left, Top-Right, Bottom-Left or Bottom-Right; the north and west edges belong to top and left."""
    return F.concat(F.when(lat >= lat0, "Top-").otherwise("Bottom-"), F.when(lon <= lon0, "Left").otherwise("Right"))


def bearing_quadrant(b: Column) -> Column:
    b = F.pmod(b, F.lit(360.0))
    return F.when(b < 90, "Top-Right").when(b < 180, "Bottom-Right").when(b < 270, "Bottom-Left").otherwise("Top-Left")


def headings(b: Column) -> Column:
    """Camera headings along and across a road."""
    turn = lambda d: F.pmod(b + F.lit(float(d)), F.lit(360.0))
    return F.struct(turn(0).alias("along_fwd"), turn(180).alias("along_bwd"), turn(90).alias("cross_left"), turn(-90).alias("cross_right"))
