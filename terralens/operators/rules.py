"""Rule cascades on location attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the land-use rules.
RESIDENTIAL_TYPES = ["apartments", "house", "detached", "terrace", "residential", "semidetached_house"]
INSTITUTIONAL_TYPES = ["church", "school", "hospital", "university", "public", "civic", "government"]
COMMERCIAL_TYPES = ["commercial", "office", "retail", "supermarket"]
INDUSTRIAL_TYPES = ["industrial", "warehouse", "manufacture"]
COMMERCIAL_AMENITIES = ["restaurant", "cafe", "bar", "shop", "bank", "fast_food", "pharmacy", "marketplace"]
BUFFER_M = {"NAIP": 250, "IGN": 100, "ESRI": 100, "S2": 1280}
#: lon_min, lat_min, lon_max, lat_max
US_BOXES = [(-125.0, 24.0, -66.0, 50.0), (-180.0, 51.0, -130.0, 72.0), (-161.0, 18.5, -154.5, 22.5)]
FR_BOX = (-5.5, 41.0, 10.0, 51.5)


def land_use(landuse: Column, top_type: Column, has_residential: Column, amenity_types: Column, has_park: Column, buildings: Column, amenities: Column) -> Column:
    """First rule that holds."""
    lively = F.size(F.array_intersect(amenity_types, F.array(*map(F.lit, COMMERCIAL_AMENITIES)))) >= 2
    dense = (amenities >= 10) & (buildings > 0) & (amenities / F.nullif(buildings, F.lit(0)) > 0.3)
    return (F.when(landuse == "recreation_ground", "open_space")
            .when(landuse.isin("grass", "forest", "meadow") & (buildings < 15), "open_space")
            .when(has_park & (buildings < 10), "open_space")
            .when(landuse.isin("industrial", "railway"), "industrial")
            .when(landuse.isin("retail", "commercial"), "commercial")
            .when(landuse == "residential", "residential")
            .when(top_type.isin(COMMERCIAL_TYPES), "commercial")
            .when(top_type.isin(INDUSTRIAL_TYPES), "industrial")
            .when(top_type.isin(RESIDENTIAL_TYPES), "residential")
            .when(top_type.isin(INSTITUTIONAL_TYPES), "institutional")
            .when(lively & has_residential, "mixed")
            .when(dense & has_residential, "mixed")
            .when(dense, "commercial")
            .when(buildings > 0, "residential")
            .otherwise("mixed"))


def junction(roads: Column, roundabout: Column, signal: Column, bridge: Column) -> Column:
    return F.when(roads < 2, None).when(roundabout, "roundabout").when(signal, "signalized").when(bridge, "grade_separated").otherwise("unsignalized")


def _inside(lat: Column, lon: Column, box: tuple) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def satellite_source(lat: Column, lon: Column) -> Column:
    us = _inside(lat, lon, US_BOXES[0]) | _inside(lat, lon, US_BOXES[1]) | _inside(lat, lon, US_BOXES[2])
    return F.when(us, "NAIP").when(_inside(lat, lon, FR_BOX), "IGN").otherwise("ESRI")


def buffer_m(source: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in BUFFER_M.items() for x in kv)), source), F.lit(200))
