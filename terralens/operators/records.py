"""Record projections, source choice, and integrity of finished splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralens.functions import geo
from terralens.operators import spatial
from terralens.operators.split import id_counts

#: Fixed order of attempts for each source.
FALLBACK = {"NAIP": ["NAIP", "ESRI", "S2"], "IGN": ["IGN", "ESRI", "S2"], "ESRI": ["ESRI", "S2"], "S2": ["S2"]}
TILE_BYTES = 5000
SNAP_M, TUNNEL_SPREAD = 80.0, 40.0


def blank(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def modality(sat: Column, views: Column) -> Column:
    return F.when(sat & (views > 0), "sat+sv").when(sat, "sat_only").otherwise("sv_only")


def geocode(suburb: Column, district: Column, county: Column) -> Column:
    """The first that isn't empty."""
    return F.coalesce(blank(suburb), blank(district), county, F.lit(""))


def census(fips: Column, income: Column) -> Column:
    """State, county and tract parts of a block code, and the income unless it is a negative mark."""
    return F.struct(F.substring(fips, 1, 2).alias("state"), F.substring(fips, 3, 3).alias("county"), F.substring(fips, 6, 6).alias("tract"), F.when(income >= 0, income).alias("income"))


def source_allowed(df: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """A null source fails an allow list and passes a deny list."""
    if allow is not None:
        df = df.where(F.coalesce(F.col("source").isin(allow), F.lit(False)))
    if deny is not None:
        df = df.where(~F.coalesce(F.col("source").isin(deny), F.lit(False)))
    return df


def choose_tile(samples: DataFrame, tiles: DataFrame) -> DataFrame:
    """For each sample (sample_id, source) the first source of its chain with a tile (sample_id, tile_source, bytes) of enough bytes."""
    chain = F.posexplode(F.try_element_at(F.create_map(*(x for k, v in FALLBACK.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("source"))).alias("step", "tile_source")
    tries = samples.select("sample_id", chain).join(tiles.where(F.col("bytes") > TILE_BYTES), ["sample_id", "tile_source"])
    best = tries.groupBy("sample_id").agg(F.min(F.struct("step", "tile_source")).alias("m"))
    return samples.join(best, "sample_id", "left").select("sample_id", "source", F.col("m.tile_source").alias("actual"))


def view_status(lat: Column, lon: Column, pano_lat: Column, pano_lon: Column) -> Column:
    """NO_COVERAGE, SNAP_TOO_FAR or OK by the distance to the panorama."""
    d = geo.haversine_m(lat, lon, pano_lat, pano_lon)
    return F.when(pano_lat.isNull(), "NO_COVERAGE").when(d > SNAP_M, "SNAP_TOO_FAR").otherwise("OK")


def snap_distance(lat: Column, lon: Column, pano_lat: Column, pano_lon: Column) -> Column:
    """Distance to the panorama; null without one, and where it is exactly 0."""
    return F.nullif(geo.haversine_m(lat, lon, pano_lat, pano_lon), F.lit(0.0))


#: What is read from each source's files: the least number of bytes that passes.
LEAST_BYTES = {"tile fetch": 5001, "tile validation": 5000, "view fetch": 5000, "view validation": 5001, "audit": 5120}


def large_enough(length: Column, use: str) -> Column:
    return F.coalesce(length >= LEAST_BYTES[use], F.lit(False))


def bbox_text(lat: Column, lon: Column, metres: float) -> Column:
    """west,south,east,north of a tile, as requests have it."""
    t = geo.tile_bbox(lat, lon, metres)
    return F.concat_ws(",", *(t[k].cast("string") for k in ("west", "south", "east", "north")))


def query_text(parameters: dict[str, Column | str]) -> Column:
    """An encoded query string; values may be columns."""
    return F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.url_encode(v if isinstance(v, Column) else F.lit(v))) for k, v in parameters.items()))


def wms_request(lat: Column, lon: Column, metres: float, pixels: int, layer: str) -> Column:
    """Parameters of a map image in longitude-latitude order."""
    return query_text({"SERVICE": "WMS", "VERSION": "1.3.0", "REQUEST": "GetMap", "LAYERS": layer, "STYLES": "", "CRS": "CRS:84", "BBOX": bbox_text(lat, lon, metres), "WIDTH": str(pixels), "HEIGHT": str(pixels), "FORMAT": "image/png"})


def export_request(lat: Column, lon: Column, metres: float, pixels: int) -> Column:
    """Parameters of an exported map image."""
    return query_text({"bbox": bbox_text(lat, lon, metres), "bboxSR": "4326", "size": f"{pixels},{pixels}", "imageSR": "4326", "format": "png32", "pixelType": "U8", "noDataInterpretation": "esriNoDataMatchAny", "interpolation": "RSP_BilinearInterpolation", "f": "image"})


def view_paths(sample_id: Column, views: Column) -> Column:
    """Paths of the views of an array of names."""
    return F.transform(views, lambda v: F.concat(F.lit("images/sv/"), sample_id, F.lit("_"), v, F.lit(".jpg")))


def arrow_paths(sample_id: Column) -> Column:
    """The arrow image of each view's heading."""
    return F.map_from_arrays(F.array(*(F.lit(v) for v in ("along_fwd", "along_bwd", "cross_left", "cross_right"))), F.transform(F.array(*(F.lit(v) for v in ("along_fwd", "along_bwd", "cross_left", "cross_right"))), lambda v: F.concat(F.lit("images/arrows/"), sample_id, F.lit("_"), v, F.lit(".png"))))


def arrow_head(bearing: Column, length: float = 80.0, centre: float = 256.0, head: float = 16.0, half: float = 8.0) -> Column:
    """Tip and both corners of an arrow's head: along the unit vector back from the tip, then aside."""
    a = F.radians(bearing)
    ux, uy = F.sin(a), -F.cos(a)
    tx, ty = F.lit(centre) + length * ux, F.lit(centre) + length * uy
    side = lambda k: ((tx - ux * head - uy * (k * half)), (ty - uy * head + ux * (k * half)))
    (lx, ly), (rx, ry) = side(1), side(-1)
    return F.struct(tx.alias("tip_x"), ty.alias("tip_y"), lx.alias("left_x"), ly.alias("left_y"), rx.alias("right_x"), ry.alias("right_y"))


def snapped_points(cities: DataFrame, nodes: DataFrame, n: int, attempts: int = 20, seed: int = 42) -> DataFrame:
    """The first ``n`` hashed points of each city that have a road within reach, numbered, with the road's way and vertex."""
    points = random_points(cities, n, attempts, seed).withColumn("sample_id", F.concat_ws("#", "city", F.col("attempt").cast("string")))
    snapped = spatial.snap_to_road(points, nodes).withColumnRenamed("sample_id", "point")
    return first_snapped(points.withColumnRenamed("sample_id", "point").join(snapped, "point").drop("point"), n)


def is_tunnel(r: Column, g: Column, b: Column) -> Column:
    """Channel means that lie far apart."""
    return F.greatest(r, g, b) - F.least(r, g, b) > TUNNEL_SPREAD


def composite_manifest(views: DataFrame) -> DataFrame:
    """Composites that can be made: all four views (sample_id, view, bytes) must exist and be large enough."""
    return views.where(F.col("bytes") > TILE_BYTES).groupBy("sample_id").agg(F.countDistinct("view").alias("n")).where("n = 4").select("sample_id", F.concat(F.lit("images/composites/"), "sample_id", F.lit("_stv.jpg")).alias("path"))


def arrow(bearing: Column, length: float = 80.0, centre: float = 256.0) -> Column:
    """End of an arrow in pixels (y grows downwards)."""
    a = F.radians(bearing)
    return F.struct((F.lit(centre) + length * F.sin(a)).alias("x"), (F.lit(centre) - length * F.cos(a)).alias("y"))


def fit_edge(width: Column, height: Column, most: int) -> Column:
    """Size after scaling the longer edge down to ``most``."""
    k = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return F.struct(F.floor(width * k).cast("int").alias("width"), F.floor(height * k).cast("int").alias("height"))


def random_points(cities: DataFrame, n: int, attempts: int = 20, seed: int = 42) -> DataFrame:
    """``n * attempts`` hashed points in each city's box (city, south, west, north, east); boxes without area give none."""
    u = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("_", F.lit(str(seed)), "city", F.col("attempt").cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rows = cities.where("north > south and east > west").withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(n * attempts))))
    return rows.select("city", "attempt", (F.col("south") + u("lat") * (F.col("north") - F.col("south"))).alias("lat"), (F.col("west") + u("lon") * (F.col("east") - F.col("west"))).alias("lon"))


def first_snapped(points: DataFrame, n: int) -> DataFrame:
    """The first ``n`` attempts of each city that snapped, numbered."""
    w = Window.partitionBy("city").orderBy("attempt")
    return points.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).withColumn("sample_id", F.concat_ws("_", "city", F.lpad(F.col("k").cast("string"), 4, "0")))


def half_epochs(steps: DataFrame, steps_per_epoch: int) -> DataFrame:
    """Steps (step) at which a half epoch ends, with its number."""
    half = F.floor(F.lit(2) * F.col("step") / steps_per_epoch)
    return steps.where(half > F.floor(F.lit(2) * (F.col("step") - 1) / steps_per_epoch)).withColumn("half", half.cast("int"))


def integrity(q: DataFrame, unseen: DataFrame, removed_topic: str = "water_proximity", views: int = 4) -> DataFrame:
    """Checks of a tagged set of questions (question_id, sample_id, city, topic, streetview_count, split): rule, violations."""
    pairs = [("train", "validation"), ("train", "benchmark"), ("validation", "benchmark")]
    u = unseen.select("city", F.lit(1).alias("u")).distinct()
    counted = {"unseen in train": (F.col("split") == "train") & (F.col("u") == 1), "views": F.coalesce("streetview_count", F.lit(0)) != views, "removed topic": F.col("topic") == removed_topic}
    # one pass by location, whose rows have met in the joins that tag them
    per = q.join(u, "city", "left").groupBy("sample_id").agg(*(F.bool_or(F.col("split") == s).alias(s) for s in ("train", "validation", "benchmark")), *(F.count_if(c).alias(k) for k, c in counted.items()))
    rest = per.agg(*(F.count_if(F.col(a) & F.col(b)).alias(f"overlap {a} {b}") for a, b in pairs), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in counted))
    ids = id_counts(q, "question_id").agg(F.coalesce(F.sum("surplus"), F.lit(0)).alias("duplicate ids"))
    long = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("violations")) for c in df.columns))).alias("r")).select("r.*")
    return reduce(DataFrame.unionByName, [long(rest), long(ids)])
