"""Range joins of points through a grid, and what is derived from them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralens.functions import geo


#: Metres from a sample to each side of its surroundings.
BUFFER_M = 200.0
#: A grid cell with more right-hand rows than this is split.
DENSE = 20_000
#: How often a dense cell is quartered; what is still dense then is dealt by a hash.
LEVELS = 5
_CELL = ["_y", "_x", "_level", "_v", "_u"]


def _width(y: Column, height: float, reach_lon: Callable[[Column], Column]) -> Column:
    """Cell width of a row of the grid: the reach at the farthest latitude whose points look into the row."""
    far = F.least(F.greatest(F.abs(y - 1), F.abs(y + 2)) * height, F.lit(89.999999))
    return F.least(reach_lon(far), F.lit(360.0))


def _leaves(points: DataFrame, dense: int) -> tuple[DataFrame, DataFrame]:
    """(dense cells, their leaves) of a quadtree for each cell of more than ``dense`` points: _parts is into how many parts a leaf's points must be dealt.

    points: _y, _x and (_dv, _du), the place within the cell at the deepest level. Only counts are shuffled, and cells below the limit are counted once.
    """
    c = F.col
    hot = points.groupBy("_y", "_x").agg(F.count("*").alias("n")).where(c("n") > dense).select("_y", "_x")
    deep = points.join(hot, ["_y", "_x"], "left_semi").groupBy("_y", "_x", "_dv", "_du").agg(F.count("*").alias("n"))
    up = F.explode(F.transform(F.sequence(F.lit(1), F.lit(LEVELS)), lambda k: F.struct(
        k.alias("_level"), F.floor(c("_dv") / F.pow(F.lit(2), LEVELS - k)).alias("_v"), F.floor(c("_du") / F.pow(F.lit(2), LEVELS - k)).alias("_u"))))
    nodes = deep.select("_y", "_x", up.alias("a"), "n").select("_y", "_x", "a.*", "n").groupBy(*_CELL).agg(F.sum("n").alias("n"))
    # a leaf holds few enough points, or is as deep as it goes, and all above it hold too many
    full = nodes.where((c("n") > dense) & (c("_level") < LEVELS)).select("_y", "_x", (c("_level") + 1).alias("_level"), "_v", "_u")
    below = full.select("_y", "_x", "_level", F.explode(F.expr("array(struct(2 * _v as v, 2 * _u as u), struct(2 * _v as v, 2 * _u + 1 as u), struct(2 * _v + 1 as v, 2 * _u as u), struct(2 * _v + 1 as v, 2 * _u + 1 as u))")).alias("a"))
    below = below.select("_y", "_x", "_level", c("a.v").alias("_v"), c("a.u").alias("_u"))
    reached = nodes.where("_level = 1").unionByName(nodes.join(below, _CELL, "left_semi"))
    return hot, reached.where((c("n") <= dense) | (c("_level") == LEVELS)).select(*_CELL, F.ceil(c("n") / dense).cast("int").alias("_parts"))


def _tiles(counted: DataFrame, dense: int) -> tuple[DataFrame, DataFrame] | None:
    """As ``_leaves`` for large cells, of which few are dense: both tables are on the driver (at most some leaves for each ``dense`` points), so no point is shuffled to meet them. None: no cell is dense.

    counted: _y, _x, _dv, _du, n (weight, by which cells are split) and m (weight of what is dealt by a hash where quartering is no help). Leaves without points are there too.
    """
    import pyarrow as pa

    c, spark = F.col, counted.sparkSession
    local = lambda rows, names: F.broadcast(spark.createDataFrame(pa.table({k: pa.array(v, t) for (k, t), v in zip(names.items(), zip(*rows, strict=True), strict=True)})))
    cells = counted.groupBy("_y", "_x").agg(F.sum("n").alias("n")).where(c("n") > dense).select("_y", "_x").collect()
    if not cells:
        return None
    hot = local(cells, {"_y": pa.int64(), "_x": pa.int64()})
    deep = counted.join(hot, ["_y", "_x"], "left_semi").groupBy("_y", "_x", "_dv", "_du").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    up = F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(
        k.alias("_level"), F.floor(c("_dv") / F.pow(F.lit(2), LEVELS - k)).alias("_v"), F.floor(c("_du") / F.pow(F.lit(2), LEVELS - k)).alias("_u"))))
    nodes = deep.select("_y", "_x", up.alias("a"), "n", "m").select("_y", "_x", "a.*", "n", "m").groupBy(*_CELL).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    full = nodes.where((c("n") > dense) & (c("_level") < LEVELS)).select("_y", "_x", (c("_level") + 1).alias("_level"), "_v", "_u")
    below = full.select("_y", "_x", "_level", F.explode(F.expr("array(struct(2 * _v as _v, 2 * _u as _u), struct(2 * _v as _v, 2 * _u + 1 as _u), struct(2 * _v + 1 as _v, 2 * _u as _u), struct(2 * _v + 1 as _v, 2 * _u + 1 as _u))")).alias("a")).select("_y", "_x", "_level", "a.*")
    leaves = below.join(nodes, _CELL, "left").where(c("n").isNull() | (c("n") <= dense) | (c("_level") == LEVELS))
    leaves = leaves.select(*_CELL, F.greatest(F.lit(1), F.ceil(F.coalesce("m", F.lit(0)) / dense)).cast("int").alias("_parts"))
    return hot, local(leaves.collect(), {"_y": pa.int64(), "_x": pa.int64(), "_level": pa.int32(), "_v": pa.int64(), "_u": pa.int64(), "_parts": pa.int32()})


def range_join(left: DataFrame, right: DataFrame, reach_lat: float, reach_lon: Callable[[Column], Column], dense: int | None = DENSE) -> DataFrame:
    """Pairs that may lie within a box around the left point: an equi-join on cells of a grid, for which the caller applies the exact predicate.

    ``reach_lat``: half the box's height in degrees. ``reach_lon``: half its width for a latitude, which may grow towards the poles. Rows of the grid are as
    high as the reach, and in each row cells are as wide as the reach is there, so a left point looks into 3 by 3 cells at any latitude (rows of cells near a pole are
    one cell). A cell of more than ``dense`` right points becomes a quadtree of its counts, whose leaves take as many points at most; a left
    point looks into the leaves that its box touches. Points that no quartering tells apart are dealt by a hash. So no key has more right points, and a city
    in one cell is many tasks. Cells are counted when the join is planned; ``dense`` None: no counting, for right sides that are known to be thin. Longitudes don't wrap. Points with a null coordinate have no pairs.

    Both sides have lat and lon; the right ones come as rlat and rlon. The left side, whose rows are repeated, should be the smaller.
    """
    l, r, cell = dealt(left, right, reach_lat, reach_lon, dense)
    return l.join(r, cell).drop(*cell)


def dealt(left: DataFrame, right: DataFrame, reach_lat: float, reach_lon: Callable[[Column], Column], dense: int | None, box_lat: float | None = None, box_lon: Callable[[Column], Column] | None = None, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of ``range_join`` with the columns of their cell, and the names of these. Cells may be larger than the box around a left point, whose reaches are ``box_lat`` and ``box_lon`` then.

    ``counted``: points (lat, lon, and the n and m of ``_tiles``) whose weights split large cells; else the right points' numbers do.
    """
    c = F.col
    height = reach_lat * (1 + 1e-9)
    box = (box_lat or reach_lat) * (1 + 1e-9)
    side = float(1 << LEVELS)
    r = right.withColumnsRenamed({"lat": "rlat", "lon": "rlon"}).where("rlat is not null and rlon is not null")
    r = r.withColumn("_y", F.floor(c("rlat") / height)).withColumn("_w", _width(c("_y"), height, reach_lon)).withColumn("_x", F.floor(c("rlon") / c("_w")))
    dx = (box_lon or reach_lon)(c("lat")) * (1 + 1e-9) + 1e-12
    west, east = F.greatest(c("lon") - c("_dx"), F.lit(-540.0)), F.least(c("lon") + c("_dx"), F.lit(540.0))
    # a function of lambdas parts the generated code, which in one piece with the caller's is too long for Java to compile it
    rows = F.transform(F.sequence(F.floor((c("lat") - box) / height), F.floor((c("lat") + box) / height)), lambda y: y)
    l = left.where("lat is not null and lon is not null").withColumn("_y", F.explode(rows)).withColumn("_w", _width(c("_y"), height, reach_lon)).withColumn("_dx", dx).withColumn("_west", west).withColumn("_east", east).drop("_dx")
    l = l.where("_west <= _east").withColumn("_x", F.explode(F.sequence(F.floor(c("_west") / c("_w")), F.floor(c("_east") / c("_w")))))
    if dense is None:
        return l.drop("_w", "_west", "_east"), r.drop("_w"), ["_y", "_x"]
    inner = lambda at, cell, size: F.least(F.greatest(F.floor((at / size - cell) * side), F.lit(0)), F.lit(int(side) - 1))
    r = r.withColumns({"_dv": inner(c("rlat"), c("_y"), height), "_du": inner(c("rlon"), c("_x"), c("_w"))})
    if counted is None:
        hot, leaves = _leaves(r.select("_y", "_x", "_dv", "_du"), dense)
        split = not hot.isEmpty()
    else:
        n = counted.where("lat is not null and lon is not null").withColumn("_y", F.floor(c("lat") / height)).withColumn("_w", _width(c("_y"), height, reach_lon)).withColumn("_x", F.floor(c("lon") / c("_w")))
        found = _tiles(n.select("_y", "_x", inner(c("lat"), c("_y"), height).alias("_dv"), inner(c("lon"), c("_x"), c("_w")).alias("_du"), "n", "m"), dense)
        split = found is not None
        hot, leaves = found or (None, None)
    if not split:
        return l.drop("_w", "_west", "_east"), r.drop("_w", "_dv", "_du"), ["_y", "_x"]
    # right points: their cell, or each node above them in a dense one, of which one is a leaf
    flag = hot.withColumn("_hot", F.lit(True))
    none = F.array(F.struct(F.lit(0).alias("_level"), F.lit(0).cast("long").alias("_v"), F.lit(0).cast("long").alias("_u")))
    node = lambda k: F.struct(k.alias("_level"), F.floor(c("_dv") / F.pow(F.lit(2), LEVELS - k)).alias("_v"), F.floor(c("_du") / F.pow(F.lit(2), LEVELS - k)).alias("_u"))
    ways = F.explode(F.when(c("_hot"), F.transform(F.sequence(F.lit(1), F.lit(LEVELS)), node)).otherwise(none))
    mix = F.xxhash64(*(c(f"`{x}`") for x in right.withColumnsRenamed({"lat": "rlat", "lon": "rlon"}).columns))
    r = r.join(flag, ["_y", "_x"], "left").withColumn("_a", ways).select("*", "_a.*").drop("_a").join(leaves, _CELL, "left").where("_level = 0 or _parts is not null")
    r = r.withColumn("_part", F.coalesce(F.pmod(mix, c("_parts").cast("long")), F.lit(0))).drop("_w", "_dv", "_du", "_hot", "_parts")
    # left points: the leaves that their box touches
    scale = F.pow(F.lit(2.0), F.coalesce("_level", F.lit(0)))
    south, north = (c("lat") - box) / height, (c("lat") + box) / height
    touches = (c("_y") + (c("_v") + 1) / scale >= south - 1e-6) & (c("_y") + c("_v") / scale <= north + 1e-6) & ((c("_x") + (c("_u") + 1) / scale) >= c("_west") / c("_w") - 1e-6) & ((c("_x") + c("_u") / scale) <= c("_east") / c("_w") + 1e-6)
    l = l.join(leaves, ["_y", "_x"], "left").where(c("_level").isNull() | touches)
    l = l.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(c("_parts").cast("long"), F.lit(1).cast("long")) - 1))).fillna(0, ["_level", "_v", "_u"]).drop("_w", "_west", "_east", "_parts")
    return l, r, [*_CELL, "_part"]


def fixed(degrees: float) -> Callable[[Column], Column]:
    """A longitude reach that is the same at all latitudes."""
    return lambda lat: F.lit(degrees)


def road_bearings(nodes: DataFrame) -> DataFrame:
    """way, pos, lat, lon with the bearing to the next vertex; the last takes it from the one before, single vertices vanish."""
    w = Window.partitionBy("way").orderBy("pos")
    c = F.col
    ahead = geo.bearing(c("lat"), c("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    behind = geo.bearing(F.lag("lat").over(w), F.lag("lon").over(w), c("lat"), c("lon"))
    return nodes.withColumn("bearing", F.coalesce(ahead, behind)).where("bearing is not null")


def snap_to_road(samples: DataFrame, nodes: DataFrame, radius: float = 0.002, dense: int | None = DENSE) -> DataFrame:
    """Nearest road vertex within a box (planar squared degrees; first way and vertex on a tie). Samples without one vanish."""
    from terralens.operators import boxes

    c = F.col
    reach = math.nextafter(radius, math.inf)  # the edge of the box belongs to it
    found = boxes.nearest(samples, nodes.select("lat", "lon", c("way").alias("a"), c("pos").alias("b")), reach, fixed(reach), dense=dense or boxes.DENSE)
    kind = dict(nodes.dtypes)
    best = found.groupBy("sample_id").agg(F.min(F.struct("d", "a", "b")).alias("m"))
    return best.select("sample_id", c("m.a").cast(kind["way"]).alias("way"), c("m.b").cast(kind["pos"]).alias("pos"), "m.d")


def context_pairs(samples: DataFrame, elements: DataFrame, metres: float = BUFFER_M, dense: int | None = DENSE) -> DataFrame:
    """Elements strictly inside each sample's buffer box, at any latitude."""
    c = F.col
    pairs = range_join(samples.select("sample_id", "lat", "lon"), elements, metres / geo.DEGREE_M, lambda lat: geo.lon_degrees(metres, lat), dense)
    return pairs.where((F.abs(c("rlat") - c("lat")) < geo.lat_degrees(metres)) & (F.abs(c("rlon") - c("lon")) < geo.lon_degrees(metres, c("lat"))))


def context_counts(samples: DataFrame, elements: DataFrame, key: Column, order: Column | None = None, metres: float = BUFFER_M, dense: int | None = None) -> DataFrame:
    """(sample_id, key, n, o): how many elements of each key (a string, or an array of strings) are strictly inside each sample's buffer box, and their smallest ``order``. No pair is formed."""
    from terralens.operators import boxes

    keyed = elements.select(key.alias("key"), (F.lit(None).cast("long") if order is None else order).alias("ord"), "lat", "lon")
    return boxes.box_counts(samples, keyed, metres / geo.DEGREE_M, lambda lat: geo.lon_degrees(metres, lat), dense or boxes.DENSE)


def nearest_m(samples: DataFrame, elements: DataFrame, metres: float = BUFFER_M, dense: int | None = None) -> DataFrame:
    """(sample_id, m): metres to the nearest element strictly inside each sample's buffer box; samples without one vanish."""
    from terralens.operators import boxes

    c = F.col
    points = elements.select("lat", "lon", F.lit(0).alias("a"), F.lit(0).alias("b"))
    found = boxes.nearest(samples, points, metres / geo.DEGREE_M, lambda lat: geo.lon_degrees(metres, lat), True, dense or boxes.DENSE)
    return found.groupBy("sample_id").agg(F.min(geo.haversine_m(c("lat"), c("lon"), c("rlat"), c("rlon"))).alias("m"))


def first_mode(df: DataFrame, group: str, value: str, order: str, name: str) -> DataFrame:
    """Most frequent value of each group; of equals the one seen first."""
    n = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    return n.groupBy(group).agg(F.max(F.struct("n", (-F.col("o")).alias("o"), F.col(value).alias("v"))).alias("m")).select(group, F.col("m.v").alias(name), F.col("m.n").alias("n"))


def value_at(pairs: Column, position: Column) -> Column:
    """The value at a place (from 0) of a sorted list that is given as an array of (v, n), sorted by v, n being how often v occurs."""
    walk = F.aggregate(pairs, F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("v")), lambda a, x: F.struct(
        (a["seen"] + x["n"]).alias("seen"), F.when((position >= a["seen"]) & (position < a["seen"] + x["n"]), x["v"].cast("double")).otherwise(a["v"]).alias("v")))
    return walk["v"]


def upper_median_of_counts(pairs: Column) -> Column:
    """Element n//2 of the sorted values, given as (v, n) pairs: as many as there are different values."""
    total = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return value_at(F.array_sort(pairs), F.floor(total / 2))


def contexts(samples: DataFrame, elements: DataFrame, metres: float = BUFFER_M, top: int = 5, dense: int | None = None) -> DataFrame:
    """What surrounds each sample, counted in its box without a row for each pair.

    elements: ord, lat, lon, category (building, amenity, landuse, park, road, signal or water), value (type of a building, amenity or land use;
    surface of a road), levels, roundabout and bridge (bridge or tunnel).
    Elements are dealt once, to each cell that they can be seen from, and what a cell gives for a sample is the whole. sample_id is a key. Returns
    buildings, median_levels (upper), building_types (map of the ``top`` most frequent), amenities, amenity_types (up to ten), landuse (most frequent),
    has_park, surface (most frequent, empty ones don't count), roads, has_roundabout, has_bridge, has_signal, water_m.
    """
    from terralens.operators import boxes

    c = F.col
    found = boxes.surroundings(samples, elements, metres / geo.DEGREE_M, lambda lat: geo.lon_degrees(metres, lat), top, dense or boxes.WHOLE)
    water = F.when(c("water_lat").isNotNull(), F.round(geo.haversine_m(c("lat"), c("lon"), c("water_lat"), c("water_lon")), 1))
    return found.select(
        "sample_id", "buildings", "median_levels", F.map_from_entries("building_types").alias("building_types"), "amenities", "amenity_types", "landuse", (c("parks") > 0).alias("has_park"), "surface", "roads",
        (c("roundabouts") > 0).alias("has_roundabout"), (c("bridges") > 0).alias("has_bridge"), (c("signals") > 0).alias("has_signal"), water.alias("water_m"))


def spread_stops(stops: Column, gap: float = 0.0002) -> Column:
    """Greedy thinning of an array of (ord, lat, lon): a stop stays if no kept one is within ``gap`` in both axes."""
    def add(kept: Column, s: Column) -> Column:
        close = F.exists(kept, lambda k: (F.abs(k["lat"] - s["lat"]) < gap) & (F.abs(k["lon"] - s["lon"]) < gap))
        return F.when(close, kept).otherwise(F.concat(kept, F.array(s)))
    return F.aggregate(F.array_sort(stops), F.slice(stops, 1, 0), add)


def thinned(stops: DataFrame, gap: float = 0.0002) -> DataFrame:
    """``spread_stops`` for rows of key columns and ``stops``, an array of (ord, lat, lon): the kept ones, in linear time.

    Kept stops are held by cells a little wider than the gap, and a stop is compared with those of nine cells. No two of a cell's kept stops are much closer than the gap, so a cell has few.
    A null or empty array keeps nothing; stops with a null in them keep out of it.
    """
    kept_type = "array<struct<ord: bigint, lat: double, lon: double>>"
    keys = [c for c in stops.columns if c != "stops"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in stops.schema.fields if f.name != "stops"] + [f"stops {kept_type}"])

    def run(batches):
        import pyarrow as pa

        at = pa.list_(pa.struct([("ord", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([_kept(x or [], gap) for x in b.column(len(keys)).to_pylist()], at)], names=[*keys, "stops"])
    ready = F.transform(F.filter(F.array_sort("stops"), lambda s: s["ord"].isNotNull() & s["lat"].isNotNull() & s["lon"].isNotNull()), lambda s: F.struct(s["ord"].cast("long").alias("ord"), s["lat"].cast("double").alias("lat"), s["lon"].cast("double").alias("lon")))
    return stops.select(*keys, ready.alias("stops")).mapInArrow(run, schema)


def _kept(stops: list[dict], gap: float) -> list[dict]:
    width = gap * 1.001  # quotients are rounded
    cells: dict[tuple[int, int], list[dict]] = {}
    out = []
    for s in stops:
        y, x = int(s["lat"] // width), int(s["lon"] // width)
        near = (k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in cells.get((y + i, x + j), ()))
        if not any(abs(k["lat"] - s["lat"]) < gap and abs(k["lon"] - s["lon"]) < gap for k in near):
            cells.setdefault((y, x), []).append(s)
            out.append(s)
    return out
