"""Queries of the spatial operators and location rules, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralens.functions import geo, text
from terralens.operators import boxes, records, rules, spatial
from terralens.plans import fixtures as X

METRES = 200.0
_U = "cast('0x' || substr(md5(concat_ws('_', '42', city, cast(attempt as string), '{k}')), 1, 8) as bigint) / 4294967296.0::double"
C = F.col
PAIRS = f"""l as ({X.LOCATIONS}), e as ({X.ELEMENTS}), p as (select sample_id, l.lat, l.lon, e.lat as rlat, e.lon as rlon, ord, cat, levels, kind from l join e
 on e.lat > l.lat - {METRES} / 111320.0 and e.lat < l.lat + {METRES} / 111320.0 and abs(e.lat - l.lat) < {METRES} / 111320.0 and abs(e.lon - l.lon) < {METRES} / (111320.0 * cos(radians(l.lat))))"""
HAV = """6371000.0 * 2 * atan2(sqrt({a}), sqrt(1 - ({a})))""".format(a="power(sin((radians(rlat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(rlat)) * power(sin(radians(rlon - lon) / 2), 2)")
BEAR = "(({x} % 360) + 360) % 360".format(x="degrees(atan2(sin(radians({b}lon - {a}lon)) * cos(radians({b}lat)), cos(radians({a}lat)) * sin(radians({b}lat)) - sin(radians({a}lat)) * cos(radians({b}lat)) * cos(radians({b}lon - {a}lon))))")


def _all(s, d, found):
    return X.locations(s, d).select("sample_id").join(found, "sample_id", "left")


def _found(s, d, cats, key, order=None):
    """Counts of a key's values among the elements of some categories, without a row for each pair."""
    return spatial.context_counts(X.locations(s, d), X.elements(s, d).where(C("cat").isin(cats)), key, order, METRES)


def _counts(s, d):
    n = _found(s, d, [0, 1, 4], C("cat").cast("string"))
    n = n.groupBy("sample_id").agg(*(F.coalesce(F.sum(F.when(C("key") == k, C("n"))), F.lit(0)).alias(name) for k, name in (("0", "buildings"), ("1", "amenities"), ("4", "roads"))))
    return _all(s, d, n).fillna(0)


def _median(s, d):
    n = _found(s, d, [0], C("levels").cast("string")).select("sample_id", C("key").cast("int").alias("v"), "n")
    n = n.groupBy("sample_id").agg(spatial.upper_median_of_counts(F.collect_list(F.struct("v", "n"))).cast("int").alias("median_levels"))
    return _all(s, d, n)


def _dominant(s, d):
    n = _found(s, d, [2], C("kind"), C("ord"))
    best = n.groupBy("sample_id").agg(F.max(F.struct("n", (-C("o")).alias("o"), C("key").alias("v"))).alias("m"))
    return _all(s, d, best.select("sample_id", C("m.v").alias("landuse"), C("m.n").alias("n")))


def _amenity_types(s, d):
    n = _found(s, d, [1], C("kind")).groupBy("sample_id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, 10).alias("t"))
    return _all(s, d, n).select("sample_id", F.coalesce(F.array_join("t", ","), F.lit("")).alias("amenity_types"))


def _flags(s, d):
    n = _found(s, d, [3, 5], C("cat").cast("string")).groupBy("sample_id").agg(F.bool_or(C("key") == "3").alias("has_park"), F.bool_or(C("key") == "5").alias("has_signal"))
    return _all(s, d, n).select("sample_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("has_park", "has_signal")))


def _water(s, d):
    found = spatial.nearest_m(X.locations(s, d), X.elements(s, d).where("cat = 6"), METRES)
    return _all(s, d, found.select("sample_id", F.round("m", 1).alias("water_m")))


def _transit(s, d):
    return boxes.thinned_counts(X.locations(s, d), X.elements(s, d).where("cat = 7"), 0.003, 300.0, 0.0002).withColumnRenamed("n", "stops")


CATEGORIES = ["building", "amenity", "landuse", "park", "road", "signal", "water", "transit"]


def _surroundings(s, d):
    """All contexts of each sample, and its land use and junction, from one pass."""
    e = X.numbered_elements(s, d).where("cat < 7").select("ord", "lat", "lon", F.expr(X.pick("cat", CATEGORIES)).alias("category"), F.expr("case when cat = 4 then surface else kind end").alias("value"), F.expr("case when cat = 0 then levels end").alias("levels"), "roundabout", "bridge")
    return spatial.contexts(X.locations(s, d), e, METRES)


def _context(s, d):
    x = _surroundings(s, d)
    top = F.try_element_at(F.map_keys("building_types"), F.lit(1))
    res = F.exists(F.map_keys("building_types"), lambda t: t.isin(rules.RESIDENTIAL_TYPES))
    use = rules.land_use(C("landuse"), top, F.coalesce(res, F.lit(False)), C("amenity_types"), C("has_park"), C("buildings"), C("amenities"))
    types = F.array_join(F.transform(F.map_entries("building_types"), lambda t: F.concat_ws(":", t["key"], t["value"].cast("string"))), ",")
    return x.select("sample_id", "buildings", C("median_levels").cast("int").alias("median_levels"), types.alias("types"), "amenities", F.array_join("amenity_types", ",").alias("amenity_types"), "landuse", "has_park", "surface", "roads", "water_m",
                    use.alias("land_use"), rules.junction(C("roads"), C("has_roundabout"), C("has_signal"), C("has_bridge")).alias("junction"))


def _snapped(s, d):
    box = F.struct(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    n = s.read.parquet(f"{d}/nation.parquet").select(C("n_nationkey"), C("n_name").alias("city"))
    roads = X.roads(s, d)
    cities = roads.groupBy((C("way") % 25).alias("n_nationkey")).agg(box.alias("b")).join(n, "n_nationkey").select("city", "b.*")
    return records.snapped_points(cities, roads, 5, 4).select("sample_id", "attempt", "way", "pos")


def _bearings(s, d):
    return spatial.road_bearings(X.roads(s, d)).select("way", "pos", F.round("bearing", 6).alias("bearing"))


def _snap(s, d):
    return spatial.snap_to_road(X.locations(s, d), X.roads(s, d)).select("sample_id", "way", "pos", F.round(C("d") * 1e9, 3).alias("d"))


# every raw use and building type that a rule names, and some that none does
_USES = X.pick("c_custkey % 13", ["recreation_ground", "grass", "forest", "meadow", "industrial", "railway", "retail", "commercial", "residential", "cemetery", None, None, None])
_TYPES = X.pick("cast(floor(c_custkey / 13) as int) % 27", ["apartments", "house", "detached", "terrace", "residential", "semidetached_house", "church", "school", "hospital", "university", "public", "civic", "government", "commercial", "office", "retail", "supermarket",
                                                     "industrial", "warehouse", "manufacture", "shed", None, None, None, None, None, None])
_PLACE = f"select sample_id, c_custkey, {_USES} as raw, {_TYPES} as top, (c_custkey * 7 + 1) % 30 as b, c_custkey * 29 % 40 as a, c_custkey % 3 = 0 as park, c_custkey % 2 = 0 as res, c_custkey % 5 in (0, 2) as lively"


def _land_use(s, d):
    x = X.samples(s, d).selectExpr(*_select(_PLACE))
    types = F.expr("case c_custkey % 5 when 0 then array('cafe', 'bar') when 1 then array('cafe', 'school') when 2 then array('school', 'bank', 'shop') else array() end")
    return x.select("sample_id", rules.land_use(C("raw"), C("top"), C("res"), types, C("park"), C("b"), C("a")).alias("land_use"))


def _select(sql: str) -> list[str]:
    """The expressions of a select list; commas in brackets don't part them."""
    out, depth, last = [], 0, 0
    text = sql.removeprefix("select ")
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[last:k])
            last = k + 1
    return [*out, text[last:]]


def _junction(s, d):
    k = C("c_custkey")
    return X.samples(s, d).select("sample_id", rules.junction(k % 4, k % 5 == 0, k % 3 == 0, k % 7 == 0).alias("junction"))


_P = "(c_custkey * 7919 % 18000 - 9000) / cast(100 as double)", "(c_custkey * 104729 % 36000 - 18000) / cast(100 as double)"


def _source(s, d):
    x = X.samples(s, d).select("sample_id", F.expr(_P[0]).alias("lat"), F.expr(_P[1]).alias("lon"))
    src = rules.satellite_source(C("lat"), C("lon"))
    return x.select("sample_id", src.alias("source"), rules.buffer_m(src).alias("buffer_m"))


def _quadrants(s, d):
    lat, lon, b = C("lat"), C("lon"), C("c_custkey") * 73 % 720 - 360.0
    h = geo.headings(b)
    return X.locations(s, d).select("sample_id", geo.point_quadrant(lat, lon, F.lit(46.01), F.lit(16.01)).alias("quadrant"), geo.bearing_quadrant(b).alias("facing"), *(h[k].alias(k) for k in ("along_fwd", "along_bwd", "cross_left", "cross_right")))


def _tiles(s, d):
    t = geo.tile_bbox(C("lat"), C("lon"), 250.0)
    return X.locations(s, d).select("sample_id", *(F.round(t[k], 6).alias(k) for k in ("south", "west", "north", "east")))


def _parse(s, d):
    t = F.expr("case c_custkey % 9 when 0 then '3' when 1 then '3.7' when 2 then '3;4' when 3 then '' when 4 then 'nan' when 5 then 'inf' when 6 then '3d' when 7 then '-2' else ' 3 ' end")
    return X.samples(s, d).select("sample_id", text.parse_int(t).alias("levels"), text.safe_int(t).alias("safe"), text.city_key(C("sample_id")).alias("city_key"),
                                  text.sid_from_path(F.concat(F.lit("images/sv/"), C("sample_id"), F.expr("case c_custkey % 3 when 0 then '_along_fwd' when 1 then '_cross_left' else '' end"), F.lit(".jpg"))).alias("sid"))


QUERIES = {"context_counts": _counts, "context_median_levels": _median, "context_dominant": _dominant, "context_amenity_types": _amenity_types, "context_flags": _flags, "context_water": _water, "context_transit": _transit, "sample_context": _context, "snapped_points": _snapped,
           "road_bearing": _bearings, "snap_to_road": _snap, "land_use": _land_use, "junction_type": _junction, "sat_source": _source, "quadrants_headings": _quadrants, "tile_bbox": _tiles, "parse_ids": _parse}
S = f"s as ({X.SAMPLES})"
ORACLE = {
    "context_counts": f"with {PAIRS} select l.sample_id, count(*) filter (where cat = 0) as buildings, count(*) filter (where cat = 1) as amenities, count(*) filter (where cat = 4) as roads from l left join p using (sample_id) group by 1",
    "context_median_levels": f"with {PAIRS}, v as (select sample_id, list_sort(list(levels)) as x from p where cat = 0 and levels is not null group by 1) select l.sample_id, x[len(x) // 2 + 1] as median_levels from l left join v using (sample_id)",
    "context_dominant": f"with {PAIRS}, n as (select sample_id, kind, count(*) as n, min(ord) as o from p where cat = 2 and kind is not null group by 1, 2), r as (select *, row_number() over (partition by sample_id order by n desc, o) as rk from n) select l.sample_id, kind as landuse, n from l left join (select * from r where rk = 1) using (sample_id)",
    "context_amenity_types": f"with {PAIRS}, n as (select sample_id, array_to_string(list_sort(list(distinct kind))[1:10], ',') as t from p where cat = 1 and kind is not null group by 1) select l.sample_id, coalesce(t, '') as amenity_types from l left join n using (sample_id)",
    "context_flags": f"with {PAIRS} select l.sample_id, coalesce(bool_or(cat = 3), false) as has_park, coalesce(bool_or(cat = 5), false) as has_signal from l left join p using (sample_id) group by 1",
    "context_water": f"with {PAIRS}, n as (select sample_id, round(min({HAV}), 1) as water_m from p where cat = 6 group by 1) select l.sample_id, water_m from l left join n using (sample_id)",
    "context_transit": f"""with l as ({X.LOCATIONS}), e as (select * from ({X.ELEMENTS}) where cat = 7),
p as (select sample_id, l.lat, l.lon, e.lat as rlat, e.lon as rlon, ord from l join e on e.lat > l.lat - 0.003 and e.lat < l.lat + 0.003 and abs(e.lat - l.lat) < 0.003 and abs(e.lon - l.lon) < 0.003),
n as (select sample_id, list({{'lat': rlat, 'lon': rlon}} order by ord, rlat, rlon) as v from p where {HAV} <= 300 group by 1),
k as (select sample_id, len(list_reduce(v, lambda acc, x: case when len(list_filter(acc, lambda y: abs(y.lat - x[1].lat) < 0.0002 and abs(y.lon - x[1].lon) < 0.0002)) > 0 then acc else list_concat(acc, x) end, [])) as c from (select sample_id, [[x] for x in v] as v from n))
select l.sample_id, cast(coalesce(c, 0) as bigint) as stops from l left join k using (sample_id)""",
    "sample_context": f"""with l as ({X.LOCATIONS}), e as ({X.ELEMENTS}), p as (select sample_id, l.lat, l.lon, e.lat as rlat, e.lon as rlon, ord, cat, levels, kind, surface, roundabout, bridge from l join e
 on e.lat > l.lat - {METRES} / 111320.0 and e.lat < l.lat + {METRES} / 111320.0 and abs(e.lat - l.lat) < {METRES} / 111320.0 and abs(e.lon - l.lon) < {METRES} / (111320.0 * cos(radians(l.lat))) where cat < 7),
t as (select sample_id, cat, v, count(*) as n, row_number() over (partition by sample_id, cat order by count(*) desc, min(ord)) as r from (select sample_id, cat, ord, case when cat = 4 then surface else kind end as v from p) where coalesce(v, '') <> '' group by 1, 2, 3),
bt as (select sample_id, string_agg(concat(v, ':', cast(n as varchar)), ',' order by r) as types, max(case when r = 1 then v end) as top, bool_or(v = 'residential') as res from t where cat = 0 and r <= 5 group by 1),
am as (select sample_id, array_to_string(list_sort(list(v))[1:10], ',') as amenity_types from t where cat = 1 group by 1), lu as (select sample_id, v as landuse from t where cat = 2 and r = 1), su as (select sample_id, v as surface from t where cat = 4 and r = 1),
ml as (select sample_id, list_sort(list(levels)) as x from p where cat = 0 and levels is not null group by 1),
g as (select sample_id, count(*) filter (where cat = 0) as b, count(*) filter (where cat = 1) as a, count(*) filter (where cat = 4) as roads, coalesce(bool_or(cat = 3), false) as park, coalesce(bool_or(cat = 4 and roundabout), false) as ra, coalesce(bool_or(cat = 4 and bridge), false) as br,
 coalesce(bool_or(cat = 5), false) as sig, round(min(case when cat = 6 then {HAV} end), 1) as water_m from p group by 1),
x as (select l.sample_id, coalesce(b, 0) as b, coalesce(a, 0) as a, coalesce(roads, 0) as roads, coalesce(park, false) as park, coalesce(ra, false) as ra, coalesce(br, false) as br, coalesce(sig, false) as sig, water_m, coalesce(types, '') as types, top, coalesce(res, false) as res, coalesce(amenity_types, '') as amenity_types, landuse, surface, ml.x[len(ml.x) // 2 + 1] as med
 from l left join g using (sample_id) left join bt using (sample_id) left join am using (sample_id) left join lu using (sample_id) left join su using (sample_id) left join ml using (sample_id))
select sample_id, b as buildings, med as median_levels, types, a as amenities, amenity_types, landuse, park as has_park, surface, roads, water_m,
 case when landuse = 'grass' and b < 15 then 'open_space' when park and b < 10 then 'open_space' when landuse = 'industrial' then 'industrial' when landuse = 'retail' then 'commercial' when landuse = 'residential' then 'residential' when top = 'retail' then 'commercial' when top = 'industrial' then 'industrial' when top = 'residential' then 'residential'
 when a >= 10 and b > 0 and a / cast(b as double) > 0.3 then case when res then 'mixed' else 'commercial' end when b > 0 then 'residential' else 'mixed' end as land_use,
 case when roads < 2 then null when ra then 'roundabout' when sig then 'signalized' when br then 'grade_separated' else 'unsignalized' end as junction from x""",
    "snapped_points": f"""with r as ({X.ROADS}), c as (select n_name as city, min(lat) as south, max(lat) as north, min(lon) as west, max(lon) as east from r join nation on n_nationkey = way % 25 group by 1),
p as (select city, attempt, south + {_U.format(k='lat')} * (north - south) as lat, west + {_U.format(k='lon')} * (east - west) as lon from (select *, unnest(range(1, 21)) as attempt from c)),
n as (select city, attempt, way, pos, row_number() over (partition by city, attempt order by (r.lat - p.lat) * (r.lat - p.lat) + (r.lon - p.lon) * (r.lon - p.lon), way, pos) as k from p join r on r.lat between p.lat - 0.002 and p.lat + 0.002 and abs(r.lat - p.lat) <= 0.002 and abs(r.lon - p.lon) <= 0.002),
o as (select *, row_number() over (partition by city order by attempt) as i from n where k = 1) select concat_ws('_', city, lpad(cast(i as varchar), 4, '0')) as sample_id, attempt, way, pos from o where i <= 5""",
    "road_bearing": f"with r as ({X.ROADS}), b as (select way, pos, lat, lon, lead(lat) over w as nlat, lead(lon) over w as nlon, lag(lat) over w as plat, lag(lon) over w as plon from r window w as (partition by way order by pos)) select way, pos, round(coalesce({BEAR.format(a='', b='n')}, {BEAR.format(a='p', b='').replace('radians(lon - plon)', 'radians(lon - plon)')}), 6) as bearing from b where nlat is not null or plat is not null",
    "snap_to_road": f"with l as ({X.LOCATIONS}), r as ({X.ROADS}), p as (select sample_id, way, pos, (r.lat - l.lat) * (r.lat - l.lat) + (r.lon - l.lon) * (r.lon - l.lon) as d from l join r on r.lat >= l.lat - 0.0021 and r.lat <= l.lat + 0.0021 and abs(r.lat - l.lat) <= 0.002 and abs(r.lon - l.lon) <= 0.002) select sample_id, way, pos, round(d * 1e9, 3) as d from (select *, row_number() over (partition by sample_id order by d, way, pos) as k from p) where k = 1",
    "land_use": f"""with {S}, x as ({_PLACE} from s)
select sample_id, case when raw = 'recreation_ground' then 'open_space' when raw in ('grass', 'forest', 'meadow') and b < 15 then 'open_space' when park and b < 10 then 'open_space' when raw in ('industrial', 'railway') then 'industrial' when raw in ('retail', 'commercial') then 'commercial' when raw = 'residential' then 'residential'
 when top in ('commercial', 'office', 'retail', 'supermarket') then 'commercial' when top in ('industrial', 'warehouse', 'manufacture') then 'industrial' when top in ('apartments', 'house', 'detached', 'terrace', 'residential', 'semidetached_house') then 'residential'
 when top in ('church', 'school', 'hospital', 'university', 'public', 'civic', 'government') then 'institutional' when lively and res then 'mixed' when a >= 10 and b > 0 and a / cast(b as double) > 0.3 and res then 'mixed' when a >= 10 and b > 0 and a / cast(b as double) > 0.3 then 'commercial'
 when b > 0 then 'residential' else 'mixed' end as land_use from x""",
    "junction_type": f"with {S} select sample_id, case when c_custkey % 4 < 2 then null when c_custkey % 5 = 0 then 'roundabout' when c_custkey % 3 = 0 then 'signalized' when c_custkey % 7 = 0 then 'grade_separated' else 'unsignalized' end as junction from s",
    "sat_source": f"""with {S}, x as (select sample_id, {_P[0]} as lat, {_P[1]} as lon from s), y as (select sample_id, case when lon between -125 and -66 and lat between 24 and 50 or lon between -180 and -130 and lat between 51 and 72 or lon between -161 and -154.5 and lat between 18.5 and 22.5 then 'NAIP'
 when lon between -5.5 and 10 and lat between 41 and 51.5 then 'IGN' else 'ESRI' end as source from x) select sample_id, source, case source when 'NAIP' then 250 else 100 end as buffer_m from y""",
    "quadrants_headings": f"""with l as ({X.LOCATIONS}), x as (select *, c_custkey * 73 % 720 - cast(360 as double) as b from l) select sample_id, concat(case when lat >= 46.01 then 'Top-' else 'Bottom-' end, case when lon <= 16.01 then 'Left' else 'Right' end) as quadrant,
 case when (b + 360) % 360 < 90 then 'Top-Right' when (b + 360) % 360 < 180 then 'Bottom-Right' when (b + 360) % 360 < 270 then 'Bottom-Left' else 'Top-Left' end as facing, (b + 720) % 360 as along_fwd, (b + 900) % 360 as along_bwd, (b + 810) % 360 as cross_left, (b + 630) % 360 as cross_right from x""",
    "tile_bbox": f"with l as ({X.LOCATIONS}) select sample_id, round(lat - 250 / 111320.0::double, 6) as south, round(lon - 250 / (111320.0::double * cos(radians(lat))), 6) as west, round(lat + 250 / 111320.0::double, 6) as north, round(lon + 250 / (111320.0::double * cos(radians(lat))), 6) as east from l",
    "parse_ids": f"""with {S}, x as (select sample_id, case c_custkey % 9 when 0 then 3 when 1 then 3 when 7 then -2 when 8 then 3 end as levels from s) select sample_id, levels, case when levels >= 0 then levels end as safe, regexp_extract(sample_id, '^(.*)_[0-9]+$', 1) as city_key, sample_id as sid from x""",
}
