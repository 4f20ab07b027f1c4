"""Queries of collection, source choice and integrity, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralens.operators import flatten, pixels, quantiles, split
from terralens.operators import records as R
from terralens.plans import fixtures as X
from terralens.plans.splits import FLAT, SEEN
from terralens.sources import pictures, web

C = F.col
S, L = f"s as ({X.SAMPLES})", f"l as ({X.LOCATIONS})"
SRC = X.pick("c_custkey % 5", ["NAIP", "IGN", "ESRI", "S2", None])


def _sources(s, d):
    return X.samples(s, d).select("sample_id", "c_custkey", F.expr(SRC).alias("source"))


def _tiles(s, d):
    each = F.explode(F.array(*(F.lit(x) for x in ("NAIP", "IGN", "ESRI", "S2")))).alias("tile_source")
    return X.samples(s, d).select("sample_id", "c_custkey", each).select("sample_id", "tile_source", ((C("c_custkey") * 7 + F.char_length("tile_source") * 13) % 11 * 1000).alias("bytes"))


def _views(s, d):
    each = F.posexplode(F.array(*(F.lit(x) for x in ("along_fwd", "along_bwd", "cross_left", "cross_right")))).alias("k", "view")
    return X.samples(s, d).select("sample_id", "c_custkey", each).select("sample_id", "view", ((C("c_custkey") + C("k") * 3) % 19 * 1000).alias("bytes"))


def _projections(s, d):
    k = C("c_custkey")
    census = R.census(F.lpad(k.cast("string"), 15, "0"), k % 7 - 1)
    size = R.fit_edge(k % 1500 + 1, k % 900 + 1, 768)
    end = R.arrow(C("bearing"))
    return X.samples(s, d).select("sample_id", R.modality(k % 3 != 0, k % 4).alias("modality"), R.geocode(F.when(k % 2 == 0, ""), F.when(k % 3 == 0, "").otherwise("d"), F.when(k % 5 != 0, "c")).alias("place"),
                                  census["tract"].alias("tract"), census["income"].alias("income"), R.is_tunnel(k % 200, k % 100, k % 150).alias("tunnel"), size["width"].alias("width"), size["height"].alias("height"), F.round(end["x"], 4).alias("x"), F.round(end["y"], 4).alias("y"))


def _drawn(s, d):
    """A small picture for each sample, by a rule of its key."""
    k, w = C("c_custkey"), C("c_custkey") % 4 + 5
    value = lambda i: (k * 7 + F.floor(i / 3) % w * 13 + F.floor(i / (w * 3)) * 29 + i % 3 * 53 * (k % 3)) % 256
    digits = F.transform(F.sequence(F.lit(0), (w * 12 - 1).cast("int")), lambda i: F.lpad(F.hex(value(i)), 2, "0"))
    return X.samples(s, d).select(C("sample_id").alias("key"), w.cast("int").alias("width"), F.lit(4).alias("height"), F.unhex(F.array_join(digits, "")).alias("rgb"))


def _picture_means(s, d):
    """Channel means of pictures that have been written as PNG and read again, and which of them show a tunnel."""
    m = pixels.channel_means(pictures.decoded(pictures.encoded(_drawn(s, d))))
    return m.select(C("key").alias("sample_id"), *(F.round(x, 6).alias(x) for x in "rgb"), R.is_tunnel(C("r"), C("g"), C("b")).alias("tunnel"))


def _status(s, d):
    k = C("c_custkey")
    return X.locations(s, d).select("sample_id", R.view_status(C("lat"), C("lon"), F.when(k % 6 != 0, C("lat") + (k % 20) / 10000.0), C("lon")).alias("status"))


def _boxes(s, d):
    n = s.read.parquet(f"{d}/nation.parquet")
    k = C("n_nationkey")
    return n.select(C("n_name").alias("city"), k.cast("double").alias("south"), k.cast("double").alias("west"), (k + F.when(k % 4 == 0, 0).otherwise(1)).cast("double").alias("north"), (k + 1).cast("double").alias("east"))


def _numbered(s, d):
    p = R.random_points(_boxes(s, d), 5, 4)
    return R.first_snapped(p.where(C("attempt") % 3 != 0), 5).select("sample_id", "attempt", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


def _integrity(s, d):
    loc = flatten.flatten_questions(X.records(s, d))
    tags = split.split_seen_unseen(loc.select("sample_id", "city").distinct(), X.unseen(s, d)).select("sample_id", "split")
    return R.integrity(loc.join(tags, "sample_id"), X.unseen(s, d))


PRICES = "select n_name as city, l_extendedprice as price from lineitem join nation on n_nationkey = l_orderkey % 25 where l_suppkey % 13 > 0"
SCENES = """select n_name as tile, l_partkey % 40 as pixel, substr('rgb', cast(l_linenumber % 3 + 1 as int), 1) as band, l_quantity * 100 as value, l_discount * 400 as cloud
 from lineitem join nation on n_nationkey = l_orderkey % 25"""


def _price_quantiles(s, d):
    """Few values are held, so the rounds are taken at any size."""
    q = quantiles.quantiles(X.frame(s, d, PRICES), "price", ["city"], [0.1, 0.5, 0.9, 0.99], held=64)
    return q.select("city", "rows", *(F.round(C("q")[k], 4).alias(n) for k, n in enumerate(("q10", "median", "q90", "q99"))))


QUERIES = {
    "price_quantiles": _price_quantiles,
    "median_composite": lambda s, d: web.median_composite(X.frame(s, d, SCENES)).withColumn("value", F.round("value", 6)),
    "picture_means": _picture_means,
    "source_allow_list": lambda s, d: R.source_allowed(_sources(s, d), allow=["NAIP", "IGN"]).select("sample_id", "source"),
    "source_deny_list": lambda s, d: R.source_allowed(_sources(s, d), deny=["S2"]).select("sample_id", "source"),
    "tile_fallback": lambda s, d: R.choose_tile(_sources(s, d).select("sample_id", "source"), _tiles(s, d)),
    "composite_manifest": lambda s, d: R.composite_manifest(_views(s, d)),
    "record_projections": _projections,
    "view_status": _status,
    "random_points": _numbered,
    "half_epochs": lambda s, d: R.half_epochs(s.read.parquet(f"{d}/orders.parquet").select(C("o_orderkey").alias("step")).where("step > 0"), 450),
    "integrity_checks": _integrity,
    "city_selection": lambda s, d: X.unseen(s, d).join(X.locations(s, d).select("city").distinct(), "city", "left_semi"),
}
_CHAIN = "case source when 'NAIP' then ['NAIP', 'ESRI', 'S2'] when 'IGN' then ['IGN', 'ESRI', 'S2'] when 'ESRI' then ['ESRI', 'S2'] when 'S2' then ['S2'] else [] end"
_U = "cast('0x' || substr(md5(concat_ws('_', '42', city, cast(attempt as string), '{k}')), 1, 8) as bigint) / 4294967296.0::double"
ORACLE = {
    "price_quantiles": f"""select city, rows, round(q[1], 4) as q10, round(q[2], 4) as median, round(q[3], 4) as q90, round(q[4], 4) as q99
 from (select city, count(price) as rows, quantile_cont(price, [0.1, 0.5, 0.9, 0.99]) as q from ({PRICES}) group by city)""",
    "median_composite": f"select tile, pixel, band, round(quantile_cont(value, 0.5) * 0.0001, 6) as value, count(*) as scenes from ({SCENES}) where cloud < 20 group by tile, pixel, band",
    "picture_means": f"""with {S}, p as (select sample_id, c_custkey as k, c_custkey % 4 + 5 as w, unnest(range(0, (c_custkey % 4 + 5) * 12)) as i from s), v as (select sample_id, i % 3 as c, (k * 7 + (i // 3) % w * 13 + i // (w * 3) * 29 + i % 3 * 53 * (k % 3)) % 256 as v from p),
m as (select sample_id, avg(v) filter (where c = 0) as r, avg(v) filter (where c = 1) as g, avg(v) filter (where c = 2) as b from v group by 1) select sample_id, round(r, 6) as r, round(g, 6) as g, round(b, 6) as b, greatest(r, g, b) - least(r, g, b) > 40 as tunnel from m""",
    "source_allow_list": f"with {S}, x as (select sample_id, {SRC} as source from s) select * from x where source in ('NAIP', 'IGN')",
    "source_deny_list": f"with {S}, x as (select sample_id, {SRC} as source from s) select * from x where source is null or source <> 'S2'",
    "tile_fallback": f"""with {S}, x as (select sample_id, c_custkey, {SRC} as source from s), c as (select sample_id, c_custkey, unnest({_CHAIN}) as t, unnest(range(1, len({_CHAIN}) + 1)) as step from x),
g as (select *, row_number() over (partition by sample_id order by step) as r from c where (c_custkey * 7 + length(t) * 13) % 11 * 1000 > 5000) select x.sample_id, source, t as actual from x left join (select * from g where r = 1) g using (sample_id)""",
    "composite_manifest": f"with {S} select sample_id, concat('images/composites/', sample_id, '_stv.jpg') as path from s where c_custkey % 19 > 5 and (c_custkey + 3) % 19 > 5 and (c_custkey + 6) % 19 > 5 and (c_custkey + 9) % 19 > 5",
    "record_projections": f"""with {S}, z as (select *, c_custkey as k, least(1.0::double, 768.0::double / greatest(c_custkey % 1500 + 1, c_custkey % 900 + 1)) as f from s) select sample_id, case when k % 3 <> 0 and k % 4 > 0 then 'sat+sv' when k % 3 <> 0 then 'sat_only' else 'sv_only' end as modality,
 case when k % 3 <> 0 then 'd' when k % 5 <> 0 then 'c' else '' end as place, substr(lpad(cast(k as string), 15, '0'), 6, 6) as tract, case when k % 7 >= 1 then k % 7 - 1 end as income, greatest(k % 200, k % 100, k % 150) - least(k % 200, k % 100, k % 150) > 40 as tunnel,
 cast(floor((k % 1500 + 1) * f) as int) as width, cast(floor((k % 900 + 1) * f) as int) as height, round(256 + 80 * sin(radians(bearing)), 4) as x, round(256 - 80 * cos(radians(bearing)), 4) as y from z""",
    "view_status": f"with {L}, x as (select *, lat + (c_custkey % 20) / 10000.0::double as rlat, lon as rlon from l) select sample_id, case when c_custkey % 6 = 0 then 'NO_COVERAGE' when 6371000.0 * 2 * asin(sqrt(power(sin((radians(rlat) - radians(lat)) / 2), 2))) > 80 then 'SNAP_TOO_FAR' else 'OK' end as status from x",
    "random_points": f"""with c as (select n_name as city, n_nationkey as k, unnest(range(1, 21)) as attempt from nation where n_nationkey % 4 <> 0), p as (select city, attempt, k + {_U.format(k='lat')} as lat, k + {_U.format(k='lon')} as lon, row_number() over (partition by city order by attempt) as r from c where attempt % 3 <> 0)
select concat_ws('_', city, lpad(cast(r as string), 4, '0')) as sample_id, attempt, round(lat, 9) as lat, round(lon, 9) as lon from p where r <= 5""",
    "half_epochs": "select o_orderkey as step, cast(floor(2 * o_orderkey / 450.0) as int) as half from orders where o_orderkey > 0 and floor(2 * o_orderkey / 450.0) > floor(2 * (o_orderkey - 1) / 450.0)",
    "integrity_checks": f"""with {FLAT}, l as (select distinct sample_id, city from named), {SEEN[SEEN.index('b as (select sample_id'):]}, t as (select named.*, split from named join s using (sample_id)),
p as (select distinct sample_id, split from t) select concat('overlap ', a, ' ', b) as rule, (select count(*) from p x join p y using (sample_id) where x.split = a and y.split = b) as violations from (values ('train', 'validation'), ('train', 'benchmark'), ('validation', 'benchmark')) v(a, b)
 union all select 'duplicate ids', count(question_id) - count(distinct question_id) from t union all select 'unseen in train', count(*) from t where split = 'train' and city in (select city from u) union all select 'views', count(*) from t where coalesce(streetview_count, 0) <> 4 union all select 'removed topic', count(*) from t where topic = 'water_proximity'""",
    "city_selection": f"with {L} select n_name as city from nation where n_nationkey % 3 = 0 and n_name in (select city from l)",
}
