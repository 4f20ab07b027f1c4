"""Queries of question generation, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralens.operators import questions as Q
from terralens.operators import uses
from terralens.plans import fixtures as X

S = f"s as ({X.SAMPLES})"


def _lst(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _case(col: str, labels: dict[str, str]) -> str:
    return f"case {col} " + " ".join(f"when '{k}' then '{v}'" for k, v in labels.items()) + " end"


def _bins(col: str, bins, op: str = "<=") -> str:
    return "case " + " ".join(f"when {col} >= {lo} and {col} {op} {hi} then '{label}'" for label, lo, hi in bins) + " end"


_RIGHT = {
    "land_use": (_case("land_use", Q.LAND_USE), _lst(Q.LAND_USE.values())),
    "building_height": (f"case when median_levels > 0 then {_bins('median_levels', Q.HEIGHT)} end", _lst(x[0] for x in Q.HEIGHT)),
    "road_type": (_case("road_type", Q.ROAD), _lst(Q.ROAD.values())),
    "urban_density": (_bins("building_count", Q.DENSITY), _lst(x[0] for x in Q.DENSITY)),
    "green_space": (f"case when has_park then '{Q.PARK_YES[0]}' when not has_park and coalesce(building_count, 0) > 20 then '{Q.PARK_NO[0]}' end", f"case when has_park then {_lst(Q.PARK_YES)} else {_lst(Q.PARK_NO)} end"),
    "amenity_richness": (f"case when amenity_count >= 20 then '{Q.AMENITY[0]}' when amenity_count >= 5 then '{Q.AMENITY[1]}' when amenity_count >= 1 then '{Q.AMENITY[2]}' when amenity_count is not null then '{Q.AMENITY[3]}' end", _lst(Q.AMENITY)),
    "road_surface": (_case("surface", Q.SURFACE), _lst(Q.SURFACES)),
    "junction_type": (_case("junction", Q.JUNCTION), _lst(Q.JUNCTION.values())),
    "water_proximity": (_bins("water_m", Q.WATER, "<"), _lst([*(x[0] for x in Q.WATER), Q.WATER_FILLER])),
    "transit_density": (_bins("transit_stops", Q.TRANSIT), _lst(x[0] for x in Q.TRANSIT)),
}


def _oracle(topic: str) -> str:
    right, options = _RIGHT[topic]
    return f"""with {S}, c as (select sample_id, {right} as correct, {options} as o from s), x as (select sample_id, correct, unnest(o) as v from c where correct is not null),
d as (select sample_id, correct, v, row_number() over (partition by sample_id order by md5(concat_ws('_', sample_id, '{topic}', v))) as r from x where v <> correct),
four as (select sample_id, correct, v from d where r <= 3 union all select sample_id, correct, correct from c where correct is not null),
n as (select *, row_number() over (partition by sample_id order by md5(concat_ws('_', sample_id, '{topic}', 'order', v))) as p from four)
select sample_id, '{topic}' as topic, '{Q.DIFFICULTY[topic]}' as difficulty, correct, string_agg(v, '|' order by p) as options, substr('ABCD', cast(max(case when v = correct then p end) as int), 1) as answer from n group by sample_id, correct"""


def _asked(topic: str):
    return lambda s, d: Q.choice_questions(X.samples(s, d), [topic]).withColumn("options", F.array_join("options", "|"))


def _same(s, d):
    return Q.distractors(X.locations(s, d), True)


def _cross(s, d):
    return Q.distractors(X.locations(s, d), False)


def _views(s, d):
    x = X.samples(s, d)
    return x.select("sample_id", F.explode(F.expr("case when streetview_count = 4 then array('along_fwd', 'along_bwd', 'cross_left', 'cross_right') else array('along_fwd') end")).alias("view"))


def _camera(s, d):
    v = _views(s, d)
    return Q.camera_direction(X.samples(s, d).where("streetview_count = 4"), v)


def _scored(s, d):
    x = X.samples(s, d)
    q = Q.choice_questions(x).select("sample_id", "topic")
    order = {t: k for k, t in enumerate(Q.correct_options())}
    pos = F.element_at(F.create_map(*(F.lit(v) for kv in order.items() for v in kv)), F.col("topic"))
    return q.join(x, "sample_id").select("city", F.col("c_custkey").alias("ord"), "sample_id", pos.alias("pos"), "topic", Q.question_score().alias("score"))


def _questions_all(s, d):
    return Q.choice_questions(X.samples(s, d)).groupBy("topic", "answer").agg(F.count("*").alias("n"))


QUERIES = {f"q_{t}": _asked(t) for t in _RIGHT} | {
    "distractors_same_city": _same,
    "distractors_cross_city": _cross,
    "mismatch_mcq": lambda s, d: Q.mismatch_mcq(X.locations(s, d), True).unionByName(Q.mismatch_mcq(X.locations(s, d), False)),
    "mismatch_binary": lambda s, d: Q.mismatch_binary(X.locations(s, d), True).unionByName(Q.mismatch_binary(X.locations(s, d), False)),
    "camera_direction": _camera,
    "question_scores": lambda s, d: _scored(s, d).select("sample_id", "topic", "score"),
    "best_question": lambda s, d: Q.best_questions(_scored(s, d)),
    "best_question_global": lambda s, d: uses.best_questions_in_order(_scored(s, d)),
    "ranked_candidates": lambda s, d: Q.ranked_candidates(_scored(s, d)).where("rank = 1").select("sample_id", "topic", "score"),
    "generation_stats": _questions_all,
}


def _pool(same: bool) -> str:
    pick = "n > 3 and first + (o + rank + 1) % n" if same else "total - n >= 3 and case when j < first then j else j + n end"
    where, at = pick.split(" and ")
    return f"""l as ({X.LOCATIONS}), c as (select city, count(*) as n from l group by 1), cc as (select city, n, sum(n) over (order by city) - n as first, sum(n) over () as total from c),
k as (select sample_id, n, first, total, row_number() over (partition by city order by md5(concat_ws('_', 'pool', sample_id))) - 1 as o, cast('0x' || substr(md5(concat_ws('_', 'pool', sample_id)), 1, 8) as bigint) as h from l join cc using (city)),
g as (select *, (h + rank * ((total - n) // 3)) % (total - n) as j from k, (values (0), (1), (2)) v(rank)),
d as (select g.sample_id, rank, k.sample_id as other from (select sample_id, rank, {at} as at from g where {where}) g join k on k.first + k.o = g.at)"""


def _mcq(same: bool) -> str:
    return f"""with {_pool(same)}, f as (select sample_id, other from d union all select distinct sample_id, sample_id from d), n as (select *, row_number() over (partition by sample_id order by md5(concat_ws('_', sample_id, 'grid', other))) as p from f)
select sample_id, string_agg(other, ',' order by p) as options, substr('ABCD', cast(max(case when other = sample_id then p end) as int), 1) as correct_pos, '{"hard" if same else "easy"}' as difficulty from n group by sample_id"""


def _binary(same: bool) -> str:
    return f"with {_pool(same)} select sample_id, m as is_match, case when m then sample_id else other end as shown, case when m then 'A' else 'B' end as answer, '{'hard' if same else 'easy'}' as difficulty from (select * from d where rank = 0), (values (true), (false)) v(m)"


_SCORES = """case topic when 'building_height' then case when median_levels > 15 or median_levels <= 2 then 5 else 2 end when 'land_use' then case when land_use in ('industrial', 'open_space', 'institutional') then 5 else 3 end
 when 'road_type' then case when road_type in ('motorway', 'trunk', 'primary') then 4 else 2 end when 'junction_type' then case when junction = 'roundabout' then 5 else 3 end when 'road_surface' then 4 when 'water_proximity' then 4 when 'amenity_richness' then 2 when 'transit_density' then 2 else 3 end"""
_HAVE = " union all ".join(f"select s.*, '{t}' as topic from s where ({right}) is not null" for t, (right, _) in _RIGHT.items())


def _best(group: str) -> str:
    """A walk over the samples of a group in order; ``uses`` counts the choices of each topic so far."""
    topics = ", ".join(repr(t) for t in _RIGHT)
    return f"""with recursive {S}, h as ({_HAVE}), c as (select sample_id, {group} as g, city, c_custkey, list_position([{topics}], topic) as t, {_SCORES} as x from h),
a as (select g, sample_id, row_number() over (partition by g order by city, c_custkey) as k, list(t order by t) as ts, list(x order by t) as xs from c group by g, city, sample_id, c_custkey),
w as (select g, cast(0 as bigint) as k, cast('' as varchar) as sample_id, cast(0 as bigint) as best, [{', '.join('0' for _ in _RIGHT)}] as uses from (select distinct g from a)
 union all select g, k, sample_id, b, list_transform(uses, lambda u, i: u + case when i = b then 1 else 0 end) from (select w.g, a.k, a.sample_id, uses, cast(ts[list_position(list_transform(ts, lambda t, i: xs[i] - 3 * uses[t]), list_max(list_transform(ts, lambda t, i: xs[i] - 3 * uses[t])))] as bigint) as b from w join a on a.g = w.g and a.k = w.k + 1))
select sample_id, cast(best - 1 as int) as pos, [{topics}][best] as topic from w where k > 0"""


ORACLE = {f"q_{t}": _oracle(t) for t in _RIGHT} | {
    "distractors_same_city": f"with {_pool(True)} select sample_id, cast(rank as int) as rank, other from d",
    "distractors_cross_city": f"with {_pool(False)} select sample_id, cast(rank as int) as rank, other from d",
    "mismatch_mcq": f"({_mcq(True)}) union all ({_mcq(False)})",
    "mismatch_binary": f"({_binary(True)}) union all ({_binary(False)})",
    "camera_direction": f"""with {S}, v as (select sample_id, unnest(['along_fwd', 'along_bwd', 'cross_left', 'cross_right']) as view from s where streetview_count = 4), o as (select v.*, unnest(['along_fwd', 'along_bwd', 'cross_left', 'cross_right']) as opt from v),
n as (select *, row_number() over (partition by sample_id, view order by md5(concat_ws('_', sample_id, view, 'camera', opt))) as p from o) select sample_id, view, substr('ABCD', cast(p as int), 1) as answer from n where opt = view""",
    "question_scores": f"with {S}, h as ({_HAVE}) select sample_id, topic, {_SCORES} as score from h",
    "best_question": _best("city"),
    "best_question_global": _best("'all'"),
    "ranked_candidates": f"with {S}, h as ({_HAVE}), c as (select sample_id, topic, {_SCORES} as score, list_position([{', '.join(repr(t) for t in _RIGHT)}], topic) as p from h) select sample_id, topic, score from (select *, row_number() over (partition by sample_id order by score desc, p) as r from c) where r = 1",
    "generation_stats": " union all ".join(f"select topic, answer, count(*) as n from ({_oracle(t)}) group by 1, 2" for t in _RIGHT),
}
