"""Queries of validation and quality, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralens.operators import quality as A
from terralens.plans import fixtures as X

S = f"s as ({X.SAMPLES})"
#: A question of each topic for each sample, some with a null answer, two options or without images.
QS = f"""{S}, t as (select unnest(range(0, 13)) as k), q as (select s.* replace (case when c_custkey % 4 = 0 then 'Tokyo' else city end as city, case when c_custkey % 23 = 0 then 120 when c_custkey % 29 = 0 then -3 when c_custkey % 5 = 2 then median_levels + 5 else median_levels end as median_levels), k, {X.pick('k', X.TOPICS)} as topic, {X.pick('(c_custkey + k) % 3', ['easy', 'medium', 'hard'])} as difficulty,
 case when (c_custkey + k) % 29 = 0 then null else substr('ABCD', cast((c_custkey * 7 + k) % 4 + 1 as int), 1) end as answer, case when (c_custkey + k) % 31 = 0 then 3 else 4 end as n_options,
 case when k < 10 then null else (c_custkey + k) % 12 <> 0 end as images_ok from s, t)"""


def _questions(s, d):
    k, key = F.col("k"), F.col("c_custkey")
    q = X.samples(s, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(12))))
    part = lambda p, c: F.struct(p.alias("composite_path"), c.alias("correct_pos"))
    q = q.withColumns({"city": F.when(key % 4 == 0, "Tokyo").otherwise(F.col("city")), "median_levels": F.when(key % 23 == 0, 120).when(key % 29 == 0, -3).when(key % 5 == 2, F.col("median_levels") + 5).otherwise(F.col("median_levels"))})
    return q.withColumns({
        "arrow_paths": F.when(key % 8 == 0, F.create_map(F.lit("a"), F.lit("p"), F.lit("b"), F.lit("p"))).when(key % 9 != 0, F.create_map(*(F.lit(x) for v in "abcd" for x in (v, "p")))),
        "binary_variants": F.when(key % 7 == 0, F.array().cast("array<string>")).when(key % 6 != 0, F.array(F.lit("v"))),
        "mcq_variants": F.when(key % 5 == 0, F.array(part(F.lit("p"), F.lit("A")), part(F.lit(""), F.lit("B")))).when(key % 5 == 1, F.array(part(F.lit("p"), F.lit(None).cast("string")))).when(key % 5 != 2, F.array(part(F.lit("p"), F.lit("C")))),
        "topic": F.expr(X.pick("k", X.TOPICS)), "difficulty": F.expr(X.pick("(c_custkey + k) % 3", ["easy", "medium", "hard"])),
        "answer": F.when((key + k) % 29 != 0, F.substring(F.lit("ABCD"), ((key * 7 + k) % 4 + 1).cast("int"), F.lit(1))),
        "n_options": F.when((key + k) % 31 == 0, 3).otherwise(4), "images_ok": F.when(k >= 10, (key + k) % 12 != 0)})


def _rows(s, d):
    return A.assess(_questions(s, d))


def _records(s, d):
    x = X.samples(s, d)
    views = F.expr("map('along_fwd', c_custkey % 4 * 3000, 'along_bwd', case when c_custkey % 5 = 0 then null else c_custkey % 7 * 1500 end, 'cross_left', c_custkey % 3 * 6000, 'cross_right', c_custkey % 2 * 9000)")
    opts = F.expr("case c_custkey % 4 when 0 then array('a', 'b', 'c', 'd') when 1 then array('a', 'a', 'c', 'd') when 2 then array('a', 'b') else array() end")
    x = x.select("sample_id", F.expr("case when c_custkey % 13 = 0 then '' else 'q' end").alias("question"), F.expr("substr('ABCD', cast(c_custkey % 4 + 1 as int), 1)").alias("answer"), opts.alias("options"),
                 F.expr("case when c_custkey % 9 = 0 then null else c_custkey % 11 * 1000 end").alias("sat_bytes"), views.alias("view_bytes"), F.expr("c_custkey % 260 - 20").alias("levels"), _all_questions().alias("all"))
    return x.select("sample_id", A.record_issues(asked=F.col("all")).alias("issues"))


def _all_questions():
    """None to five questions a record; by the sum of key and place: a good one, no such answer, equal options, two options, no options, no topic."""
    options = lambda *v: F.create_map(*(F.lit(x) for k, t in zip("ABCD", v) for x in (k, t)))
    kinds = [("land_use", options("w", "x", "y", "z"), "A"), ("road_type", options("w", "x", "y", "z"), "E"), ("green_space", options("w", "w", "y", "z"), "B"), ("mismatch_binary", options("yes", "no"), "A"),
             ("urban_density", F.create_map().cast("map<string,string>"), ""), (None, options("w", "w"), "C")]
    each = F.array(*(F.struct(F.lit(t).cast("string").alias("topic"), o.cast("map<string,string>").alias("options"), F.lit(a).alias("answer")) for t, o, a in kinds))
    n = F.col("c_custkey") % 6
    places = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.get(each, ((F.col("c_custkey") + i) % 6).cast("int")))


QUERIES = {
    "validate_rows": lambda s, d: _records(s, d).select("sample_id", F.array_join("issues", "|").alias("issues"), A.is_valid(F.col("issues")).alias("valid")),
    "severity_counts": lambda s, d: A.severity_counts(_records(s, d)),
    "validate_dataset": lambda s, d: A.dataset_issues(X.questions(s, d).withColumn("answer", F.when(F.col("pos") < 5, "A").otherwise(F.col("answer")))),
    "quality_rows": _rows,
    "quality_by_topic": lambda s, d: A.by_topic(_rows(s, d)).select("topic", "n", *(F.round(c, 4).alias(c) for c in ("meta_pct", "plausible_pct", "pass_pct", "share_pct")), "mark"),
    "quality_matrix": lambda s, d: A.matrix(_rows(s, d), X.TOPICS),
    "flag_reasons": lambda s, d: A.top_reasons(_rows(s, d)),
    "recommendations": lambda s, d: A.recommendations(_rows(s, d)),
    "image_completeness": lambda s, d: _rows(s, d).where("images_ok is not null").groupBy("topic").agg(F.round(F.avg("images_ok") * 100, 4).alias("ok_pct")),
    "answer_skew": lambda s, d: _rows(s, d).where("answer is not null").groupBy("topic", "answer").agg(F.count("*").alias("n")).groupBy("topic").agg(F.sum("n").alias("n"), (F.max("n") > 0.4 * F.sum("n")).alias("skewed")),
    "city_summary": lambda s, d: _rows(s, d).groupBy("city").agg(F.countDistinct("sample_id").alias("samples"), F.count("*").alias("questions"), F.round(F.avg((F.col("overall_quality") == "pass").cast("int")) * 100, 4).alias("pass_pct")),
}


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _odd(col: str, label: str, values) -> str:
    return f"when topic = '{label[0]}' and coalesce({col} not in {_in(values)}, true) then concat('{label[1]}=', coalesce('''' || {col} || '''', 'None'), ' not in valid set')"


_MISSING = f"""case {_odd('land_use', ('land_use', 'land_use_category'), A.LAND_USE)} when topic = 'building_height' and coalesce(median_levels, 0) = 0 then 'osm_median_building_levels is null or 0'
 {_odd('road_type', ('road_type', 'road_type'), A.ROAD)} when topic = 'urban_density' and building_count is null then 'osm_building_count is null' when topic = 'green_space' and has_park is null then 'osm_has_park is null'
 {_odd('surface', ('road_surface', 'osm_road_surface'), A.SURFACE)} {_odd('junction', ('junction_type', 'osm_junction_type'), A.JUNCTION)} when topic = 'water_proximity' and water_m is null then 'osm_water_distance_m is null'
 when topic = 'building_height' and median_levels < 0 then concat('osm_median_building_levels=', cast(median_levels as string), ' <= 0')
 when topic = 'camera_direction' and (bearing < 0 or bearing > 360) then concat('road_bearing=', cast(bearing as string), ' out of 0-360 range') when topic = 'camera_direction' and c_custkey % 8 = 0 then 'camera_arrow_paths has only 2/4 entries'
 when topic = 'camera_direction' and c_custkey % 9 = 0 then 'camera_arrow_paths has only 0/4 entries' when topic = 'mismatch_binary' and (c_custkey % 7 = 0 or c_custkey % 6 = 0) then 'mismatch_binary_variants is empty' when topic = 'mismatch_mcq' and c_custkey % 5 = 2 then 'mismatch_mcq_variants is empty'
 when topic = 'mismatch_mcq' and c_custkey % 5 < 2 then 'mismatch_mcq variant missing composite_path or correct_pos' else '' end"""
_FLAGS = """list_filter([case when topic = 'land_use' and land_use = 'open_space' and coalesce(building_count, 0) > 50 then 'open_space but building_count>50' end,
 case when topic = 'land_use' and land_use = 'residential' and coalesce(building_count, 0) = 0 then 'residential but building_count=0' end, case when topic = 'land_use' and land_use = 'industrial' and amenity_count > 15 then 'industrial but amenity_count>15' end,
 case when topic = 'urban_density' and building_count > 150 and amenity_count = 0 then 'very_high_density but amenity_count=0' end, case when topic = 'green_space' and has_park and land_use = 'industrial' and building_count > 80 then 'has_park=True but heavy industrial area (lu=industrial, bc>80)' end,
 case when topic = 'building_height' and median_levels >= 21 and land_use = 'residential' and city <> 'Tokyo' then concat('skyscraper height but lu=residential in non-skyscraper city (', city, ')') end, case when topic = 'building_height' and median_levels > 100 then concat('implausible building levels: ', cast(median_levels as string)) end,
 case when topic = 'road_type' and road_type = 'motorway' and junction = 'unsignalized' then 'motorway but junction_type=unsignalized' end], lambda x: x is not null)"""
ROWS = f"""{QS}, m as (select *, {_MISSING} as missing, {_FLAGS} as flags, answer is null or n_options not in (2, 4) as bad from q),
r as (select sample_id, city, topic, difficulty, answer, cast(missing = '' as int) as metadata_complete, cast(len(flags) > 0 as int) as plausibility_flag, cast(images_ok as int) as images_ok,
 case when bad then 'invalid' when missing <> '' then 'low_metadata' when images_ok = false then 'missing_images' when len(flags) > 0 then 'suspicious' else 'pass' end as overall_quality,
 array_to_string(list_filter([nullif(missing, ''), nullif(array_to_string(flags, '; '), ''), case when not images_ok then 'images missing' end, case when bad then 'invalid structure' end], lambda x: x is not null), '; ') as flag_reasons from m)"""
_ASK = "case when c_custkey % 6 > 0 then list_transform(range(1, c_custkey % 6 + 1), lambda i: c_custkey + i) else [] end"
_REC = f"""{S}, x as (select sample_id, c_custkey as c, case when c_custkey % 9 = 0 then null else c_custkey % 11 * 1000 end as sat, c_custkey % 4 * 3000 as v1, case when c_custkey % 5 = 0 then 0 else c_custkey % 7 * 1500 end as v2, c_custkey % 3 * 6000 as v3, c_custkey % 2 * 9000 as v4, c_custkey % 260 - 20 as lv, {_ASK} as asked from s),
i as (select sample_id, list_filter([case when c % 13 = 0 then 'CRITICAL: No question generated' end, case when c % 4 in (2, 3) then 'CRITICAL: Answer key not in options' end, case when c % 4 = 1 then 'CRITICAL: Duplicate options' end,
 case when c % 4 = 2 then 'WARNING: Expected 4 options, got 2' end, case when sat is null then 'CRITICAL: Missing satellite image' when sat < 5000 then 'CRITICAL: Satellite image too small (likely blank/cloud)' end,
 case when v1 <= 5000 then 'WARNING: Missing/small SV image: along_fwd' end, case when v2 <= 5000 then 'WARNING: Missing/small SV image: along_bwd' end, case when v3 <= 5000 then 'WARNING: Missing/small SV image: cross_left' end, case when v4 <= 5000 then 'WARNING: Missing/small SV image: cross_right' end,
 case when greatest(v1, v2, v3, v4) <= 5000 then 'CRITICAL: No street view images at all' end, case when len(asked) = 0 and c % 13 = 0 then 'WARNING: No questions in all_questions array' end]
 || flatten(list_transform(asked, lambda k, i: case k % 6 when 1 then [concat('CRITICAL: all_questions[', i - 1, '] (road_type) answer key not in options')] when 2 then [concat('WARNING: all_questions[', i - 1, '] (green_space) has duplicate options')]
  when 3 then [concat('WARNING: all_questions[', i - 1, '] (mismatch_binary) expected 4 options, got 2')] when 5 then [concat('CRITICAL: all_questions[', i - 1, '] (?) answer key not in options'), concat('WARNING: all_questions[', i - 1, '] (?) has duplicate options'), concat('WARNING: all_questions[', i - 1, '] (?) expected 4 options, got 2')] else [] end))
 || [case when lv < 0 or lv > 200 then concat('WARNING: Implausible building levels: ', cast(lv as string), '.0') end], lambda x: x is not null) as issues from x)"""
ORACLE = {
    "validate_rows": f"with {_REC} select sample_id, array_to_string(issues, '|') as issues, len(list_filter(issues, lambda x: x like 'CRITICAL%')) = 0 as valid from i",
    "severity_counts": f"with {_REC} select split_part(v, ':', 1) as severity, count(*) as n from (select unnest(issues) as v from i) group by 1",
    "validate_dataset": f"""with q as (select * replace (case when pos < 5 then 'A' else answer end as answer) from ({X.QUESTIONS})), a as (select count(*) as n, count(distinct topic) as topics, count(distinct city) as cities, count(distinct land_use) as uses, count(distinct sample_id) as samples from q), m as (select max(c) as most from (select count(*) as c from q group by answer))
select unnest(list_filter([case when most > 0.4 * n then 'answer skew' end, case when topics < 3 then 'few topics' end, case when cities < 2 then 'few cities' end, case when uses < 3 then 'few land uses' end, case when topics < 5 then 'few question types' end, case when n / cast(samples as double) < 2 then 'few questions per sample' end], lambda x: x is not null)) as issue from a, m""",
    "quality_rows": f"with {ROWS} select * from r",
    "quality_by_topic": f"""with {ROWS}, g as (select topic, count(*) as n, round(avg(metadata_complete) * 100, 4) as meta_pct, round(avg(1 - plausibility_flag) * 100, 4) as plausible_pct, round(avg(cast(overall_quality = 'pass' as int)) * 100, 4) as pass_pct from r group by 1)
select *, round(n * 100.0::double / sum(n) over (), 4) as share_pct, array_to_string(list_filter([case when n < 1000 then 'SPARSE' end, case when meta_pct < 60 then 'LOW METADATA' end], lambda x: x is not null), ',') as mark from g""",
    "quality_matrix": f"with {ROWS} select city, " + ", ".join(f"round(avg(metadata_complete) filter (where topic = '{t}') * 100, 3) as {t}" for t in X.TOPICS) + " from r group by 1",
    "flag_reasons": f"with {ROWS}, n as (select topic, reason, count(*) as n from (select topic, unnest(string_split(flag_reasons, '; ')) as reason from r where plausibility_flag = 1) group by 1, 2) select * from (select *, cast(row_number() over (partition by topic order by n desc, reason) as int) as r from n) where r <= 5",
    "recommendations": f"""with {ROWS} select 'remove type' as rule, 'water_proximity' as subject union all select 'low metadata', topic from r where topic <> 'water_proximity' group by topic having avg(metadata_complete) < 0.6 union all select 'many flags', topic from r group by topic having avg(plausibility_flag) > 0.05
 union all select 'few questions', city from r group by city having count(*) / cast(count(distinct sample_id) as double) < 12 union all select 'missing images', topic from r where images_ok is not null group by topic having avg(1 - images_ok) > 0.05""",
    "image_completeness": f"with {ROWS} select topic, round(avg(images_ok) * 100, 4) as ok_pct from r where images_ok is not null group by 1",
    "answer_skew": f"with {ROWS}, n as (select topic, answer, count(*) as n from r where answer is not null group by 1, 2) select topic, sum(n)::bigint as n, max(n) > 0.4 * sum(n) as skewed from n group by 1",
    "city_summary": f"with {ROWS} select city, count(distinct sample_id) as samples, count(*) as questions, round(avg(cast(overall_quality = 'pass' as int)) * 100, 4) as pass_pct from r group by 1",
}
