"""Queries of records, their checks and packages, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terralens.operators import assemble as A
from terralens.operators import flatten, phrases, reports, select, split
from terralens.operators import merge as M
from terralens.operators import packaged as P
from terralens.operators import quality as Y
from terralens.operators import questions as Q
from terralens.operators import records as R
from terralens.plans import fixtures as X
from terralens.plans.asking import _HAVE, _oracle
from terralens.plans.splits import FLAT, SEEN, SPLIT

C = F.col
S, L = f"s as ({X.SAMPLES})", f"l as ({X.LOCATIONS})"
TOPICS = ["land_use", "building_height", "road_type", "urban_density", "green_space", "amenity_richness", "road_surface", "junction_type", "water_proximity", "transit_density"]
FEW = ["land_use", "road_type", "green_space"]
OTHERS = ["camera_direction", "mismatch_binary", "mismatch_mcq"]
LEVELS = "case when c_custkey % 13 = 0 then 'x' when median_levels is not null then concat(cast(median_levels - 2 as string), '.0') end"


def _asked(s, d):
    q = Q.choice_questions(X.samples(s, d), TOPICS)
    letters = F.array(*(F.lit(x) for x in "ABCD"))
    return phrases.phrased(q).withColumns({"options": F.map_from_arrays(letters, "options"), "pos": F.array_position(F.array(*map(F.lit, TOPICS)), C("topic")).cast("int")})


def _worded(s, d):
    """The text of each question: ten topics where they have an answer, the others for all samples."""
    x = X.samples(s, d)
    rest = x.select("sample_id", F.explode(F.array(*map(F.lit, OTHERS))).alias("topic"))
    return phrases.phrased(Q.choice_questions(x).select("sample_id", "topic").unionByName(rest)).select("sample_id", "topic", "question")


def _sample_rows(s, d):
    at = X.locations(s, d).select("sample_id", "lat", "lon", "country")
    names = {"city": "city_name", "land_use": "land_use_category", "building_count": "osm_building_count", "amenity_count": "osm_amenity_count", "has_park": "osm_has_park", "water_m": "osm_water_distance_m", "transit_stops": "osm_transit_stop_count",
             "surface": "osm_road_surface", "junction": "osm_junction_type", "road_type": "highway_type", "bearing": "road_bearing"}
    x = X.samples(s, d).withColumn("osm_median_levels", F.expr(LEVELS)).withColumnsRenamed(names).join(at, "sample_id")
    k = C("c_custkey")
    return x.withColumns({"census_tract": F.when(k % 6 == 0, k.cast("string")), "census_median_income": k % 5 - 2, "sat_marked_path": F.when(k % 4 == 0, ""), "validation_issues": F.when(k % 10 == 0, F.array(F.lit("CRITICAL: none"))),
                          "topic": F.when(k % 3 == 0, "land_use"), "answer": F.when(k % 3 == 0, F.substring(F.lit("ABCD"), (k % 4 + 1).cast("int"), F.lit(1)))})


def _listing(s, d):
    k = C("c_custkey")
    names = F.array(F.when(k % 9 != 0, F.concat(F.lit("images/sat/"), "sample_id", F.lit(".png"))), *(F.when(k % 5 > i, F.concat(F.lit("images/sv/"), "sample_id", F.lit(f"_{v}.jpg"))) for i, v in enumerate(A.VIEWS)))
    return X.samples(s, d).select(F.explode(F.filter(names, lambda x: x.isNotNull())).alias("path"))


def _records(s, d):
    x = _sample_rows(s, d)
    return A.build_records(x, _asked(s, d), A.presence(x, _listing(s, d)))


def _record_fields(s, d):
    r = _records(s, d)
    flat = {"modality": "image_modality", "city": "location.city", "hood": "location.neighborhood", "satellite": "images.satellite", "left_view": "images.streetview_cross_left", "marked": "images.satellite_marked", "label": "metadata.land_use_label",
            "buildings": "metadata.osm_building_count", "levels": "metadata.osm_median_building_levels", "park": "metadata.osm_has_park", "tract": "metadata.census.tract", "income": "metadata.census.median_income", "whole": "validation.all_images_present",
            "views": "validation.streetview_count"}
    return r.select("sample_id", *(C(v).alias(k) for k, v in flat.items()), C("question_count").cast("long").alias("asked"), F.size("validation.issues").cast("long").alias("n_issues"), F.array_join(F.transform("questions", lambda q: F.concat(q["topic"], F.lit(":"), q["answer"])), ",").alias("topics"))


def _promoted(s, d):
    r = A.promote(_records(s, d).withColumn("osm_amenity_count", F.lit(None).cast("int")))
    return r.select("sample_id", "osm_building_count", "osm_amenity_count", "highway_type", "osm_median_levels", "osm_has_park", "road_bearing", F.lit("questions" in r.columns).alias("has_questions"), A.city_of(C("location.city"), F.lit("x")).alias("city"), A.view_count_of(C("validation.streetview_count")).alias("views"))


def _viewer_rows(s, d):
    each = F.struct("pos", "topic", "difficulty", F.expr("case pos % 3 when 0 then true when 1 then false end").alias("mismatch_is_match"), F.expr("case when pos % 2 = 0 then 'near' when pos % 5 = 0 then '' end").alias("mismatch_strategy"))
    r = X.questions(s, d).groupBy("sample_id").agg(F.collect_list(F.when(C("topic").isin(*A.GEO_TOPICS), each)).alias("questions"), F.struct(F.min("city").alias("city")).alias("location"), F.struct(F.lit("x").alias("satellite")).alias("images"))
    return A.explode_viewer(r)


VIEW = f"v as (select sample_id, pos, topic, difficulty, case pos % 3 when 0 then true when 1 then false end as m, case when pos % 2 = 0 then 'near' when pos % 5 = 0 then '' end as st from ({X.QUESTIONS}) where topic in ('mismatch_mcq', 'mismatch_binary', 'camera_direction'))"
VIEW_ALL = f"{VIEW}, f as (select * from v where (topic <> 'mismatch_binary' or coalesce(m, false)) and coalesce(nullif(st, ''), 'far') = 'far' and difficulty = 'easy')"


def _filtered(s, d):
    return A.viewer_filter(_viewer_rows(s, d), match=(True,), strategy="far", difficulty="easy")


def _cache(s, d):
    loc = X.locations(s, d).withColumn("ordinal", F.row_number().over(Window.partitionBy("city").orderBy("c_custkey")))
    cache = loc.where("ordinal <= 2 + n_nationkey % 4").select("city", "ordinal", "sample_id")
    return A.cached_locations(cache, loc.where("ordinal <= 4").select("city", "ordinal", F.concat("sample_id", F.lit("_new")).alias("sample_id")), 4)


CACHE = f"{L}, o as (select *, row_number() over (partition by city order by c_custkey) as ordinal from l), c as (select * from o where ordinal <= 2 + n_nationkey % 4), e as (select city from c group by 1 having count(*) >= 4)"


def _tagged(s, d):
    q = flatten.flatten_questions(X.records(s, d))
    tags = split.split_seen_unseen(X.questions(s, d).select("sample_id", "city").distinct(), X.unseen(s, d)).select("sample_id", "split")
    extra = {"question": F.lit("q"), "options": F.create_map(F.lit("A"), F.concat(F.lit("images/sat/"), "sample_id", F.lit(".png"))), "deep": F.struct(F.array(F.struct(F.concat(F.lit("images/sv/"), "sample_id", F.lit("/x.jpg")).alias("p"))).alias("inner"))}
    return q.join(tags, "sample_id").withColumns(extra)


def _suite(s, d):
    t = _tagged(s, d).select("question_id", "sample_id", "city", "topic", "answer", "question", "options", "deep", "split")
    listing = X.questions(s, d).where("value > 10").select(F.concat(F.lit("images/sat/"), "sample_id", F.lit(".png")).alias("path")).distinct()
    public = t.where("split = 'benchmark'").withColumn("answer", F.when(C("topic") == "road_type", C("answer")))
    return P.suite(t, public, listing, X.unseen(s, d), "seen_unseen")


SUITE = f"""{FLAT}, l as (select distinct sample_id, city from named), {SEEN[SEEN.index('b as (select sample_id'):]}, t as (select named.*, split from named join s using (sample_id)),
have as (select distinct sample_id from q where value > 10), ids as (select distinct sample_id from t), p as (select distinct sample_id, split from t),
r as (select 'fields' as c, 0 as bad, concat(cast(count(*) as string), ' ') as detail from t
 union all select 'images', (select count(*) from ids where sample_id not in (select sample_id from have)) + (select count(*) from ids), (select concat(cast(a + b as string), '/', cast(2 * b as string), ' (', case when a > 0 then concat('sat: ', cast(a as string), ', ') else '' end, 'sv: ', cast(b as string), ')') from (select (select count(*) from ids where sample_id not in (select sample_id from have)) as a, (select count(*) from ids) as b))
 union all select 'no answers', count(*), cast(count(*) as string) from t where split = 'benchmark' and topic = 'road_type' and answer is not null union all select 'all answers', 0, cast(count(*) as string) from t where split = 'benchmark' and answer is null
 union all select concat(a, '/', b, ' overlap'), n, cast(n as string) from (select a, b, (select count(*) from p x join p y using (sample_id) where x.split = a and y.split = b) as n from (values ('train', 'validation'), ('train', 'benchmark'), ('validation', 'benchmark')) v(a, b))
 union all select 'unique ids', count(question_id) - count(distinct question_id), cast(count(question_id) - count(distinct question_id) as string) from t
 union all select 'unseen cities', count(distinct city), coalesce(string_agg(distinct city, ','), '') from t where split = 'train' and city in (select city from u))"""


def _city_sets(s, d):
    t = X.questions(s, d).select("city", F.expr("case when pos = 0 then 'train' when pos = 1 and sample_id like '%1' then 'validation' when city like '%7' then 'train' else 'benchmark' end").alias("split"))
    return P.city_sets(t, X.unseen(s, d))


CITY_SETS = f"""t as (select city, case when pos = 0 then 'train' when pos = 1 and sample_id like '%1' then 'validation' when city like '%7' then 'train' else 'benchmark' end as split from ({X.QUESTIONS})), u as (select n_name as city from nation where n_nationkey % 3 = 0),
g as (select city, bool_or(split = 'validation') as v, bool_or(split = 'benchmark') as b from t group by 1)"""


def _copy(s, d):
    k = C("c_custkey")
    x = X.locations(s, d).select(F.concat(F.lit("images/sat/"), "sample_id", F.lit(".png")).alias("path"), "c_custkey")
    sources = x.select("path", F.explode(F.expr("case c_custkey % 4 when 0 then array(1, 0) when 1 then array(1) when 2 then array(2, 1) else array() end")).alias("dir_ord"))
    return P.copy_manifest(x, sources, x.where(k % 7 == 0))


COPY = f"{L}, m as (select concat('images/sat/', sample_id, '.png') as path, case when c_custkey % 7 = 0 then 'present' when c_custkey % 4 < 3 then 'copied' else 'missing' end as status, case when c_custkey % 7 <> 0 then case c_custkey % 4 when 0 then 0 when 1 then 1 when 2 then 1 end end as dir_ord from l)"


def _packages(s, d):
    q = X.questions(s, d)
    return P.package_variation(q.select(C("city").alias("package"), F.concat_ws("-", "sample_id", "pos").alias("question_id"), F.array(F.concat(F.lit("a/"), "topic"), C("sample_id")).alias("paths")))


def _variants(s, d):
    k = C("c_custkey")
    t = F.array(*map(F.lit, ("camera_direction", "mismatch_binary", "mismatch_mcq", "land_use")))
    q = X.samples(s, d).select("sample_id", "c_custkey", F.explode(t).alias("topic"))
    p = lambda n: F.concat(F.lit("p"), ((k + n) % 60).cast("string"))
    return q.withColumns({"question_id": F.concat_ws("_", "sample_id", "topic"), "arrow_paths": F.when(k % 8 != 0, F.create_map(F.lit("a"), p(0), F.lit("b"), p(1), F.lit("c"), p(2), F.lit("d"), F.when(k % 6 != 0, p(3)))),
                          "binary_variants": F.array(F.struct(F.when(k % 3 == 0, "").otherwise(F.when(k % 3 == 1, p(4))).alias("negative_stv_composite"), F.when(k % 5 != 0, p(5)).alias("composite_stv_path"))),
                          "mcq_variants": F.array(F.struct(p(6).alias("composite_path"), F.lit("A").alias("correct_pos")), F.struct(F.lit("").alias("composite_path"), F.lit("B").alias("correct_pos")))})


def _image_checks(s, d):
    files = s.range(60).where("id % 11 <> 0").select(F.concat(F.lit("p"), C("id").cast("string")).alias("path"), F.explode(F.array(F.lit(0), F.lit(1))).alias("dir_ord"), "id").where("dir_ord = 1 or id % 7 <> 0")
    listing = files.select("path", "dir_ord", F.when(C("dir_ord") == 0, F.when(C("id") % 13 == 0, 5119).otherwise(5120)).otherwise(90000).alias("length"))
    return Y.image_checks(_variants(s, d), listing).select("question_id", "images_ok")


_OK = "case when x % 11 = 0 then false when x % 7 = 0 then true else x % 13 <> 0 end"
_FILE = lambda n: _OK.replace("x %", f"((c_custkey + {n}) % 60) %")
_REC_NUM = "case when c_custkey % 13 = 0 or median_levels is null or median_levels < 2 then null else median_levels - 2 end"

def _split_tagged(s, d):
    q = X.questions(s, d)
    return q.join(split.split_per_city(q.select("sample_id", "city").distinct()).select("sample_id", "split"), "sample_id")


def _scored_topics(s, d):
    n = X.questions(s, d).groupBy("topic").agg(F.count("*").alias("n"), F.count_if(C("value") > 20).alias("correct"))
    return n.withColumn("accuracy", C("correct") / C("n")).withColumn("delta", C("accuracy") - 0.6)


QUERIES = {
    "sample_frame": lambda s, d: reports.sample_frame(_records(s, d)).withColumn("topics_in_sample", F.array_join("topics_in_sample", ",")),
    "question_frame": lambda s, d: reports.question_frame(_records(s, d)),
    "split_report": lambda s, d: reports.split_report(_split_tagged(s, d)),
    "accuracy_lines": lambda s, d: reports.accuracy_lines(_scored_topics(s, d)),
    "question_text": _worded,
    "build_record": _record_fields,
    "promote_record": _promoted,
    "run_summary": lambda s, d: A.run_summary(_records(s, d)).withColumn("n", F.round("n", 6)),
    "viewer_filter": lambda s, d: _filtered(s, d).select(C("_sid").alias("sample_id"), "pos", "topic"),
    "viewer_counts": lambda s, d: A.viewer_counts(A.viewer_filter(_viewer_rows(s, d))),
    "census_gate": lambda s, d: A.census_wanted(X.locations(s, d).withColumn("country", F.when(C("n_nationkey") % 4 == 0, "USA").otherwise(C("country")))).select("sample_id"),
    "unknown_cities": lambda s, d: A.select_cities(X.locations(s, d).select("city").distinct().unionByName(s.createDataFrame([("Atlantis",)], "city string")), X.unseen(s, d))[1],
    "cached_locations": _cache,
    "composite_counts": lambda s, d: A.composite_counts(_variants(s, d).where("topic = 'land_use'").withColumns({"sat_marked_path": F.when(C("c_custkey") % 3 == 0, "p"), "camera_arrow_paths": C("arrow_paths"), "mismatch_mcq_variants": C("mcq_variants"), "mismatch_binary_variants": F.when(C("c_custkey") % 4 == 0, F.slice("binary_variants", 1, 0)).otherwise(C("binary_variants"))})),
    "image_presence": lambda s, d: A.presence(X.samples(s, d), _listing(s, d)),
    "packaged_checks": _suite,
    "check_counts": lambda s, d: P.check_counts(_suite(s, d)),
    "nested_paths": lambda s, d: (lambda t: t.select("question_id", F.array_join(F.array_sort(P.nested_image_paths(t)), ",").alias("paths")))(_tagged(s, d)),
    "city_sets": _city_sets,
    "subset_test": lambda s, d: P.is_subset(X.unseen(s, d), X.samples(s, d).where("c_custkey % 2 = 0").select("city")),
    "copy_manifest": _copy,
    "copy_counts": lambda s, d: P.copy_counts(_copy(s, d)),
    "package_variation": _packages,
    "image_checks": _image_checks,
    "split_counts": lambda s, d: split.split_counts(split.split_per_city(X.locations(s, d))),
    "adjusted_targets": lambda s, d: split.adjusted_targets(X.questions(s, d), 4600),
    "sample_rows": lambda s, d: select.sample_rows(X.locations(s, d), "sample_id", 300).select("sample_id"),
    "enabled_topics": lambda s, d: Q.enabled(X.questions(s, d), FEW).groupBy("topic").agg(F.count("*").alias("n")),
    "option_split": lambda s, d: Q.by_option_count(_asked(s, d).withColumn("options", F.when(C("topic") == "green_space", F.map_filter("options", lambda k, v: k.isin("A", "B"))).otherwise(C("options"))), 2).select("sample_id", "topic"),
    "merge_totals": lambda s, d: M.merge_totals(X.records(s, d)),
    "run_totals": lambda s, d: M.run_totals(X.questions(s, d).withColumn("key", F.when(C("pos") % 3 != 0, C("sample_id")).otherwise(F.when(C("pos") == 0, ""))), "key", "run_ord"),
    "snap_distance": lambda s, d: X.locations(s, d).select("sample_id", F.round(R.snap_distance(C("lat"), C("lon"), F.when(C("c_custkey") % 6 != 0, C("lat") + (C("c_custkey") % 5) / 10000.0), C("lon")), 4).alias("metres")),
    "least_bytes": lambda s, d: X.locations(s, d).select("sample_id", *(F.coalesce(R.large_enough(4990 + C("c_custkey") % 200, k), F.lit(False)).alias(k.replace(" ", "_")) for k in R.LEAST_BYTES)),
    "requests": lambda s, d: X.locations(s, d).select("sample_id", R.wms_request(C("lat"), C("lon"), 100.0, 512, "ORTHO.X").alias("wms"), R.export_request(C("lat"), C("lon"), 250.0, 256).alias("export")),
    "view_paths": lambda s, d: X.samples(s, d).select("sample_id", F.array_join(R.view_paths(C("sample_id"), F.array(F.lit("along_fwd"), F.lit("cross_left"))), ",").alias("views"), F.element_at(R.arrow_paths(C("sample_id")), "cross_right").alias("arrow")),
    "arrow_head": lambda s, d: X.samples(s, d).select("sample_id", *(F.round(R.arrow_head(C("bearing"))[k], 4).alias(k) for k in ("tip_x", "tip_y", "left_x", "left_y", "right_x", "right_y"))),
}
_QT = "concat_ws('_', sample_id, topic, 'phrase')"
_SQ = lambda v: v.replace("'", "''")
_PHRASES = "case topic " + " ".join(f"when '{t}' then [" + ", ".join(f"'{_SQ(x)}'" for x in phrases.PHRASES[t]) + "]" for t in [*TOPICS, *OTHERS]) + " end"
_ASKED = " union all ".join(f"select sample_id, topic, answer from ({_oracle(t)})" for t in TOPICS)
_LABEL = "case land_use when 'residential' then 'Residential' when 'commercial' then 'Commercial & Office' when 'retail' then 'Retail & Shopping' when 'industrial' then 'Industrial & Manufacturing' when 'mixed' then 'Mixed Use' when 'institutional' then 'Public Facilities & Institutions' when 'open_space' then 'Open Space & Recreation' when 'transport' then 'Transportation & Infrastructure' else coalesce(land_use, 'unknown') end"
_AT = f"list_position([{', '.join(repr(t) for t in TOPICS)}], topic)"
_UNION = lambda rows: " union all ".join(rows)
REC = f"{S}, a as ({_ASKED}), an as (select sample_id, count(*) as c from a group by 1), k as (select s.*, c_custkey % 9 <> 0 as sat, c_custkey % 5 as nv, coalesce(c, 0) as asked, {_LABEL} as label from s left join an using (sample_id))"
_SPLIT_Q = f"q as ({X.QUESTIONS}), l as (select distinct sample_id, city from q), {SPLIT[SPLIT.index('b as (select sample_id'):]}, t as (select q.*, split, list_position(['train', 'validation', 'benchmark'], split) - 1 as p from q join s using (sample_id))"
_DIMS = _UNION(f"select p, {k} as d, '{c}' as c, {c} as v from t" for k, c in enumerate(("topic", "difficulty", "land_use", "answer")))
_BOX = "concat_ws('%2C', " + ", ".join(f"cast({x} as varchar)" for x in ("lon - {m} / (111320.0::double * cos(radians(lat)))", "lat - {m} / 111320.0::double", "lon + {m} / (111320.0::double * cos(radians(lat)))", "lat + {m} / 111320.0::double")) + ")"
ORACLE = {
    "sample_frame": f"""with {REC}, g as (select sample_id, string_agg(topic, ',' order by {_AT}) as topics from a group by 1)
select k.sample_id, city, (select any_value(country) from ({X.LOCATIONS}) l where l.city = k.city) as country, nv as sv_count, cast(asked as int) as question_count, coalesce(land_use, 'unknown') as land_use_category, building_count as osm_building_count, amenity_count as osm_amenity_count, {_REC_NUM} as osm_median_building_levels, water_m as osm_water_distance_m,
 transit_stops as osm_transit_stop_count, coalesce(has_park, false) as osm_has_park, coalesce(road_type, 'unknown') as road_type, coalesce(surface, 'unknown') as osm_road_surface, coalesce(junction, 'unknown') as osm_junction_type, 'unknown' as osm_dominant_landuse_raw, coalesce(topics, '') as topics_in_sample from k left join g using (sample_id)""",
    "question_frame": f"with {S}, a as ({_ASKED.replace('topic, answer from', 'topic, answer, difficulty from')}) select sample_id, city, topic, difficulty, answer, 4 as n_options from a join s using (sample_id)",
    "split_report": f"""with {_SPLIT_Q}, x as ({_DIMS}), n as (select p, d, c, v, count(*) as n from x group by all), r as (select *, row_number() over (partition by p, d order by case when d = 1 then case v when 'easy' then 1 when 'medium' then 2 else 3 end end, v) as r, sum(n) over (partition by p, d) as tot from n)
select cast(p * 100000 + (d + 1) * 10000 + r as int) as ord, concat('  ', c, ' ', v, ': ', n, ' (', printf('%.1f', n * 100.0::double / tot), '%)') as line from r union all select p * 100000, concat('[', upper(any_value(split)), ']') from t group by p union all select p * 100000 + 1, concat('  Total questions: ', count(*)) from t group by p
 union all select p * 100000 + 2, concat('  Total locations: ', count(distinct sample_id)) from t group by p union all select p * 100000 + 3, concat('  Cities: ', count(distinct city), ' (', array_to_string(list_sort(list(distinct city)), ', '), ')') from t group by p""",
    "accuracy_lines": f"""with q as ({X.QUESTIONS}), n as (select topic, count(*) as n, count(*) filter (where value > 20) as k from q group by 1), a as (select *, k / cast(n as double) as acc, k / cast(n as double) - 0.6 as dl, row_number() over (order by topic) + 1 as r from n)
select cast(r as int) as ord, concat('| ', topic, ' | ', printf('%.1f', acc * 100), '% | ', k, '/', n, ' | ', case when dl >= 0 then '+' else '' end, printf('%.1f', dl * 100), '% |') as line from a union all select 0, '| Topic | Accuracy | Correct/Total | vs Base |' union all select 1, '|-------|----------|---------------|---------|'""",
    "question_text": f"with {S}, a as (select sample_id, topic from ({_HAVE}) union all select sample_id, t from s, (values ('camera_direction'), ('mismatch_binary'), ('mismatch_mcq')) v(t)) select sample_id, topic, ({_PHRASES})[cast('0x' || substr(md5({_QT}), 1, 8) as bigint) % 10 + 1] as question from a",
    "build_record": f"""with {REC}, g as (select sample_id, string_agg(concat(topic, ':', answer), ',' order by {_AT}) as topics from a group by 1)
select k.sample_id, case when sat and nv > 0 then 'sat+sv' when sat then 'sat_only' else 'sv_only' end as modality, city, '' as hood, concat('images/sat/', k.sample_id, '.png') as satellite, concat('images/sv/', k.sample_id, '_cross_left.jpg') as left_view, cast(null as varchar) as marked, label,
 building_count as buildings, {_REC_NUM} as levels, coalesce(has_park, false) as park, case when c_custkey % 6 = 0 then cast(c_custkey as varchar) end as tract, case when c_custkey % 6 = 0 and c_custkey % 5 >= 2 then c_custkey % 5 - 2 end as income, sat and nv = 4 as whole, nv as views, cast(asked as bigint) as asked,
 cast(case when c_custkey % 10 = 0 then 1 else 0 end as bigint) as n_issues, topics from k left join g using (sample_id)""",
    "promote_record": f"with {REC} select sample_id, building_count as osm_building_count, amenity_count as osm_amenity_count, road_type as highway_type, {_REC_NUM} as osm_median_levels, coalesce(has_park, false) as osm_has_park, bearing as road_bearing, false as has_questions, city, nv as views from k",
    "run_summary": f"""with {REC} select 'total' as section, 'samples' as value, cast(count(*) as double) as n from k union all select 'total', 'valid', count(*) from k where c_custkey % 10 <> 0 union all select 'total', 'satellite', count(*) from k where sat union all select 'total', 'four views', count(*) from k where nv = 4
 union all select 'city', city, count(*) from k group by 2 union all select 'topic', 'land_use', count(*) from k where c_custkey % 3 = 0 union all select 'answer', substr('ABCD', cast(c_custkey % 4 + 1 as int), 1), count(*) from k where c_custkey % 3 = 0 group by 2 union all select 'land use', label, count(*) from k group by 2
 union all select 'questions', 'total', sum(asked) from k union all select 'questions', 'average', round(avg(asked), 6) from k union all select 'questions', 'least', min(asked) from k union all select 'questions', 'most', max(asked) from k union all select 'question topic', topic, count(*) from a group by 2""",
    "viewer_filter": f"with {VIEW_ALL} select sample_id, pos, topic from f",
    "viewer_counts": f"with {VIEW} select count(*) as n, count(*) filter (where topic = 'mismatch_mcq') as mcq, count(*) filter (where topic = 'mismatch_binary' and coalesce(m, false)) as binary_yes, count(*) filter (where topic = 'mismatch_binary' and not coalesce(m, false)) as binary_no, count(*) filter (where topic = 'camera_direction') as camera from v",
    "census_gate": f"with {L} select sample_id from l where n_nationkey % 4 = 0",
    "unknown_cities": f"with {L} select distinct city from l where city not in (select n_name from nation where n_nationkey % 3 = 0) union all select 'Atlantis'",
    "cached_locations": f"with {CACHE} select city, ordinal, sample_id from c where city in (select city from e) and ordinal <= 4 union all select city, ordinal, concat(sample_id, '_new') from o where ordinal <= 4 and city not in (select city from e)",
    "composite_counts": f"with {S} select count(*) filter (where c_custkey % 3 = 0) as dots, count(*) filter (where c_custkey % 8 <> 0) as arrows, count(*) as mcq, count(*) filter (where c_custkey % 4 <> 0) as pairs from s",
    "image_presence": f"with {S} select sample_id, c_custkey % 9 <> 0 as has_sat, cast(c_custkey % 5 as int) as views from s",
    "packaged_checks": f"with {SUITE} select concat('seen_unseen: ', c) as rule, case when bad > 0 then 'FAIL' else 'PASS' end as result, detail from r",
    "check_counts": f"with {SUITE} select case when bad > 0 then 'FAIL' else 'PASS' end as result, count(*) as n from r group by 1",
    "nested_paths": f"with {FLAT} select question_id, concat('images/sat/', sample_id, '.png,images/sv/', sample_id, '/x.jpg') as paths from named",
    "city_sets": f"with {CITY_SETS} select city, 'benchmark' as lacks from g where not b union all select city, 'validation' from g where not v and not b and city in (select city from u)",
    "subset_test": f"with {S}, a as (select n_name as city from nation where n_nationkey % 3 = 0 except select city from s where c_custkey % 2 = 0) select count(*) = 0 as subset, count(*) as missing from a",
    "copy_manifest": f"with {COPY} select * from m",
    "copy_counts": f"with {COPY} select count(*) filter (where status <> 'missing') as copied, count(*) filter (where status = 'missing') as missing from m",
    "package_variation": f"with q as ({X.QUESTIONS}), p as (select city as package, concat('a/', topic) as path from q union select city, sample_id from q) select q.city as package, count(distinct concat_ws('-', sample_id, cast(pos as varchar))) as questions, (select count(*) from p where package = q.city) as images from q group by 1",
    "image_checks": f"""with {S}, c as (select sample_id, c_custkey, {_FILE(0)} as f0, {_FILE(1)} as f1, {_FILE(2)} as f2, {_FILE(3)} as f3, {_FILE(4)} as f4, {_FILE(5)} as f5, {_FILE(6)} as f6 from s)
select concat(sample_id, '_camera_direction') as question_id, c_custkey % 8 = 0 or (f0 and f1 and f2 and f3 and c_custkey % 6 <> 0) as images_ok from c union all select concat(sample_id, '_mismatch_binary'), case when c_custkey % 3 = 1 then f4 when c_custkey % 5 <> 0 then f5 else true end from c
 union all select concat(sample_id, '_mismatch_mcq'), f6 from c union all select concat(sample_id, '_land_use'), null from c""",
    "split_counts": f"with {SPLIT} select city, count(*) as total, count(*) filter (where split = 'benchmark') as benchmark, count(*) filter (where split <> 'benchmark') as remaining, count(*) filter (where split = 'validation') as validation, count(*) filter (where split = 'train') as train from s group by 1",
    "adjusted_targets": f"select topic, count(*) as n, least(4600, count(*)) as target from ({X.QUESTIONS}) group by 1",
    "sample_rows": f"with {L} select sample_id from l order by md5(concat_ws('_', '42', sample_id)), sample_id limit 300",
    "enabled_topics": f"select topic, count(*) as n from ({X.QUESTIONS}) where topic in ('land_use', 'road_type', 'green_space') group by 1",
    "option_split": f"with a as ({_ASKED}) select sample_id, topic from a where topic = 'green_space'",
    "merge_totals": f"with q as ({X.QUESTIONS}) select 'city' as level, city as value, count(distinct sample_id) as n, cast(null as double) as pct from q group by 2 union all select 'topic', topic, count(*), round(count(*) * 100.0::double / sum(count(*)) over (), 4) from q group by 2",
    "run_totals": f"select run_ord, count(*) filter (where pos % 3 <> 0) as total, count(*) filter (where pos % 3 = 0) as skipped from ({X.QUESTIONS}) group by 1",
    "snap_distance": f"with {L}, x as (select *, lat + (c_custkey % 5) / 10000.0::double as rlat from l) select sample_id, case when c_custkey % 6 <> 0 and c_custkey % 5 <> 0 then round(6371000.0 * 2 * asin(sqrt(power(sin((radians(rlat) - radians(lat)) / 2), 2))), 4) end as metres from x",
    "least_bytes": f"with {L}, x as (select sample_id, 4990 + c_custkey % 200 as n from l) select sample_id, n > 5000 as tile_fetch, n >= 5000 as tile_validation, n >= 5000 as view_fetch, n > 5000 as view_validation, n >= 5120 as audit from x",
    "requests": f"""with {L}, b as (select sample_id, {_BOX.format(m=100.0)} as near, {_BOX.format(m=250.0)} as far from l)
select sample_id, concat('SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&LAYERS=ORTHO.X&STYLES=&CRS=CRS%3A84&BBOX=', near, '&WIDTH=512&HEIGHT=512&FORMAT=image%2Fpng') as wms,
 concat('bbox=', far, '&bboxSR=4326&size=256%2C256&imageSR=4326&format=png32&pixelType=U8&noDataInterpretation=esriNoDataMatchAny&interpolation=RSP_BilinearInterpolation&f=image') as export from b""",
    "view_paths": f"with {S} select sample_id, concat('images/sv/', sample_id, '_along_fwd.jpg,images/sv/', sample_id, '_cross_left.jpg') as views, concat('images/arrows/', sample_id, '_cross_right.png') as arrow from s",
    "arrow_head": f"""with {S}, u as (select sample_id, sin(radians(bearing)) as ux, -cos(radians(bearing)) as uy from s), t as (select *, 256 + 80 * ux as tx, 256 + 80 * uy as ty from u)
select sample_id, round(tx, 4) as tip_x, round(ty, 4) as tip_y, round(tx - 16 * ux - 8 * uy, 4) as left_x, round(ty - 16 * uy + 8 * ux, 4) as left_y, round(tx - 16 * ux + 8 * uy, 4) as right_x, round(ty - 16 * uy - 8 * ux, 4) as right_y from t""",
}
