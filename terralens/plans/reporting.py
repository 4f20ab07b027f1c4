"""Queries of statistics, merging, packaging and evaluation, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralens.operators import evaluate as E
from terralens.operators import flatten, merge
from terralens.operators import questions as Qn
from terralens.operators import stats as T
from terralens.plans import fixtures as X
from terralens.plans.asking import _bins
from terralens.plans.asking import _oracle as _ask
from terralens.plans.splits import FLAT

C = F.col
S, Q, L = (f"{n} as ({t})" for n, t in (("s", X.SAMPLES), ("q", X.QUESTIONS), ("l", X.LOCATIONS)))
LETTERS = ["A", "B", "C", "D"]
FIELDS = ["building_count", "median_levels", "has_park", "water_m", "road_type", "surface"]


def _per_sample(s, d):
    return X.questions(s, d).groupBy("sample_id", "city").agg(F.count("*").alias("k"))


def _listing(s, d):
    x = X.locations(s, d)
    dirs = F.explode(F.expr("case c_custkey % 4 when 0 then array(0, 1) when 1 then array(1) when 2 then array(2, 1) else array() end")).alias("dir_ord")
    return x.select(F.concat(F.lit("images/sat/"), "sample_id", F.lit(".png")).alias("path"), dirs, "c_custkey").select("path", "dir_ord", (C("c_custkey") % 9000 + C("dir_ord")).alias("length"))


def _image_records(s, d):
    p = lambda k, v: F.concat(F.lit(f"images/{k}/"), C("sample_id"), F.lit(v))
    return X.locations(s, d).select("sample_id", p("sat", ".png").alias("sat"), F.array(p("sv", "_along_fwd.jpg"), p("sv", "_along_bwd.jpg"), F.lit("other/x.jpg"), F.lit(None).cast("string")).alias("views"), F.create_map(F.lit("A"), p("composites", ".jpg"), F.lit("B"), p("sat", ".png")).alias("options"))


def _predictions(s, d):
    k = C("value").cast("int") + C("pos")
    return flatten.flatten_questions(X.records(s, d)).select("question_id", "topic", "difficulty", C("answer").alias("gold"), F.when(k % 3 == 0, F.concat("answer", F.lit(". because"))).when(k % 3 == 1, "A").alias("predicted"))


def _epochs(s, d):
    q = X.questions(s, d).groupBy("topic", C("run_ord").alias("epoch")).agg(F.round(F.avg((C("value") > 20).cast("int")), 6).alias("accuracy"))
    return E.epoch_deltas(q, 0.25)


def _merged(s, d):
    return merge.last_run_wins(X.questions(s, d).select("sample_id", "run_ord", "pos", "topic", "answer"), "sample_id", ["run_ord", "pos"])


def _tables(s, d):
    return s.read.parquet(f"{d}/conversations.parquet")


def _lengths(s, d):
    return _tables(s, d).groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("n"))


_BINS = {"building_height": ("median_levels", Qn.HEIGHT), "urban_density": ("building_count", Qn.DENSITY), "transit": ("transit_stops", Qn.TRANSIT), "amenity": ("amenity_count", [("0", 0, 0), ("1-4", 1, 4), ("5-19", 5, 19), ("20+", 20, 10**9)])}


def _bin_query(col, bins):
    return lambda s, d: T.binned(X.samples(s, d), Qn._bin(C(col), bins))


QUERIES = {
    "stats_topic_frequency": lambda s, d: T.frequency(X.questions(s, d), "topic"),
    "stats_questions_per_sample": lambda s, d: T.describe(_per_sample(s, d), "k"),
    "stats_questions_per_city": lambda s, d: T.describe(_per_sample(s, d), "k", "city"),
    "stats_questions_cdf": lambda s, d: T.empirical_cdf(_per_sample(s, d), "k"),
    "stats_split_sections": lambda s, d: T.grouping(X.questions(s, d), "topic", "difficulty", "land_use", "answer", "city"),
    "stats_answer_by_topic": lambda s, d: T.row_percent(X.questions(s, d), "topic", "answer", LETTERS),
    "stats_difficulty_by_topic": lambda s, d: T.row_percent(X.questions(s, d), "topic", "difficulty", ["easy", "medium", "hard"]),
    "stats_topic_by_city": lambda s, d: T.row_percent(X.questions(s, d), "city", "topic", X.TOPICS),
    "stats_views_by_city": lambda s, d: X.samples(s, d).groupBy("city").agg(F.count("*").alias("n"), F.round(F.avg((C("streetview_count") >= 4).cast("int")) * 100, 4).alias("full_pct"), F.round(F.avg((C("streetview_count") == 3).cast("int")) * 100, 4).alias("three_pct")),
    "stats_land_use": lambda s, d: T.frequency(X.samples(s, d).where("land_use is not null"), "land_use"),
    "stats_road_types": lambda s, d: T.frequency(X.samples(s, d).withColumn("road_type", F.coalesce("road_type", F.lit("unknown"))), "road_type"),
    "stats_buildings_by_city": lambda s, d: T.describe(X.samples(s, d).where("building_count is not null").withColumn("b", F.least("building_count", F.lit(500))), "b", "city").select("city", "n", "q1", "median", "q3").orderBy(F.desc("median"), "city").limit(15),
    "stats_coverage": lambda s, d: T.coverage(X.samples(s, d), "city", FIELDS),
    "stats_raw_landuse": lambda s, d: T.top_with_rest(X.samples(s, d).where("landuse_raw is not null"), "landuse_raw", 2),
    "stats_sample_summary": lambda s, d: X.samples(s, d).agg(F.count("*").alias("samples"), F.countDistinct("city").alias("cities"), F.countDistinct("land_use").alias("uses"), F.count_if(C("streetview_count") >= 4).alias("full_views")),
    "cooccurrence": lambda s, d: T.cooccurrence(X.questions(s, d)),
    "merge_runs": lambda s, d: _merged(s, d).select("sample_id", "run_ord", "pos", "topic", "answer", C("first_seen.run_ord").alias("first_run"), C("first_seen.pos").alias("first_pos")),
    "merge_stats": lambda s, d: merge.run_counts(X.questions(s, d), "sample_id", "run_ord"),
    "image_manifest": lambda s, d: merge.image_paths(_image_records(s, d)),
    "missing_images": lambda s, d: merge.missing_images(merge.image_paths(_image_records(s, d)), _listing(s, d)),
    "first_match_dir": lambda s, d: merge.first_match(X.locations(s, d).select(F.concat(F.lit("images/sat/"), "sample_id", F.lit(".png")).alias("path")), _listing(s, d)),
    "folder_merge": lambda s, d: merge.folder_merge(_listing(s, d)),
    "topic_accuracy": lambda s, d: E.accuracy(_predictions(s, d)),
    "token_quantiles": lambda s, d: E.floor_quantiles(_lengths(s, d), "n", (0.5, 0.9, 0.95, 0.99)).withColumn("bucket", E.length_bucket(C("value"))),
    "epoch_delta": _epochs,
    "chat_messages": lambda s, d: E.chat_messages(_tables(s, d)).select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"][0]["text"])), "|").alias("dialog")),
    "prompts": lambda s, d: Qn.choice_questions(X.samples(s, d), ["land_use"]).select("sample_id", E.prompt(F.lit("What is it?"), C("options")).alias("prompt")),
    "stats_topic_order": lambda s, d: T.in_order(X.questions(s, d).where("topic <> 'green_space'").groupBy("topic").agg(F.count("*").alias("n")), "topic", ["road_type", "green_space", "land_use"]),
    "stats_answers": lambda s, d: T.answer_distribution(X.questions(s, d).select((C("pos") % 2 * 2 + 2).cast("int").alias("n_options"), F.when(C("answer") != "D", C("answer")).alias("answer"))),
    "stats_questions_histogram": lambda s, d: T.histogram(_per_sample(s, d), "k", 4).withColumn("low", F.round("low", 6)),
    "stats_levels_histogram": lambda s, d: T.histogram(X.samples(s, d), "median_levels", 40).withColumn("low", F.round("low", 6)),
    "stats_buildings_clipped": lambda s, d: T.histogram(X.samples(s, d), "building_count", 40, 150.0).withColumn("low", F.round("low", 6)),
    "stats_height_categories": lambda s, d: T.category_counts(X.samples(s, d), _height(), HEIGHTS),
    "stats_city_ends": lambda s, d: T.ends(X.samples(s, d).groupBy("city").agg(F.count("*").alias("n")), "city", 5),
    "stats_city_mean": lambda s, d: T.city_sample_counts(X.samples(s, d)),
    "stats_summary": lambda s, d: T.summary_lines(X.samples(s, d), X.questions(s, d)),
    "stats_percent_texts": lambda s, d: X.samples(s, d).select("sample_id", T.percent(C("c_custkey") % 50, C("c_custkey") % 3 * 40).alias("pct"), T.thousands(C("c_custkey") * 977).alias("n")),
    "cooccurrence_percent": lambda s, d: T.cooccurrence_percent(X.questions(s, d)),
    "count_order": lambda s, d: T.count_order(X.questions(s, d).groupBy("city").agg(F.count("*").alias("n"), F.min("sample_id").alias("seen")), "seen"),
    "batch_plan": lambda s, d: X.samples(s, d).select("sample_id", E.batch_plan(C("c_custkey") * 97, 6).alias("p")).select("sample_id", "p.*"),
    "against_baseline": lambda s, d: E.against_baseline(_accuracy(s, d), _accuracy(s, d).where("topic < 'm'").withColumn("accuracy", C("accuracy") / 2)),
    "compare_models": lambda s, d: E.compare(_predictions(s, d), _predictions(s, d).withColumn("predicted", F.when(F.expr("ascii(gold) % 2 = 0"), C("gold")).otherwise("A"))),
    "training_images": lambda s, d: _training(s, d).select("sample_id", F.array_join("shown", "|").alias("shown")),
    "training_records": lambda s, d: _training(s, d).select("sample_id", E.training_record(E.prompt(F.lit("Q?"), F.array(F.lit("x"), F.lit("y"))), C("shown"), F.lit("A"), "Answer with a letter.").alias("m")).select(
        "sample_id", F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["role"], F.array_join(F.transform(x["content"], lambda p: F.concat_ws("=", p["type"], F.coalesce(p["text"], p["image"]))), ";"))), "|").alias("said")),
} | {f"stats_{k}_bins": _bin_query(*v) for k, v in _BINS.items()}
HEIGHTS = ["Low-rise (1-3)", "Mid-rise (4-7)", "High-rise (8-20)", "Skyscraper (20+)"]


def _height():
    x = C("median_levels")
    return F.when(x <= 3, HEIGHTS[0]).when(x <= 7, HEIGHTS[1]).when(x <= 20, HEIGHTS[2]).when(x.isNotNull(), HEIGHTS[3])


def _accuracy(s, d):
    return X.questions(s, d).groupBy("topic").agg(F.round(F.avg((C("value") > 20).cast("int")), 6).alias("accuracy"))


def _training(s, d):
    p = lambda v: F.concat("sample_id", F.lit(v))
    x = X.samples(s, d).select("sample_id", F.expr(X.pick("c_custkey % 7", [E.ARROW, E.COMPOSITE, E.BINARY, E.MEGA, "satellite_marked", None, E.COMPOSITE])).alias("image_mode"), p("/main").alias("primary"), p("/sat").alias("satellite"),
                               F.when(C("c_custkey") % 2 == 0, F.array(p("/v1"), p("/v2"))).alias("views"), F.array(p("/n1")).alias("negative"), F.create_map(F.lit("B"), p("/b"), F.lit("A"), p("/a")).alias("options"))
    return x.withColumn("shown", E.shown_images(x))


def _pct(row: str, col: str, values) -> str:
    return f"with {Q} select {row}, " + ", ".join(f"round(count(*) filter (where {col} = '{v}') * 100.0::double / count(*), 4) as {v}" for v in values) + f" from q group by {row}"


def _desc(src: str, v: str, by: str = "") -> str:
    b, g = (f"{by}, ", f"group by {by}") if by else ("", "")
    return f"select {b}count({v}) as n, min({v}) as min, max({v}) as max, round(avg({v}), 4) as mean, round(stddev_samp({v}), 4) as std, round(quantile_cont({v}, 0.25), 4) as q1, round(quantile_cont({v}, 0.5), 4) as median, round(quantile_cont({v}, 0.75), 4) as q3 from {src} {g}"


def _hist(src: str, bins: int) -> str:
    return f"""with v as (select cast(v as double) as v from {src} where v is not null), e as (select min(v) as lo, (max(v) - min(v)) / {bins} as w from v), b as (select unnest(range(0, {bins})) as bin)
select cast(bin as int) as bin, round(lo + bin * w, 6) as low, (select count(*) from v where least(floor((v - lo) / w), {bins - 1}) = bin) as n from b, e"""


_SHOWN = "case c_custkey % 7 when 0 then concat(sample_id, '/a|', sample_id, '/b') when 1 then concat(sample_id, '/sat', VIEWS) when 6 then concat(sample_id, '/sat', VIEWS) when 2 then concat(sample_id, '/sat|', sample_id, '/n1') when 3 then concat(sample_id, '/sat|', sample_id, '/main') else concat(sample_id, '/main') end".replace(
    "VIEWS", "case when c_custkey % 2 = 0 then concat('|', sample_id, '/v1|', sample_id, '/v2') else '' end")
K = f"{Q}, k as (select sample_id, city, count(*) as k from q group by 1, 2)"
LIST = f"{L}, f as (select concat('images/sat/', sample_id, '.png') as path, c_custkey % 9000 + dir_ord as length, dir_ord from (select *, unnest(case c_custkey % 4 when 0 then [0, 1] when 1 then [1] when 2 then [2, 1] else [] end) as dir_ord from l))"
IMG = f"{LIST}, i as (select distinct sample_id, unnest([concat('images/sat/', sample_id, '.png'), concat('images/sv/', sample_id, '_along_fwd.jpg'), concat('images/sv/', sample_id, '_along_bwd.jpg'), concat('images/composites/', sample_id, '.jpg')]) as path from l)"
ORACLE = {
    "stats_topic_frequency": f"with {Q} select topic, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 4) as pct from q group by 1",
    "stats_questions_per_sample": f"with {K}, m as (select k as v, count(*) as c from k group by 1) select *, (select v from m order by c desc, v limit 1) as mode from ({_desc('k', 'k')})",
    "stats_questions_per_city": f"with {K}, m as (select city, k as v, row_number() over (partition by city order by count(*) desc, k) as r from k group by 1, 2) select d.*, m.v as mode from ({_desc('k', 'k', 'city')}) d join m on m.city = d.city and r = 1",
    "stats_questions_cdf": f"with {K}, m as (select k, count(*) as n from k group by 1) select k, n, round(sum(n) over (order by k) / cast(sum(n) over () as double), 6) as cdf from m",
    "stats_split_sections": f"with {Q} " + " union all ".join(f"select '{b}' as dimension, {b} as value, count(*) as n from q group by 2" for b in ("topic", "difficulty", "land_use", "answer", "city")),
    "stats_answer_by_topic": _pct("topic", "answer", LETTERS),
    "stats_difficulty_by_topic": _pct("topic", "difficulty", ["easy", "medium", "hard"]),
    "stats_topic_by_city": _pct("city", "topic", X.TOPICS),
    "stats_views_by_city": f"with {S} select city, count(*) as n, round(avg(cast(streetview_count >= 4 as int)) * 100, 4) as full_pct, round(avg(cast(streetview_count = 3 as int)) * 100, 4) as three_pct from s group by 1",
    "stats_land_use": f"with {S} select land_use, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 4) as pct from s where land_use is not null group by 1",
    "stats_road_types": f"with {S} select coalesce(road_type, 'unknown') as road_type, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 4) as pct from s group by 1",
    "stats_buildings_by_city": f"with {S}, b as (select city, least(building_count, 500) as b from s where building_count is not null) select city, count(*) as n, round(quantile_cont(b, 0.25), 4) as q1, round(quantile_cont(b, 0.5), 4) as median, round(quantile_cont(b, 0.75), 4) as q3 from b group by 1 order by median desc, city limit 15",
    "stats_coverage": f"with {S}, c as (select city, " + ", ".join(f"round(avg(cast({f} is not null and cast({f} as string) not in ('unknown', '') as int)) * 100, 4) as {f}" for f in FIELDS) + f" from s group by 1) select *, round(({' + '.join(FIELDS)}) / {len(FIELDS)}, 4) as mean from c",
    "stats_raw_landuse": f"with {S}, n as (select landuse_raw, count(*) as n, row_number() over (order by count(*) desc, landuse_raw) as r from s where landuse_raw is not null group by 1) select case when r <= 2 then landuse_raw else 'other' end as value, sum(n)::bigint as n, count(*) as values from n group by 1",
    "stats_topic_order": f"with {Q}, n as (select topic, count(*) as n from q where topic <> 'green_space' group by 1) select topic, n, cast(case topic when 'road_type' then 0 when 'land_use' then 2 else row_number() over (partition by topic in ('road_type', 'land_use') order by n desc, topic) + 2 end as int) as place from n",
    "stats_answers": f"with {Q}, n as (select pos % 2 * 2 + 2 as n_options, case when answer <> 'D' then answer end as answer from q) select cast(k as int) as n_options, a as answer, (select count(*) from n where n_options = k and answer = a) as n from (values (4, 'A'), (4, 'B'), (4, 'C'), (4, 'D'), (2, 'A'), (2, 'B')) v(k, a)",
    "stats_questions_histogram": _hist(f"(select count(*) as v from ({X.QUESTIONS}) group by sample_id)", 4),
    "stats_levels_histogram": _hist(f"(select median_levels as v from ({X.SAMPLES}))", 40),
    "stats_buildings_clipped": _hist(f"(select least(building_count, 150) as v from ({X.SAMPLES}) where building_count is not null)", 40),
    "stats_height_categories": f"with {S}, v as (select * from (values ('Low-rise (1-3)', 0), ('Mid-rise (4-7)', 1), ('High-rise (8-20)', 2), ('Skyscraper (20+)', 3)) v(bin, place)), n as (select bin, cast(place as int) as place, (select count(*) from s where case bin when 'Low-rise (1-3)' then median_levels <= 3 when 'Mid-rise (4-7)' then median_levels between 4 and 7 when 'High-rise (8-20)' then median_levels between 8 and 20 else median_levels > 20 end) as n from v) select bin, place, n, round(n * 100.0::double / sum(n) over (), 4) as pct from n",
    "stats_city_ends": f"with {S}, n as (select city, count(*) as n from s group by 1) select * from (select city, n, 'top' as side from n order by n desc, city limit 5) union all select * from (select city, n, 'bottom' from n order by n, city desc limit 5)",
    "stats_city_mean": f"with {S}, n as (select city, count(*) as n from s group by 1) select city, n, round(avg(n) over (), 4) as mean from n",
    "stats_summary": f"""with {Q}, {S}, k as (select count(*) as k from q group by sample_id), t as ({' union all '.join(f"select {8 + 2 + 1000 * i} as base, '{c}' as c, {c} as v, count(*) as n from q group by 3" for i, c in enumerate(('topic', 'difficulty', 'answer')))})
select 0 as ord, concat('Total samples: ', format('{{:,}}', count(*))) as line from s union all select 1, concat('Number of cities: ', format('{{:,}}', count(distinct city))) from s union all select 2, concat('Total questions: ', format('{{:,}}', count(*))) from q union all select 3, concat('Question types: ', format('{{:,}}', count(distinct topic))) from q
 union all select 4, concat('Min: ', min(k)) from k union all select 5, concat('Max: ', max(k)) from k union all select 6, concat('Mean: ', printf('%.2f', avg(k))) from k union all select 7, concat('Median: ', printf('%.0f', median(k))) from k union all select 8, concat('Std: ', printf('%.2f', stddev_samp(k))) from k
 union all select 9, concat('Mode: ', (select k from k group by 1 order by count(*) desc, k limit 1))
 union all select cast(base + row_number() over (partition by c order by n desc, v) as int), concat(c, ' ', v, ': ', format('{{:,}}', n), ' (', printf('%.1f', n * 100.0::double / sum(n) over (partition by c)), '%)') from t""",
    "stats_percent_texts": f"with {S} select sample_id, case when c_custkey % 3 = 0 then '0.0%' else concat(printf('%.1f', c_custkey % 50 * 100.0::double / (c_custkey % 3 * 40)), '%') end as pct, format('{{:,}}', c_custkey * 977) as n from s",
    "cooccurrence_percent": f"with {Q}, t as (select distinct sample_id, topic from q), m as (select count(distinct sample_id) as m from q) select x.topic as a, y.topic as b, count(*) as n, round(count(*) * 100.0::double / max(m), 4) as pct from t x join t y using (sample_id), m group by 1, 2",
    "count_order": f"with {Q} select city, count(*) as n, min(sample_id) as seen from q group by 1",
    "batch_plan": f"with {S}, e as (select sample_id, c_custkey * 97 as n, greatest(1, greatest(8, least(32, c_custkey * 97 // 1000)) // 6) as t from s) select sample_id, cast(t * 6 as int) as effective, cast(t as int) as accumulate, cast(ceil(n / cast(t * 6 as double)) as bigint) as steps from e",
    "against_baseline": f"with {Q}, a as (select topic, round(avg(cast(value > 20 as int)), 6) as accuracy from q group by 1) select topic, accuracy, round(accuracy - case when topic < 'm' then accuracy / 2 else 0 end, 6) as delta from a",
    "compare_models": f"""with {FLAT}, p as (select question_id, case when (cast(floor(value) as int) + pos) % 3 = 0 then true when (cast(floor(value) as int) + pos) % 3 = 1 then answer = 'A' else false end as base_right, answer in ('B', 'D', 'A') as tuned_right from named)
select *, case when base_right = tuned_right then 'same' when tuned_right then 'better' else 'worse' end as change from p""",
    "training_images": f"with {S} select sample_id, {_SHOWN} as shown from s",
    "training_records": f"with {S} select sample_id, concat('system:text=Answer with a letter.|user:text=Q?\nA. x\nB. y', case when {_SHOWN} = '' then '' else concat(';image=', replace({_SHOWN}, '|', ';image=')) end, '|assistant:text=A') as said from s".replace("\\n", "\n"),
    "prompts": f"with x as ({_ask('land_use')}) select sample_id, concat('What is it?\nA. ', split_part(options, '|', 1), '\nB. ', split_part(options, '|', 2), '\nC. ', split_part(options, '|', 3), '\nD. ', split_part(options, '|', 4)) as prompt from x",
    "stats_sample_summary": f"with {S} select count(*) as samples, count(distinct city) as cities, count(distinct land_use) as uses, count(*) filter (where streetview_count >= 4) as full_views from s",
    "cooccurrence": f"with {Q}, t as (select distinct sample_id, topic from q) select x.topic as a, y.topic as b, count(*) as n from t x join t y using (sample_id) group by 1, 2",
    "merge_runs": f"""with {Q}, r as (select *, row_number() over (partition by sample_id order by run_ord desc, pos desc) as last, row_number() over (partition by sample_id order by run_ord, pos) as first from q)
select a.sample_id, a.run_ord, a.pos, a.topic, a.answer, b.run_ord as first_run, b.pos as first_pos from r a join r b on a.sample_id = b.sample_id and a.last = 1 and b.first = 1""",
    "merge_stats": f"with {Q}, r as (select distinct sample_id, run_ord from q), f as (select *, row_number() over (partition by sample_id order by run_ord) as k from r) select run_ord, count(*) filter (where k = 1) as new, count(*) filter (where k > 1) as overwritten from f group by 1",
    "image_manifest": f"with {IMG} select * from i",
    "missing_images": f"with {IMG} select split_part(path, '/', 2) as class, count(distinct path) as n from i where path not in (select path from f) group by 1",
    "first_match_dir": f"with {LIST}, b as (select *, row_number() over (partition by path order by dir_ord) as r from f) select p.path, dir_ord, length from (select concat('images/sat/', sample_id, '.png') as path from l) p left join (select * from b where r = 1) using (path)",
    "folder_merge": f"with {LIST} select path, min(dir_ord) as dir_ord, count(*) - 1 as skipped from f group by 1",
    "topic_accuracy": f"""with {FLAT}, p as (select topic, difficulty, case when (cast(floor(value) as int) + pos) % 3 = 0 then 1 when (cast(floor(value) as int) + pos) % 3 = 1 and answer = 'A' then 1 else 0 end as r from named),
k as (select 'all' as level, 'all' as value, r from p union all select 'topic', topic, r from p union all select 'difficulty', difficulty, r from p) select level, value, count(*) as n, sum(r)::bigint as correct, round(avg(r), 6) as accuracy from k group by 1, 2""",
    "token_quantiles": """with n as (select conv_id, sum(length(text)) as n from conversations group by 1), v as (select list_sort(list(cast(n as bigint))) as x from n)
select share, x[least(cast(floor(len(x) * share) as bigint), len(x) - 1) + 1] as value, case when value <= 8192 then 8192 when value <= 16384 then 16384 else 32768 end as bucket from v, (values (0.5::double), (0.9::double), (0.95::double), (0.99::double)) w(share)""",
    "epoch_delta": f"with {Q}, a as (select topic, run_ord as epoch, round(avg(cast(value > 20 as int)), 6) as accuracy from q group by 1, 2), d as (select *, accuracy - coalesce(lag(accuracy) over (partition by topic order by epoch), 0.25) as x from a) select topic, epoch, accuracy, round(x, 6) as delta, x < -0.02 as fell from d",
    "chat_messages": "select conv_id, count(*) as n, string_agg(case when role is null or text is null then null else role || ':' || text end, '|' order by turn, role, text) as dialog from conversations group by 1",
} | {f"stats_{k}_bins": f"with {S} select bin, count(*) as n from (select {_bins(*v)} as bin from s) where bin is not null group by 1" for k, v in _BINS.items()}
