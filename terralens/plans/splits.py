"""Queries of flattening, splitting and leak checks, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralens.operators import flatten, split
from terralens.plans import fixtures as X

FLAT = f"""q as ({X.QUESTIONS}), flat as (select *, row_number() over (partition by sample_id, topic order by pos) - 1 as idx from q),
named as (select *, concat_ws('_', sample_id, topic, cast(idx as string)) as question_id from flat),
renamed as (select * replace (case when topic in ('mismatch_binary', 'mismatch_mcq') then concat(topic, case when difficulty = 'hard' then '_hard' else '_easy' end) else topic end as topic) from named),
deduped as (select * from (select *, row_number() over (partition by sample_id, topic order by md5(concat_ws('_', '42', sample_id, topic, question_id))) as rn from renamed) where rn = 1)"""
L = f"l as ({X.LOCATIONS})"
PICK = """{out} as (select sample_id from (select sample_id, row_number() over (partition by city order by md5(concat_ws('_', '{seed}', sample_id))) as r, count(*) over (partition by city) as n from {src}) where r <= greatest(1, round_even(n * {ratio}, 0)))"""
SPLIT = f"""{L}, {PICK.format(out='b', seed=42, src='l', ratio='0.1')}, rest as (select * from l where sample_id not in (select sample_id from b)), {PICK.format(out='v', seed=43, src='rest', ratio='0.15')},
s as (select sample_id, city, case when sample_id in (select sample_id from b) then 'benchmark' when sample_id in (select sample_id from v) then 'validation' else 'train' end as split from l)"""
SEEN = f"""{L}, {PICK.format(out='b', seed=42, src='l', ratio='0.1')}, u as (select n_name as city from nation where n_nationkey % 3 = 0),
s as (select sample_id, city, case when sample_id in (select sample_id from b) then 'benchmark' when city in (select city from u) then 'validation' else 'train' end as split,
 case when city in (select city from u) then 'unseen' else 'seen' end as city_type from l)"""
TARGET = 300
ALLOC = f"""{FLAT}, n as (select topic, city, land_use, difficulty, answer, count(*) as n from renamed group by all),
t as (select *, sum(n) over (partition by topic) as total from n), f as (select *, floor((n / cast(total as double)) * {TARGET}) as fl, (n / cast(total as double)) * {TARGET} - floor((n / cast(total as double)) * {TARGET}) as frac from t),
k as (select *, {TARGET} - sum(fl) over (partition by topic) as short, row_number() over (partition by topic order by frac desc, city, land_use, difficulty, answer) as rk from f),
alloc as (select topic, city, land_use, difficulty, answer, cast(n as bigint) as n, cast(case when total <= {TARGET} then n else fl + case when rk <= short then 1 else 0 end end as bigint) as take from k)"""
LEAK = f"{FLAT}, tr as (select r.*, m.n_name as distractor_city from renamed r join nation m on m.n_nationkey = r.neg_key), u as (select n_name as city from nation where n_nationkey % 3 = 0)"
COLS = ["question_id", "sample_id", "city", "topic", "difficulty", "answer"]


def _flat(s, d):
    return flatten.flatten_questions(X.records(s, d))


def _renamed(s, d):
    return flatten.rename_mismatch(_flat(s, d))


def _train(s, d):
    names = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("neg_key"), F.col("n_name").alias("distractor_city"))
    return _renamed(s, d).join(names, "neg_key")


def split_pipeline(s, d):
    """Flatten, filter, rename, one per location, split per city, and count."""
    q = flatten.one_per_location(_renamed(s, d).select("question_id", "sample_id", "city", "topic"))
    # every question has its location, so locations come from two columns of the source
    loc = X.questions(s, d).select("sample_id", "city").distinct()
    # locations are counted where their questions are
    per = q.join(split.split_per_city(loc).select("sample_id", "split"), "sample_id").groupBy("sample_id", "city", "split").agg(F.count("*").alias("n"))
    return per.groupBy("city", "split").agg(F.sum("n").alias("n_questions"), F.count("*").alias("n_locations"))


def _overlap(s, d):
    sp = split.split_per_city(X.locations(s, d))
    part = lambda x: sp.where(F.col("split") == x)
    pairs = [("benchmark", "train"), ("benchmark", "validation"), ("train", "validation")]
    out = [split.split_overlap(part(a), part(b)).agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count("*").alias("n")) for a, b in pairs]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _coverage(s, d):
    sp = split.split_seen_unseen(X.locations(s, d), X.unseen(s, d))
    return sp.groupBy("city").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "validation").alias("validation"), F.count_if(F.col("split") == "benchmark").alias("benchmark"))


QUERIES = {
    "split_pipeline": split_pipeline,
    "flatten_questions": lambda s, d: _flat(s, d).select(*COLS, "idx", "pos"),
    "filter_min_views": lambda s, d: flatten.filter_min_views(X.records(s, d)).select("sample_id", F.size("questions").cast("long").alias("n")),
    "view_filter_counts": lambda s, d: flatten.view_filter_counts(X.records(s, d)),
    "remove_topics": lambda s, d: flatten.remove_topics(_flat(s, d), ["water_proximity"]).groupBy("topic").agg(F.count("*").alias("n")),
    "subtype_rename": lambda s, d: _renamed(s, d).select(*COLS),
    "dedup_per_location": lambda s, d: flatten.one_per_location(_renamed(s, d).select(*COLS)),
    "dedup_counts": lambda s, d: _renamed(s, d).groupBy("topic").agg(F.count("*").alias("before"), F.countDistinct("sample_id").alias("after")),
    "benchmark_split": lambda s, d: split.pick_share(X.locations(s, d), 0.10, 42).select("sample_id", "city"),
    "per_city_split": lambda s, d: split.split_per_city(X.locations(s, d)).select("sample_id", "city", "split"),
    "seen_unseen_split": lambda s, d: split.split_seen_unseen(X.locations(s, d), X.unseen(s, d)).select("sample_id", "city", "split", "city_type"),
    "split_fields": lambda s, d: split.split_fields(split.split_per_city(X.locations(s, d)), X.unseen(s, d)).select("sample_id", "split", "city_type", "benchmark_city_type"),
    "unlisted_cities": lambda s, d: split.unlisted_cities(X.locations(s, d), s.read.parquet(f"{d}/nation.parquet").where("n_nationkey % 3 = 1").select(F.col("n_name").alias("city")), X.unseen(s, d)),
    "allocation_table": lambda s, d: split.allocation(_renamed(s, d), TARGET),
    "stratified_downsample": lambda s, d: split.downsample(_renamed(s, d).select(*COLS, "land_use"), TARGET),
    "leak_filter": lambda s, d: split.drop_leaks(_train(s, d), X.unseen(s, d)).select("question_id", "topic", "distractor_city"),
    "leak_audit": lambda s, d: split.leak_audit(_train(s, d), X.unseen(s, d)),
    "split_overlap": _overlap,
    "city_coverage": _coverage,
    "duplicate_ids": lambda s, d: split.duplicate_ids(_flat(s, d)),
}
_C = ", ".join(COLS)
ORACLE = {
    "split_pipeline": f"""with {FLAT}, l as (select distinct sample_id, city from deduped), {SPLIT[len(L) + 2:]}
select deduped.city, split, count(*) as n_questions, count(distinct sample_id) as n_locations from deduped join s using (sample_id) group by 1, 2""",
    "flatten_questions": f"with {FLAT} select {_C}, idx, pos from named",
    "filter_min_views": f"with {FLAT} select sample_id, count(*) as n from q where coalesce(streetview_count, 0) >= 4 group by 1",
    "view_filter_counts": f"with {FLAT} select count(distinct sample_id) as removed_locations, count(*) as removed_questions from q where coalesce(streetview_count, 0) < 4",
    "remove_topics": f"with {FLAT} select topic, count(*) as n from named where topic <> 'water_proximity' group by 1",
    "subtype_rename": f"with {FLAT} select {_C} from renamed",
    "dedup_per_location": f"with {FLAT} select {_C} from deduped",
    "dedup_counts": f"with {FLAT} select topic, count(*) as before, count(distinct sample_id) as after from renamed group by 1",
    "benchmark_split": f"with {SPLIT} select sample_id, city from s where split = 'benchmark'",
    "per_city_split": f"with {SPLIT} select * from s",
    "seen_unseen_split": f"with {SEEN} select * from s",
    "split_fields": f"with {SPLIT}, u as (select n_name as city from nation where n_nationkey % 3 = 0) select sample_id, split, case when city in (select city from u) then 'unseen' else 'seen' end as city_type, case when split = 'benchmark' then case when city in (select city from u) then 'unseen_city' else 'seen_city' end end as benchmark_city_type from s",
    "unlisted_cities": f"with {L} select city, count(*) as n_locations, concat('WARNING: City ', chr(39), city, chr(39), ' not in seen or unseen lists, assigning to train') as warning from l where n_nationkey % 3 = 2 group by 1",
    "allocation_table": f"with {ALLOC} select * from alloc",
    "stratified_downsample": f"""with {ALLOC} select {_C}, land_use from (select r.*, take, row_number() over (partition by topic, city, land_use, difficulty, answer order by md5(concat_ws('_', '42', question_id))) as r
 from renamed r join alloc using (topic, city, land_use, difficulty, answer)) where r <= take""",
    "leak_filter": f"with {LEAK} select question_id, topic, distractor_city from tr where not (topic in ('mismatch_binary_easy', 'mismatch_mcq_easy') and distractor_city in (select city from u))",
    "leak_audit": f"with {LEAK} select topic, count(*) as n, count(*) filter (where distractor_city in (select city from u)) as leaks from tr where topic like 'mismatch%' group by 1",
    "split_overlap": f"with {SPLIT} select a, b, (select count(*) from s x join s y using (sample_id) where x.split = a and y.split = b) as n from (values ('benchmark', 'train'), ('benchmark', 'validation'), ('train', 'validation')) v(a, b)",
    "city_coverage": f"with {SEEN} select city, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'validation') as validation, count(*) filter (where split = 'benchmark') as benchmark from s group by 1",
    "duplicate_ids": f"with {FLAT} select count(question_id) - count(distinct question_id) as surplus, count(*) as n from named",
}
