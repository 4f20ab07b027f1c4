"""Leak-free splits of locations, and stratified downsampling of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralens.functions.text import hash_key
from terralens.operators.select import first_by_hash, mark_first

STRATA = ["city", "land_use", "difficulty", "answer"]
#: Up to so many rows a topic, the buckets of the rows that are taken are sent to all tasks.
FEW = 5000


def _share(ratio: float):
    """max(1, round-half-even(n * ratio)) of a city's n locations."""
    return lambda n: F.greatest(F.lit(1), F.bround(n * F.lit(ratio)).cast("int"))


def mark_share(locations: DataFrame, ratio: float, seed: int, name: str) -> DataFrame:
    keyed = locations.withColumn("_k", hash_key(str(seed), F.col("sample_id")))
    return mark_first(keyed, ["city"], "_k", _share(ratio), name).drop("_k")


def pick_share(locations: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Per city, the first max(1, round-half-even(n * ratio)) locations in hash order."""
    return mark_share(locations, ratio, seed, "_picked").where("_picked").select(locations.columns)


def split_per_city(locations: DataFrame, bench: float = 0.10, val: float = 0.15, seed: int = 42) -> DataFrame:
    """locations with split: benchmark, then validation from the rest (seed + 1), then train. Benchmark rows order last, in a group of their own."""
    marked = mark_share(locations, bench, seed, "_bench")
    keyed = marked.withColumn("_k", hash_key(str(seed + 1), F.col("sample_id")))
    both = mark_first(keyed, ["city", "_bench"], "_k", _share(val), "_val")
    split = F.when(F.col("_bench"), "benchmark").when(F.col("_val"), "validation").otherwise("train")
    return both.select(*locations.columns, split.alias("split"))


def split_counts(split: DataFrame) -> DataFrame:
    """Locations of each city: all, benchmark, what remains of them, validation and train."""
    n = lambda s: F.count_if(F.col("split") == s)
    return split.groupBy("city").agg(F.count("*").alias("total"), n("benchmark").alias("benchmark"), F.count_if(F.col("split") != "benchmark").alias("remaining"), n("validation").alias("validation"), n("train").alias("train"))


def split_seen_unseen(locations: DataFrame, unseen: DataFrame, bench: float = 0.10, seed: int = 42) -> DataFrame:
    """The benchmark as above; of the rest, unseen cities (a dimension: city) go to validation, all others to train."""
    new = unseen.select("city", F.lit(True).alias("u")).distinct()
    split = F.when(F.col("_bench"), "benchmark").when(F.col("u"), "validation").otherwise("train")
    return (mark_share(locations, bench, seed, "_bench").join(new, "city", "left")
            .select(*locations.columns, split.alias("split"), F.when(F.col("u"), "unseen").otherwise("seen").alias("city_type")))


def split_fields(split: DataFrame, unseen: DataFrame) -> DataFrame:
    """Rows of any split (city, split) with city_type, and benchmark_city_type (seen_city or unseen_city; null outside the benchmark)."""
    new = unseen.select(F.col("city").alias("_city")).where("city is not null").distinct()
    kind = F.when(F.col("_city").isNotNull(), "unseen").otherwise("seen")
    keep = [c for c in split.columns if c not in ("city_type", "benchmark_city_type")]
    return split.join(new, F.col("city") == F.col("_city"), "left").select(*keep, kind.alias("city_type"), F.when(F.col("split") == "benchmark", F.concat(kind, F.lit("_city"))).alias("benchmark_city_type"))


def unlisted_cities(locations: DataFrame, seen: DataFrame, unseen: DataFrame) -> DataFrame:
    """Cities in neither list (dimensions: city), whose locations go to train, with a line of warning: city, n_locations, warning."""
    listed = seen.select("city").unionByName(unseen.select("city")).where("city is not null").distinct()
    n = locations.where("city is not null").groupBy("city").agg(F.count("*").alias("n_locations"))
    return n.join(listed, "city", "left_anti").withColumn("warning", F.concat(F.lit("WARNING: City '"), "city", F.lit("' not in seen or unseen lists, assigning to train")))


def _allocated(n: DataFrame, target: int) -> DataFrame:
    """n: rows of each stratum. Adds ``take``."""
    t = Window.partitionBy("topic")
    exact = (F.col("n") / F.col("total")) * F.lit(target)
    n = n.withColumn("total", F.sum("n").over(t)).withColumn("floor", F.floor(exact)).withColumn("frac", exact - F.col("floor"))
    rank = F.row_number().over(t.orderBy(F.desc("frac"), *STRATA))
    n = n.withColumn("short", F.lit(target) - F.sum("floor").over(t)).withColumn("rank", rank)
    take = F.when(F.col("total") <= target, F.col("n")).otherwise(F.col("floor") + F.when(F.col("rank") <= F.col("short"), 1).otherwise(0))
    return n.select("topic", *STRATA, "n", take.cast("bigint").alias("take"))


def allocation(df: DataFrame, target: int) -> DataFrame:
    """Largest-remainder allocation of ``target`` rows a topic over its strata; a topic of fewer rows keeps all."""
    return _allocated(df.groupBy("topic", *STRATA).agg(F.count("*").alias("n")), target)


def adjusted_targets(df: DataFrame, target: int, by: str = "topic") -> DataFrame:
    """What can be asked of each topic: the target, or all its rows if they are fewer."""
    return df.groupBy(by).agg(F.count("*").alias("n")).select(by, "n", F.least(F.lit(target).cast("bigint"), "n").alias("target"))


def downsample(df: DataFrame, target: int, seed: int = 42) -> DataFrame:
    keyed = df.withColumn("_k", hash_key(str(seed), F.col("question_id")))
    return first_by_hash(keyed, ["topic", *STRATA], "_k", allocation(df, target), few=target <= FEW).select(df.columns)


def drop_leaks(train: DataFrame, unseen: DataFrame) -> DataFrame:
    """Easy mismatch questions whose distractor city is unseen go; distractor_city is compared, other topics pass."""
    bad = unseen.select(F.col("city").alias("_bad")).where("city is not null").distinct()
    easy = F.coalesce(F.col("topic").isin("mismatch_binary_easy", "mismatch_mcq_easy"), F.lit(False))
    return train.join(bad, F.col("distractor_city") == F.col("_bad"), "left").where(~easy | F.col("_bad").isNull()).select(train.columns)


def leak_audit(train: DataFrame, unseen: DataFrame) -> DataFrame:
    """Leaking questions by topic."""
    bad = unseen.select(F.col("city").alias("distractor_city"), F.lit(1).alias("leak")).distinct()
    return (train.where(F.col("topic").like("mismatch%")).join(bad, "distractor_city", "left")
            .groupBy("topic").agg(F.count("*").alias("n"), F.count("leak").alias("leaks")))


def split_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("sample_id").intersect(b.select("sample_id"))


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Rows whose id an other row has, less one for each such id, and all rows."""
    n = id_counts(df, "question_id").agg(F.sum("surplus").alias("surplus"), F.sum("n").alias("n"))
    return n.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in n.columns))


def id_counts(df: DataFrame, key: str) -> DataFrame:
    """n and surplus (n - 1; 0 for null, which is no id) of each value of a key that is mostly unique. Ids are dealt before they are counted, as counting first would hold all of a task's, and few bytes of them fill no task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = df.select(key).repartition(parts, key).groupBy(key).agg(F.count("*").alias("n"))
    return n.select("n", F.when(F.col(key).isNull(), 0).otherwise(F.col("n") - 1).alias("surplus"))
