"""Records with nested questions to flat questions, and filters on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralens.functions.text import hash_key

MISMATCH = ("mismatch_binary", "mismatch_mcq")


def flatten_questions(records: DataFrame) -> DataFrame:
    """One row per question, with its parent's attributes, the occurrence of its topic in the record, and an id. Records without questions vanish."""
    parent = [c for c in records.columns if c != "questions"]
    flat = records.select(*parent, F.posexplode("questions").alias("pos", "q")).select(*parent, "pos", "q.*")
    nth = F.row_number().over(Window.partitionBy("sample_id", "topic").orderBy("pos")) - 1
    return flat.withColumn("idx", nth).withColumn("question_id", F.concat_ws("_", "sample_id", "topic", F.col("idx").cast("string")))


def filter_min_views(df: DataFrame, least: int = 4) -> DataFrame:
    return df.where(F.coalesce("streetview_count", F.lit(0)) >= least)


def view_filter_counts(records: DataFrame, least: int = 4) -> DataFrame:
    """Locations and questions that the view filter removes."""
    low = F.coalesce("streetview_count", F.lit(0)) < least
    return records.agg(F.count_if(low).alias("removed_locations"), F.coalesce(F.sum(F.when(low, F.size("questions"))), F.lit(0)).alias("removed_questions"))


def remove_topics(df: DataFrame, topics: list[str]) -> DataFrame:
    return df.where(~F.coalesce("topic", F.lit("unknown")).isin(topics))


def rename_mismatch(df: DataFrame) -> DataFrame:
    """Mismatch topics get _hard or _easy by their difficulty."""
    suffix = F.when(F.col("difficulty") == "hard", "_hard").otherwise("_easy")
    return df.withColumn("topic", F.when(F.col("topic").isin(*MISMATCH), F.concat("topic", suffix)).otherwise(F.col("topic")))


def one_per_location(df: DataFrame, seed: int = 42) -> DataFrame:
    """One question for each location and topic, by hash order: a combined minimum, without ranking."""
    key = hash_key(str(seed), F.col("sample_id"), F.col("topic"), F.col("question_id"))
    return df.groupBy("sample_id", "topic").agg(F.min(F.struct(key.alias("k"), *(F.col(c) for c in df.columns if c not in ("sample_id", "topic")))).alias("m")).select("sample_id", "topic", "m.*").drop("k").select(df.columns)
