"""Union of runs by key, the last one winning; and image manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_run_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, with the place where the key was first seen: one combined aggregate, no ranking."""
    rest = [c for c in rows.columns if c != key]
    at = F.struct(*order)
    got = rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.max(F.struct(at.alias("at"), F.struct(*rest).alias("row"))).alias("m"), F.min(at).alias("first_seen"))
    return got.select(key, "m.row.*", "first_seen")


def run_counts(rows: DataFrame, key: str, run: str) -> DataFrame:
    """Keys that each run adds, and those that it overwrites."""
    per_run = rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.sort_array(F.collect_set(run)).alias("runs"))
    return per_run.select(F.posexplode("runs").alias("p", run)).groupBy(run).agg(F.count_if(F.col("p") == 0).alias("new"), F.count_if(F.col("p") > 0).alias("overwritten"))


def merge_totals(merged: DataFrame) -> DataFrame:
    """(level, value, n, pct) of merged records (city, questions): samples of each city, and questions of each topic with their share."""
    city = merged.groupBy(F.coalesce("city", F.lit("Unknown")).alias("value")).agg(F.count("*").alias("n")).select(F.lit("city").alias("level"), "value", "n", F.lit(None).cast("double").alias("pct"))
    topic = merged.select(F.explode("questions").alias("q")).groupBy(F.coalesce("q.topic", F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    return city.unionByName(topic.select(F.lit("topic").alias("level"), "value", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 4).alias("pct")))


def run_totals(lines: DataFrame, key: str, run: str) -> DataFrame:
    """Lines of each run with a key, and skipped ones without."""
    good = F.coalesce(F.col(key), F.lit("")) != ""
    return lines.groupBy(run).agg(F.count_if(good).alias("total"), F.count_if(~good).alias("skipped"))


def image_paths(records: DataFrame) -> DataFrame:
    """Distinct (sample_id, path) of all image references below images/; records have scalar, array and map columns of paths."""
    kinds = dict(records.dtypes)
    parts = [F.map_values(c) if kinds[c].startswith("map") else F.col(c) if kinds[c].startswith("array") else F.array(c) for c in records.columns if c != "sample_id"]
    return records.select("sample_id", F.explode(F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts))).alias("path")).where(F.col("path").startswith("images/")).distinct()


def first_match(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """For each path the first folder (dir_ord) that has it, with that file's length; null where none has."""
    best = listing.groupBy("path").agg(F.min(F.struct("dir_ord", "length")).alias("m"))
    return paths.join(best, "path", "left").select(*paths.columns, F.col("m.dir_ord").alias("dir_ord"), F.col("m.length").alias("length"))


def missing_images(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Missing paths by their class, the second part of the path."""
    gone = paths.select("path").distinct().join(listing.select("path").distinct(), "path", "left_anti")
    return gone.groupBy(F.split("path", "/")[1].alias("class")).agg(F.count("*").alias("n"))


def folder_merge(listing: DataFrame) -> DataFrame:
    """Which copy of each path is moved when folders are merged: the first folder's."""
    best = listing.groupBy("path").agg(F.min(F.struct("dir_ord", "length")).alias("m"), F.count("*").alias("copies"))
    return best.select("path", F.col("m.dir_ord").alias("dir_ord"), (F.col("copies") - 1).alias("skipped"))
