"""Selection of the first rows of each group by hash order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralens.functions.text import hash_key

#: Hex digits of the hash that name a bucket.
DIGITS = 3


def same(left: str, right: str, columns: list[str]) -> Column:
    """Join condition on columns of two aliased frames, null being equal to null."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def mark_first(df: DataFrame, group: list[str], key: str, take: Callable[[Column], Column], name: str) -> DataFrame:
    """``df`` with a flag for the rows that are among the first of their group in the order of ``key`` (an md5 text, unique in its group).

    take: how many, from the group's size. Rows are counted by hash bucket; only buckets are ordered within a group, and rows within a bucket, so no
    group, however large, is sorted in one task. One shuffle by group and bucket serves the join and the ranking.
    """
    rows = df.withColumn("_b", F.substring(key, 1, DIGITS))
    each = Window.partitionBy(*group)
    counts = rows.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    cuts = counts.select(*group, "_b", (take(F.sum("_n").over(each)) - F.sum("_n").over(each.orderBy("_b")) + F.col("_n")).alias("_left"))
    ranked = rows.alias("r").join(cuts.alias("c"), same("r", "c", [*group, "_b"])).select("r.*", "c._left").withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(key)))
    return ranked.select(*df.columns, (F.col("_r") <= F.col("_left")).alias(name))


def first_by_hash(df: DataFrame, group: list[str], key: str, quota: DataFrame, take: str = "take", few: bool = False) -> DataFrame:
    """Rows of ``df`` that are among the first ``take`` of their group in the order of ``key`` (an md5 text, unique in its group).

    quota: one row per group; a null of a group column is a value like others. As in ``mark_first``, buckets are counted, and rows are ranked within buckets alone.
    few: few rows are taken in all. Each bucket that is looked into has one of them, so these are sent to all tasks, and other rows aren't shuffled.
    """
    rows = df.withColumn("_b", F.substring(key, 1, DIGITS))
    counts = rows.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_n"))
    cuts = before.alias("b").join(quota.select(*group, F.col(take).alias("_take")).alias("q"), same("b", "q", group)).select("b.*", "q._take").where("_before < _take").select(*group, "_b", (F.col("_take") - F.col("_before")).alias("_left"))
    found = rows.alias("r").join((F.broadcast(cuts) if few else cuts).alias("c"), same("r", "c", [*group, "_b"])).select("r.*", "c._left")
    return found.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(key))).where("_r <= _left").select(df.columns)


def sample_rows(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows without replacement, those of the smallest hashes: the same on every run. A top-k, which keeps k rows a task."""
    return df.orderBy(hash_key(str(seed), F.col(key)), key).limit(k)
