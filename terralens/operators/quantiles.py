"""Exact quantiles by group in buffers of bounded size.

Different values are counted first. Where a group has many, rounds of range counts narrow the interval in which each wanted rank lies: an interval is cut
into bins, bins are counted, and only values of bins that hold a wanted rank go on to the next round. So a task holds the bins of an interval and never the
values of a group. Joins of values with their intervals are salted by the value: a group with most of the rows is many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralens.operators.saving import use_shared_folder

BINS = 1024
#: A group of at most so many different values is one buffer.
HELD = 1 << 16
_SALTS = 16


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join where nulls are keys like others."""
    other = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    same = reduce(lambda a, b: a & b, (left[k].eqNullSafe(other[f"{k}__r"]) for k in keys))
    return left.join(other, same).drop(*(f"{k}__r" for k in keys))


def value_counts(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, value, n) of values that aren't null, saved, as several jobs read it."""
    use_shared_folder(df.sparkSession)
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")).checkpoint()


def _finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin of a value, never less for a larger one: by sign first, then by logarithm while an interval spans more than a factor of ``bins``, then in equal widths. What isn't finite has bins of its own; NaN is the largest, as in Spark's order."""
    inf = float("inf")
    part = lambda x, a, b: F.coalesce((x - a) / F.nullif(b - a, F.lit(0.0)), F.lit(0.0))
    far = F.when(lo > 0, hi / F.nullif(lo, F.lit(0.0)) > bins).otherwise(lo / F.nullif(hi, F.lit(0.0)) > bins)
    log = lambda x: F.when(lo > 0, F.ln(x)).otherwise(-F.ln(-x))
    share = F.when(far, part(log(v), log(lo), log(hi))).otherwise(part(v, lo, hi))
    inner = F.when((lo <= 0) & (hi >= 0), F.signum(v) + 1).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1)))
    return F.when(F.isnan(v), bins + 1).when(v == inf, bins).when(v == -inf, -1).otherwise(inner).cast("int")


def _ranked(counts: DataFrame, ranks: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """(keys, _rank, _v): the value of each 0-based rank. counts: keys, _v, _n."""
    v = F.col("_v")
    node = [*keys, "_node"]
    opened = counts.groupBy(*keys).agg(F.min(_finite(v)).alias("_lo"), F.max(_finite(v)).alias("_hi")).withColumns({"_node": F.lit(0).cast("long"), "_bin": F.lit(0), "_next": F.lit(0).cast("long")})
    rows, ranks, done = counts.withColumns({"_node": F.lit(0).cast("long"), "_bin": F.lit(0)}), ranks.withColumn("_node", F.lit(0).cast("long")), []
    while True:
        salted = opened.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        rows = _joined(rows.withColumn("_salt", F.pmod(F.hash("_v"), F.lit(_SALTS))), salted, [*node, "_bin", "_salt"])
        rows = rows.select(*keys, F.col("_next").alias("_node"), "_v", "_n", _bin(v, F.col("_lo"), F.col("_hi"), bins).alias("_bin")).checkpoint()
        counted = rows.groupBy(*node, "_bin").agg(F.sum("_n").alias("_c"), F.min(_finite(v)).alias("_lo"), F.max(_finite(v)).alias("_hi"), F.min(v).alias("_least"), F.max(v).alias("_most"))
        # a bin's node is the number of the group's rows below it
        upto = F.col("_node") + F.sum("_c").over(Window.partitionBy(*node).orderBy("_bin"))
        counted = counted.withColumn("_upto", upto).withColumn("_next", F.col("_upto") - F.col("_c"))
        hit = _joined(ranks, counted, node).where("_rank >= _next and _rank < _upto").checkpoint()
        one = F.col("_least").eqNullSafe(F.col("_most"))
        done.append(hit.where(one).select(*keys, "_rank", F.col("_least").alias("_v")))
        left = hit.where(~one)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        opened = left.select(*node, "_bin", "_next", "_lo", "_hi").distinct()
        ranks = left.select(*keys, "_rank", F.col("_next").alias("_node"))


def quantiles_of_counts(counts: DataFrame, value: str, by: list[str], shares: list[float], *, held: int = HELD, bins: int = BINS) -> DataFrame:
    """(by, rows, q) from ``value_counts``: q are the quantiles of ``shares`` as doubles, between two values in proportion, as ``percentile`` gives them.

    Groups without a value are not in the counts, so not in the result; a null of ``by`` is a group like others, and NaN is larger than any value.
    """
    c = counts.select(*by, F.col(value).cast("double").alias("_v"), F.col("n").alias("_n"))
    per = c.groupBy(*by).agg(F.sum("_n").alias("rows"), F.count("*").alias("_different"))
    if (per.agg(F.max("_different")).first()[0] or 0) <= held:
        return c.groupBy(*by).agg(F.sum("_n").alias("rows"), F.percentile("_v", F.array(*(F.lit(float(q)) for q in shares)), F.col("_n")).alias("q"))
    place = [(F.col("rows") - 1) * F.lit(float(q)) for q in shares]
    low, high = [F.floor(p).cast("long") for p in place], [F.ceil(p).cast("long") for p in place]
    ranks = per.select(*by, F.explode(F.array_distinct(F.array(*low, *high))).alias("_rank"))
    found = _ranked(c, ranks, by, bins).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    at = lambda k: F.element_at("_at", k)
    between = lambda p, a, b: F.when((a == b) | (at(a) == at(b)), at(a)).otherwise((b - p) * at(a) + (p - a) * at(b))
    return _joined(per, found, by).select(*by, "rows", F.array(*(between(p, a, b) for p, a, b in zip(place, low, high, strict=True))).alias("q"))


def quantiles(df: DataFrame, value: str, by: list[str], shares: list[float], *, held: int = HELD, bins: int = BINS) -> DataFrame:
    """(by, rows, q): exact quantiles of ``value`` in each group; see ``quantiles_of_counts``. Nulls don't count; without ``by``, all rows are one group."""
    if not by:
        return quantiles(df.withColumn("_all", F.lit(0)), value, ["_all"], shares, held=held, bins=bins).drop("_all")
    return quantiles_of_counts(value_counts(df, value, *by), value, by, shares, held=held, bins=bins)
