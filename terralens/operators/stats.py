"""Statistics of questions and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralens.operators import quantiles as Q


def frequency(df: DataFrame, *by: str) -> DataFrame:
    """Counts and percent of all rows."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def grouping(df: DataFrame, *by: str) -> DataFrame:
    """Counts by each of several columns in one pass: (dimension, value, n)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(b).alias("dimension"), F.col(b).cast("string").alias("value")) for b in by))).alias("p")
    return df.select(pairs).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def row_percent(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Percent of each row's total by the values of ``col``, as columns."""
    wide = df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).fillna(0)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return wide.select(row, *(F.round(F.col(v) * 100.0 / F.nullif(total, F.lit(0)), 4).alias(v) for v in values))


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, extremes, mean, deviation, quartiles and the (least) mode of each group. Quartiles and mode come from counts of the different values, which no buffer holds all of."""
    v, keys = F.col(value), list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    counts = Q.value_counts(rows, value, *keys)
    plain = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("std"))
    modes = counts.groupBy(*keys).agg(F.max_by(v, F.struct("n", -v)).alias("mode"))
    parts = plain.unionByName(modes, allowMissingColumns=True).unionByName(Q.quantiles_of_counts(counts, value, keys, [0.25, 0.5, 0.75]).drop("rows"), allowMissingColumns=True)
    out = parts.groupBy(*by).agg(F.coalesce(F.first("n", ignorenulls=True), F.lit(0)).alias("n"), *(F.first(x, ignorenulls=True).alias(x) for x in ("min", "max", "mean", "std", "q", "mode")))
    return out.select(*by, "n", "min", "max", "mean", "std", F.round(F.col("q")[0], 4).alias("q1"), F.round(F.col("q")[1], 4).alias("median"), F.round(F.col("q")[2], 4).alias("q3"), "mode")


def _cumulated(n: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """n (value, n) with ``upto``, the sum up to each value. Values are dealt by range and summed within parts; only the parts' totals meet in one task, so the number of values has no bound."""
    ranged = n.repartitionByRange(parts, value).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p")
    inner = ranged.withColumn("_in", F.sum("n").over(w.orderBy(value)))
    totals = inner.groupBy("_p").agg(F.sum("n").alias("_t"), F.min(value).alias("_first"))
    before = totals.select("_p", (F.sum("_t").over(Window.partitionBy(F.lit(1)).orderBy("_first")) - F.col("_t")).alias("_before"), F.sum("_t").over(Window.partitionBy(F.lit(1))).alias("total"))
    return inner.join(F.broadcast(before), "_p").select(value, "n", (F.col("_before") + F.col("_in")).alias("upto"), "total")


def cumulated(df: DataFrame, value: str) -> DataFrame:
    """(value, n, upto, total) of the different values."""
    return _cumulated(df.groupBy(value).agg(F.count("*").alias("n")), value)


def empirical_cdf(df: DataFrame, value: str) -> DataFrame:
    """Share of rows up to each distinct value."""
    return cumulated(df, value).select(value, "n", F.round(F.col("upto") / F.col("total"), 6).alias("cdf"))


def histogram(df: DataFrame, value: str, bins: int, most: float | None = None) -> DataFrame:
    """(bin, low, n): counts in ``bins`` equal bins from the least to the largest value, which belongs to the last; ``most`` clips. Empty bins count 0."""
    x = F.col(value).cast("double") if most is None else F.least(F.col(value).cast("double"), F.lit(float(most)))
    rows = df.where(F.col(value).isNotNull()).select(x.alias("x"))
    edge = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    e = edge.select(F.struct("lo", ((F.col("hi") - F.col("lo")) / bins).alias("step"))).scalar()
    placed = rows.select(F.when(e["step"] == 0, 0).otherwise(F.least(F.floor((F.col("x") - e["lo"]) / e["step"]), F.lit(bins - 1))).cast("int").alias("bin"))
    step = (F.col("hi") - F.col("lo")) / bins
    all_ = edge.where("lo is not null").select(F.posexplode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin", "_"), "lo", step.alias("step"))
    n = placed.groupBy("bin").agg(F.count("*").alias("n"))
    return all_.join(n, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def in_order(counts: DataFrame, value: str, order: list[str], fill: bool = False) -> DataFrame:
    """counts (value, n) with ``place``: values of ``order`` first, as given, then others by falling count. With ``fill``, values that don't occur count 0 and no others are shown."""
    dim = counts.sparkSession.createDataFrame(list(enumerate(order)), f"place int, {value} string")
    if fill:
        return F.broadcast(dim).join(counts, value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"), "place")
    placed = counts.join(F.broadcast(dim), value, "left")
    rest = F.row_number().over(Window.partitionBy(F.col("place").isNull()).orderBy(F.desc("n"), value)) + len(order) - 1
    return placed.select(value, "n", F.coalesce("place", rest).alias("place"))


def answer_distribution(questions: DataFrame) -> DataFrame:
    """(n_options, answer, n) of questions with four and with two options; letters without an answer count 0."""
    letters = questions.sparkSession.createDataFrame([(4, x) for x in "ABCD"] + [(2, x) for x in "AB"], "n_options int, answer string")
    n = questions.groupBy("n_options", "answer").agg(F.count("*").alias("n"))
    return F.broadcast(letters).join(n, ["n_options", "answer"], "left").select("n_options", "answer", F.coalesce("n", F.lit(0)).alias("n"))


def category_counts(df: DataFrame, label: Column, order: list[str]) -> DataFrame:
    """(bin, n, pct, place) of a label, all of ``order`` in that order; rows without a label don't count."""
    n = in_order(binned(df, label), "bin", order, fill=True)
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / F.nullif(F.sum("n").over(Window.partitionBy(F.lit(1))), F.lit(0)), 4))


def ends(counts: DataFrame, value: str, k: int) -> DataFrame:
    """The ``k`` values of the largest counts and the ``k`` of the smallest: two top-k, no full sort."""
    first = counts.orderBy(F.desc("n"), value).limit(k).withColumn("side", F.lit("top"))
    return first.unionByName(counts.orderBy("n", F.desc(value)).limit(k).withColumn("side", F.lit("bottom")))


def city_sample_counts(samples: DataFrame) -> DataFrame:
    """Samples of each city, and their mean over the cities."""
    n = samples.groupBy("city").agg(F.count("*").alias("n"))
    return n.withColumn("mean", F.round(F.avg("n").over(Window.partitionBy(F.lit(1))), 4))


def cooccurrence_percent(q: DataFrame) -> DataFrame:
    """``cooccurrence`` with the percent of all samples."""
    total = q.agg(F.countDistinct("sample_id")).scalar()
    return cooccurrence(q).select("a", "b", "n", F.round(F.col("n") * 100.0 / total, 4).alias("pct"))


def count_order(counts: DataFrame, seen: str) -> DataFrame:
    """Falling counts; of equal ones the one seen first."""
    return counts.orderBy(F.desc("n"), seen)


def percent(x: Column, total: Column, digits: int = 1) -> Column:
    """Text like ``12.5%``, halves to even; of nothing, ``0.0%``."""
    return F.when(total == 0, f"{0:.{digits}f}%").otherwise(F.format_string(f"%.{digits}f%%", F.bround(x * 100.0 / F.nullif(total, F.lit(0)), digits)))


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def summary_lines(samples: DataFrame, questions: DataFrame) -> DataFrame:
    """(ord, line) of a text summary: scale, questions a sample, and the counts of topics, difficulties and answers. Every line is an aggregate; nothing is collected."""
    per = questions.groupBy("sample_id").agg(F.count("*").alias("k"))
    scale = samples.agg(F.count("*").alias("Total samples"), F.countDistinct("city").alias("Number of cities"))
    asked = questions.agg(F.count("*").alias("Total questions"), F.countDistinct("topic").alias("Question types"))
    spread = per.agg(F.min("k").alias("Min"), F.max("k").alias("Max"), F.avg("k").alias("Mean"), F.percentile("k", F.lit(0.5)).alias("Median"), F.stddev_samp("k").alias("Std"), F.mode("k", True).alias("Mode"))
    decimals = {"Mean", "Std"}
    shown = lambda c: F.format_string("%.2f", c) if c in decimals else F.format_string("%.0f", F.col(c).cast("double")) if c in ("Median",) else thousands(F.col(c))
    parts, at = [], 0
    for frame in (scale, asked, spread):
        lines = F.array(*(F.struct(F.lit(at + k).alias("ord"), F.concat(F.lit(f"{c}: "), shown(c) if c not in decimals else F.format_string("%.2f", F.col(c))).alias("line")) for k, c in enumerate(frame.columns)))
        parts.append(frame.select(F.explode(lines).alias("x")).select("x.*"))
        at += len(frame.columns)
    for label in ("topic", "difficulty", "answer"):
        n = questions.groupBy(label).agg(F.count("*").alias("n"))
        total = F.sum("n").over(Window.partitionBy(F.lit(1)))
        rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), label))
        parts.append(n.select((rank + at).cast("int").alias("ord"), F.concat(F.lit(f"{label} "), F.coalesce(F.col(label), F.lit("?")), F.lit(": "), thousands(F.col("n")), F.lit(" ("), percent(F.col("n"), total), F.lit(")")).alias("line")))
        at += 1000
    return reduce(DataFrame.unionByName, parts)


def binned(df: DataFrame, label: Column) -> DataFrame:
    return df.select(label.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def coverage(df: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """Percent of rows whose field is filled (not null, empty or unknown), and the mean over the fields."""
    each = [F.round(F.avg((F.col(f).isNotNull() & ~F.col(f).cast("string").isin("unknown", "")).cast("int")) * 100, 4).alias(f) for f in fields]
    wide = df.groupBy(by).agg(*each)
    return wide.withColumn("mean", F.round(sum((F.col(f) for f in fields[1:]), F.col(fields[0])) / len(fields), 4))


def cooccurrence(q: DataFrame) -> DataFrame:
    """Samples that have both of two topics; a sample's topics are few and distinct, and are paired in its row."""
    sets = q.groupBy("sample_id").agg(F.collect_set("topic").alias("t"))
    pairs = sets.select(F.explode("t").alias("a"), "t").select("a", F.explode("t").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def top_with_rest(df: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values, and the rest as one with the number of its values: a top-k and one total, so no task holds all values."""
    n = df.groupBy(value).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), value).limit(k).select(F.col(value).alias("value"), "n", F.lit(1).cast("bigint").alias("values"))
    all_ = n.agg(F.sum("n").alias("n"), F.count("*").alias("values"))
    head = top.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("values"))).scalar()
    rest = all_.select(F.lit("other").alias("value"), (F.col("n") - head["n"]).alias("n"), (F.col("values") - head["values"]).alias("values")).where("values > 0")
    return top.unionByName(rest)
