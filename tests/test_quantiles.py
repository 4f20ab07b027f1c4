"""Quantiles by rounds of range counts against ``percentile``."""

import math
import random

from pyspark.sql import functions as F

from terralens.operators import quantiles as Q
from terralens.operators import stats

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def made():
    rnd = random.Random(5)
    rows = [("hot", rnd.gauss(0, 1)) for _ in range(2000)] + [("wide", rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-300, 300)) for _ in range(300)]
    rows += [("ends", v) for v in (-1.7e308, 1.7e308, 0.0, 5e-324, 1e-323, 1.0)] + [("one", 7.0)] * 50 + [(None, float(k % 9)) for k in range(40)] + [("hot", None), ("none", None)]
    rows += [("odd", v) for v in (math.inf, -math.inf, 1.0, 2.0, 2.0, 3.5)] + [("two", 1.0), ("two", 2.0)]
    return rows


def test_rounds_give_what_percentile_gives(spark):
    df = spark.createDataFrame(made(), "g string, v double").repartition(5).cache()
    want = {r.g: r.q for r in df.where("v is not null").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("q")).collect()}
    got = Q.quantiles(df, "v", ["g"], SHARES, held=1, bins=64).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.q == want[r.g] or [repr(x) for x in r.q] == [repr(x) for x in want[r.g]], r.g
    assert {r.g: r.q for r in Q.quantiles(df, "v", ["g"], SHARES).collect() if r.g != "odd"} == {k: v for k, v in want.items() if k != "odd"}
    assert {r.g: r.rows for r in got} == {"hot": 2000, "wide": 300, "ends": 6, "one": 50, None: 40, "odd": 6, "two": 2}


def test_all_rows_are_one_group_and_nan_is_largest(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, math.nan, 1.0, 2.0, math.nan)], "v double")
    (r,) = Q.quantiles(df, "v", [], [0.0, 0.5, 1.0], held=1, bins=4).collect()
    assert r.rows == 5 and r.q[:2] == [1.0, 3.0] and math.isnan(r.q[2])
    assert Q.quantiles(df.limit(0), "v", [], [0.5], held=1).collect() == []


def test_describe_of_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 4), ("a", 4), (None, 2), ("n", None)], "g string, k int")
    got = {r.g: (r.n, r.min, r.max, r.mean, r.q1, r.median, r.q3, r["mode"]) for r in stats.describe(df, "k", "g").collect()}
    assert got == {"a": (4, 1, 4, 2.5, 1.0, 2.5, 4.0, 1), None: (1, 2, 2, 2.0, 2.0, 2.0, 2.0, 2), "n": (0, None, None, None, None, None, None, None)}
    (none,) = stats.describe(df.limit(0), "k").collect()
    assert (none.n, none.min, none.median, none["mode"]) == (0, None, None, None)
