"""The range join at all latitudes and densities, against a scan of all pairs."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from terralens.operators import spatial


def pairs(samples, elements, metres):
    out = []
    for s, lat, lon in samples:
        dy, dx = metres / 111320.0, metres / (111320.0 * math.cos(math.radians(lat)))
        out += [(s, e) for e, y, x in elements if abs(y - lat) < dy and abs(x - lon) < dx]
    return sorted(out)


def around(rnd, lat, lon, n, metres):
    """Points up to three reaches away, many of them close to the edge of the box."""
    dy, dx = metres / 111320.0, metres / (111320.0 * math.cos(math.radians(lat)))
    at = lambda: rnd.choice([rnd.uniform(-3, 3), rnd.choice([-1, 1]) * rnd.uniform(0.99, 1.01)])
    return [(lat + at() * dy, lon + at() * dx) for _ in range(n)]


@pytest.mark.parametrize("metres", [100.0, 200.0])
@pytest.mark.parametrize("dense", [None, 5, 10_000])
def test_all_latitudes(spark, metres, dense):
    rnd = random.Random(3)
    samples, elements = [], []
    for lat in (0.0, 0.0001, 45.0, 64.0, 70.0, -80.0, 89.9, -89.99):
        for lon in (0.0, -0.001, 121.5, 179.999, -180.0):
            s = around(rnd, lat, lon, 2, metres)
            samples += [(f"{len(samples) + k}", *p) for k, p in enumerate(s)]
            for p in s:
                elements += [(len(elements) + k, *q) for k, q in enumerate(around(rnd, *p, 12, metres))]
    want = pairs(samples, elements, metres)
    s = spark.createDataFrame([*samples, ("none", None, 1.0)], "sample_id string, lat double, lon double")
    e = spark.createDataFrame([*elements, (-1, 2.0, None)], "ord int, lat double, lon double")
    got = spatial.context_pairs(s, e, metres, dense=dense).select("sample_id", "ord").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 200


def test_a_city_in_one_cell_is_many_keys(spark):
    """Half of all elements in one cell, a third of these at one point: no key of the join has more than the limit allows, and no pair is lost."""
    rnd = random.Random(4)
    elements = [(k, 10.0 + rnd.uniform(0, 0.0015), 20.0 + rnd.uniform(0, 0.0015)) for k in range(600)] + [(600 + k, 10.0007, 20.0007) for k in range(300)]
    elements += [(900 + k, rnd.uniform(-60, 60), rnd.uniform(-170, 170)) for k in range(900)]
    samples = [(f"s{k}", 10.0 + rnd.uniform(-0.002, 0.004), 20.0 + rnd.uniform(-0.002, 0.004)) for k in range(40)]
    s = spark.createDataFrame(samples, "sample_id string, lat double, lon double")
    e = spark.createDataFrame(elements, "ord int, lat double, lon double")
    got = spatial.context_pairs(s, e, 200.0, dense=20).select("sample_id", "ord")
    assert sorted(map(tuple, got.collect())) == pairs(samples, elements, 200.0)
    cells = e.withColumns({"_y": F.floor(F.col("lat") / 0.0018), "_x": F.floor(F.col("lon") / 0.002), "_dv": F.pmod(F.floor(F.col("lat") / 0.0018 * 32), F.lit(32)), "_du": F.pmod(F.floor(F.col("lon") / 0.002 * 32), F.lit(32))})
    _, leaves = spatial._leaves(cells, 20)
    leaf = leaves.collect()
    assert len(leaf) > 40 and max(r._parts for r in leaf) >= 15


def test_snap_and_no_points(spark):
    s = spark.createDataFrame([("a", 70.0, 10.0)], "sample_id string, lat double, lon double")
    n = spark.createDataFrame([(1, 0, 70.001, 10.0), (1, 1, 70.0, 10.0015), (2, 0, 70.0, 10.0021)], "way int, pos int, lat double, lon double")
    for dense in (1, None):
        assert [(r.way, r.pos) for r in spatial.snap_to_road(s, n, dense=dense).collect()] == [(1, 0)]
        assert spatial.snap_to_road(s, n.limit(0), dense=dense).count() == 0 and spatial.snap_to_road(s.limit(0), n, dense=dense).count() == 0


def test_thinning_by_cells_keeps_what_the_fold_keeps(spark):
    rnd = random.Random(3)
    def place(n, size):
        return [(k, round(rnd.uniform(-size, size), 5), round(179.99 + rnd.uniform(-size, size), 5)) for k in range(n)]
    rows = [(f"s{k}", place(rnd.randint(0, 60), rnd.choice([0.0003, 0.001, 0.01]))) for k in range(80)]
    rows += [("grid", [(k, k // 9 * 0.0002, k % 9 * 0.0002) for k in range(81)]), ("same", [(k, 1.0, 2.0) for k in range(50)]), ("none", None)]
    df = spark.createDataFrame(rows, "sample_id string, stops array<struct<ord: bigint, lat: double, lon: double>>")
    got = {r.sample_id: r.stops for r in spatial.thinned(df).collect()}
    want = {r.sample_id: r.s for r in df.select("sample_id", spatial.spread_stops(F.col("stops")).alias("s")).collect()}
    assert len(got) == 83 and len(got["same"]) == 1 and got["none"] == []
    assert {k: v for k, v in got.items() if k != "none"} == {k: v for k, v in want.items() if k != "none"}
    odd = spark.createDataFrame([("a", [(1, None, 2.0), (2, 1.0, 2.0), None])], df.schema)
    assert [x.ord for x in spatial.thinned(odd).first().stops] == [2]


def test_a_sample_of_many_stops_takes_linear_time():
    rnd = random.Random(4)
    stops = [{"ord": k, "lat": rnd.uniform(0, 1), "lon": rnd.uniform(0, 1)} for k in range(50000)]
    t = time.monotonic()
    kept = spatial._kept(stops, 0.0002)
    assert time.monotonic() - t < 10 and len(kept) > 45000
