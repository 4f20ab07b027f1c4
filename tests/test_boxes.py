"""Aggregates of boxes against a scan of all pairs, and that no pair is formed."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terralens.functions import geo
from terralens.operators import boxes, spatial
from tests.test_spatial import around, pairs


@pytest.fixture(scope="module")
def places(spark):
    rnd = random.Random(5)
    samples, elements = [], []
    for lat, lon in ((0.0, 0.0), (45.0, 121.5), (-80.0, 10.0), (89.9, -180.0)):
        samples += [(f"s{len(samples) + k}", round(y, 6), round(x, 6)) for k, (y, x) in enumerate(around(rnd, lat, lon, 12, 200.0))]
        elements += [(len(elements) + k, round(y, 6), round(x, 6)) for k, (y, x) in enumerate(around(rnd, lat, lon, 900, 200.0))]
    # elements of one place, and some exactly on the edge of a box
    elements += [(10_000 + k, 0.0003, 0.0002) for k in range(200)] + [(20_000 + k, samples[k][1] + 200.0 / 111320.0, samples[k][2]) for k in range(12)]
    s = spark.createDataFrame([*samples, ("none", None, 1.0)], "sample_id string, lat double, lon double")
    e = spark.createDataFrame([(o, y, x, None if o % 11 == 0 else f"k{o % 3}" if o % 5 else f"rare{o % 40}") for o, y, x in elements] + [(-1, 2.0, None, "k1")], "ord int, lat double, lon double, kind string")
    return samples, elements, s, e


@pytest.mark.parametrize("dense", [None, 100])
def test_counts_and_first(places, dense):
    samples, elements, s, e = places
    want = {}
    for sid, o in pairs(samples, elements, 200.0):
        if o % 11:
            k = (sid, f"k{o % 3}" if o % 5 else f"rare{o % 40}")
            n, low = want.get(k, (0, o))
            want[k] = (n + 1, min(low, o))
    got = spatial.context_counts(s, e, F.col("kind"), F.col("ord"), 200.0, dense)
    assert {(r.sample_id, r.key): (r.n, r.o) for r in got.collect()} == want and max(n for n, _ in want.values()) > 64
    assert {(r.sample_id, r.key, r.n, r.o) for r in spatial.context_counts(s, e, F.col("kind"), None, 200.0, dense).collect()} == {(*k, n, None) for k, (n, _) in want.items()}


@pytest.mark.parametrize("dense", [None, 100])
def test_nearest(places, dense):
    samples, elements, s, e = places
    at = {o: (y, x) for o, y, x in elements}
    pos = {sid: (y, x) for sid, y, x in samples}
    water, flat = {}, {}
    for sid, o in pairs(samples, elements, 200.0):
        (y, x), (v, u) = pos[sid], at[o]
        a = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
        water[sid] = min(water.get(sid, 1e9), 2 * geo.EARTH_M * math.atan2(math.sqrt(a), math.sqrt(1 - a)))
    for sid, (y, x) in pos.items():
        near = [((v - y) * (v - y) + (u - x) * (u - x), o) for o, (v, u) in at.items() if abs(v - y) <= 0.002 and abs(u - x) <= 0.002]
        if near:
            flat[sid] = min(near)
    got = {r.sample_id: r.m for r in spatial.nearest_m(s, e, 200.0, dense).collect()}
    assert got.keys() == water.keys() and all(abs(got[k] - water[k]) < 1e-6 for k in got)
    roads = e.select(F.col("ord").alias("way"), F.lit(0).alias("pos"), "lat", "lon")
    assert {r.sample_id: (r.d, r.way) for r in spatial.snap_to_road(s, roads, dense=dense).collect()} == flat


def test_what_is_shuffled_is_no_pairs(spark):
    """Twice as many on both sides: the rows that reach the tasks double, where pairs quadruple."""
    def rows(n):
        s = spark.range(n).selectExpr("cast(id as string) sample_id", "id % 97 * 1e-5 as lat", "id % 89 * 1e-5 as lon")
        e = spark.range(20 * n).selectExpr("id as ord", "id % 101 * 1e-5 as lat", "id % 103 * 1e-5 as lon", "'k' as kind")
        got = spatial.context_counts(s, e, F.col("kind"), F.col("ord"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan
        return got.agg(F.count("*"), F.sum("n")).first()
    a, b = rows(200), rows(400)
    assert (a[0], b[0]) == (200, 400) and b[1] > 3.9 * a[1] > 1_000_000


def test_contexts_form_no_pairs(spark):
    """The plan joins no elements with samples, and ties of counts go to the first seen."""
    e = spark.createDataFrame([(3, 0.0, 0.0, "building", "b", 2), (1, 0.0001, 0.0, "building", "a", 5), (2, 0.0, 0.0001, "building", "a", None), (4, 0.0, 0.0, "building", "b", 2), (5, 0.0, 0.0, "building", None, 7), (6, 0.0, 0.0, "road", "", None),
                               (7, 0.001, 0.0, "water", None, None), (8, 0.0, 0.0, "transit", "x", None)], "ord int, lat double, lon double, category string, value string, levels int")
    e = e.withColumns({"roundabout": F.lit(None).cast("boolean"), "bridge": F.col("category") == "road"})
    s = spark.createDataFrame([("a", 0.0, 0.0), ("far", 1.0, 0.0)], "sample_id string, lat double, lon double")
    got = spatial.contexts(s, e)
    assert not [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x and ("_y" in x or "_x" in x)]
    r = {x.sample_id: x for x in got.collect()}
    a, far = r["a"], r["far"]
    assert (a.buildings, a.median_levels, list(a.building_types.items()), a.roads, a.surface, a.has_bridge, a.has_roundabout, a.water_m) == (5, 5.0, [("a", 2), ("b", 2)], 1, None, True, False, 111.2)
    assert (far.buildings, far.median_levels, far.building_types, far.amenity_types, far.water_m) == (0, None, {}, [], None)


def test_thinned_counts_match_pairs(spark):
    """Dense stops with repeated places and places at the edge of the box, at two latitudes; the samples share places, and one has nothing near it."""
    rng = np.random.default_rng(5)
    for south in (10.0, 71.0):
        at = rng.integers(0, 9000, (1500, 2)) / 1e6 + [south, 16.0]
        at = np.concatenate([at, at[:200], at[:1] + [[0.003, 0.0]]])
        stops = [(int(k), float(y), float(x)) for k, (y, x) in zip(rng.permutation(len(at)), at, strict=True)] + [(None, south, 16.0), (-1, None, 16.0)]
        places = [*at[rng.integers(0, len(at), 30)], at[0], at[0], [south + 5, 16.0], [south, float("nan")]]
        samples = [(f"s{k}", float(y), float(x)) for k, (y, x) in enumerate(places)] + [("none", None, None)]
        l, r = spark.createDataFrame(samples, "sample_id string, lat double, lon double"), spark.createDataFrame(stops, "ord long, lat double, lon double")
        got = {x.sample_id: x.n for x in boxes.thinned_counts(l, r, 0.003, 300.0, 0.0002).collect()}
        want = {}
        for k, y, x in samples:
            near = []
            for o, b, a in sorted(s for s in stops if None not in s) if y is not None else []:
                h = math.sin(math.radians(b - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(b)) * math.sin(math.radians(a - x) / 2) ** 2
                if abs(b - y) < 0.003 and abs(a - x) < 0.003 and 6371000.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) <= 300 and not any(abs(b - m) < 0.0002 and abs(a - n) < 0.0002 for m, n in near):
                    near.append((b, a))
            want[k] = len(near)
        assert got == want and max(want.values()) > 50


def test_thinning_holds_few_neighbours(monkeypatch):
    """Clusters that exceed the limits of what is found and held at once."""
    monkeypatch.setattr(boxes.Thinned, "BLOCK", 50)
    monkeypatch.setattr(boxes.Thinned, "HELD", 200)
    rng = np.random.default_rng(6)
    lat, lon = 5 + rng.normal(0, 2e-4, 800), 5 + rng.normal(0, 2e-4, 800)
    t = boxes.Thinned(pa.table({"lat": lat, "lon": lon, "ord": np.arange(800)}), 0.003, 300.0, 0.0002)
    kept = []
    for k in range(800):
        if not any(abs(lat[k] - lat[m]) < 0.0002 and abs(lon[k] - lon[m]) < 0.0002 for m in kept):
            kept.append(k)
    assert t.kept(5.0, 5.0) == kept == t.kept(5.0, 5.0)


def test_transit_makes_no_row_for_each_pair(spark):
    from terralens.plans.catalog import QUERIES

    plan = QUERIES["context_transit"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "rlat" not in plan


@pytest.mark.parametrize("dense, part", [(None, boxes.PART), (150, 40), (20, 7)])
def test_surroundings_match_pairs(spark, places, dense, part):
    """Cells that are split, points that come in parts, samples that are dealt by a hash: what is around a sample is what a scan of all pairs gives."""
    samples, elements, s, e = places
    kind = lambda o: ["building", "amenity", "landuse", "park", "road", "signal", "water", "transit", "odd"][o % 9]
    value = lambda o: None if o % 13 == 0 else "" if o % 17 == 0 else f"v{o // 9 * 7 % 12}"
    level = lambda o: None if o % 4 == 0 else o % 23
    at = {o: (y, x) for o, y, x in elements}
    pos = {sid: (y, x) for sid, y, x in samples}
    near = {sid: [] for sid in [*pos, "none"]}
    for sid, o in pairs(samples, elements, 200.0):
        near[sid].append(o)

    def ranked(found, k):
        n = {}
        for o in sorted(found):
            if kind(o) == k and value(o):
                n[value(o)] = n.get(value(o), 0) + 1
        return sorted(n.items(), key=lambda x: -x[1])  # stable: of equals the one seen first
    want = {}
    for sid, found in near.items():
        has = lambda k: sum(kind(o) == k for o in found)  # noqa: B023, E731
        levels = sorted(level(o) for o in found if kind(o) == "building" and level(o) is not None)
        water = []
        for y, x in (at[o] for o in found if kind(o) == "water"):
            v, u = pos[sid]
            a = math.sin(math.radians(y - v) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(x - u) / 2) ** 2
            water.append(2 * geo.EARTH_M * math.atan2(math.sqrt(a), math.sqrt(1 - a)))
        first = lambda k: (ranked(found, k) or [(None, 0)])[0][0]  # noqa: B023, E731
        want[sid] = (has("building"), float(levels[len(levels) // 2]) if levels else None, ranked(found, "building")[:5], has("amenity"), sorted({value(o) for o in found if kind(o) == "amenity" and value(o)})[:10], first("landuse"), has("park") > 0, first("road"), has("road"),
                     any(kind(o) == "road" and o % 5 == 0 for o in found), any(kind(o) == "road" and o % 7 == 0 for o in found), has("signal") > 0, round(min(water), 1) if water else None)
    rows = spark.createDataFrame([(o, y, x, kind(o), value(o), level(o), o % 5 == 0, o % 7 == 0) for o, y, x in elements] + [(-1, 2.0, None, "road", "a", None, True, True), (-2, float("nan"), 0.0, "road", "a", None, None, None)],
                                 "ord int, lat double, lon double, category string, value string, levels int, roundabout boolean, bridge boolean").repartition(7)
    around = boxes.surroundings
    try:
        boxes.surroundings = lambda *a: around(*a, part)
        found = spatial.contexts(s, rows, 200.0, dense=dense).withColumn("building_types", F.map_entries("building_types"))
        got = {r[0]: (r.buildings, r.median_levels, [tuple(x) for x in r.building_types], r.amenities, r.amenity_types, *r[6:]) for r in found.collect()}
    finally:
        boxes.surroundings = around
    assert got == want and sum(len(w[2]) == 5 for w in want.values()) > 20


def test_dense_cells_shuffle_no_point_to_meet_their_leaves(spark, places):
    """Points were shuffled five times over to find the leaf of a dense cell; leaves are few, so they are brought to the points."""
    _, _, s, e = places
    plan = spatial.context_counts(s, e, F.col("kind"), F.col("ord"), 200.0, 100)._jdf.queryExecution().executedPlan().toString()
    assert "_level#" in plan and "SortMergeJoin" not in plan and not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "_level#" in x]


def test_contexts_shuffle_points_and_samples_once(spark):
    """Lines to be numbered, with their own columns only, then points and samples by cell: no answers by key, and no samples to meet them."""
    import re

    from terralens.plans.catalog import QUERIES

    plan = QUERIES["sample_context"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert sorted(x.split("#")[0] for x in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)) == ["cell", "l_orderkey"]
    below = plan[plan.index("Exchange hashpartitioning(l_orderkey") :]
    assert "611953" not in below[: below.index("FileScan")]
