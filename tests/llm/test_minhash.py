import re

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from terralens.llm import minhash

DOCS = "/root/testdata/sf0.01/documents.parquet"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, percent=85):
    sets = {d: shingles(t) for d, t in rows}
    by, up = {}, {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for d, s in sets.items():
        for e in {e for x in s for e in by[x] if e > d}:
            i = len(s & sets[e])
            if 100 * i >= percent * (len(s) + len(sets[e]) - i):
                a, b = sorted((find(d), find(e)))
                up[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_matches_brute_force(spark):
    docs = spark.read.parquet(DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    t = pq.read_table(DOCS, columns=["doc_id", "text"])
    assert got == brute(zip(*(c.to_pylist() for c in t.columns), strict=True))


def test_edge_cases(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "  \n", 7), (4, "a b", 7), (5, "A  b", 7), (6, "a b c", 7), (7, "x " * 3000, 7), (8, "x " * 5000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (1, 6, True), 7: (1, 7, True), 8: (1, 7, False)}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert {r.doc_id for r in minhash.keep_first(docs).collect()} == {1, 2, 3, 4, 6, 7}


def test_keep_first_whatever_the_id(spark):
    """One row of a group stays, if ids are null or repeated too; rows without words all stay."""
    near = " ".join(f"w{i}" for i in range(100))
    rows = [(None, "a b"), (None, "A b"), (5, "c d"), (5, "c d"), (5, "other text"), (None, f"{near} x"), (None, near), (7, near), (9, "e f"), (8, "E f"), (None, None), (None, ""), (6, ""), (6, "")]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, row int, key string")
    out = minhash.keep_first(docs.repartition(3), percent=80)
    assert out.columns == docs.columns
    got = sorted((str(r.doc_id), (r.text or "").lower()) for r in out.collect())
    by_near = [x for x in got if "w50" in x[1]]
    assert len(by_near) == 1 and by_near[0][0] == "None"
    assert [x for x in got if x not in by_near] == sorted([("None", "a b"), ("5", "c d"), ("5", "other text"), ("8", "e f"), ("None", ""), ("None", ""), ("6", ""), ("6", "")])


def test_large_groups_are_cut_into_blocks(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(60):
        w = list(base)
        for k in range(d % 7):
            w[(d * 13 + k * 31) % 200] = f"e{d}_{k}"
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for block in (8, 256):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, block=block).collect()}
        assert got == want


def test_min_max_values_estimate_similarity():
    rng = np.random.RandomState(0)
    pool = rng.randint(0, 1 << 62, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    sets, off = np.concatenate([a, b]), np.array([0, 2000, 4000])
    bands = minhash.min_max_bands(sets, off, band_rows=1)
    assert bands.shape == (2, 64)
    assert abs((bands[0] == bands[1]).mean() - 0.6) < 0.2


def test_columns_of_other_names_are_ignored(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 3)], "doc_id long, text string, band string, rep long")
    assert minhash.near_duplicates(docs).where(F.col("kept")).count() == 1


def test_large_clusters_of_several_components(spark):
    """Near copies of two texts that share bands but no links, strays that only link to one another, and chains: hubs and blocks lose none of the links."""
    rng = np.random.RandomState(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    base = [word() for _ in range(120)]
    other = base[:70] + [word() for _ in range(50)]
    rows = []
    for d in range(90):
        w = list(base if d % 3 else other)
        for _ in range(d % 4):
            w[rng.randint(120)] = word()
        rows.append((d, " ".join(w)))
    chain = list(base)
    for d in range(100, 130):
        chain[(d * 4) % 120] = word()
        rows.append((d, " ".join(chain)))
    rows += [(200 + d, rows[d][1]) for d in range(0, 90, 9)] + [(5, rows[7][1]), (5, "nothing like it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    unique = {}
    for k, (d, t) in enumerate(rows):
        unique[k] = (d, t)
    by_row = brute([(k, t) for k, (_, t) in unique.items()], 85)
    least = {}
    for k, (_, root) in by_row.items():
        least[root] = min(least.get(root, 10**9), rows[k][0])
    want = sorted((rows[k][0], n, least[root]) for k, (n, root) in by_row.items())
    for block in (4, 16, 500):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, block=block, band_rows=1).collect())
        assert got == want, block
    assert len({c for _, _, c in want}) > 3


def test_blocks_left_pair_all_but_one_component(spark):
    """Every pair of members of different components of a cluster meets in a task; a cluster of one component has no tasks."""
    rows = [(v, 1, v // 25 if v < 75 else v) for v in range(90)] + [(v, 2, 500) for v in range(500, 530)]
    big = spark.createDataFrame([(v, c) for v, c, _ in rows], "v long, cluster long")
    joined = spark.createDataFrame([(v, k * 25 if k < 3 else k) for v, _, k in rows], "id long, component long")
    got = minhash._blocks_left(big, joined, 10).collect()
    assert {r.cluster for r in got} == {1} and {r.v for r in got} == set(range(90))
    place, others = {r.v: r.block for r in got}, {r.v: set(r.others) for r in got}
    kind = {v: (k * 25 if k < 3 else k) for v, _, k in rows}
    for a in range(90):
        for b in range(90):
            if kind[a] != kind[b]:
                assert place[b] in others[a] and place[a] in others[b]
    assert all(place[v] not in others[v] for v in range(75))
