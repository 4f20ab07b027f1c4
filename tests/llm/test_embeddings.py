import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terralens.llm import embeddings as E

VECS = "/root/testdata/sf0.01/embeddings.parquet"
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, least=0.98):
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    links = {k: [] for k in range(len(rows))}
    units = [np.array(v, float) / np.linalg.norm(v) if ok[k] else None for k, (_, v, _) in enumerate(rows)]
    groups = {}
    for k, (_, v, lab) in enumerate(rows):
        if ok[k]:
            groups.setdefault((lab, len(v)), []).append(k)
    for g in groups.values():
        x = np.stack([units[k] for k in g])
        a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
        for i, j in zip(a, b, strict=True):
            links[g[i]].append(g[j])
            links[g[j]].append(g[i])
    low, done = {}, set()
    for k in links:
        if k in done:
            continue
        todo, comp = [k], {k}
        while todo:
            for n in links[todo.pop()]:
                if n not in comp:
                    comp.add(n)
                    todo.append(n)
        done |= comp
        ids = [rows[m][0] for m in comp if rows[m][0] is not None]
        for m in comp:
            low[m] = min(ids, default=None)
    return sorted(((rows[k][0], len(links[k]), low[k], rows[k][0] is not None and rows[k][0] == low[k]) for k in links), key=repr)


def found(spark, rows, parts=3):
    return sorted(map(tuple, E.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()), key=repr)


def test_matches_brute_force(spark):
    t = pq.read_table(VECS)
    rows = list(zip(*(t[c].to_pylist() for c in ("vec_id", "embedding", "label")), strict=True))
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize(("spread", "dim"), [(0.02, 24), (0.06, 24), (0.1, 24), (0.14, 24), (0.15, 600)])
def test_groups_of_all_widths(spark, spread, dim):
    """Groups within a ball, wider than a ball, and so wide that only some pairs are linked: each member's links are as many as brute force finds, but for missed borderline pairs."""
    r = np.random.default_rng(int(spread * 100))
    rows = []
    for g, n in enumerate((60, 25, 3, 2)):
        base = r.normal(size=dim)
        base /= np.linalg.norm(base)
        for _ in range(n):
            noise = r.normal(size=dim)
            rows.append((len(rows), (base + noise / np.linalg.norm(noise) * spread * r.uniform(0.5, 1)).tolist(), g % 2))
    rows += [(1000 + k, r.normal(size=dim).tolist(), 1) for k in range(60)]
    got, want = found(spark, rows), brute(rows)
    total = sum(x[1] for x in want)
    assert 0.99 * total <= sum(x[1] for x in got) <= total
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True)) and [a[2] for a in got] == [b[2] for b in want]


def test_edge_cases(spark):
    v = [1.0, 2.0, 0.5, -1.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, [2 * x for x in v], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0] * 4, 1), (8, [None, 1.0, 1.0, 1.0], 1), (9, [float("nan")] * 4, 1), (10, [float("inf"), 1.0, 0.0, 0.0], 1),
            (11, [], 1), (12, [*v, 0.0], 1), (None, v, 2), (None, [9.0, 0.0, 0.0, 1.0], 2), (13, [-x for x in v], 1), (14, [1e300 * x for x in v], 1), (15, [1e-300 * x for x in v], 1)]
    assert found(spark, rows) == brute([(i, [x * 1e-300 for x in v] if i == 14 else [x * 1e300 for x in v] if i == 15 else v, lab) for i, v, lab in rows])
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"rid": F.lit(1), "head": F.lit(2), "key": F.lit("k"), "ok": F.lit(False)})
    assert sorted(map(tuple, E.near_duplicates(df).collect()), key=repr) == found(spark, rows)
    assert found(spark, rows[:1]) == [(1, 0, 1, True)]
    assert E.near_duplicates(df.limit(0)).count() == 0
    assert found(spark, [(1, None, 1), (2, [0.0], 1)]) == [(1, 0, 1, True), (2, 0, 2, True)]
    long = [1.0, -1.0] * 50_000
    assert found(spark, [(1, long, 1), (2, long, 1), (3, [1.0] * 100_000, 1)]) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_equal_vectors_over_many_tasks(spark):
    """One vector is most of the table; its rows are dealt over tasks and counted, not paired."""
    r = np.random.default_rng(5)
    same = r.normal(size=16).tolist()
    rows = [(k, same if k % 3 else r.normal(size=16).tolist(), 1) for k in range(1500)]
    assert found(spark, rows, 7) == brute(rows)


def test_shared_keys_across_batches():
    import pyarrow as pa

    rows = [(k // 5, k, 0) for k in range(40)] + [(100, 1000, 0), (101, 1001, 0), (102, 1002, 0), (102, 1003, 0), (103, 1004, 0), (104, 1005, 0)]
    for head in ([], [(-1, -1, 0)]):
        for step in (1, 2, 3, 7, 44):
            all_ = head + rows
            batches = [pa.RecordBatch.from_pylist([{"key": k, "rid": r, "t": t} for k, r, t in all_[i : i + step]]) for i in range(0, len(all_), step)]
            got = [tuple(x.values()) for b in E._shared(iter(batches)) for x in b.to_pylist()]
            assert [x[:3] for x in got] == [r for r in all_ if r[0] not in (100, 101, 103)]
            assert step < 44 or [x[3] for x in got if 0 <= x[0] < 8] == [5] * 40
            first = {}
            for k, r, _ in all_:
                first.setdefault(k, r)
            got = [tuple(x.values()) for b in E._heads(iter(batches)) for x in b.to_pylist()]
            assert got == [(r, first[k]) for k, r, _ in all_]


def test_a_wide_group_in_small_blocks(spark, monkeypatch):
    """Members about as far from each other as links go: neither balls nor pairs help, blocks of a bucket count them."""
    monkeypatch.setattr(E, "BLOCK", 16)
    r = np.random.default_rng(11)
    base = r.normal(size=32)
    base /= np.linalg.norm(base)
    rows = []
    for k in range(150):
        noise = r.normal(size=32)
        rows.append((k, (base + noise / np.linalg.norm(noise) * r.uniform(0.09, 0.15)).tolist(), 1))
    got, want = found(spark, rows), brute(rows)
    total = sum(x[1] for x in want)
    assert 0.99 * total <= sum(x[1] for x in got) <= total and all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert [a[2] for a in got] == [b[2] for b in want]
