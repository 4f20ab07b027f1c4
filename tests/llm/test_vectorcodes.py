import hashlib
import math

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from terralens.llm import vectorcodes as V

VECS = "/root/testdata/sf0.01/embeddings.parquet"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Python integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: r[0])
    w = len(order[0][1]) // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    books = [list(b) for b in zip(*(cut(v) for _, v, _ in order[:entries]), strict=True)]
    near = lambda x, b: min((sum((p - q) ** 2 for p, q in zip(x, e, strict=True)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                x = cut(v)[p]
                groups.setdefault(near(x, books[p])[1], []).append(x)
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out, by = [], {}
    for i, v, lab in kept:
        found = [near(x, b) for x, b in zip(cut(v), books, strict=True)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        by[lab] = by.get(lab, 0) + out[-1][3]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, by[lab], sha) for i, lab, c, e in out)


def test_matches_brute_force(spark):
    t = pq.read_table(VECS)
    rows = list(zip(*(t[c].to_pylist() for c in ("vec_id", "embedding", "label")), strict=True))[:200]
    rows = [(i, v, None if i % 11 == 0 else lab) for i, v, lab in rows]
    rows += [(1000, None, 1), (1001, [None] + [0.5] * 63, 1), (-5, [float("nan")] * 64, 1), (-6, [float("inf")] * 64, None), (1002, [0.0] * 64, 1), (1003, rows[3][1], 2)]
    got = V.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 20), st.integers(0, 2**32))
def test_search_finds_the_nearest(w, k, seed):
    r = np.random.default_rng(seed)
    x, e = r.integers(-4, 5, (50, w)), r.integers(-4, 5, (k, w))
    at, best = V.nearest(x, e)
    d = ((x[:, None] - e[None]) ** 2).sum(2)
    assert (at == d.argmin(1)).all() and (best == d.min(1)).all()


def test_edge_cases(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, code int, error string")
    assert V.compress(make([])).count() == 0
    assert V.compress(make([(1, None, "a", 0, ""), (2, [None] * 8, "a", 0, "")])).count() == 0
    rows = [(2, [1.0] * 8, "a", 0, ""), (2, [1.0] * 8, "a", 0, ""), (None, [2.0] * 8, None, 0, ""), (7, [1.0] * 9, "a", 0, ""), (8, [], None, 0, ""), (9, [1e300] + [0.0] * 7, None, 0, "")]
    got = sorted(map(tuple, V.compress(make(rows)).select("vec_id", "code", "error").collect()), key=repr)
    assert len(got) == 6 and (7, None, None) in got and (8, None, None) in got
    assert [r for r in got if r[0] == 2] == [(2, "0000000000000000", 0)] * 2
    # a dimension that eight parts don't divide
    got = V.compress(make([(1, [0.5, 1.5, 2.5], "a", 0, ""), (2, [0.5, 1.5, 9.5], "a", 0, "")])).select("vec_id", "error").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 0)]
    long = [[float(i % 7)] * 40000 for i in range(3)]
    assert V.compress(make([(i, v, "a", 0, "") for i, v in enumerate(long)])).select("error").distinct().collect()[0].error == 0


def test_decode(spark):
    rows = [(i, [i / 4 + j / 64 for j in range(16)], 1) for i in range(12)]
    books = V.fit(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    for r in V.encode(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), books).collect():
        assert max(abs(a - b) for a, b in zip(books.decode(r.code), rows[r.vec_id][1], strict=True)) <= 1 / 4096
