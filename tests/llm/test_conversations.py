import hashlib
import heapq
import re
import zlib
from itertools import product

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terralens.llm import conversations as C

CONVS = "/root/testdata/sf0.01/conversations.parquet"
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = {}
    s = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        k = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        mine += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """Dijkstra over (row, roles so far), least (cost, audit) first: no cost to go and no sharing."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, made = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in made)
        key = (i, roles[-1:] or "-")
        if key in done:
            continue
        done.add(key)
        fits = lambda r: re.fullmatch("s?(ua)*u?", r)
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, made))
            if fault[i] not in ("blank", "duplicate"):
                more = 3 if fault[i] == "truncated" else 0
                if role and fits(roles + role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[0], (*made, (role, text))))
                for r in ("user", "assistant"):
                    if fits(roles + r[0]):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, roles + r[0], (*made, (r, text))))
        for r in ("user", "assistant"):
            if fits(roles + r[0]):
                heapq.heappush(heap, (cost + 3, audit + "I", i, roles + r[0], (*made, (r, ""))))


def brute(found):
    out = []
    for conv, rows in found.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
        f = faults(rows)
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, text = cheapest(rows, f)
        out.append((conv, gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def query(spark, rows):
    d = C.damage(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return sorted(map(tuple, C.report(d, F.col("present")).collect()), key=repr)


def test_matches_brute_force(spark):
    t = pq.read_table(CONVS)
    rows = list(zip(*(t[c].to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True))
    assert query(spark, rows) == brute(damaged(rows))


def test_nulls_and_odd_rows(spark):
    rows = [(None, 1, "user", "a."), (None, 2, None, "b."), (1, None, "user", None), (1, None, "user", None), (1, 3, "", "x."), (1, 9, "Assistant", "x ."), (2, 1, "user", "."), (3, 0, None, None),
            (4, -5, "system", "s."), (4, 5, "system", "s."), (4, 7, "usher", "ends \n"), (5, 1, "a", "x?\t\x0b ")]
    rows += [(6, k, "user", "same.") for k in range(40)] + [(7, k, "user" if k % 3 else "assistant", f"{k}") for k in range(300)]
    assert query(spark, rows) == brute(damaged(rows))


def test_every_short_string(spark):
    """All role and fault strings up to three rows."""
    kinds = [(r, t) for r in ("system", "user", "assistant", "tool") for t in ("ok {}.", "cut {}", " ")]
    rows = []
    for n in range(1, 4):
        for k, picked in enumerate(product(kinds, repeat=n)):
            rows += [(n * 10000 + k, i, r, t.format(i)) for i, (r, t) in enumerate(picked)]
    found = {}
    for c, i, r, t in rows:
        found.setdefault(c, []).append((i, r, t))
    got = C.report(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ABCDEMNOP"), max_size=14))
def test_nodes(symbols):
    node = C.END
    for s in reversed(symbols):
        node = C._node(s, node)
    rows = [(0, {0: "s", 1: "u", 2: "a", 3: "x"}[C.SYMBOLS.index(s) % 4], "") for s in symbols]
    fault = ["blank" if s == "E" else "truncated" if s in "MNOP" else "" for s in symbols]
    assert node[0][0] == cheapest(rows, fault)[0]


def test_clashing_columns_empty_and_long(spark):
    df = spark.createDataFrame([(1, 0, "user", "q" * 3_000_000 + "?", 1, "x"), (1, 1, "assistant", "w " * 1_000_000 + ".", 1, "x")], SCHEMA + ", h int, audit string")
    r = C.report(df).collect()[0]
    assert (r.cost, r.audit) == (0, "KK") and r.repaired_sha256 == hashlib.sha256(("user:" + "q" * 3_000_000 + "?\nassistant:" + "w " * 1_000_000 + ".").encode()).hexdigest()
    assert C.report(df.limit(0)).count() == 0
    gone = C.report(df, F.lit(False)).collect()
    assert [tuple(x) for x in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_a_conversation_over_many_tasks(spark):
    """Its rows are cut into ranges and batches; counts and order hold."""
    rows = [(1, k // 2, "user" if k % 2 else "assistant", f"t{k % 700}.") for k in range(3000)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = C.find_edits(spark.createDataFrame(rows, SCHEMA)).collect()[0]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (r.duplicate, r.gaps, r.blank, r.truncated, len(r.audit) - r.audit.count("I")) == (2300, 0, 0, 0, 3000)


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "a."), (1, 1, "tool", "b."), (2, 0, "system", "only.")], SCHEMA)
    got = sorted(map(tuple, C.repaired(df).collect()))
    sha = {r.conv_id: r.repaired_sha256 for r in C.report(df).collect()}
    for conv in (1, 2):
        assert hashlib.sha256("\n".join(f"{r}:{t}" for c, _, r, t in got if c == conv).encode()).hexdigest() == sha[conv]
