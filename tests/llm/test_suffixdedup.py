import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from terralens.llm import suffixdedup
from terralens.llm.induced import common_prefixes, suffix_array


def brute(rows, window=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            if w in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(w)
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest())
    return out


def rows_of(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array(values):
    a = np.array(values, np.uint8)
    b, sa = a.tobytes(), suffix_array(np.array(values, np.uint8))
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    shared = common_prefixes(a, sa, 12)
    for k in range(1, len(b)):
        x, y = b[sa[k] :], b[sa[k - 1] :]
        same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert shared[sa[k]] == min(same, 12)


def test_name_strings_of_many_symbols():
    rng = np.random.RandomState(3)
    words = [rng.randint(97, 123, rng.randint(2, 9)).astype(np.uint8) for _ in range(3000)]
    a = np.concatenate([words[k] for k in rng.randint(0, 3000, 8000)])
    b = a.tobytes()
    assert suffix_array(a).tolist() == sorted(range(len(b)), key=lambda i: b[i : i + 400])


@pytest.mark.parametrize("hot", [suffixdedup.HOT, 1])
def test_table(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    path = "/root/testdata/sf0.01/documents.parquet"
    t = pq.read_table(path, columns=["doc_id", "text"])
    want = brute(list(zip(*(c.to_pylist() for c in t.columns), strict=True)))
    assert sum(w[1] for w in want.values()) > 10000
    assert rows_of(suffixdedup.remove_repeats(spark.read.parquet(path), digest=True)) == want


@pytest.mark.parametrize("hot", [suffixdedup.HOT, 1])
def test_edges(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    line = "All of this line of some length stands in many documents, and it is longer than one hundred bytes in all, é."
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, "a" * 5000), (6, "b" + "a" * 300), (7, line), (8, f"x {line} y"), (9, f"{line}\n{line}"), (10, "é" * 120), (11, "xyz" + "é" * 60), (12, "ab" * 400)]
    rows += [(20 + k, f"{k} {line} {k * 7}") for k in range(40)]
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, n int, lo string")
    assert rows_of(suffixdedup.remove_repeats(docs, digest=True)) == brute(rows)
    kept = {r.doc_id: bytes(r.kept) for r in suffixdedup.remove_repeats(docs).collect()}
    assert kept[7] == line.encode() and kept[8] == b"x  y"
    assert suffixdedup.remove_repeats(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(7, line), (7, line)], "doc_id long, text string")
    assert [r.n_removed for r in suffixdedup.remove_repeats(twice).collect()] == [0, 0]


def test_small_slices_and_shards(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "SHARD_BYTES", 3000)
    rng = np.random.RandomState(5)
    parts = ["".join(chr(97 + x) for x in rng.randint(0, 26, 130)) for _ in range(12)]
    rows = [(d, "".join(parts[k] if rng.rand() < 0.7 else parts[k][: rng.randint(60, 130)] for k in rng.randint(0, 12, 6))) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(suffixdedup.remove_repeats(docs, digest=True)) == brute(rows)


def test_long_positions_choose_the_same_anchors():
    rng = np.random.RandomState(9)
    data = rng.randint(97, 101, 4000).astype(np.uint8)
    off = np.array([0, 1500, 1550, 4000])
    a = suffixdedup.runs(data, off, 100, 24)
    old, suffixdedup._POS_BITS = suffixdedup._POS_BITS, 11
    try:
        b = suffixdedup.runs(data, off, 100, 24)
    finally:
        suffixdedup._POS_BITS = old
    assert sum(a[3]) == sum(b[3]) == 1500 - 99 + 2450 - 99


def test_rows_without_id_stay_whole(spark):
    text = "".join(np.random.RandomState(2).choice(list("abcdefghij "), 330))
    docs = spark.createDataFrame([(None, text), ((1 << 60) + 1, text), ((1 << 60) + 3, text)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffixdedup.remove_repeats(docs.coalesce(1)).collect()}
    assert got == {None: 0, (1 << 60) + 1: 0, (1 << 60) + 3: len(text)}


def place(text):
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).view(np.int64)) if text is not None else 42


def test_several_texts_of_one_id(spark):
    """Texts of one id are documents of their own; a row that repeats id and text is the same document."""
    rng = np.random.RandomState(4)
    text = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    a, b, own = text(1480), text(1480), text(40)
    rows = [(1, a + b), (2, a + own + b), (2, b[:160]), (2, b[:160]), (3, text(300)), (3, own + a[:200]), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = {k: (d, place(t)) for k, (d, t) in enumerate(rows)}
    ranked = sorted({(order[k], t) for k, (_, t) in enumerate(rows)}, key=lambda r: r[0])
    want = brute([(k, t) for k, (_, t) in enumerate(ranked)])
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(docs, digest=True).collect())
    at = {r: k for k, (r, _) in enumerate(ranked)}
    assert got == sorted((d, *want[at[order[k]]]) for k, (d, _) in enumerate(rows))


def test_regular_texts_are_told_apart(spark):
    """A Thue-Morse text and its complement share no window of 100 bytes, but a hash modulo a power of two would make them equal."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    rows = [(1, "".join("ab"[x] for x in bits)), (2, "".join("cd"[x] for x in bits)), (3, "".join("dc"[x] for x in bits))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(suffixdedup.remove_repeats(docs, digest=True)) == brute(rows)


def test_a_task_remembers_what_is_everywhere():
    """A passage that occurs twice in each batch leaves about one open run of each kind in a task, not one for each batch."""
    rng = np.random.RandomState(8)
    line = "".join(rng.choice(list("abcdefghij "), 400))
    batch = lambda k: pa.RecordBatch.from_arrays([pa.array([2 * k, 2 * k + 1]), pa.array([line, line]), pa.array([0, 0])], names=["doc_id", "text", "place"])
    out = list(suffixdedup._find_runs(100, 24)(iter([batch(k) for k in range(30)])))
    kinds = sum(not x for x in out[0].column("done").to_pylist())
    assert sum(not x for b in out for x in b.column("done").to_pylist()) == kinds
    assert {d for b in out for d, x in zip(b.column("doc_id").to_pylist(), b.column("done").to_pylist(), strict=True) if not x} == {0}


def test_an_anchor_with_many_surroundings(spark, monkeypatch):
    """A short boilerplate in ever other surroundings: its runs are dealt over many tasks, and the result is that of brute force."""
    from pyspark.sql import functions as F

    rng = np.random.RandomState(8)
    word = lambda: "".join(chr(97 + c) for c in rng.randint(0, 26, 9))
    rows = [(d, " ".join(word() for _ in range(9)) + " -- the very same forty bytes of notice -- " + " ".join(word() for _ in range(9))) for d in range(1500)]
    rows += [(2000 + d, rows[d * 7][1]) for d in range(40)] + [(3000 + d, rows[d * 5][1][30:170]) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("place"))
    for least, found in ((8, True), (10**9, False)):
        monkeypatch.setattr(suffixdedup, "HOT_RUNS", least)
        monkeypatch.setattr(suffixdedup, "HOT_SAMPLE", 4)
        hot = suffixdedup.hot_anchors(placed, 100, 24)
        assert bool(hot) == found
        assert rows_of(suffixdedup.remove_repeats(docs, digest=True)) == brute(rows)
        if found:
            runs = placed.mapInArrow(suffixdedup._find_runs(100, 24), suffixdedup._RUN)
            sizes = [r["count"] for r in suffixdedup._dealt(runs, hot).repartition(16, "h", "part").groupBy(F.spark_partition_id()).count().collect()]
            before = [r["count"] for r in runs.repartition(16, "h").groupBy(F.spark_partition_id()).count().collect()]
            assert max(sizes) < 1.5 * np.median(sizes) and max(before) > 2 * np.median(before)


def test_windows_of_hot_anchors_carry_no_bytes():
    """A passage that ends in ever other ways: its windows are rows of hashes, and those a task remembers come as ranges."""
    rng = np.random.RandomState(6)
    word = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    same = word(130)
    rows = [((1 << 60) + d, same + word(60)) for d in range(24)]
    texts = dict(rows)
    runs = [{"h": 5, "lo": 0, "n": 91, "hot": True}]
    kind = pa.list_(pa.struct([("h", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("hot", pa.bool_())]))
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([t for _, t in part] + [None]), pa.array([d for d, _ in part] + [None]), pa.array([0] * len(part) + [1]), pa.array([runs] * len(part) + [None], kind)], names=["text", "doc_id", "place", "runs"])
    out = pa.Table.from_batches(list(suffixdedup._contexts(100)(iter([batch(rows[:8]), batch(rows[8:])]))))
    assert out.column("bytes").null_count == out.num_rows
    late = {(d, lo + k) for d, lo, n in zip(*(out.column(c).to_pylist() for c in ("doc_id", "lo", "n")), strict=True) for k in range(n)}
    out = out.sort_by([(c, "ascending") for c in ("key", "doc_id", "place", "lo")])
    for size in (1, 7, out.num_rows):
        got = [b for b in suffixdedup._shards(100)(iter(out.to_batches(max_chunksize=size)))]
        found = [(d, lo + k) for b in got for d, lo, n in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lo", "n")), strict=True) for k in range(n)]
        first, want = {}, set()
        for d, t in rows:
            for k in range(91):
                if first.setdefault(texts[d][k : k + 100], (d, k)) != (d, k):
                    want.add((d, k))
        assert set(found) == want and len(found) == len(want) and late <= want


def test_names_are_sorted_by_doubling():
    from terralens.llm.induced import _doubled

    rng = np.random.RandomState(4)
    for s in (rng.randint(1, 900, 3000), np.tile(rng.randint(1, 900, 70), 30), np.ones(500, np.int64), rng.randint(1, 3, 1200)):
        s = np.append(s, 0)
        assert _doubled(s).tolist() == sorted(range(len(s)), key=lambda k: s[k:].tolist())
