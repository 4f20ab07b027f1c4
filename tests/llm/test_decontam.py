import hashlib
import re

import pyarrow.parquet as pq
import pytest

from terralens.llm import decontam

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    where = {}
    for i, text in items:
        w = words(text)
        m = min(len(w), window)
        for s in range(len(w) - m + 1 if m else 0):
            where.setdefault(tuple(w[s : s + m]), set()).add(str(i))
    sizes = {len(k) for k in where}
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                if (got := where.get(tuple(w[s : s + m]))):
                    found |= got
                    hit |= set(range(s, s + m))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def rows_of(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


@pytest.mark.parametrize("block", [decontam.BLOCK_WORDS, 300])
def test_table(spark, block):
    docs, bench = (pq.read_table(f"{SF}/{t}.parquet", columns=[c, "text"]) for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = brute(*(list(zip(*(c.to_pylist() for c in t.columns), strict=True)) for t in (docs, bench)))
    assert any(w[4] for w in want.values())
    got = decontam.contamination(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"), block_words=block)
    assert rows_of(got) == want


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30))
    docs = [(1, None), (2, ""), (3, "!!"), (4, "Short item"), (5, f"x {long} y"), (6, " ".join(f"w{i}" for i in range(12))), (7, "short ... ITEM " * 3), (8, "z " * 60000 + long), (9, "é1 é1 é1")]
    items = [(7, "short item"), (7, "short item"), (8, long), (9, None), (10, " "), (11, "É1"), (100, "é1 é1")]
    d = spark.createDataFrame([(*r, "q", 1) for r in docs], "doc_id long, text string, items string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(decontam.contamination(d, b)) == brute(docs, items)
    none = decontam.contamination(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated or r.n_items for r in none)
    assert decontam.contamination(d.limit(0), b).count() == 0
    left = decontam.remove_contaminated(d, b)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {1, 2, 3, 6, 8}


@pytest.mark.parametrize("block", [decontam.BLOCK_WORDS, 10])
def test_rows_of_one_id_stay_apart(spark, block):
    """Null and repeated ids, equal lengths, repeated rows: each has its own result, whatever the number of blocks."""
    a, b = (" ".join(f"{c}{i}" for i in range(15)) for c in "ab")
    docs = [(None, a), (None, b), (None, a), (None, b.replace("b1", "c1")), (1, a), (1, a), (1, b), (1, f"x {a}"), (1, None), (1, None), (2, f"{a} {b}")]
    items = [(1, a), (2, b), (3, f"{a} {b}"), (4, "none such")]
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    want = [(d, *brute([(d, t)], items)[d]) for d, t in docs]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in got.collect())


@pytest.mark.parametrize("block", [decontam.BLOCK_WORDS, 10])
def test_contaminated_rows_go_whatever_their_id(spark, block):
    bad = " ".join(f"a{i}" for i in range(15))
    docs = [(None, bad), (None, "clean"), (None, None), (1, bad), (1, "clean too"), (1, None), (2, "clean"), (2, "clean"), (3, f"x {bad}")]
    items = spark.createDataFrame([(1, bad), (2, "none such " * 20)], "item_id long, text string")
    d = spark.createDataFrame([(*r, 1, "k") for r in docs], "doc_id long, text string, row int, key string")
    left = decontam.remove_contaminated(d, items, block_words=block)
    assert left.columns == d.columns
    assert sorted(map(str, left.select("doc_id", "text").collect())) == sorted(map(str, d.where("text is null or text not like '%a1%'").select("doc_id", "text").collect()))


def test_phrase_and_proximity(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat the cat ran"), (2, "cat and the dog"), (3, "mat x x x x cat")], "doc_id long, text string")
    index = decontam.build_index(docs)
    assert sorted(map(tuple, decontam.find_phrase(index, "The cat").collect())) == [(1, 0), (1, 6)]
    assert decontam.find_phrase(index, "").count() == decontam.find_phrase(index, "none such").count() == 0
    assert sorted({r.doc_id for r in decontam.find_near(index, "cat mat", 6).collect()}) == [1, 3]
    assert sorted({r.doc_id for r in decontam.find_near(index, "mat cat", 4).collect()}) == [1]


def test_long_items_and_common_words(spark, monkeypatch):
    """Items that are cut into pieces, and windows of common words in parts, lose nothing."""
    monkeypatch.setattr(decontam, "PIECE_WORDS", 20)
    w = [f"w{k % 7}{k % 11}" for k in range(200)]
    items = [(1, " ".join(w)), (2, " ".join(w[40:60])), (3, "a a a a a a a a a a a a a a"), (None, "the very same")]
    docs = [(1, " ".join(w[13:180])), (2, "a " * 500), (3, " ".join(w[:13])), (4, " ".join(w[30:41])), (5, "x the very same")]
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, [(("" if i is None else i), t) for i, t in items])
    assert rows_of(got) == want


def test_a_real_id_of_the_least_value_stays(spark):
    docs = spark.createDataFrame([(-(1 << 63), "a b"), (None, "c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontam.contamination(docs, items).collect()} == {-(1 << 63): 2, None: 0}


def test_many_places_are_intersected_in_parts(monkeypatch):
    """The same occurrences, whatever number of windows and places are handled at once."""
    import numpy as np
    import pyarrow as pa
    rng = np.random.RandomState(6)
    text = " ".join(f"w{k}" for k in rng.randint(0, 4, 3000))
    seg = next(decontam._segments(decontam._build(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text[:500]])], names=["doc_id", "text"])]))))
    block = decontam.Block.of(["i", "j"], [decontam.term_hashes(text[100:900]).tobytes(), decontam.term_hashes("w1 w2").tobytes()], 5)
    whole = sorted(zip(*(x.tolist() for x in seg.windows(block, block.windows())), strict=True))
    monkeypatch.setattr(decontam, "_WINDOWS", 7)
    monkeypatch.setattr(decontam, "_PLACES", 50)
    assert whole == sorted(zip(*(x.tolist() for x in seg.windows(block, block.windows())), strict=True)) and len(whole) > 1000
