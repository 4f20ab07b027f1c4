"""Words that a hash modulo a power of two can't tell apart, through every operator that hashes words."""

import test_decontam
import test_minhash
import test_quality_langid
from hypothesis import given, settings
from hypothesis import strategies as st

from terralens.llm import decontam, linear, minhash, quality
from terralens.llm import textkernel as K


def thue(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


ONE, TWO = thue(1024), thue(1024, "b", "a")
LONG, OTHER = thue(2048, "c", "d"), thue(2048, "d", "c")


@settings(max_examples=30, deadline=None)
@given(st.integers(7, 12), st.text("xyz é", max_size=9), st.text("xyz é", max_size=9))
def test_spans_of_equal_hash_are_equal(k, before, after):
    import numpy as np
    a, b = thue(1 << k), thue(1 << k, "b", "a")
    raw = f"{before}{a} {b} {a}{after}".encode()
    data, s = np.frombuffer(raw, np.uint8), len(before.encode())
    n = 1 << k
    h = K.span_hash(K.prefix_hash(data), np.array([s, s + n + 1, s + 2 * n + 2]), np.array([s + n, s + 2 * n + 1, s + 3 * n + 2]))
    assert h[0] == h[2] != h[1]


def test_near_duplicates(spark):
    rows = [(1, f"{ONE} x y z w {LONG}"), (2, f"{TWO} x y z w {LONG}"), (3, f"{ONE} x y z w {OTHER}"), (4, ONE), (5, TWO), (6, ONE), (7, LONG), (8, OTHER)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == test_minhash.brute(rows)


def test_decontamination(spark):
    docs, items = [(1, f"q {TWO} r {LONG}"), (2, f"{ONE} {OTHER}"), (3, ONE)], [(1, ONE), (2, OTHER), (3, f"{TWO} r")]
    got = test_decontam.rows_of(decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == test_decontam.brute(docs, items)


def test_quality_counts(spark):
    texts = [f"{ONE}\n{TWO}\n{ONE}\n", f"x {ONE} y x {TWO} y", f"x {ONE} y x {ONE} y", f"{LONG}\n{OTHER}"]
    model = quality.Model(__import__("numpy").zeros((len(quality.KINDS) << linear.BITS, 1), "f4"), 0.0, 1.0, 0.0)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.assess(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert got == {k: test_quality_langid.brute(t) for k, t in enumerate(texts)}
