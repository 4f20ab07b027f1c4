from itertools import product

import numpy as np

from terralens.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_marginals_match_enumeration():
    rng = np.random.RandomState(1)
    e, start, move = rng.randn(9), 0.3, rng.randn(2, 2)
    at = np.array([0, 4, 4, 5, 9])
    got, pairs = toxicity.marginals(e, at, start, move, pairs=True)
    want_pairs = np.zeros((2, 2))
    for a, b in zip(at[:-1], at[1:], strict=True):
        total, each, moves = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in product((0, 1), repeat=b - a):
            if not y:
                continue
            w = np.exp(y[0] * start + sum(v * x for v, x in zip(y, e[a:b], strict=True)) + sum(move[p, q] for p, q in zip(y, y[1:])))
            total += w
            each += w * np.array(y)
            for p, q in zip(y, y[1:]):
                moves[p, q] += w
        if b > a:
            assert np.allclose(got[a:b], each / total)
            want_pairs += moves / total
    assert np.allclose(pairs, want_pairs)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    right = (got.predicted == got.toxic)
    assert right.mean() > 0.94 and right[got.toxic == 0].mean() > 0.98 and right[got.toxic == 1].mean() > 0.9
    assert got.score.between(0, 1).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "é you moron", 5), (4, "word " * 30000, 5), (None, "x", 5)], "doc_id long, text string, label int")
    big = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(big, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert got[1].score == got[2].score < 0.5 and got[3].predicted == 1 and got[3].toxic_spans == "6:11" and got[4].predicted == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(big, none)).where("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_a_faint_word_in_a_long_clean_text_is_not_enough(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out and toxic = 0").toPandas()
    assert (got.predicted == 1).mean() < 0.005
