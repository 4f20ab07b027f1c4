import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from terralens.llm import langid, linear, quality

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    rep = {k + d for k in range(len(w) - 2) if tri[(w[k], w[k + 1], w[k + 2])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep)


EDGES = [(1, None), (2, ""), (3, "a\n\nb\n \n a\na\n"), (4, "é é é é #<|"), (5, "x " * 20000), (6, "123 456 \n"), (7, "ab ab ab ab"), (8, "日本語")]


def test_counts(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    rows = list(zip(*(c.to_pylist() for c in t.columns), strict=True))
    docs = spark.createDataFrame([(d + 10**6, x, 0) for d, x in rows] + [(*e, 0) for e in EDGES], "doc_id long, text string, quality int")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    got = {r.doc_id: r for r in quality.assess(docs, model).collect()}
    for d, x in [(d + 10**6, x) for d, x in rows] + EDGES:
        r, want = got[d], brute(x)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, d
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}
    assert quality.keep_good(docs.limit(0), model).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert all(r.kept != r.base_failed for r in quality.assess(docs, none).collect())


def test_quality_verdicts(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    seen = labels.where("crc32(cast(doc_id as string)) % 2 = 0")
    got = quality.assess(docs, quality.train(docs, seen)).join(labels.join(seen, "doc_id", "left_anti"), "doc_id").where("not base_failed").select("kept", labels.quality).collect()
    right = np.array([k == (q == 1) for k, q in got])
    assert right.mean() > 0.98


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    edge = {r.doc_id: r for r in langid.predict(spark.createDataFrame([(*e, "zz") for e in EDGES], "doc_id long, text string, lang string"), model).collect()}
    assert [edge[k].lang_pred for k in (1, 2, 6)] == ["und"] * 3 and edge[8].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in edge.values())
    empty = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    ids = spark.range(-50, 50).withColumnRenamed("id", "doc_id")
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in ids.select("doc_id", langid.held_out(ids.doc_id).alias("h")).collect())


def test_one_language_and_unknown_codes(spark):
    rows = [(k, f"{'alpha beta' if k % 2 else 'gamma delta'} {k}", "xx" if k % 2 else "yy") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(docs, langid.train(docs)).collect()
    assert np.mean([r.lang_pred == ("xx" if r.doc_id % 2 else "yy") for r in got]) > 0.9
    one = docs.where("lang = 'xx'")
    assert {r.lang_pred for r in langid.predict(docs, langid.train(one)).collect()} == {"xx"}


def test_calibration():
    z = np.concatenate([np.linspace(-3, 1, 50), np.linspace(-1, 3, 50)])
    y = np.repeat([0.0, 1.0], 50)
    a, c = linear.calibrate(z, y)
    assert a > 0 and abs(linear.sigmoid(a * 0 + c) - 0.5) < 0.1


def test_samples_are_bounded_and_tell_texts_of_one_id_apart(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d e"), (2, "f" * 5000), (3, None), (4, "g")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (4, None), (None, 1)], "doc_id long, quality int")
    ids, y, x = linear.labelled_sample(docs, labels, "quality", 100, ("w1",))
    assert ids.tolist() == [1, 1, 2, 3] and y.tolist() == [1, 1, 0, 1] and x.n == 4
    assert linear.labelled_sample(docs, labels, "quality", 100, ("w1",), bound_bytes=1000)[0].tolist() == [1, 1, 3]
    assert len(linear.labelled_sample(docs, labels, "quality", 2, ("w1",))[0]) == 2
    assert len(linear.labelled_sample(docs, labels.limit(0), "quality", 2, ("w1",))[0]) == 0


def test_character_grams_are_of_characters():
    texts = ["é日x", "", "ab"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw])
    bucket, first, end = next(linear.ngram_buckets(data, off, ("c2",)))
    assert [max(0, int(e - f)) for f, e in zip(first, end, strict=True)] == [2, 0, 1]
    lone, _, _ = next(linear.ngram_buckets(np.frombuffer("日x".encode(), np.uint8), np.array([0, 4]), ("c2",)))
    assert lone[0] == bucket[1]


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "the word is here", "en"), (1, "the word is here", "en"), (None, "the word", "en"), (2, "das Wort ist hier", "de"), (3, "das ist das", "de"), (6, "the cat is there", "en")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    got = sorted((str(r.doc_id), r.held_out, r.lang_pred) for r in langid.predict(docs, model).collect())
    assert len(got) == 6 and got.count(got[0]) == 2 and [x[1] for x in got if x[0] == "None"] == [False]
    assert langid.predict(docs.limit(0), model).count() == 0


def test_features_stay_off_the_driver(spark, monkeypatch):
    """What training collects is ids and sizes, and the model is that of the collected features."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    _, y, x = linear.labelled_sample(docs, labels, "quality", quality.SAMPLE, quality.KINDS)
    want = quality._fit(y, x)
    kind, seen = type(docs), []
    collect = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda df: seen.append(collect(df)) or seen[-1])
    got = quality.train(docs, labels)
    assert sum(t.nbytes for t in seen) < 20_000 < len(x.idx)
    assert (got.weights.tobytes(), got.bias, got.slope, got.shift) == (want["weights"], want["bias"], want["slope"], want["shift"])
    bad = quality.train(docs, labels.where("quality = 0"))
    assert (bad.slope, bad.shift, bad.weights.any()) == (1.0, -5.0, False)
