import base64
import hashlib
import re

import pyarrow.parquet as pq
import public_tokenizers
import test_decontam
import test_minhash
import test_pii
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from terralens.llm import quality

SF = "/root/testdata/sf0.01"


def redacted(text):
    spans = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in test_pii.brute(text)[2].split(",") if x))
    out, at = [], 0
    for s, e, k in sorted(spans, key=lambda x: (x[0], list(test_pii.P).index(x[2]))):
        if s >= at:
            out.append(text[at:s] + f"[{k.upper()}]")
        at = max(at, e)
    return "".join(out) + text[at:]


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {r.doc_id for r in quality.assess(docs, model).where("kept").collect()}
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    rows = {d: x for d, x in zip(*(c.to_pylist() for c in t.columns), strict=True) if d in keep}
    group = test_minhash.brute(rows.items(), 80)
    rows = {d: x for d, x in rows.items() if group[d][1] == d}
    b = pq.read_table(f"{SF}/benchmark.parquet", columns=["item_id", "text"])
    bad = test_decontam.brute(rows.items(), list(zip(*(c.to_pylist() for c in b.columns), strict=True)))
    rows = {d: redacted(x) for d, x in rows.items() if not bad[d][4] and not re.search(r"[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}|\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", x)} | {
        d: None for d, x in rows.items() if not bad[d][4] and re.search(r"[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}|\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", x)}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(c) for a, c in map(bytes.split, open(path, "rb"))}, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(rows) and 0 < len(got) < docs.count()
    for d, x in rows.items():
        if x is not None:
            ids = lib.encode_ordinary(x)
            assert got[d] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()), d


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_rows_without_id_and_odd_columns(spark):
    """Every stage keeps clean rows that have no id, whatever other columns are called."""
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    docs = some.unionByName(some.where("length(text) > 2000").limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for name in ("a b.c", "row", "found", "bands", "component", "kept", "kept_id", "runs"):
        docs = docs.withColumn(name, F.lit(1))
    assert sorted(corpus_pipeline.quality_rules(spark, docs, SF).columns) == sorted(docs.columns)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(docs.columns) and out.where("doc_id is null").count() == 1, name


def test_encoded_rows_have_their_ids(spark):
    docs = spark.createDataFrame([(1, "Grün a  b\n"), (2, None), (None, "x")], "doc_id long, text string")
    rows = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, SF).collect()}
    for d, t in [(1, "Grün a  b\n"), (2, ""), (None, "x")]:
        r = rows[d]
        assert bytes(r.decoded).decode() == t and len(r.ids) == r.n_tokens and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()


def test_account_numbers_go(spark):
    rows = [(k, t.format(*n)) for k, (t, n) in enumerate(test_pii.IBANS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, docs, SF).collect()}
    assert got == {k: t.format(*["[IBAN]"] * len(n)) for k, (t, n) in enumerate(test_pii.IBANS)}
