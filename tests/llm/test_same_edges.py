"""Rows without an id, repeated rows, and columns that are called like results, through the operators that judge rows by themselves."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from terralens.llm import bpe, langid, pii, quality, secrets, toxicity

SF = "/root/testdata/sf0.01"
ROWS = [(1, "The first text of all, and a good one."), (1, "The first text of all, and a good one."), (1, "another text"), (None, "no id é"), (None, None), (2, ""), (2, "password = hunter22 a@b.co 中")]


@pytest.fixture(scope="module")
def operators(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    good, toxic, lang = quality.train(docs, labels), toxicity.train(docs, labels), langid.train(docs)
    return {"op4": lambda d: bpe.encode_documents(d, ranks, P.PATTERN, with_ids=False, with_digests=True), "op5": secrets.find_secrets, "op6": lambda d: quality.assess(d, good), "op7": lambda d: toxicity.score(d, toxic),
            "op8": lambda d: langid.predict(d, lang), "op10": pii.report}


def plain(r):
    """A row as text; sums over a batch of texts may differ in the last digits from those over one."""
    return repr([round(v, 9) if isinstance(v, float) else v for v in r])


@pytest.mark.parametrize("name", ["op4", "op5", "op6", "op7", "op8", "op10"])
def test_each_row_by_itself(spark, operators, name):
    op = operators[name]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = sorted(map(plain, op(docs).collect()))
    alone = sorted(plain(r) for d, t in ROWS for r in op(spark.createDataFrame([(d, t)], "doc_id long, text string")).collect())
    assert got == alone and len(got) == len(ROWS)
    clash = docs
    for c in op(docs).columns:
        if c not in ("doc_id", "text"):
            clash = clash.withColumn(c, F.lit("other"))
    clash = clash.withColumns({"label": F.lit(1), "lang": F.lit("xx"), "row": F.lit(0), "a b.c": F.lit(2)})
    assert sorted(map(plain, op(clash).collect())) == got
    assert op(docs.limit(0)).count() == 0 and op(docs.limit(0)).columns == op(docs).columns
