"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's docs.
All but the last return the columns of ``documents``; the last one the encoded documents.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from terralens.llm import bpe, decontam, minhash, pii, quality
from terralens.llm.queries import table
from terralens.llm.scratch import save_alone


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the model judges bad go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more in five-word shingles, the one of smallest id stays."""
    return minhash.keep_first(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover a twentieth or more go."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text decoded from them, and digests of both."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, with_ids=True, with_digests=True)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("personal_data", personal_data), ("bpe", encode)]

#: The quality model and the tokenizer aren't expressible in SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is kept until the next has read it; what a stage saved on its own way is deleted when its table is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = save_alone(spark, partial(stage, spark, docs, sf_dir), name) if k < len(STAGES) - 1 else stage(spark, docs, sf_dir)
    return docs
