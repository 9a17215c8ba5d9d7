"""From raw documents to token ids in five stages, each written as Parquet and read again by the next.

Every stage works on all rows that the one before kept. The first three drop or edit documents, the fourth repeats or
drops them to reach the sources' target weights (near duplicates are sought on shingles of five words and a similarity of
0.8, as stages do unless told otherwise; the operator's own query takes two words), and the last gives one row for each row it gets: doc_id, n_tokens,
ids_sha256, decoded_sha256.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from narrata.llm import bpe, minhash, mixing, quality, secrets
from narrata.llm.common import bounded, clear_staged, stage, staged_so_far, table

TOKENIZER = "word_bpe_49k.json"


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return minhash.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", keep_good_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: SQL can express neither the classifier nor the tokenizer; the tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has staged on its way is deleted once its own result is written."""
    docs = table(spark, sf_dir, "documents")
    mark = staged_so_far()
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        clear_staged(spark, mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
