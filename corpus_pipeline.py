"""The training-data pipeline: five operators in a row, each stage written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, changed
where its decision changes them; all but the last return the columns of documents. The last returns
(doc_id, source, epoch, finish, words, text, lang, n_chars): the mix in order of virtual finish
time, a document once for each epoch in which it is taken, cut to ``words`` words where the
budget ends inside it. The SQL of the rows can't be given (the classifier and the
MinHash stage aren't expressible), so tests hold the stages against brute-force versions.
Stages that use Python bound the session's Arrow batches by bytes (``small_batches``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, near_dedup, pii, quality
from tessera.llm.common import checkpoint_dir, small_batches, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return near_dedup.deduplicate(docs, far=True)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that are nothing else go."""
    small_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked."""
    small_batches(spark)
    return pii.mask(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("minhash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("mixing", mixed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
