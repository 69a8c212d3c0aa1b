"""The corpus pipeline: documents in, encoded clean documents out.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame, which run() writes as Parquet to
the workspace and reads again as the next stage's docs. All but the last return the columns of docs unchanged.

Defined results: documents without an id pass the language and toxicity stages like others; of near duplicates the row with
the smallest id stays; a group of rows without ids keeps one. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import bpe, decontaminate, language_id, shared, simhash, toxicity


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows from here on: this is an application, and its session's stages all hold whole texts.

    What earlier stages left in the driver goes back to the system.
    """
    shared.give_back_driver(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) not in range(1, 1_001):
        spark.conf.set(key, 1_000)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null and empty texts, texts without a letter and texts too far from every centroid; long texts are judged whole."""
    _small_batches(spark)
    model = language_id.train(docs, F.lit(True))
    shared.give_back_driver(spark)
    return language_id.keep_known(docs, model)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the factorization machine predicts to be toxic; null and empty texts have no terms and stay unless most labels are 1."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, "toxic", F.lit(True))
    shared.give_back_driver(spark)
    return toxicity.keep_civil(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles are alike by 0.8 keeps the document with the smallest id.

    Texts without words are copies of each other. Ties go to the text with the smaller hash, then to the row with the smaller one.
    """
    _small_batches(spark)
    return simhash.keep_similar_first(docs)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark, wherever in the text; null and empty texts hold none."""
    shared.give_back_driver(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left: doc_id, n_tokens, ids_sha256, decoded_sha256 and ids. Null and empty texts have no ids; repeated rows come out again."""
    _small_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"], with_ids=True, kept_words=60_000)


STAGES = [("language", keep_known_language), ("toxicity", keep_civil), ("near_dedup", keep_one_of_each), ("decontamination", keep_unseen), ("bpe", encode)]

#: The classifiers' decisions and the hash joins of the search are beyond SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
